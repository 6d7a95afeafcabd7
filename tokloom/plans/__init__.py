"""Named queries assembled from the operators, with their oracle SQL."""
