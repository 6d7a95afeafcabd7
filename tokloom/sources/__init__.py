"""tokloom.sources"""
