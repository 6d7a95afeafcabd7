"""tokloom.operators"""
