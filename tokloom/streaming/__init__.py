"""tokloom.streaming"""
