"""tokloom.functions"""
