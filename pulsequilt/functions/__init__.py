"""pulsequilt.functions"""
