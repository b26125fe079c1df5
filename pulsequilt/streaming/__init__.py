"""pulsequilt.streaming"""
