"""pulsequilt.sources"""
