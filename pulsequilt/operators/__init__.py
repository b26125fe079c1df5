"""pulsequilt.operators"""
