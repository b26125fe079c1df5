"""pulsequilt.plans"""
