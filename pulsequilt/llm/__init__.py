"""pulsequilt.llm"""
