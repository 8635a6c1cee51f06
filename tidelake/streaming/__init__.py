"""tidelake.streaming"""
