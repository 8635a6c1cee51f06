"""tidelake.sources"""
