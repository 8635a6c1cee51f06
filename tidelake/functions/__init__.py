"""tidelake.functions"""
