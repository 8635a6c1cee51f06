"""tidelake.operators"""
