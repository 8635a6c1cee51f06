"""tidelake.plans"""
