"""Operators that prepare training text: each one is a module, its query is in ``queries``."""
