"""Registered queries: the operators on pages rendered from the given tables."""
