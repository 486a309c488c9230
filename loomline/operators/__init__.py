"""Operators on large tables."""
