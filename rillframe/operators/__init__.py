"""Operators on ordered and unordered frames."""
