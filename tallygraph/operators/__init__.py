"""Operators of the pattern-counting engine."""
