"""Streaming of the pattern-counting engine."""
