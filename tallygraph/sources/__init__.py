"""Sources of the pattern-counting engine."""
