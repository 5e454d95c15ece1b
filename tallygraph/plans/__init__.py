"""Plans of the pattern-counting engine."""
