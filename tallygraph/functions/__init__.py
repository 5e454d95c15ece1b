"""Functions of the pattern-counting engine."""
