"""Counter-based random numbers: a function of (seed, id, step) alone, so a lost task or another engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52
SPAN = 1 << BITS


def draw(seed: int, *parts: Column | int | str) -> Column:
    """An integer in [0, 2^52): the first 13 hex digits of md5('seed:part:part...')."""
    columns = [p if isinstance(p, Column) else F.lit(p) if isinstance(p, int) else F.col(p) for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def below(n: Column | int, seed: int, *parts: Column | int | str) -> Column:
    """Uniform in [0, n); null where n is 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, draw(seed, *parts) % F.when(n > 0, n))


def integer(low: int, high: int, seed: int, *parts: Column | int | str) -> Column:
    """Uniform in [low, high], both included."""
    return F.lit(low) + draw(seed, *parts) % F.lit(high - low + 1)


def bernoulli(rate: float, seed: int, *parts: Column | int | str) -> Column:
    return draw(seed, *parts) < F.lit(int(rate * SPAN))
