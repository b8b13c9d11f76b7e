"""Column formulas: guarded ratios, decibels, scaling, masks.

Missing pixels are NULL everywhere; every formula gives NULL where an input is
NULL or a denominator is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: float) -> Column:
    return F.lit(float(x))


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def nd(a, b) -> Column:
    """Normalised difference (a - b) / (a + b)."""
    return ratio(col(a) - col(b), col(a) + col(b))


def db_to_linear(x) -> Column:
    return F.pow(number(10), col(x) / 10.0)


def linear_to_db(x, floor: float = 1e-12) -> Column:
    return F.log10(F.greatest(col(x), number(floor))) * 10.0


def unit_scale(x, low: float, high: float) -> Column:
    """(x - low) / (high - low), not clamped."""
    return (col(x) - low) / (high - low)


def clip(x, low: float, high: float) -> Column:
    """Clamped between the bounds; NULL stays NULL."""
    x = col(x)
    return F.when(x < low, number(low)).when(x > high, number(high)).otherwise(x.cast("double"))


def clamp01(x) -> Column:
    return clip(x, 0.0, 1.0)


def all_valid(*xs) -> Column:
    return reduce(lambda a, b: a & b, [col(x).isNotNull() for x in xs])


def any_valid(*xs) -> Column:
    return reduce(lambda a, b: a | b, [col(x).isNotNull() for x in xs])


def flag(condition: Column, valid: Column | None = None) -> Column:
    """1.0 where the condition holds, else 0.0; NULL outside ``valid`` if given."""
    out = F.when(F.coalesce(condition, F.lit(False)), number(1)).otherwise(number(0))
    return out if valid is None else F.when(valid, out)


def bits_clear(qa, *bits: int) -> Column:
    """All the given bits of an integer column are 0."""
    return col(qa).bitwiseAND(F.lit(sum(1 << b for b in bits)).cast("long")) == 0


def weighted(terms: dict[str, float]) -> Column:
    """Sum of weight times column; NULL if any is NULL."""
    return reduce(lambda a, b: a + b, [col(n) * w for n, w in terms.items()])


def first_greatest(scores: dict[str, Column]) -> Column:
    """Name of the largest score, the first on ties; NULL if any score is NULL."""
    top = F.greatest(*scores.values())
    known = all_valid(*scores.values())
    chain = None
    for name, score in scores.items():
        chain = F.when(score == top, name) if chain is None else chain.when(score == top, name)
    return F.when(known, chain)


def rounded(x, digits: int = 6) -> Column:
    """Rounded to ``digits``; negative zero becomes zero."""
    return F.round(col(x), digits) + number(0)
