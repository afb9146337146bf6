"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATING_RANGE = (0.5, 5.0)


def clip(x: Column, low: float = RATING_RANGE[0], high: float = RATING_RANGE[1]) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def clamp_index(x: Column, n: int) -> Column:
    """An index forced into 0..n-1: unseen ids take the last one."""
    return F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))


def or_zero(x: Column) -> Column:
    """Null and NaN count as 0."""
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; 0 if one is missing."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(product, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def dcg_gain(position: Column) -> Column:
    """Gain of a hit at a 1-based position."""
    return 1.0 / F.log2(position + 1)


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """Discounted gain if the first min(n_relevant, k) positions are hits."""
    seq = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n_relevant.cast("int"), F.lit(k))))
    return F.when(n_relevant > 0, F.aggregate(seq, F.lit(0.0), lambda s, m: s + 1.0 / F.log2(m + 1))).otherwise(F.lit(0.0))
