"""Numeric expressions with the guards that pandas code has: zero denominators, nulls, constants, banker's rounding."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ratio(n, d, otherwise: float | None = 0.0) -> Column:
    """n / d, or otherwise where d is zero or either is null."""
    q = _col(n).cast("double") / F.nullif(_col(d).cast("double"), F.lit(0.0))
    return q if otherwise is None else F.coalesce(q, F.lit(otherwise))


def to_int(c) -> Column:
    """A whole number from text such as 2 or 2.0; null if there is none."""
    return _col(c).cast("string").try_cast("double").try_cast("bigint")


def to_date(c) -> Column:
    return _col(c).cast("string").try_cast("date")


def in_window(c, first: str, last: str) -> Column:
    """Between both days, ends included; null is false."""
    return F.coalesce(_col(c).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def clamp01(c) -> Column:
    """Within 0 and 1; null and text that is no number count as 0, NaN as 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_col(c).cast("string").try_cast("double"), F.lit(0.0))))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def round_even(c) -> Column:
    """To a whole number, halves to the even one."""
    return F.bround(_col(c).cast("double")).cast("bigint")


def sum0(c) -> Column:
    """Sum that is 0 where nothing is there."""
    return F.coalesce(F.sum(c), F.lit(0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def share_if(cond: Column) -> Column:
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def correlation(x, y) -> Column:
    """Pearson's r as an aggregate; null where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def average_rank(c, *partition: str) -> Column:
    """Rank from 1; equal values share the mean of their ranks."""
    order = Window.partitionBy(*partition).orderBy(_col(c).asc_nulls_last())
    ties = Window.partitionBy(*partition, _col(c))
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def tertile(rank, n) -> Column:
    """1, 2 or 3 by first-come rank (from 1) of n, with cuts at a third and two thirds of the way."""
    at = 3 * (_col(rank) - 1)
    return F.when(at < _col(n) - 1, 1).when(at < 2 * (_col(n) - 1), 2).otherwise(3)


def band(c, edges: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first edge that the value reaches; edges fall."""
    out = None
    for least, name in edges:
        out = F.when(_col(c) >= least, name) if out is None else out.when(_col(c) >= least, name)
    return out.otherwise(otherwise)


def cosine(dot, norm_a, norm_b) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(_col(dot) / F.nullif(_col(norm_a) * _col(norm_b), F.lit(0.0)), F.lit(0.0))


def unit_or_zero(x, mean, std) -> Column:
    """z-score; 0 where the deviation is 0."""
    return F.when(_col(std) == 0, 0.0).otherwise((_col(x) - _col(mean)) / F.nullif(_col(std), F.lit(0.0)))
