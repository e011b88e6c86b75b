"""Long-form quality reports: every metric of a table in one wide aggregate, as (metric, value, note) text rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, metrics: dict[str, tuple[Column, str]]) -> DataFrame:
    """metrics: name -> (aggregate, note). Values become text, so counts, dates and flags share a column."""
    wide = df.agg(*(c.cast("string").alias(f"_{i}") for i, (c, _) in enumerate(metrics.values())))
    rows = [F.struct(F.lit(name).alias("metric"), F.col(f"_{i}").alias("value"), F.lit(note).alias("note")) for i, (name, (_, note)) in enumerate(metrics.items())]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicates_of(column: str) -> Column:
    """Rows beyond the first of each value, nulls equal, as an aggregate."""
    return F.count(F.lit(1)) - F.count_distinct(column) - F.max(F.when(F.col(column).isNull(), 1).otherwise(0))


def balanced(df: DataFrame, keys: Sequence[str]) -> Column:
    """Whether rows are as many as the product of the keys' distinct values."""
    out = F.lit(1)
    for k in keys:
        out = out * F.count_distinct(k)
    return F.count(F.lit(1)) == out


def one_row(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    return df.agg(*(c.alias(n) for n, c in metrics.items()))
