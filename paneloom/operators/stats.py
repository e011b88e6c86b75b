"""Summaries: descriptions, correlations, crosstabs, ranks, profiles, overlap groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.functions.numeric import correlation, count_if
from paneloom.operators.ranges import average_ranks, quantiles


def unpivot(df: DataFrame, rows: dict[str, dict[str, Column]], key: str = "variable") -> DataFrame:
    """One wide row to long: a row for each entry of rows, with the given columns."""
    packed = [F.struct(F.lit(k).alias(key), *(c.alias(n) for n, c in cols.items())) for k, cols in rows.items()]
    return df.select(F.explode(F.array(*packed)).alias("r")).select("r.*")


def describe(df: DataFrame, columns: Sequence[str], ddof: int = 0, digits: int = 6) -> DataFrame:
    """Count, missing, mean, deviation, quartiles, extremes and zeros of each column. Quartiles are exact and computed at once; the rest is one lazy aggregate."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    exact = quantiles(df, columns, list(quartiles.values()))
    aggs, rows = [], {}
    for c in columns:
        x = F.col(c).cast("double")
        parts = {"n": F.count(x), "missing": count_if(F.col(c).isNull()), "mean": F.avg(x), "std": std(x), "min": F.min(x)}
        parts |= {k: F.max(F.lit(exact[c][p]).cast("double")) for k, p in quartiles.items()} | {"max": F.max(x), "zeros": count_if(x == 0)}
        aggs += [v.alias(f"_{k}_{c}") for k, v in parts.items()]
        rows[c] = {k: F.col(f"_{k}_{c}") if k in ("n", "missing", "zeros") else F.round(F.col(f"_{k}_{c}"), digits) for k in parts}
    return unpivot(df.agg(*aggs), rows)


def pearson(df: DataFrame, columns: Sequence[str], pairs: str = "unordered", digits: int = 6) -> DataFrame:
    """Correlations of pairs of columns (unordered pairs, or the full matrix), all in one aggregate."""
    chosen = list(combinations(columns, 2)) if pairs == "unordered" else [(a, b) for a in columns for b in columns]
    wide = df.agg(*(correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(chosen)))
    packed = [F.struct(F.lit(a).alias("left_variable"), F.lit(b).alias("right_variable"), F.round(F.col(f"_{i}"), digits).alias("pearson")) for i, (a, b) in enumerate(chosen)]
    return wide.select(F.explode(F.array(*packed)).alias("r")).select("r.*")


def spearman(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Correlations of average ranks over the whole table."""
    return pearson(average_ranks(df, columns), columns, digits=digits).withColumnRenamed("pearson", "spearman")


def crosstab(df: DataFrame, a: str, b: str, domain_a: Sequence, domain_b: Sequence) -> DataFrame:
    """Counts of every pair of the domains, zero cells included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in domain_a for y in domain_b], f"{a} {df.schema[a].dataType.simpleString()}, {b} {df.schema[b].dataType.simpleString()}")
    return F.broadcast(grid).join(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("records")), [a, b], "left").na.fill(0, ["records"])


def pivot_counts(df: DataFrame, row: str, column: str, domain: Sequence) -> DataFrame:
    """Counts by row and column over a fixed domain of columns."""
    return df.groupBy(row).pivot(column, list(domain)).count().na.fill(0)


def pivot_values(df: DataFrame, row: str, column: str, value: Column, domain: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(domain)).agg(value)


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null, missing and distinct values of each column. ``top_values`` gives examples."""
    aggs = [f for c in columns for f in (F.count(c).alias(f"_n_{c}"), count_if(F.col(c).isNull()).alias(f"_m_{c}"), F.count_distinct(c).alias(f"_u_{c}"))]
    return unpivot(df.agg(*aggs), {c: {"non_null": F.col(f"_n_{c}"), "missing": F.col(f"_m_{c}"), "n_unique": F.col(f"_u_{c}")} for c in columns}, "column")


def top_examples(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent values (ties: by value)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), F.col(column).asc_nulls_last()).limit(n)


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(column, value, records): the n most frequent values of each column as text (ties: by value); nulls are no value."""
    parts = [top_examples(df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value")), "value", n).select(F.lit(c).alias("column"), "value", "records") for c in columns]
    return reduce(DataFrame.unionByName, parts)


def dense_ranked(df: DataFrame, value: str, name: str = "rank", partition: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(F.col(value).desc_nulls_last())))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", partition: Sequence[str] = ()) -> DataFrame:
    """Position from 1 in a full order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def overlap_groups(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Counts for any, none, all, each, each alone, and each pair of flags; one pass."""
    every = reduce(lambda a, b: a & b, flags.values())
    some = reduce(lambda a, b: a | b, flags.values())
    groups = {"any": some, "none": ~some, "all": every}
    groups |= dict(flags)
    for k in flags:
        rest = [v for n, v in flags.items() if n != k]
        groups[f"{k}_only"] = flags[k] & ~reduce(lambda a, b: a | b, rest)
    groups |= {f"{a}_and_{b}": flags[a] & flags[b] for a, b in combinations(flags, 2)}
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *(count_if(c).alias(f"_{k}") for k, c in groups.items()))
    return unpivot(wide, {k: {"records": F.col(f"_{k}"), "share": F.coalesce(F.col(f"_{k}") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0))} for k in groups}, "group")


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first of each value; nulls are equal."""
    return df.groupBy(column).agg((F.count(F.lit(1)) - 1).alias("d")).agg(F.lit(column).alias("column"), F.coalesce(F.sum("d"), F.lit(0)).alias("duplicates"))


def text_profile(df: DataFrame, column: str, long_from: int = 100) -> DataFrame:
    n = F.length(F.coalesce(F.col(column), F.lit("")))
    return df.agg(F.round(F.avg(n), 6).alias("mean_length"), F.max(n).cast("bigint").alias("max_length"), F.round(F.avg(F.when(n > long_from, 1.0).otherwise(0.0)), 6).alias("long_share"))
