"""Row numbers, ranks and quantiles over whole tables by range sorts: no partition of a window grows with the table.

Rows are range-sorted over the cluster and written once; counts of the ranges, a row for each range and group, say where
each range begins. What is left is a window within a range. Tables of at most ``SMALL_ROWS`` rows take the plain window
or aggregate, which gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.session import Scratch

SMALL_ROWS = 100_000
RANGE_ROWS = 500_000


def _parts(df: DataFrame, rows: int, parts: int | None) -> int:
    return parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1)


def _ranged(df: DataFrame, order: Sequence[str], parts: int, scratch: Scratch) -> DataFrame:
    return scratch.keep(df.repartitionByRange(parts, *order).withColumn("_rng", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], index: str = "_i", size: str = "_n", small_rows: int = SMALL_ROWS, parts: int | None = None) -> DataFrame:
    """df with each row's number from 1 in its group's order, and the group's size. Groups may be of any size; order must be a full order."""
    scratch = Scratch(df.sparkSession, "numbered")
    kept = scratch.keep(df, "rows")
    rows = kept.count()
    if rows <= small_rows:
        w = Window.partitionBy(*groups)
        return kept.withColumn(size, F.count(F.lit(1)).over(w)).withColumn(index, F.row_number().over(w.orderBy(*order)))
    ranges = _ranged(kept, [*groups, *order], _parts(df, rows, parts), scratch)
    sums = ranges.groupBy(*groups, "_rng").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*groups)
    before = sums.withColumn("_base", F.sum("_k").over(w.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1))).withColumn(size, F.sum("_k").over(w))
    starts = scratch.keep(before.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_rng").alias("_r"), F.coalesce("_base", F.lit(0)).alias("_base"), size), "starts")
    inside = ranges.withColumn("_own", F.row_number().over(Window.partitionBy(*groups, "_rng").orderBy(*order)))
    same = F.col("_rng") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return inside.join(starts, same).withColumn(index, F.col("_base") + F.col("_own")).select(*df.columns, size, index)


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], small_rows: int = SMALL_ROWS, parts: int | None = None) -> dict[str, dict[float, float | None]]:
    """Exact quantiles (linear between neighbours) of several columns.

    Equal values are counted first. Values are range-sorted by column; only the values at the wanted ranks, a row for
    each, and the counts of the ranges reach the driver.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "quantiles")
    kept = scratch.keep(df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))), "values")
    rows = kept.count()
    if rows <= small_rows:
        found = kept.agg(*(F.percentile(f"x{i}", F.lit(p)).alias(f"q{i}_{k}") for i in range(len(columns)) for k, p in enumerate(probabilities))).first()
        return {c: {p: found[f"q{i}_{k}"] for k, p in enumerate(probabilities)} for i, c in enumerate(columns)}
    long = kept.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("x")) for i in range(len(columns))))).alias("v")).select("v.*").where("x is not null")
    ranges = _ranged(long.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")), ["c", "x"], _parts(df, rows, parts), scratch)
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in ranges.groupBy("c", "_rng").agg(F.sum("n").alias("n")).orderBy("c", "_rng").collect():
        sizes.setdefault(r["c"], []).append((r["_rng"], r["n"]))
    places, heights = [], {}
    for c, spans in sizes.items():
        total = sum(n for _, n in spans)
        heights[c] = {p: (total - 1) * p for p in probabilities}
        ranks = {k for h in heights[c].values() for k in (int(h), min(int(h) + 1, total - 1))}
        before = 0
        for rng, n in spans:
            places += [(c, rng, k - before, k) for k in ranks if before <= k < before + n]
            before += n
    if not places:
        return {c: dict.fromkeys(probabilities) for c in columns}
    wanted = F.broadcast(spark.createDataFrame(places, "c int, _rng int, place bigint, rank bigint"))  # two rows for each quantile
    some = ranges.join(wanted.select("c", "_rng").distinct(), ["c", "_rng"], "left_semi")
    upto = some.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "_rng").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = {(r["c"], r["rank"]): r["x"] for r in upto.join(wanted, ["c", "_rng"]).where("place < upto and place >= upto - n").collect()}

    def at(c: int, h: float) -> float:
        low, high = hit[c, int(h)], hit.get((c, int(h) + 1))
        return low if high is None else low + (high - low) * (h - int(h))

    return {name: {p: at(i, heights[i][p]) if i in heights else None for p in probabilities} for i, name in enumerate(columns)}


def average_ranks(df: DataFrame, columns: Sequence[str], small_rows: int = SMALL_ROWS, parts: int | None = None) -> DataFrame:
    """The columns as ranks from 1, equal values sharing the mean of theirs; nulls rank last."""
    from paneloom.functions.numeric import average_rank

    scratch = Scratch(df.sparkSession, "ranks")
    kept = scratch.keep(df.select(*columns), "values")
    rows = kept.count()
    if rows <= small_rows:
        return kept.select(*(average_rank(c).alias(c) for c in columns))
    out = kept
    for i, c in enumerate(columns):
        counts = kept.groupBy(F.col(c).alias("x")).agg(F.count(F.lit(1)).alias("n")).withColumn("late", F.col("x").isNull().cast("int"))
        ranges = _ranged(counts, ["late", "x"], _parts(df, rows, parts), scratch)
        sums = ranges.groupBy("_rng").agg(F.sum("n").alias("k"))
        base = sums.select("_rng", F.coalesce(F.sum("k").over(Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each range
        before = F.sum("n").over(Window.partitionBy("_rng").orderBy("late", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        ranks = ranges.withColumn("before", before).join(base, "_rng").select(F.col("x").alias(f"_x{i}"), (F.col("base") + F.col("before") + (F.col("n") + 1) / 2.0).alias(f"_r{i}"))
        out = out.join(scratch.keep(ranks, "ranks"), F.col(c).eqNullSafe(F.col(f"_x{i}")))
    return out.select(*(F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)))
