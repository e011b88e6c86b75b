"""Deterministic sampling and splits: hash order in place of random numbers, so every run and engine agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.numeric import round_even
from paneloom.operators.ranges import numbered
from paneloom.session import Scratch


def hash_order(key: str, seed: int = 42) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256), 1, 32)


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int = 42, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """split of each row: in hash order within the stratum, 70/15/15 rounded to even; of three or more rows one is for testing. Strata may be of any size."""
    n = F.col("_n")
    out = numbered(df.withColumn("_h", hash_order(key, seed)), [stratum], ["_h", key]).drop("_h")
    out = out.withColumn("_t", round_even(n * F.lit(train))).withColumn("_v", F.least(round_even(n * F.lit(validation)), F.greatest(n - F.col("_t"), F.lit(0))))
    # no row left for testing: validation gives one up if it has more than one, else training
    none = (n >= 3) & (F.col("_t") + F.col("_v") == n)
    out = out.withColumn("_t2", F.when(none & (F.col("_v") <= 1) & (F.col("_t") > 1), F.col("_t") - 1).otherwise(F.col("_t")))
    out = out.withColumn("_v2", F.when(none & (F.col("_v") > 1), F.col("_v") - 1).otherwise(F.col("_v")))
    split = F.when(F.col("_i") <= F.col("_t2"), "train").when(F.col("_i") <= F.col("_t2") + F.col("_v2"), "validation").otherwise("test")
    return out.withColumn("split", split).drop("_n", "_i", "_t", "_v", "_v2", "_t2")


def pool_flags(df: DataFrame, tools: dict[str, int], other: str) -> DataFrame:
    """Pool membership from hit counts: a specific hit, or enough broad ones (the number for each tool)."""
    out = df.withColumns({f"pool_{t}": (F.col(f"{t}_specific") > 0) | (F.col(f"{t}_broad") >= least) for t, least in tools.items()})
    every = None
    for t in tools:
        every = (F.col(f"{t}_specific") > 0) if every is None else every & (F.col(f"{t}_specific") > 0)
    out = out.withColumn(f"pool_{other}", F.col(f"{other}_signal") > 0).withColumn("all_specific", every)
    return out.withColumn(f"pool_{other}_priority", F.col(f"pool_{other}") & ~F.col("all_specific"))


def pool_sample(df: DataFrame, key: str, pools: Sequence[tuple[str, str, str | None]], each: int, seed: int = 42) -> DataFrame:
    """Draw from pools one after the other without drawing a row twice; rows with priority first, then by hash.

    pools: (name, membership column, priority column or None). Each pool takes up to ``each`` rows that no pool
    before it took. The order by hash makes the draw the same on any number of executors. df is read once: memberships
    and hashes are written, and the first k * each of the k-th pool, which are enough as those before it took fewer,
    are drawn from on the driver: each * pools * (pools + 1) / 2 rows at most.
    """
    spark = df.sparkSession
    columns = [c for _, member, priority in pools for c in (member, priority) if c]
    flags = Scratch(spark, "pools").keep(df.select(key, hash_order(key, seed).alias("_h"), *dict.fromkeys(columns)).where(F.coalesce(*(F.when(F.col(m), True) for _, m, _ in pools), F.lit(False))), "flags")
    taken: dict = {}
    for k, (name, member, priority) in enumerate(pools, 1):
        first = F.when(F.col(priority), 0).otherwise(1) if priority else F.lit(0)
        near = flags.where(F.col(member)).select(key, first.alias("_p"), "_h").orderBy("_p", "_h", key).limit(k * each).orderBy("_p", "_h", key).collect()
        free = [r[key] for r in near if r[key] not in taken]
        taken |= dict.fromkeys(free[:each], name)
    schema = T.StructType([df.schema[key], T.StructField("sample_pool", T.StringType())])
    return spark.createDataFrame(list(taken.items()), schema)


def boundary_samples(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """Rows for a second look: for each rule (condition, order, n) its first n rows, tagged with the rule."""
    parts = None
    for name, (cond, order, n) in rules.items():
        part = df.where(cond).orderBy(order, F.col(key)).limit(n).select(key, F.lit(name).alias("reason"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
