"""Keys and joins: checks of uniqueness and columns, validated joins, key differences, override lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data does not meet what an operator requires."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


BROADCAST_ROWS = 20_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most that many rows; else the engine chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; null is a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """df itself; raises with up to ten examples if a key repeats."""
    examples = duplicate_keys(df, keys).limit(10).collect()
    if examples:
        raise ContractError(f"{what}: repeated {list(keys)}: {[tuple(r)[:-1] for r in examples]}")
    return df


def once_each(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """df, which fails when it is run if a key repeats; null is a key. The check is a part of the plan, on the partitioning that a join by the keys needs anyway."""
    rest = [c for c in df.columns if c not in set(keys)]
    packed = df.select(*keys, F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(1).alias("_one")).alias("_row"))
    found = packed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("_row").alias("_row"))
    names = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    text = F.concat(F.lit(f"{what}: repeated {list(keys)}: "), names)
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(text))
    return found.select(*keys, row.alias("_row")).where(F.col("_row._one") == 1).select(*(F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "1:1", suffixes: tuple[str, str] = ("_a", "_b"), unique: Sequence[str] = ()) -> DataFrame:
    """An equi-join whose sides are unique as validate says (1:1 or m:1); clashing columns get suffixes.

    The join fails when it is run if a key repeats; nothing is run before. unique names sides (left, right) that are
    so by the way they were made, such as groups by the keys.
    """
    if validate.startswith("1") and "left" not in unique:
        left = once_each(left, keys, "left side")
    if "right" not in unique:
        right = once_each(right, keys, "right side")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, list(keys), how)


def outer_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "side") -> DataFrame:
    """Full outer join with a column that tells left_only, right_only or both."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, list(keys), "full_outer").withColumn(name, side).drop("_l", "_r")


def key_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, as missing or extra."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("difference", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("difference", F.lit("extra")))


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, target: str, corrected: str, status: str = "correction_status", carry: Sequence[str] = ()) -> DataFrame:
    """Replace target where an override for the key exists; keeps the value before and a status.

    Rows without an override have status ``original``; an override without a status has ``corrected``. It fails when it
    is run if a key has two overrides.
    """
    o = once_each(overrides, [key], "overrides").select(F.col(key).alias("_k"), F.col(corrected).alias("_new"), F.col(status).alias("_status"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    hit = F.col("_k").isNotNull()
    out = df.join(o, df[key] == F.col("_k"), "left")
    out = out.withColumn(f"{target}_before", F.col(target)).withColumn(target, F.when(hit, F.col("_new")).otherwise(F.col(target)))
    out = out.withColumn(f"{target}_status", F.when(hit, F.coalesce(F.nullif(F.col("_status"), F.lit("")), F.lit("corrected"))).otherwise("original"))
    for c in carry:
        out = out.withColumn(f"{target}_{c}", F.coalesce(f"_c_{c}", F.lit("")))
    return out.drop("_k", "_new", "_status", *(f"_c_{c}" for c in carry))


def label_map(c: Column, mapping: dict[str, str], otherwise: Column | None = None) -> Column:
    """The mapped value; others as they are (or as given)."""
    out = otherwise if otherwise is not None else c
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of todo that done does not hold yet: restarts cost only what is missing."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group by an explicit order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def merge_provenance(df: DataFrame, key: str, order: str, merge: Sequence[str], keep: Sequence[str], separator: str = ";") -> DataFrame:
    """One row for each key: the first row's ``keep`` columns; of ``merge`` columns all distinct values in order."""
    spot = lambda c: F.filter(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x.isNotNull())
    merged = [F.array_join(F.array_distinct(F.transform(F.array_sort(spot(c)), lambda x: x["v"])), separator).alias(c) for c in merge]
    return df.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in keep), *merged)
