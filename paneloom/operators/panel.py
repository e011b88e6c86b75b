"""Balanced unit-by-period panels: skeleton, zero fill, shares, intensities and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions.numeric import clamp01, ratio, tertile, unit_or_zero
from paneloom.operators.keys import BROADCAST_ROWS, join_checked, require_columns, small_side
from paneloom.operators.ranges import quantiles


def skeleton(units: DataFrame, periods: DataFrame | Sequence, period: str = "period") -> DataFrame:
    """Every unit with every period; both sides are made distinct first, and periods are broadcast if they are few."""
    if not isinstance(periods, DataFrame):
        listed = units.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(periods)], [period])
        return units.distinct().crossJoin(F.broadcast(listed) if len(periods) <= BROADCAST_ROWS else listed)
    return units.distinct().crossJoin(small_side(periods.distinct()))


def balance(frame: DataFrame, facts: DataFrame, keys: Sequence[str], zero: Sequence[str], logs: dict[str, str] | None = None) -> DataFrame:
    """Facts on every cell of the frame: missing cells get 0 in the zero columns; logs name ln(1+x) columns."""
    out = frame.join(facts, list(keys), "left").na.fill(0, list(zero))
    for name, source in (logs or {}).items():
        out = out.withColumn(name, F.round(F.log1p(F.col(source).cast("double")), 6))
    return out


def shares(df: DataFrame, parts: Sequence[str], total: Column | None = None, suffix: str = "_share") -> DataFrame:
    """Each part over the sum of the parts (or total); 0 where that is 0."""
    whole = total if total is not None else reduce(lambda a, b: a + b, (F.coalesce(F.col(p), F.lit(0)) for p in parts))
    return df.withColumns({p + suffix: ratio(F.col(p), whole) for p in parts})


def hard_labels(df: DataFrame, tools: Sequence[str], other: str, at: float = 0.5, other_at: float = 0.6, tool_below: float = 0.4) -> DataFrame:
    """0/1 labels from probabilities p_*: a tool from ``at`` on; other only if it is likely and no tool is."""
    best = F.array_max(F.array(*(F.col(f"p_{t}") for t in tools)))
    out = df.withColumns({f"{t}_label": (F.col(f"p_{t}") >= at).cast("int") for t in tools})
    out = out.withColumn("max_tool_prob", best).withColumn(f"{other}_label", ((F.col(f"p_{other}") >= other_at) & (best < tool_below)).cast("int"))
    some = reduce(lambda a, b: a | b, (F.col(f"{t}_label") == 1 for t in tools))
    return out.withColumn("valid_tool", ((F.col(f"{other}_label") == 0) & some).cast("int"))


def confident(df: DataFrame, tools: Sequence[str], other: str, at: float = 0.75) -> DataFrame:
    """high_* flags: tools from ``at`` on; other by its hard label or by being likely with no likely tool."""
    out = df.withColumns({f"high_{t}": F.col(f"p_{t}") >= at for t in tools})
    return out.withColumn(f"high_{other}", (F.col(f"{other}_label") == 1) | ((F.col(f"p_{other}") >= 0.6) & (F.col("max_tool_prob") < 0.4)))


def intensity(rows: DataFrame, frame: DataFrame, keys: Sequence[str], tools: Sequence[str], other: str, at: float = 0.75, digits: int = 6) -> DataFrame:
    """Probabilities summed to panel cells: raw, filtered to valid rows, hard and confident counts, and shares. frame has each cell once, as ``skeleton`` makes it."""
    every = [*tools, other]
    aggs = [F.count(F.lit(1)).alias("records"), F.sum("valid_tool").cast("bigint").alias("valid_count"), F.sum(f"{other}_label").cast("bigint").alias(f"{other}_count")]
    for t in every:
        p = F.col(f"p_{t}")
        aggs += [F.round(F.sum(p), digits).alias(f"sum_p_{t}"), F.round(F.avg(p), digits).alias(f"avg_p_{t}"), F.round(F.sum(p * F.col("valid_tool")), digits).alias(f"filtered_sum_p_{t}")]
    for t in tools:
        aggs += [F.sum(f"{t}_label").cast("bigint").alias(f"{t}_count"), F.sum((F.col(f"p_{t}") >= at).cast("int")).cast("bigint").alias(f"high_{t}_count")]
    cells = rows.groupBy(*keys).agg(*aggs)
    out = join_checked(frame, cells, keys, unique=("left", "right")).na.fill(0)
    for prefix, name in (("sum_p_", ""), ("filtered_sum_p_", "filtered_")):
        whole = reduce(lambda a, b: a + b, (F.col(prefix + t) for t in tools))
        out = out.withColumns({f"{name}{t}_share": F.round(ratio(F.col(prefix + t), whole), digits) for t in tools})
    return out.withColumn("valid_share", F.round(ratio("valid_count", "records"), digits))


def zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_z", digits: int = 6) -> DataFrame:
    """Global z-scores with the population deviation; 0 for a constant column. One aggregate, one tiny cross join."""
    stats = df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*df.columns, *(F.round(unit_or_zero(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")), digits).alias(c + suffix) for c in columns))


def robust_z(df: DataFrame, columns: Sequence[str], suffix: str = "_rz", digits: int = 6) -> DataFrame:
    """0.6745 (x - median) / MAD; with MAD 0 the plain z-score; with that deviation 0 too, 0. Medians are exact and computed at once."""
    half = {c: q[0.5] for c, q in quantiles(df, columns, [0.5]).items()}
    away = df.select(*(F.abs(F.col(c) - F.lit(half[c]).cast("double")).alias(c) for c in columns))
    mad = {c: q[0.5] for c, q in quantiles(away, columns, [0.5]).items()}
    out = df.crossJoin(F.broadcast(df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))))  # one row

    def score(c: str) -> Column:
        if mad[c]:
            return F.round(0.6745 * (F.col(c) - F.lit(half[c])) / F.lit(mad[c]), digits).alias(c + suffix)
        plain = unit_or_zero(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        return F.round(plain if mad[c] == 0 else F.lit(None).cast("double"), digits).alias(c + suffix)

    return out.select(*df.columns, *map(score, columns))


def outliers(df: DataFrame, columns: Sequence[str], suffix: str = "_rz", limit: float = 3.0) -> DataFrame:
    """Rows where any score reaches the limit, with the greatest."""
    top = F.greatest(*(F.abs(F.col(c + suffix)) for c in columns)) if len(columns) > 1 else F.abs(F.col(columns[0] + suffix))
    return df.withColumn("max_abs_z", top).where(F.col("max_abs_z") >= limit)


def tertiles(df: DataFrame, value: str, tiebreak: Sequence[str], name: str = "tertile") -> DataFrame:
    """1 to 3 by rank of the value, ties by the tiebreak columns. For small tables: the ranking is global."""
    order = Window.orderBy(F.col(value).asc_nulls_last(), *tiebreak)
    everything = Window.partitionBy()
    return df.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(everything)).withColumn(name, tertile("_r", "_n")).drop("_r", "_n")


def panel_id(*parts: str, separator: str = "_") -> Column:
    return F.concat_ws(separator, *(F.col(p).cast("string") for p in parts))


def clamp_probabilities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clamp01(c) for c in columns})


def fill_groups(df: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), value: float = 0) -> DataFrame:
    """Nulls to a value in all columns whose names begin or end so."""
    chosen = [c for c in df.columns if c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes))] if prefixes or suffixes else []
    return df.na.fill(value, chosen) if chosen else df


def without_nulls(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Rows without a null in any of the columns, or (how: all) without nulls in all of them; all columns by default."""
    return df.na.drop(how=how, subset=list(columns) if columns is not None else None)


def without_empty_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """df without those of the columns that hold nothing but nulls; one aggregate says which."""
    chosen = list(columns) if columns is not None else df.columns
    filled = df.agg(*(F.max(F.col(f"`{c}`").isNotNull()).alias(f"_{i}") for i, c in enumerate(chosen))).first()
    return df.drop(*(c for i, c in enumerate(chosen) if not filled[f"_{i}"]))


def variable_map(spark: SparkSession, variables: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(position, variable, role, source, note) of a final panel's columns, in their order."""
    rows = [(i, name, role, source, note) for i, (name, (role, source, note)) in enumerate(variables.items(), 1)]
    return spark.createDataFrame(rows, "position int, variable string, role string, source string, note string")


def check_variables(df: DataFrame, mapped: DataFrame) -> DataFrame:
    """df with the mapped columns only, in the map's order; raises if one is missing."""
    names = [r["variable"] for r in mapped.orderBy("position").collect()]  # a row for each column
    return require_columns(df, names).select(*names)
