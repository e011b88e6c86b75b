"""Dictionary text mining: row features, panel features, term coverage, flags and comparisons of measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.numeric import band, count_if, ratio
from paneloom.functions.text import count_terms, literal_count, matched_terms
from paneloom.operators.keys import small_side

COVERAGE_BANDS = [(0.80, "saturated"), (0.50, "high"), (0.25, "medium"), (0.05, "low")]


def row_features(df: DataFrame, text: str, categories: dict[str, list[str]]) -> DataFrame:
    """For each category: hits, a flag and the matched terms; and whether any hits. One projection over the text."""
    cols = {}
    for name, terms in categories.items():
        cols[f"{name}_hits"] = count_terms(F.coalesce(F.col(text), F.lit("")), terms)
        cols[f"{name}_terms"] = F.array_join(matched_terms(F.coalesce(F.col(text), F.lit("")), terms), ";")
    out = df.withColumns(cols)
    total = sum((F.col(f"{n}_hits") for n in categories), F.lit(0))
    return out.withColumns({f"has_{n}": F.col(f"{n}_hits") > 0 for n in categories}).withColumns({"total_hits": total.cast("bigint"), "any_hit": total > 0})


def panel_features(rows: DataFrame, keys: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Row features summed to cells: documents, hits and hit documents for each category."""
    aggs = [F.count(F.lit(1)).alias("documents")]
    for n in categories:
        aggs += [F.sum(f"{n}_hits").cast("bigint").alias(f"{n}_hits"), count_if(F.col(f"has_{n}")).alias(f"{n}_documents")]
    return rows.groupBy(*keys).agg(*aggs)


def term_coverage(df: DataFrame, text: str, categories: dict[str, list[str]]) -> DataFrame:
    """For each term: documents that hold it, all hits, share of documents, band. One pass, one wide aggregate."""
    body = F.coalesce(F.col(text), F.lit(""))
    pairs = [(c, t) for c, terms in categories.items() for t in terms]
    counted = df.select(*(literal_count(body, t).alias(f"_{i}") for i, (_, t) in enumerate(pairs)))
    wide = counted.agg(F.count(F.lit(1)).alias("_n"), *(f for i in range(len(pairs)) for f in (count_if(F.col(f"_{i}") > 0).alias(f"r{i}"), F.coalesce(F.sum(f"_{i}"), F.lit(0)).cast("bigint").alias(f"h{i}"))))
    packed = [F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), F.col(f"r{i}").alias("records_hit"), F.col(f"h{i}").alias("total_hits"), F.col("_n").alias("n")) for i, (c, t) in enumerate(pairs)]
    out = wide.select(F.explode(F.array(*packed)).alias("x")).select("x.*")
    return out.withColumn("record_hit_share", ratio("records_hit", "n")).drop("n")


def with_band(coverage: DataFrame) -> DataFrame:
    return coverage.withColumn("coverage_band", band("record_hit_share", COVERAGE_BANDS, "rare"))


def review_flags(coverage: DataFrame, short: int = 2, broad: Sequence[str] = (), high: float = 0.8, low: float = 0.05) -> DataFrame:
    """Reasons to look at a term again, joined by semicolons in a fixed order."""
    share = F.col("record_hit_share")
    usage = F.when(F.col("records_hit") == 0, "zero_coverage").when(share < low, "low_coverage")
    return coverage.withColumn(
        "review_flags",
        F.concat_ws(";", usage, F.when(share >= high, "high_coverage"), F.when(F.length("term") <= short, "short_term"), F.when(F.col("term").isin(*broad), "broad_term") if broad else F.lit(None).cast("string")),
    )


def term_role(coverage: DataFrame, broad: Sequence[str], saturated: float = 0.8, high: float = 0.5, useful: float = 0.05) -> DataFrame:
    """How a term may be used: background, discriminating, rare or unused."""
    share, is_broad = F.col("record_hit_share"), F.col("term").isin(*broad)
    role = F.when((share >= saturated) | ((share >= high) & is_broad), "background").when(share >= useful, "discriminating").when(F.col("records_hit") > 0, "rare").otherwise("unused")
    return coverage.withColumn("role", role)


def hits_by_join(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, term) wherever the text contains the term: for term tables too long for one projection. Terms are broadcast if they are few."""
    return df.join(small_side(terms), F.contains(F.col(text), F.col(term))).select(key, *terms.columns)


def two_surfaces(df: DataFrame, first: Column, second: Column, categories: dict[str, list[str]], prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Row features of two texts of the same rows side by side, a_* and b_*: one scan, no join."""
    out = df
    for text, prefix in zip((first, second), prefixes, strict=True):
        cols = {f"{prefix}{name}_hits": count_terms(F.coalesce(text, F.lit("")), terms) for name, terms in categories.items()}
        out = out.withColumns(cols).withColumns({f"{prefix}has_{name}": F.col(f"{prefix}{name}_hits") > 0 for name in categories})
    return out


def transitions(a: DataFrame, b: DataFrame, key: str, categories: Sequence[str]) -> DataFrame:
    """How often each category's flag is the same or changes between two measures of the same keys in two tables; all four cells."""
    left = a.select(key, *(F.col(f"has_{c}").alias(f"a_has_{c}") for c in categories))
    return transitions_within(left.join(b.select(key, *(F.col(f"has_{c}").alias(f"b_has_{c}") for c in categories)), key), categories)


def transitions_within(both: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The same of one table that holds both measures (``two_surfaces``)."""
    cells = [(c, x, y) for c in categories for x in (False, True) for y in (False, True)]
    wide = both.agg(*(count_if((F.col(f"a_has_{c}") == x) & (F.col(f"b_has_{c}") == y)).alias(f"{c}_{int(x)}{int(y)}") for c, x, y in cells))
    packed = [F.struct(F.lit(c).alias("category"), F.lit(x).alias("before_hit"), F.lit(y).alias("after_hit"), F.col(f"{c}_{int(x)}{int(y)}").alias("records")) for c, x, y in cells]
    return wide.select(F.explode(F.array(*packed)).alias("r")).select("r.*")


def measure_deltas(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """b - a for each value on the same keys."""
    left = a.select(*keys, *(F.col(v).alias(f"{v}_a") for v in values))
    return deltas_within(left.join(b.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values)), list(keys)), values)


def deltas_within(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """The same of one table that holds both measures, as v_a and v_b."""
    return df.withColumns({f"{v}_delta": F.col(f"{v}_b") - F.col(f"{v}_a") for v in values})


def revision_effect(before: Column, after: Column) -> Column:
    """Relative change; 0 where there was nothing before."""
    return ratio(after - before, before)
