"""Domain-phrase TF-IDF on long frames (document, term, count): label lift, overlap, yearly cells and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.functions.numeric import cosine, ratio
from paneloom.functions.text import squeeze, tokens
from paneloom.operators.keys import small_side


def vocabulary(sources: Sequence[DataFrame], term: str, stop: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Terms of several tables (term, source, category): cleaned, long enough, not stopped; provenance joined."""
    rows = None
    for s in sources:
        s = s.withColumn(term, squeeze(term))
        rows = s if rows is None else rows.unionByName(s)
    rows = rows.where((F.length(term) >= least) & ~F.col(term).isin(*stop) if stop else F.length(term) >= least)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c)
    return rows.groupBy(term).agg(joined("source"), joined("category")).withColumn("term_length", F.length(term))


def term_counts(df: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(key, term, n) by one scan of each text with a single expression, longest terms first, without overlap."""
    return df.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit("")), list(terms))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def idf(counts: DataFrame, key: str, n_docs: int | Column, digits: int = 9) -> DataFrame:
    """Document frequency and smoothed inverse document frequency of each term."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    df = counts.groupBy("term").agg(F.count_distinct(key).alias("doc_count"))
    return df.withColumn("idf", F.round(F.log((1.0 + n) / (1.0 + F.col("doc_count"))) + 1.0, digits))


def weigh(counts: DataFrame, frequencies: DataFrame, digits: int = 9) -> DataFrame:
    """tfidf = ln(1+n) * idf; term tables are small next to counts."""
    return counts.join(frequencies, "term").withColumn("tfidf", F.round(F.log1p(F.col("n").cast("double")), digits) * F.col("idf"))


def label_lift(weights: DataFrame, key: str, members: DataFrame, label: str, n_docs: int, terms: DataFrame, digits: int = 6) -> DataFrame:
    """Each label's terms: mean weight inside and outside, document shares, lift and score.

    Means divide by all documents of the label (or outside it), also those without the term.
    members: (key, label), one row for each document of a label.
    """
    sizes = members.groupBy(label).agg(F.count(F.lit(1)).alias("label_docs"))
    total = weights.groupBy("term").agg(F.sum("tfidf").alias("all_sum"), F.count(F.lit(1)).alias("global_doc_count"))
    inside = weights.join(members, key).groupBy(label, "term").agg(F.sum("tfidf").alias("in_sum"), F.count(F.lit(1)).alias("label_doc_count"))
    grid = sizes.crossJoin(small_side(terms.select("term"))).join(inside, [label, "term"], "left").join(total, "term", "left").na.fill(0)
    mean = ratio("in_sum", "label_docs")
    outside = ratio(F.col("all_sum") - F.col("in_sum"), F.lit(n_docs) - F.col("label_docs"))
    label_share, global_share = ratio("label_doc_count", "label_docs"), F.col("global_doc_count") / F.lit(n_docs).cast("double")
    out = grid.withColumns({"mean_tfidf": F.round(mean, digits), "outside_tfidf": F.round(outside, digits), "label_share": F.round(label_share, digits), "global_share": F.round(global_share, digits)})
    out = out.withColumn("tfidf_lift", F.round(F.col("mean_tfidf") - F.col("outside_tfidf"), digits)).withColumn("share_lift", F.round(F.col("label_share") - F.col("global_share"), digits))
    score = F.col("mean_tfidf") + F.greatest("tfidf_lift", F.lit(0.0)) + F.greatest("share_lift", F.lit(0.0))
    return out.withColumn("score", F.round(score, digits)).drop("in_sum", "all_sum")


def top_terms(lifted: DataFrame, label: str, n: int = 30) -> DataFrame:
    w = Window.partitionBy(label).orderBy(F.desc("score"), F.desc("mean_tfidf"), F.desc("label_share"), "term")
    return lifted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def overlap(top: DataFrame, label: str, within: int = 20, least: int = 2) -> DataFrame:
    """Terms near the top of several labels."""
    out = top.where(F.col("rank") <= within).groupBy("term").agg(F.count_distinct(label).alias("n_labels"), F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), ";").alias("labels"), F.min("rank").alias("best_rank"))
    return out.where(F.col("n_labels") >= least)


def cell_means(weights: DataFrame, key: str, members: DataFrame, cells: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean weight of each term in each cell of documents, over all documents of the cell."""
    sizes = members.groupBy(*cells).agg(F.count(F.lit(1)).alias("docs"))
    sums = weights.join(members, key).groupBy(*cells, "term").agg(F.sum("tfidf").alias("s"))
    return sums.join(sizes, list(cells)).withColumn("mean_tfidf", F.round(F.col("s") / F.col("docs"), digits)).drop("s")


def cell_stats(counts: DataFrame, key: str, members: DataFrame, cells: Sequence[str], grid: DataFrame, thin: int = 10) -> DataFrame:
    """Documents, terms and share with any term in every cell of the grid; cells under ``thin`` documents are marked."""
    each = counts.groupBy(key).agg(F.sum("n").alias("n"))
    found = members.join(each, key, "left").na.fill(0, ["n"]).groupBy(*cells).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 6).alias("mean_terms"), F.round(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), 6).alias("any_term_share"))
    return grid.join(found, list(cells), "left").na.fill(0).withColumn("is_thin", F.col("docs") < thin)


def _norms(vectors: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return vectors.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def drift(means: DataFrame, baseline: DataFrame, label: str, year: str, digits: int = 6) -> DataFrame:
    """Cosine of each label-year vector with the label's vector over all years, and with the year before."""
    v = means.select(label, year, "term", F.col("mean_tfidf").alias("x"))
    b = baseline.select(label, "term", F.col("mean_tfidf").alias("y"))
    cells = v.select(label, year).distinct()
    vn, bn = _norms(v, [label, year], "x").withColumnRenamed("norm", "xn"), _norms(b, [label], "y").withColumnRenamed("norm", "yn")
    dots = v.join(b, [label, "term"]).groupBy(label, year).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    to_base = cells.join(dots, [label, year], "left").join(vn, [label, year], "left").join(bn, [label], "left").select(label, year, F.lit("baseline").alias("against"), F.round(cosine("dot", "xn", "yn"), digits).alias("cosine"))
    before = v.select(label, (F.col(year) + 1).alias(year), "term", F.col("x").alias("y"))
    pn = _norms(before, [label, year], "y").withColumnRenamed("norm", "yn")
    dots2 = v.join(before, [label, year, "term"]).groupBy(label, year).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    to_prev = cells.join(pn, [label, year]).join(dots2, [label, year], "left").join(vn, [label, year], "left").select(label, year, F.lit("previous").alias("against"), F.round(cosine("dot", "xn", "yn"), digits).alias("cosine"))
    return to_base.unionByName(to_prev)


def representatives(counts: DataFrame, key: str, top: DataFrame, label: str, members: DataFrame, score: str, n: int = 15, terms: int = 12) -> DataFrame:
    """Documents of each label that hold most of its top terms; ties by hits, then score, then key."""
    best = top.where(F.col("rank") <= terms).select(label, "term")
    hit = counts.join(best, "term").join(members, [key, label]).groupBy(label, key).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("hits"), F.max(score).alias(score))
    w = Window.partitionBy(label).orderBy(F.desc("n_terms"), F.desc("hits"), F.desc(score), key)
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def vector_top_terms(weights: DataFrame, groups: Sequence[str], value: str = "mean_tfidf", n: int = 20) -> DataFrame:
    """The n heaviest terms of each group's vector, those above 0 only (ties: by term); groups hold a vocabulary of terms, not documents."""
    w = Window.partitionBy(*groups).orderBy(F.desc(value), "term")
    return weights.where(F.col(value) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
