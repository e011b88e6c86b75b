"""Multilabel metrics, class weights and label balance, from 0/1 truth and prediction columns in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.stats import unpivot


def _over(n: Column, d: Column, least: float = 1.0) -> Column:
    return n / F.greatest(d, F.lit(least))


def multilabel(df: DataFrame, labels: Sequence[str], truth: str = "y_", predicted: str = "z_", digits: int = 6) -> DataFrame:
    """(metric, value): micro, macro and single precision, recall and F1, and the mean Jaccard of rows."""
    y, z = {v: F.col(truth + v) for v in labels}, {v: F.col(predicted + v) for v in labels}
    both, either = sum((y[v] * z[v] for v in labels), F.lit(0)), sum((F.greatest(y[v], z[v]) for v in labels), F.lit(0))
    aggs = [f for v in labels for f in (F.sum(y[v] * z[v]).cast("double").alias(f"tp_{v}"), F.sum((1 - y[v]) * z[v]).cast("double").alias(f"fp_{v}"), F.sum(y[v] * (1 - z[v])).cast("double").alias(f"fn_{v}"))]
    wide = df.agg(*aggs, F.avg(both / F.greatest(either, F.lit(1))).alias("jaccard"))

    def three(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
        p, r = _over(tp, tp + fp), _over(tp, tp + fn)
        return p, r, 2 * p * r / F.greatest(p + r, F.lit(1e-12))

    each = {v: three(*(F.col(f"{k}_{v}") for k in ("tp", "fp", "fn"))) for v in labels}
    micro = three(*(sum((F.col(f"{k}_{v}") for v in labels), F.lit(0.0)) for k in ("tp", "fp", "fn")))
    names = ("precision", "recall", "f1")
    rows = {f"micro_{m}": micro[i] for i, m in enumerate(names)} | {f"macro_{m}": sum((each[v][i] for v in labels), F.lit(0.0)) / len(labels) for i, m in enumerate(names)}
    rows |= {f"{v}_{m}": each[v][i] for v in labels for i, m in enumerate(names)} | {"samples_jaccard": F.col("jaccard")}
    return unpivot(wide, {k: {"value": F.round(c, digits)} for k, c in rows.items()}, "metric")


def class_weights(df: DataFrame, labels: Sequence[str], prefix: str = "y_", digits: int = 6) -> DataFrame:
    """(label, positive, negative, pos_weight): negatives for each positive, of which there is one at least."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(prefix + v), F.lit(0)).cast("bigint").alias(f"p_{v}") for v in labels))
    rows = {v: {"positive": F.col(f"p_{v}"), "negative": F.col("n") - F.col(f"p_{v}"), "pos_weight": F.round((F.col("n") - F.col(f"p_{v}")).cast("double") / F.greatest(F.col(f"p_{v}"), F.lit(1)), digits)} for v in labels}
    return unpivot(wide, rows, "label")


def label_pattern(labels: Sequence[str], prefix: str = "y_") -> Column:
    return F.concat(*(F.col(prefix + v).cast("int").cast("string") for v in labels))
