"""A trainable multilabel text model on Spark ML: one weighted logistic regression for each label.

It stands where a fine-tuned transformer would (that needs libraries that are not here): the same inputs (text, 0/1
labels, splits), the same class weights, the choice of the best candidate by validation macro-F1, saved models that
a later run loads, and probabilities for ``panel.hard_labels`` and ``panel.intensity``. Features are hashed character
pairs, so texts need no word boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators import metrics


def character_pairs(df: DataFrame, text: str, name: str = "_pairs") -> DataFrame:
    """Array of all pairs of neighbouring characters; a text of one character is its own pair."""
    chars = F.split(F.coalesce(F.col(text), F.lit("")), "")
    n = F.greatest(F.size(chars) - 1, F.lit(1))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return df.withColumn(name, pairs)


@dataclass
class TextModel:
    """Fitted models by label; predict adds p_<label> columns."""

    labels: list[str]
    models: list[LogisticRegressionModel]
    buckets: int

    def _features(self, df: DataFrame, text: str) -> DataFrame:
        return HashingTF(inputCol="_pairs", outputCol="_x", numFeatures=self.buckets, binary=True).transform(character_pairs(df, text)).drop("_pairs")

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        out = self._features(df, text)
        for label, model in zip(self.labels, self.models, strict=True):
            scored = model.setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_z").transform(out)
            out = scored.withColumn(f"p_{label}", vector_to_array("_p")[1]).drop("_p", "_r", "_z")
        return out.drop("_x")

    def save(self, path: str) -> None:
        PipelineModel(self.models).write().overwrite().save(path)

    @staticmethod
    def load(path: str, labels: Sequence[str], buckets: int) -> TextModel:
        return TextModel(list(labels), PipelineModel.load(path).stages, buckets)


def fit(train: DataFrame, validation: DataFrame, text: str, labels: Sequence[str], prefix: str = "y_", penalties: Sequence[float] = (0.001, 0.01, 0.1), buckets: int = 1 << 14, iterations: int = 40) -> tuple[TextModel, DataFrame]:
    """The candidate of best validation macro-F1, and (penalty, metric, value) of all candidates. Positives weigh as many as negatives."""
    weights = {r["label"]: float(r["pos_weight"]) for r in metrics.class_weights(train, labels, prefix).collect()}
    table = TextModel(list(labels), [], buckets)._features(train, text).select("_x", *(F.col(f"{prefix}{v}").cast("double").alias(f"{prefix}{v}") for v in labels)).persist()  # read once for each label and penalty
    best, report = None, None
    try:
        for penalty in penalties:
            model = TextModel(list(labels), [], buckets)
            for label in labels:
                y = F.col(f"{prefix}{label}")
                rows = table.select("_x", y.alias("label"), F.when(y == 1, max(weights[label], 1e-6)).otherwise(1.0).alias("w"))
                model.models.append(LogisticRegression(featuresCol="_x", labelCol="label", weightCol="w", regParam=penalty, maxIter=iterations).fit(rows))
            found = evaluate(model, validation, text, prefix).withColumn("penalty", F.lit(penalty)).collect()
            frame = train.sparkSession.createDataFrame([(r["penalty"], r["metric"], r["value"]) for r in found], "penalty double, metric string, value double")
            report = frame if report is None else report.unionByName(frame)
            score = next(r["value"] for r in found if r["metric"] == "macro_f1")
            if best is None or score > best[0]:
                best = (score, model)
    finally:
        table.unpersist()
    return best[1], report


def evaluate(model: TextModel, rows: DataFrame, text: str, prefix: str = "y_", threshold: float = 0.5) -> DataFrame:
    """(metric, value) of the model on labelled rows."""
    scored = model.predict(rows, text).withColumns({f"z_{v}": (F.col(f"p_{v}") >= threshold).cast("int") for v in model.labels})
    return metrics.multilabel(scored, model.labels, prefix, "z_")
