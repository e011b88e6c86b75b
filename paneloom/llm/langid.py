"""Language identification in two steps: family first, then one-versus-one linear SVMs within the family.

A text becomes counts of hashed byte trigrams and hashed words (ASCII case ignored), square-rooted and scaled to
length one. Linear support vector machines, trained by dual coordinate descent, decide every pair of families;
the family with most votes wins (ties: larger sum of margins, then the name that sorts first). Within it, one machine
for each pair of its languages decides likewise. The score is the product of the winner's mean logistic margin at both
steps.

Machines are fitted on the driver from a bounded sample of labelled rows. ``MAX_LANGS`` values of lang with most
distinct texts are learned (ties: by name), so k values cost k(k-1)/2 machines at most; rows of rarer values are left
out of the training and get the language they resemble most. Of each learned language the ``max_rows`` / languages
distinct texts with the smallest hash are taken, so the sample is the same on any number of executors, and copies of a
text count once. Both bounds are parameters and hold at any corpus size. Prediction reads whole texts in one map-only
pass and sees the text alone.

``und`` (score 0): the text is null, or holds no letter, or nothing could be learned. With a single learned
language that one is predicted. A language outside the table of families is a family of its own. Rows without
lang or text are not learned from; a null doc_id counts as not held out. Repeated rows get equal results; an
empty table gives an empty result. A very long text is counted whole by one task, block by block of its words and
bytes. Only ``doc_id``, ``text`` and ``lang`` are read; ``keep_identified`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm import textcore as tc
from paneloom.session import ship_package

HALF = 4_096  # buckets for trigrams, and as many for words
MAX_ROWS, MAX_LANGS = 4_000, 64
LEAST_SCORE = 0.3  # with two values a step, 0.25 is what coin flips at both steps give
FOLDS, HELD = 4, 2

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ["da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "celtic": ["br", "cy", "ga", "gd"],
    "baltic": ["lt", "lv"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "tr", "uz"],
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def counts(column: pa.Array, block: int = 1 << 19) -> Iterator[np.ndarray]:
    """Dense counts of the hashed features of each text."""
    data, offsets = tc.utf8(column)
    texts = tc.texts_words(column, lower=True)
    for i in range(len(column)):
        words = (next(texts) % np.uint64(HALF)).astype(np.int64) + HALF
        total = np.bincount(words, minlength=2 * HALF)
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for at in range(lo, max(lo, hi - 2), block):  # a block's trigrams start in it and may end behind it
            own = tc._LOWER[data[at : min(at + block + 2, hi)]].astype(np.int64)
            grams = (((own[:-2] * 0x9E3779B1 + own[1:-1] * 0x85EBCA6B + own[2:] * 0xC2B2AE35) >> 7) * 0x27D4EB2F >> 9) % HALF
            total += np.bincount(grams, minlength=2 * HALF)
        yield total


Row = tuple[np.ndarray, np.ndarray]  # places and values of what is not zero


def scaled(at: np.ndarray, n: np.ndarray) -> Row:
    """Counts to a row of length one, and a constant."""
    x = np.sqrt(n.astype(np.float64))
    return np.append(at, 2 * HALF), np.append(x / max(float(np.linalg.norm(x)), 1e-6), 1.0).astype(np.float32)


def fit_svm(x: list[Row], rows: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear SVM (hinge loss) on those rows of x, for labels +1 and -1, by dual coordinate descent."""
    rng, alpha, w = np.random.default_rng(3), np.zeros(len(rows)), np.zeros(2 * HALF + 1)
    q = [float(x[i][1] @ x[i][1]) for i in rows]
    cost = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = x[rows[i]]
            new = min(max(alpha[i] - (y[i] * float(w[at] @ value) - 1) / q[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * value
                alpha[i] = new
    return w.astype(np.float32)


class Hierarchy:
    """Machines for each pair of families and for each pair of languages within a family."""

    def __init__(self, x: list[Row], langs: list[str]):
        groups = defaultdict(set)
        for lang in langs:
            groups[family_of(lang)].add(lang)
        self.families = sorted(groups)
        self.languages = {f: sorted(groups[f]) for f in self.families}
        name, fam = np.array(langs, object), np.array([family_of(v) for v in langs], object)
        self.pairs: list[tuple[str, str, str]] = []
        weights = []
        for level, labels, values in [("", fam, self.families), *((f, name, self.languages[f]) for f in self.families)]:
            for a, b in combinations(values, 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                self.pairs.append((level, a, b))
                weights.append(fit_svm(x, rows, np.where(labels[rows] == a, 1.0, -1.0)))
        self.weights = np.stack(weights, axis=1) if weights else np.zeros((2 * HALF + 1, 0), np.float32)

    def _duel(self, level: str, values: list[str], margins: dict) -> tuple[str, float]:
        if len(values) == 1:
            return values[0], 1.0
        votes, total = dict.fromkeys(values, 0), dict.fromkeys(values, 0.0)
        own = defaultdict(list)
        for a, b in combinations(values, 2):
            m = margins[level, a, b]
            votes[a if m >= 0 else b] += 1
            for v, s in ((a, m), (b, -m)):
                total[v] += s
                own[v].append(1 / (1 + np.exp(-2 * s)))
        best = max(sorted(values), key=lambda v: (votes[v], total[v]))  # the first of equal ones
        return best, float(np.mean(own[best]))

    def decide(self, margins: dict[tuple[str, str, str], float]) -> tuple[str, float]:
        """(language, score) from the margin of each machine: positive for the first of its pair."""
        family, p = self._duel("", self.families, margins)
        lang, q = self._duel(family, self.languages[family], margins)
        return lang, min(1.0, max(0.0, p * q))

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        out = []
        for c in counts(texts):
            at, value = scaled(np.flatnonzero(c), c[c > 0])
            out.append(self.decide(dict(zip(self.pairs, (value @ self.weights[at]).tolist(), strict=True))))
        return out


def _fold(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % FOLDS, F.lit(0))


def sample(docs: DataFrame, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> DataFrame:
    """(lang, h, text): the training texts, distinct for each language; the same whatever the order of the rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() != HELD)).select("lang", "text", F.xxhash64("text", F.lit(17)).alias("h"))
    # a row for each learned language: at most max_langs
    sizes = rows.select("lang", "h").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return rows.limit(0)
    each = max(1, max_rows // len(sizes))
    share = F.create_map(*(F.lit(v) for r in sizes for v in (r["lang"], min(1.0, 1.3 * each / r["count"] + 20 / r["count"]))))
    near = rows.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    once = near.groupBy("lang", "h").agg(F.first("text").alias("text"))  # some 1.3 * each + 20 texts of a language
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h")
    return once.withColumn("i", F.row_number().over(order)).where(F.col("i") <= each).drop("i")


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> Hierarchy | None:
    """Fit on a bounded sample of the rows that are not held out."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.tidied(batches):
            body = []
            for c in counts(b.column(2)):
                at = np.flatnonzero(c)
                body.append(at.astype("<u2").tobytes() + c[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(body, pa.binary())], ["lang", "h", "c"])

    # a few KB a row and max_rows rows (or one for each language), whatever the size of the corpus
    found = sorted((r["lang"], r["h"], bytes(r["c"])) for r in sample(docs, max_rows, max_langs).mapInArrow(features, "lang string, h bigint, c binary").toLocalIterator())
    x = []
    for _, _, c in found:
        n = len(c) // 6
        x.append(scaled(np.frombuffer(c, "<u2", n).astype(np.int64), np.frombuffer(c, "<u4", n, 2 * n)))
    return Hierarchy(x, [lang for lang, _, _ in found]) if found else None


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _judged(model: Hierarchy | None, texts: pa.Array) -> list[tuple[str, float]]:
    """(language, score) of each text; und without a model or a letter."""
    told = model.predict(texts) if model is not None else [("und", 0.0)] * len(texts)
    return [p if has_letter(t) else ("und", 0.0) for p, t in zip(told, texts.to_pylist(), strict=True)]


def identify(docs: DataFrame, model: Hierarchy | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model or train(docs, max_rows))  # a machine has 8,193 weights

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.tidied(batches):
            pred = _judged(held.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p[0] for p in pred], pa.string()), pa.array([p[1] for p in pred], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (_fold() == HELD).alias("held_out"), "text")
    return src.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, max_rows: int = MAX_ROWS, least_score: float = LEAST_SCORE, targets: Sequence[str] | None = None) -> DataFrame:
    """docs whose language the machines can tell, with the predicted language in lang; other columns stay as they are.

    Rows go that hold no letter, that score below least_score, or whose language is not among targets (all by default).
    Where nothing could be learned, no language is known: rows with a letter stay, with the lang that they have.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(train(docs, max_rows))
    wanted = None if targets is None else frozenset(targets)
    kind = next(f.dataType for f in docs.schema if f.name == "lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in tc.tidied(batches):
            told = _judged(model, b.column(1))
            good = [has_letter(t) if model is None else v != "und" and score >= least_score and (wanted is None or v in wanted) for t, (v, score) in zip(b.column(1).to_pylist(), told, strict=True)]
            pred = pa.array([v if model is not None else None for v, _ in told], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pred], ["row", "text", "pred"]).filter(pa.array(good, pa.bool_()))

    # the other columns travel in one struct, whatever their names
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.lit(0).alias("_"))
    rows = docs.select(rest.alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("pred", T.StringType())])
    kept = rows.mapInArrow(keep, schema)
    lang = F.coalesce(F.col("pred").cast(kind), F.col("row.lang"))
    return kept.select(*(F.col("text") if c == "text" else lang.alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
