from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, ids=None, lang="en", source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def extra(df):
    """Columns that clash with names used inside the operators."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("n", "fp", "rid", "label", "id", "th", "start", "s", "pos", "digest", "words", "lang_pred", "_th", "_key", "_text", "_gone", "_id", "_cuts", "row", "spans", "left", "cuts", "a.b")})


ODD = [None, "", " ", "\n\n\t", "x", "12 34", "é à ü", "word " * 30_000, "a" * 50_000, "same text here", "same text here", " \x00 nul", "語語語 語", "$$$ ### &&&"]
