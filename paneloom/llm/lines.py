"""Quality rules with cross-document line frequency per host.

Lines are normalised (lower case, digits to 0, white space collapsed) and hashed. For each host the distinct
documents that hold a line are counted; equal texts count as one document, so copies do not make their own
lines common. The limit of a host is ``host_share`` of its distinct documents, but not under ``min_docs`` nor over
``max_docs``, so on a very large host it doesn't rise with the host. A line held by more distinct documents than that
is removed, and a document that keeps less than ``min_left`` of its words is rejected.

Lines are counted after a map-side sum per (host, line, text), so no host or line gathers in one task; the
lines above the limit come back by a sort-merge join that may be split, and only line hashes move, no text.

A null host is a host of its own. Null, empty and white-space texts have no words, fail the base rules and are
not kept. Repeated rows are judged each. An empty table gives an empty result. A very long text is split into its lines
by one task, which holds them. Only ``doc_id``, ``text`` and ``source`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm import textcore as tc
from paneloom.session import Scratch, ship_package

MIN_DOCS, MAX_DOCS = 10, 100
HOST_SHARE = 0.05
MIN_LEFT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGITS = re.compile(r"[0-9]")


def normalise_line(line: str) -> str:
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def repeat_words(words: np.ndarray, k: int = 3) -> int:
    """Words that stand in a k-word window found twice or more."""
    windows = tc.shingle_hashes(words, k)
    if not len(windows):
        return 0
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words) + 1, np.int64)
    start = np.flatnonzero(n[at] > 1)
    hit[start] += 1
    np.add.at(hit, start + k, -1)
    return int((np.cumsum(hit) > 0).sum())


def line_facts(text: str) -> tuple[int, list[tuple[int, int]]]:
    """(lines equal to an earlier one, [(hash of normalised line, its words in all its places)])."""
    seen: set[str] = set()
    dup, found = 0, {}
    for line in text.split("\n"):
        words = len(line.encode().split())
        if not words:
            continue
        dup += line in seen
        seen.add(line)
        h = _signed(xxhash.xxh64_intdigest(normalise_line(line)))
        found[h] = found.get(h, 0) + words
    return dup, list(found.items())


FACTS = "doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, text_hash bigint, lines array<struct<h: bigint, w: bigint>>"


def facts(docs: DataFrame) -> DataFrame:
    """Base measures and normalised line hashes of each document."""
    ship_package(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.tidied(batches):
            data, offsets = tc.utf8(b.column(2))
            for lo, hi in tc.slices(b.column(2)):
                texts = [t or "" for t in b.column(2).slice(lo, hi - lo).to_pylist()]
                off = offsets[lo : hi + 1]
                starts, ends, first = tc.word_spans(data, off)
                words = tc.word_hashes(data, starts, ends, lower=False)
                own, at = data[off[0] : off[-1]], off - off[0]
                per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
                chars = per(((own & 0xC0) != 0x80) & ~tc._IS_SPACE[own])
                symbols = per(_SYMBOL[own])
                repeats = [repeat_words(words[first[i] : first[i + 1]]) for i in range(hi - lo)]
                lines = [line_facts(t) for t in texts]
                i64 = lambda x: pa.array(np.asarray(x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(lo, hi - lo) for c in (0, 1)),
                        i64(np.diff(first)), i64(chars), i64(symbols), i64([x[0] for x in lines]), i64(repeats),
                        i64([_signed(xxhash.xxh64_intdigest(t)) for t in texts]),
                        pa.array([[{"h": h, "w": w} for h, w in x[1]] for x in lines], pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))),
                    ],
                    ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "lines"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text")).mapInArrow(measure, FACTS)


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_left: float = MIN_LEFT, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document: base measures, base_failed, n_common_words (words in lines above the limit) and kept."""
    scratch = Scratch(docs.sparkSession, "lines")
    d = scratch.keep(facts(docs).withColumn("rid", F.monotonically_increasing_id()), "facts")
    limits = (
        d.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("n"))
        .select("host", F.greatest(F.lit(float(min_docs)), F.least(F.lit(float(max_docs)), F.col("n") * F.lit(host_share))).alias("limit"))
    )
    lines = d.select("rid", "host", "text_hash", F.explode("lines").alias("x")).select("rid", "host", "text_hash", "x.h", "x.w")
    held = lines.groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("one").alias("docs"))
    common = (
        held.where(F.col("docs") > min_docs).alias("a").join(limits.alias("b"), F.expr("a.host <=> b.host and a.docs > b.limit"))
        .selectExpr("a.host as chost", "a.h as ch")
    )
    gone = lines.join(common, F.expr("host <=> chost and h = ch")).groupBy("rid").agg(F.sum("w").alias("n_common_words"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("n_common_words", F.lit(0))
    return (
        d.drop("lines", "text_hash").join(gone, "rid", "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), F.coalesce("n_common_words", F.lit(0)).cast("bigint").alias("n_common_words"), (~base_failed & (left >= F.col("n_words") * F.lit(min_left))).alias("kept"))
    )


def oracle_sql(min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_left: float = MIN_LEFT, max_docs: int = MAX_DOCS) -> str:
    """The same rows with the normalised lines themselves in place of their hashes."""
    space = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i + 1], w[i + 2], w[i + 3]) AS n FROM (SELECT rid, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat FROM (SELECT rid, i FROM g WHERE n > 1), range(3) r(k) GROUP BY rid),
li AS (SELECT rid, source, t, line, regexp_replace(regexp_replace(regexp_replace(lower(line), '{space}+', ' ', 'g'), '^ +| +$', '', 'g'), '[0-9]', '0', 'g') AS nl, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw FROM (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
ln AS (SELECT * FROM li WHERE lw > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup FROM ln GROUP BY rid),
lim AS (SELECT source, greatest({min_docs}, least({max_docs}, {host_share} * count(DISTINCT t))) AS lim FROM d GROUP BY source),
com AS (SELECT source, nl FROM (SELECT source, nl, count(DISTINCT t) AS docs FROM ln GROUP BY source, nl) JOIN lim USING (source) WHERE docs > lim),
gone AS (SELECT rid, sum(lw) AS n_common FROM ln JOIN com USING (source, nl) GROUP BY rid),
f AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_common, 0) AS BIGINT) AS n_common_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_common_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_common_words >= n_words * {min_left} AS kept
FROM f
"""
