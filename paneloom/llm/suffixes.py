"""Sparse suffix arrays: passages of at least 50 words that occur more than once in the corpus.

Words are hashed (ASCII case ignored). Of all suffixes of a text only those are retained that start at a
minimiser: the 25-word gram with the least hash among 26 consecutive ones. Every 50-word window has exactly one
minimiser, fixed by its content, so two occurrences of a passage retain suffixes at the same places. Retained
suffixes are sorted by their first 25 words over the cluster and neighbours compared; suffixes without an equal
neighbour are done with (by far the most). The others are extended left and right: for each shift, the 50-word
windows that a minimiser governs are sorted and compared with their neighbours. All windows that occur again
anywhere are found, and their union gives the maximal repeated spans of each text.

Equal texts are one text in all this; afterwards every row of a class but the smallest doc_id is a repeat from
its first to its last word. The order of texts is that of doc_id (null last): an occurrence is removable if an
earlier text, or an earlier place in the same text, holds the window. Each task combines its own entries first,
so a passage held by very many texts does not gather in one task, and entries move as packed blobs.

Null, empty and short texts (under 50 words) have no spans. Rows that repeat another row's doc_id and text are
equal to it and share its spans. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read;
``remove_repeats`` keeps all other columns, whatever their names. Windows are compared by 64-bit hashes. A very long
text is hashed block by block; a task holds its word hashes (8 bytes a word) and at most 400,000 suffixes beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm import textcore as tc
from paneloom.session import Scratch, release_shuffles, ship_package

GRAM = 25
LEAST = 2 * GRAM  # words of the shortest passage that is surely found
WINDOW = LEAST - GRAM + 1
SEEN = 100_000  # fingerprints that a task remembers, some 10 MB; a text met twice is dropped by the reducer
_LAST = np.iinfo(np.int64).max


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, for each 50-word window the position of its minimiser)."""
    grams = tc.shingle_hashes(words, GRAM)
    if len(words) < LEAST:
        return grams, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return grams, np.concatenate([view[i : i + 65_536].argmin(axis=1) + np.arange(i, min(i + 65_536, len(view))) for i in range(0, len(view), 65_536)])


def window_hashes(grams: np.ndarray) -> np.ndarray:
    """Hash of each 50-word window, from its two halves."""
    return tc.mix(grams[:-GRAM] * np.uint64(0xC2B2AE3D27D4EB4F) + grams[GRAM:])


def sequence_print(words: np.ndarray) -> int:
    """64 bits of a whole sequence of words."""
    if not len(words):
        return 0
    h = tc.mix(words + np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (int(np.bitwise_xor.reduce(h)) + int(np.add.reduce(tc.mix(h)))) & (2**64 - 1)


def _i64(a) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _blobs(rows: np.ndarray, key: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    part = (tc.mix(key) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    rows = rows[order]
    full = [p for p in range(parts) if cut[p + 1] > cut[p]]
    return full, [rows[cut[p] : cut[p + 1]].tobytes() for p in full]


def _facts(src: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, n_words, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.tidied(batches):
            n, fp = [], []
            for words in tc.texts_words(b.column(2), lower=True):
                n.append(len(words))
                fp.append(sequence_print(words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _i64(np.array(n, np.int64)), _i64(np.array(fp, np.uint64))], ["doc_id", "th", "n_words", "fp"])

    return scratch.keep(src.mapInArrow(run, "doc_id bigint, th bigint, n_words bigint, fp bigint"), "facts")


def _repeated_grams(src: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """(fp, pos) of retained suffixes whose first 25 words also start another retained suffix."""
    names = ["part", "fp", "pos", "blob"]

    def neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted rows (gram, fp, pos, flag): the first of each gram, flagged if it has equals, and the others."""
        rows = rows[np.lexsort((1 - rows[:, 3].astype(np.int64), rows[:, 2], rows[:, 1], rows[:, 0]))]  # of equal rows a flagged one stays
        rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])] if len(rows) else rows
        new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, bool)
        first, at = rows[new].copy(), np.flatnonzero(new)
        first[:, 3] |= np.diff(np.append(at, len(rows))).astype(np.uint64) > 1
        if len(rows):
            first[:, 3] |= np.maximum.reduceat(rows[:, 3], at)
        return first, rows[~new]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            first, rest = neighbours(np.concatenate(held))
            held.clear()
            full, blobs = _blobs(first, first[:, 0], parts)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()), pa.array(blobs, pa.binary())], names)
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array((tc.mix(rest[:, 1] + rest[:, 2]) % np.uint64(parts)).astype(np.int32)), _i64(rest[:, 1]), _i64(rest[:, 2]), pa.nulls(len(rest), pa.binary())], names)

        for b in tc.tidied(batches):
            for words in tc.texts_words(b.column(0), lower=True):
                fp = sequence_print(words)
                if len(words) < LEAST or fp in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                grams, at = minimisers(words)
                pos = np.unique(at)
                held.append(np.stack([grams[pos], np.full(len(pos), fp, np.uint64), pos.astype(np.uint64), np.zeros(len(pos), np.uint64)], axis=1))
                size += len(pos)
                if size > 400_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
            tc.tidy()

    def reduce(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 4) for x in group.column("blob").combine_chunks() if x.is_valid]
        first, rest = neighbours(np.concatenate(blobs)) if blobs else (np.zeros((0, 4), np.uint64),) * 2
        old = group.filter(pa.compute.is_valid(group.column("fp")))
        hit = np.concatenate([first[first[:, 3] > 0, 1:3], rest[:, 1:3]]).view(np.int64)
        pairs = np.concatenate([hit, np.stack([old.column("fp").to_numpy(), old.column("pos").to_numpy()], axis=1).reshape(-1, 2)])
        tc.tidy()
        return pa.table({"fp": pairs[:, 0], "pos": pairs[:, 1]})

    shipped = src.select("text").mapInArrow(emit, "part int, fp bigint, pos bigint, blob binary")
    return scratch.keep(shipped.groupBy("part").applyInArrow(reduce, "fp bigint, pos bigint"), "grams")


SPANS = "fp bigint, s0 bigint, s1 bigint, source bigint, later boolean"


def _runs(fp, start, source, later) -> pa.RecordBatch:
    """Consecutive windows of a text with one source become one row: windows s0..s1."""
    o = np.lexsort((start, later, source, fp))
    fp, start, source, later = fp[o], start[o], source[o], later[o]
    cut = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (source[1:] != source[:-1]) | (later[1:] != later[:-1]) | (start[1:] > start[:-1] + 1)])) if len(fp) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(fp)) - 1
    return pa.RecordBatch.from_arrays([pa.array(fp[cut]), pa.array(start[cut]), pa.array(start[end] if len(fp) else start), pa.array(source[cut]), pa.array(later[cut].astype(bool))], ["fp", "s0", "s1", "source", "later"])


def _extend(src: DataFrame, facts: DataFrame, grams: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """Windows of the retained suffixes that occur again: fp, s0, s1, source (doc_id of an earlier holder), later."""
    # the text of a class is fetched by id and text hash, so rows without an id don't meet all others without one
    reps = facts.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("o"), "th", "doc_id")).alias("r"))
    places = grams.groupBy("fp").agg(F.collect_set("pos").alias("pos")).alias("g").join(reps.alias("r"), F.expr("g.fp = r.fp")).selectExpr("g.fp as fp", "r.r.doc_id as rep", "r.r.th as rep_th", "pos")
    names = ["part", "fp", "s0", "s1", "source", "later", "blob"]
    schema = "part int, fp bigint, s0 bigint, s1 bigint, source bigint, later boolean, blob binary"

    def neighbours(rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Rows (window, ord, fp, start, flag, gram) sorted: the first of each window, flagged if it has equals; the others as (fp, start, source, later)."""
        rows = rows[np.lexsort((1 - rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]  # of equal rows a flagged one stays
        rows = rows[np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])] if len(rows) else rows
        new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        first = rows[new].copy()
        n = np.diff(np.append(at, len(rows)))
        first[:, 4] |= n > 1
        if len(rows):
            first[:, 4] |= np.maximum.reduceat(rows[:, 4], at)
        source = np.repeat(rows[new, 1], n)[~new] if len(rows) else rows[:, 1]
        rest = rows[~new]
        return first, (rest[:, 2], rest[:, 3], source, np.ones(len(rest), np.int64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        done: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            first, rest = neighbours(np.concatenate(held))
            held.clear()
            full, blobs = _blobs(first.view(np.uint64), first[:, 5].view(np.uint64), parts)
            k = len(full)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())), pa.array(blobs, pa.binary())], names)
            runs = _runs(*rest)
            if runs.num_rows:
                part = (tc.mix(runs.column(0).to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), *runs.columns, pa.nulls(runs.num_rows, pa.binary())], names)

        for b in tc.tidied(batches):
            fps, reps, poss = (b.column(c).to_pylist() for c in (1, 2, 3))
            for i, words in enumerate(tc.texts_words(b.column(0), lower=True)):
                if fps[i] in done or sequence_print(words) != fps[i] & (2**64 - 1):
                    continue  # a row that repeats id and text, or another text of the same id and hash
                if len(done) >= SEEN:
                    done.clear()
                done.add(fps[i])
                g, at = minimisers(words)
                s = np.flatnonzero(np.isin(at, np.asarray(poss[i], np.int64)))
                w = window_hashes(g)[s].view(np.int64)
                full = lambda v: np.full(len(s), v, np.int64)
                held.append(np.stack([w, full(_LAST if reps[i] is None else reps[i]), full(fps[i]), s, full(0), g[at[s]].view(np.int64)], axis=1))
                size += len(s)
                if size > 300_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
            tc.tidy()

    def reduce(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 6) for x in group.column("blob").combine_chunks() if x.is_valid]
        first, rest = neighbours(np.concatenate(blobs) if blobs else np.zeros((0, 6), np.int64))
        kept = first[first[:, 4] > 0]
        runs = _runs(*(np.concatenate([a, b]) for a, b in zip(rest, (kept[:, 2], kept[:, 3], kept[:, 1], np.zeros(len(kept), np.int64)), strict=True)))
        old = group.filter(pa.compute.is_valid(group.column("fp"))).select(["fp", "s0", "s1", "source", "later"])
        tc.tidy()
        return pa.concat_tables([pa.Table.from_batches([runs]), old.cast(runs.schema)])

    fetched = src.join(places, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "fp", "rep", "pos").mapInArrow(emit, schema)
    return scratch.keep(fetched.groupBy("part").applyInArrow(reduce, SPANS), "windows")


def _merge(lo: list[int], hi: list[int], source: list[int], later: list[bool], want_later: bool) -> list[tuple[int, int, int]]:
    """Maximal (start, words, smallest source) of the windows lo..hi."""
    out: list[list[int]] = []
    for a, b, s, is_later in sorted(zip(lo, hi, source, later, strict=True)):
        if want_later and not is_later:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LEAST)
            out[-1][2] = min(out[-1][2], s)
        else:
            out.append([a, b + LEAST, s])
    return [(a, b - a, s) for a, b, s in out]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per row with repeats: doc_id, th (text hash), n_words, spans and removable: arrays of (start, words, source)."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "suffixes")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    facts = _facts(src, scratch)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.sum("n_words")).first()[0] or 0
    grams = _repeated_grams(src, max(least, int(total * 0.08 / 400_000) + 1), scratch)
    release_shuffles(spark)
    windows = _extend(src, facts, grams, max(least, int(grams.count() * 14 / 300_000) + 1), scratch)
    scratch.drop(grams)
    release_shuffles(spark)
    span = "array<struct<start: bigint, words: bigint, source: bigint>>"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.tidied(batches):
            every, later = [], []
            for ws in b.column(1).to_pylist():
                cols = [[w[k] for w in ws] for k in ("s0", "s1", "source", "later")]
                for out, flag in ((every, False), (later, True)):
                    out.append([{"start": a, "words": n, "source": s} for a, n, s in _merge(*cols, flag)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(every, kind), pa.array(later, kind)], ["fp", "spans", "removable"])

    merged = windows.groupBy("fp").agg(F.collect_list(F.struct("s0", "s1", "source", "later")).alias("w")).mapInArrow(merge, f"fp bigint, spans {span}, removable {span}")
    classes = facts.where(f"n_words >= {LEAST}").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    known = classes.alias("c").join(merged.alias("m"), F.expr("c.fp = m.fp"), "left").selectExpr("c.fp as cfp", "rep", "copies", "spans", "removable").where("copies > 1 or spans is not null")
    known = scratch.keep(known, "known")  # written, so that the join may split a large class
    whole = f"cast(array(named_struct('start', 0L, 'words', n_words, 'source', coalesce(rep, {_LAST}L))) as {span})"
    return facts.join(known, F.expr("fp = cfp")).selectExpr(
        "doc_id", "th", "n_words",
        f"case when copies > 1 then {whole} else spans end as spans",
        f"case when doc_id <=> rep then coalesce(removable, cast(array() as {span})) else {whole} end as removable",
    )


def repeats(docs: DataFrame) -> DataFrame:
    """A row for each maximal repeated span: doc_id, start_word, n_words, n_removable (its words that an earlier place holds)."""
    found = repeated_spans(docs)
    cut = "aggregate(removable, 0L, (a, r) -> a + greatest(0L, least(r.start + r.words, s.start + s.words) - greatest(r.start, s.start)))"
    return found.select("doc_id", "removable", F.explode("spans").alias("s")).selectExpr("doc_id", "s.start as start_word", "s.words as n_words", f"{cut} as n_removable")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the given spans of words and the white space after each."""
    raw = (text or "").encode()
    starts, _, _ = tc.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    edge = np.append(starts, len(raw))
    out, at = [], 0
    for a, n in sorted(spans):
        out.append(raw[at : edge[a]])
        at = int(edge[min(a + n, len(edge) - 1)])
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every removable span cut out of its text; all columns stay. Texts without one are left as they are."""
    ship_package(docs.sparkSession)
    gone = repeated_spans(docs).where("size(removable) > 0").groupBy("doc_id", "th").agg(F.first("removable").alias("spans"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "spans")

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if s is None else cut_words(t, [(x["start"], x["words"]) for x in s]) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    # the input's columns travel in one struct, so no name of theirs can clash with those of the join
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(gone, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_th")), "left")
    left = cut(F.when(F.col("spans").isNotNull(), F.col("row.text")), F.col("spans"))
    kept = joined.select("row", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(left).alias("left"))
    return kept.select(*(F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """The same rows from all windows of the whole table."""
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
v AS (SELECT rid, i, md5(array_to_string(w[i + 1 : i + {LEAST}], ' ')) AS h FROM (SELECT rid, w, unnest(range(len(w) - {LEAST - 1})) AS i FROM d WHERE len(w) >= {LEAST})),
c AS (SELECT rid, i, row_number() OVER (PARTITION BY h ORDER BY rid, i) > 1 AS later, count(*) OVER (PARTITION BY h) AS n FROM v),
r AS (SELECT * FROM c WHERE n > 1),
x AS (SELECT rid, i, later, sum(CASE WHEN i <= before + {LEAST} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) AS before FROM r)),
y AS (SELECT rid, span, min(i) AS a, max(i) + {LEAST} AS b FROM x GROUP BY ALL),
z AS (SELECT rid, span, i, least(i + {LEAST}, coalesce(lead(i) OVER (PARTITION BY rid, span ORDER BY i), i + {LEAST})) - i AS gain FROM x WHERE later)
SELECT doc_id, CAST(a AS BIGINT) AS start_word, CAST(b - a AS BIGINT) AS n_words, CAST(coalesce((SELECT sum(gain) FROM z WHERE z.rid = y.rid AND z.span = y.span), 0) AS BIGINT) AS n_removable
FROM y JOIN d USING (rid)
"""
