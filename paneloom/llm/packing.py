"""Packing along a space-filling curve: hashed document vectors, Hilbert order, gapless fixed-length sequences.

Each document's token ids are hashed into a vector of counts, damped, scaled to length one and projected to a
few dimensions by fixed random signs; the normal distribution function spreads each coordinate over a grid and
the cell's Hilbert index is the document's key. The keys are range-sorted over the cluster, a prefix sum of
token counts gives every document its place on the curve, and cutting that line every ``seq_len`` tokens puts
neighbouring documents into the same sequences. All sequences but the very last are full.

Ties in the key (equal texts) are ordered by doc_id, then by the row's own number, so a large group of copies
is dealt over many range partitions. A null or empty text has only the end id. Repeated rows are packed each.
An empty table gives no pieces. A very long text is tokenised whole by one task, which holds its ids. Only ``doc_id``
and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.session import Scratch, ship_package

SEQ_LEN = 2048
END_ID = 1
DIMS = 4
BITS = 12
BUCKETS = 1024
RANGE_ROWS = 500_000

# Characters that every Unicode version classes alike: there the rank file gives the ids of the JSON file.
_COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*")


@lru_cache(maxsize=2)
def _tokenizer(json_path: str, ranks_path: str | None, pattern: str | None):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if not ranks_path:
        return slow, None, ()
    from paneloom.llm.bpe import codec

    return slow, codec(ranks_path, pattern), tuple(t.content for t in slow.get_added_tokens_decoder().values())


def token_ids(text: str, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> np.ndarray:
    """Ids of text by the tokenizer file. With the same vocabulary as ranks, common characters take the faster path to the same ids."""
    slow, fast, special = _tokenizer(json_path, ranks_path, pattern)
    if fast is not None and _COMMON.fullmatch(text) and not any(s in text for s in special):
        try:
            return fast.encoding.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # the native scanner gives up on runs of white space of a megabyte
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _signs(buckets: int, dims: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return np.where(rng.random((buckets, dims)) < 0.5, -1.0, 1.0)


def project(ids: list[np.ndarray], buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Coordinates in (0, 1) of each document's hashed count vector."""
    signs, out = _signs(buckets, dims), np.full((len(ids), dims), 0.5)
    for i, x in enumerate(ids):
        if len(x):
            h = ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
            v = np.sqrt(np.bincount(h.astype(np.int64), minlength=buckets))
            out[i] = v @ signs / np.sqrt(v @ v)
            out[i] = 1.0 / (1.0 + np.exp(-1.702 * out[i]))
    return out


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (rows of coordinates below 2**bits), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of each level
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave, highest bits first
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def hilbert_keys(ids: list[np.ndarray], dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    cells = np.minimum((project(ids, dims=dims) * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    return hilbert_index(cells, bits) if len(ids) else np.zeros(0, np.int64)


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as little-endian 32-bit numbers)."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "pack")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.append(token_ids(t or "", json_path, ranks_path, pattern), np.uint32(end_id)) for t in b.column(1).to_pylist()]
            small = [x.astype("<u2").tobytes() if x.max() < 65_536 else None for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hilbert_keys([x[:-1] for x in ids]), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary()), pa.array([x.tobytes() if s is None else None for x, s in zip(ids, small, strict=True)], pa.binary())],
                ["doc_id", "curve", "n", "ids16", "ids32"],
            )

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    tokens = scratch.keep(src.mapInArrow(tokenise, "doc_id bigint, curve bigint, n bigint, ids16 binary, ids32 binary").withColumn("rid", F.monotonically_increasing_id()), "tokens")

    # Range-sort the keys alone; each range adds up its tokens, and the sums of the ranges give every range its place.
    # A range holds some RANGE_ROWS documents at any size of the corpus.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.count() // RANGE_ROWS + 1)
    ranges = scratch.keep(
        tokens.select("rid", "doc_id", "curve", "n").repartitionByRange(parts, "curve", "doc_id", "rid").withColumn("rng", F.spark_partition_id()),
        "ranges",
    )
    sums = ranges.groupBy("rng").agg(F.sum("n").alias("s"))
    before = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("rng", "base")  # a row for each range
    along = Window.partitionBy("rng").orderBy("curve", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = ranges.withColumn("upto", F.sum("n").over(along)).join(before, "rng").select("rid", (F.col("base") + F.col("upto") - F.col("n")).alias("pos"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, n, small, wide, pos in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(small, "<u2").astype("<u4") if wide is None else np.frombuffer(wide, "<u4")
                at = 0
                while at < n:
                    seq, off = divmod(pos + at, seq_len)
                    raw = ids[at : at + seq_len - off].tobytes()
                    for col, v in zip(out, (doc_id, at, len(raw) // 4, zlib.crc32(raw), n, seq, off, raw if with_ids else None), strict=True):
                        col.append(v)
                    at += len(raw) // 4
            arrays = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{c} bigint" for c in names[:7]) + (", ids binary" if with_ids else "")
    return tokens.join(places, "rid").select("doc_id", "n", "ids16", "ids32", "pos").mapInArrow(cut, schema)


def assemble(pieces: DataFrame) -> DataFrame:
    """Sequences of pieces that carry their ids: sequence_id, ids (32-bit little-endian), n_tokens, doc_ids."""
    part = F.struct("offset", "ids", "doc_id")
    return (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(part)).alias("p"))
        .select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("aggregate(p, 0L, (a, x) -> a + length(x.ids) div 4)").alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"))
    )
