"""Content-defined chunking of media payloads, a deduplicated chunk store and verified reconstruction.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples of a mono WAV file. Its
header, which tells the length, is kept apart, so equal samples make equal chunks in media of any length. A gear hash
rolls over the samples (32 bytes wide) and cuts where its top bits are zero, between a least and a greatest chunk length.
Chunks are known by SHA-256, and each distinct medium has an ordered list of digests. Joins on the digests find the
chunks that several media share; the smallest (medium, position) is the home of such a chunk, and the store keeps its
payload there alone. A row of the store holds the header and the payloads whose home is that medium, so most media are
read back from one row; only shared chunks are joined in from their homes. Reading puts the chunks in order, checks
length and SHA-256 against what was recorded at writing, and computes the features from the samples read back. A
mismatch raises, it never passes silently.

Equal payloads are stored and read once and joined back to all rows that hold them, so a large group of copies
costs one reconstruction. Payloads travel compressed, with a dictionary trained on the first chunks of at most
``dict_chunks`` distinct texts, those with the smallest hash: the same on any number of executors, 48 MB at most on the
driver. Null and empty texts give 64 zero samples. A very long text is one medium, which the tasks that write and read it
hold whole. Repeated rows give repeated results; an empty table gives none. Only ``doc_id`` and ``text`` are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.textcore import tidied
from paneloom.session import Scratch, release_shuffles, ship_package

ALIGN = 64
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 2_048, 12, 16_384  # some 6 KB a chunk: smaller ones compress worse than they share
DICT_CHUNKS, DICT_BYTES, LEVEL = 3_000, 1 << 18, 6
WAVES = 2
SEEN = 100_000  # digests that a task remembers, some 15 MB; a medium met twice is dropped by the store
SAMPLE_RATE = 8_000
HEADER = 44
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ALIGN if raw else ALIGN), len(raw)


def to_wav(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n) + samples


def from_wav(media: bytes) -> bytes:
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != HEADER + n or size != 36 + n:
        raise ValueError("not a WAV file of this store")
    return media[HEADER:]


def gear_cuts(data: np.ndarray, least: int = MIN_CHUNK, bits: int = CUT_BITS, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of data. The hash at a byte is the sum of the gear values of the last 32 bytes, each doubled once for every byte since."""
    n = len(data)
    if n <= least:
        return [n]
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    spots = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    cuts, at = [], 0
    while n - at > least:
        i = np.searchsorted(spots, at + least)
        end = min(int(spots[i]) if i < len(spots) else n, at + most, n)
        cuts.append(end)
        at = end
    if at < n:
        cuts.append(n)
    return cuts


def feature(samples: bytes) -> str:
    """Length, mean, root of the mean square and zero crossings around 128, and a 16-bin histogram in thousandths; integers only."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    c = x - 128
    crossings = int(((c[1:] >= 0) != (c[:-1] >= 0)).sum())
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"n={len(x)};mean={int(x.sum()) * 1000 // len(x)};rms={int(np.sqrt(int((c * c).sum()) // len(x)))};zc={crossings};hist=" + ",".join(map(str, bins))


LISTS = "doc_id bigint, n_bytes bigint, payload_sha256 binary, media_sha256 binary, media_bytes bigint, chunks array<binary>"


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))


def _chunks(samples: bytes) -> list[bytes]:
    ends = gear_cuts(np.frombuffer(samples, np.uint8))
    return [samples[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_lists(docs: DataFrame) -> DataFrame:
    """Per row: the medium's digest and ordered list of chunk digests. No payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body, n = payload(text)
                media = to_wav(body)
                rows.append((doc_id, n, hashlib.sha256(body).digest(), hashlib.sha256(media).digest(), len(media), [hashlib.sha256(c).digest() for c in _chunks(body)]))
            yield _batch(rows, doc_id=pa.int64(), n_bytes=pa.int64(), payload_sha256=pa.binary(), media_sha256=pa.binary(), media_bytes=pa.int64(), chunks=pa.list_(pa.binary()))

    return docs.mapInArrow(run, LISTS)


def train_dictionary(docs: DataFrame, rows: int, chunks: int = DICT_CHUNKS) -> bytes:
    """A compression dictionary from the first chunks of at most that many distinct texts; empty if there are too few."""
    share = min(1.0, (1.5 * chunks + 100) / max(rows, 1))
    hashed = docs.select("text", F.xxhash64("text", F.lit(5)).alias("h")).where(F.pmod("h", F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    once = hashed.groupBy("h").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(h, _chunks(payload(t)[0])[0]) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], h=pa.int64(), body=pa.binary())

    near = once.select("h", "text").mapInArrow(run, "h bigint, body binary").orderBy(F.pmod("h", F.lit(1 << 20)), "h").limit(chunks)
    found = [bytes(r["body"]) for r in near.collect()]
    if len(found) < 100:
        return b""
    return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, found)) // 8), found).as_bytes()


def media_payloads(docs: DataFrame, dictionary: bytes, wave: int = 0, waves: int = 1) -> DataFrame:
    """(media_sha256, media_bytes, head, z): the header and the compressed chunks of each medium of a wave (by its digest), once for each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        seen: set[bytes] = set()
        for b in tidied(batches):
            rows = []
            for text in b.column(1).to_pylist():
                body = payload(text)[0]
                media = to_wav(body)
                d = hashlib.sha256(media).digest()
                if d[0] % waves != wave or d in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                rows.append((d, len(media), media[:HEADER], [press.compress(c) for c in _chunks(body)]))
            yield _batch(rows, media_sha256=pa.binary(), media_bytes=pa.int64(), head=pa.binary(), z=pa.list_(pa.binary()))

    return docs.mapInArrow(run, "media_sha256 binary, media_bytes bigint, head binary, z array<binary>")


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    if not raw:
        return None
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def store_media(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, bytes]:
    """Write (lists, shared, store): lists for each input row, homes of shared chunks, payloads for each distinct medium."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    lists = scratch.keep(chunk_lists(src), "lists")
    places = _places(lists)
    shared = scratch.keep(places.groupBy("digest").agg(F.min(F.struct("media_sha256", "at")).alias("home"), F.count("at").alias("n")).where("n > 1").drop("n"), "shared")
    marks = (
        places.join(shared, "digest").withColumn("own", F.expr("home = struct(media_sha256, at)"))
        .groupBy("media_sha256").agg(F.expr("collect_set(at) filter (where own)").alias("lent"), F.expr("collect_set(at) filter (where not own)").alias("borrowed"))
    )
    dictionary = train_dictionary(src, lists.count())
    waves = []
    for i in range(WAVES):  # payloads are shuffled a part at a time, so that few are on disk twice
        bodies = media_payloads(src, dictionary, i, WAVES).groupBy("media_sha256").agg(F.first("media_bytes").alias("media_bytes"), F.first("head").alias("head"), F.first("z").alias("z"))
        part = bodies.join(marks, "media_sha256", "left").selectExpr(
            "media_sha256", "media_bytes", "head", "size(z) as n_chunks",
            "filter(transform(z, (x, i) -> struct(i as at, x as z, coalesce(array_contains(lent, i), false) as lent)), p -> not coalesce(array_contains(borrowed, p.at), false)) as parts",
        )
        waves.append(scratch.keep(part, "store"))
        del bodies, part
        release_shuffles(docs.sparkSession)
    return lists, shared, reduce(DataFrame.unionByName, waves), dictionary


def _places(lists: DataFrame) -> DataFrame:
    """(media_sha256, at, digest) of each chunk of each distinct medium."""
    return lists.groupBy("media_sha256").agg(F.first("chunks").alias("chunks")).select("media_sha256", F.posexplode("chunks").alias("at", "digest"))


def read_media(lists: DataFrame, shared: DataFrame, store: DataFrame, dictionary: bytes) -> DataFrame:
    """Per distinct medium: payload_bytes, payload_sha256, tail_crc32, feature, from the chunks of the store."""
    whole = store.where("size(parts) = n_chunks").selectExpr("media_sha256", "media_bytes", "head", "transform(parts, p -> struct(p.at, p.z)) as parts")
    lent = store.select("media_sha256", F.expr("explode(filter(parts, p -> p.lent))").alias("p")).select(F.struct("media_sha256", "p.at").alias("home"), "p.z")
    offered = shared.join(lent, "home").select("digest", "z")
    borrowed = _places(lists).join(shared, "digest").where("home != struct(media_sha256, at)").select("media_sha256", "at", "digest")
    filled = borrowed.join(offered, "digest").selectExpr("media_sha256", "cast(null as bigint) as media_bytes", "cast(null as binary) as head", "at", "z")
    own = store.where("size(parts) < n_chunks").select("media_sha256", "media_bytes", "head", F.expr("explode_outer(parts)").alias("p")).select("media_sha256", "media_bytes", "head", "p.at", "p.z")
    gathered = own.unionByName(filled).groupBy("media_sha256").agg(F.max("media_bytes").alias("media_bytes"), F.max("head").alias("head"), F.expr("array_sort(collect_list(struct(at, z)) filter (where at is not null))").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for b in tidied(batches):
            rows = []
            for i in range(b.num_rows):
                digest, size, head, parts = (b.column(c)[i].as_py() for c in range(4))
                media = b"".join([head, *(unpress.decompress(p["z"]) for p in parts)])
                if len(media) != size or hashlib.sha256(media).digest() != digest:
                    raise ValueError(f"medium {digest.hex()} can't be reconstructed")
                body = from_wav(media)
                rows.append((digest, len(body), hashlib.sha256(body).digest(), zlib.crc32(body[-ALIGN:]), feature(body)))
            yield _batch(rows, media_sha256=pa.binary(), payload_bytes=pa.int64(), payload_sha256=pa.binary(), tail_crc32=pa.int64(), feature=pa.string())

    return whole.unionByName(gathered).mapInArrow(run, "media_sha256 binary, payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a medium, read it back, and return its digests and features for each row."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "media")
    lists, shared, store, dictionary = store_media(docs, scratch)
    release_shuffles(spark)
    back = read_media(lists, shared, store, dictionary)
    rows = lists.select("doc_id", "n_bytes", F.col("payload_sha256").alias("written_sha256"), "media_sha256", "media_bytes")
    joined = rows.join(back, "media_sha256", "left")
    intact = F.col("payload_sha256").eqNullSafe(F.col("written_sha256"))
    return joined.select(
        "doc_id", "n_bytes", "payload_bytes",
        F.when(intact, F.lower(F.hex("payload_sha256"))).otherwise(F.raise_error(F.lit("a payload read back differs"))).alias("payload_sha256"),
        "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature",
    )
