"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched, encoded, and decoded.

A text longer than ``chunk_chars`` is cut into chunks that overlap. Each chunk is pre-tokenised as a row of
its own, wherever Spark puts it. Two neighbouring chunks are stitched at a position inside their overlap
where both scans have a pre-token boundary that follows a character other than white space: from there on
the scans agree, and no look-ahead reaches back over it. The pieces between stitches are then encoded one by
one, which gives the ids of the whole text. Where an overlap has no such position (a run without any break),
the neighbours are joined and scanned as one. Decoding concatenates the raw bytes of the ids.

Null and empty texts have no ids (n_tokens 0, digests of zero bytes). An empty table gives an empty result. A very
long text is cut at once, its chunks are scanned anywhere, and one task gathers and encodes them piece by piece: that
task holds the text. Rows are never dropped or merged; repeated rows give repeated results. Only ``doc_id`` and ``text`` of the input are read, so other columns may
have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.session import ship_package

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Codec:
    """The encoder of one rank file: ids of a text, bytes of ids."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.scanner = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def bounds(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of text."""
        return np.fromiter((m.end() for m in self.scanner.finditer(text)), dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoding.encode_ordinary(text)
        except BaseException as e:  # the native scanner gives up on runs of white space of a megabyte
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            single = self.encoding._core_bpe.encode_single_piece
            return [i for m in self.scanner.finditer(text) for i in single(m.group().encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def split_chunks(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, str]]:
    """(start, text) of overlapping chunks that cover the text."""
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(len(text), 1), chunk)]


def _stitch(ends: np.ndarray, text: str, nxt_start: int, nxt_ends: np.ndarray) -> int | None:
    """A position in the next chunk where both scans have a safe boundary; positions count from this chunk's start."""
    seen = ends[ends < len(text)]  # the last pre-token may go on beyond the chunk
    common = np.intersect1d(seen[seen > nxt_start], nxt_ends + nxt_start)
    for q in common:
        before, after = text[q - 1], text[q]
        if not before.isspace() and (after in " \n" or before.isalnum()):
            return int(q)
    return None


def stitch_pieces(chunks: list[tuple[int, str]], ends: list[np.ndarray], rescan) -> list[str]:
    """Pieces of the text, cut where the scans of neighbouring chunks resynchronise; their concatenation is the text.

    Where they don't, the next chunk is joined and the piece scanned again; after each failure in a row twice as many
    chunks are joined at once, so a long run without a break is scanned a few times over, not once for each chunk.
    """
    pieces: list[str] = []
    at, text, own, begin = chunks[0][0], chunks[0][1], ends[0], 0
    i, joins = 1, 1
    while i < len(chunks):
        start, body = chunks[i]
        q = _stitch(own, text, start - at, ends[i])
        if q is None or q <= begin:
            taken = chunks[i : i + joins]
            upto = [*(s - t for (t, _), (s, _) in zip(taken, taken[1:], strict=False)), None]
            text = text[: start - at] + "".join(b[:n] for (_, b), n in zip(taken, upto, strict=True))
            own = rescan(text[begin:]) + begin
            i, joins = i + len(taken), 2 * joins
            continue
        pieces.append(text[begin:q])
        text, own, begin, at = body, ends[i], q - (start - at), start
        i, joins = i + 1, 1
    pieces.append(text[begin:])
    return pieces


def _digests(c: Codec, pieces: list[str]) -> tuple[int, str, str]:
    n, ids_hash, raw_hash = 0, hashlib.sha256(), hashlib.sha256()
    for piece in pieces:
        ids = c.encode(piece)
        n += len(ids)
        ids_hash.update(np.asarray(ids, dtype="<u4").tobytes())
        raw_hash.update(c.decode(ids))
    return n, ids_hash.hexdigest(), raw_hash.hexdigest()


def _table(doc_ids, rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its whole text."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield _table(b.column(0), [_digests(c, [t or ""]) for t in b.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, doc_id, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                parts = split_chunks(text, chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * len(parts), pa.int64()), pa.array([doc_id] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.string())],
                    ["rid", "doc_id", "start", "body"],
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            ends = [c.bounds(t).astype("<i4").tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.binary())], ["rid", "doc_id", "start", "body", "ends"])

    def join(group: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        rows = sorted(zip(group.column("start").to_pylist(), group.column("body").to_pylist(), group.column("ends").to_pylist(), strict=True), key=lambda r: r[0])
        pieces = stitch_pieces([r[:2] for r in rows], [np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows], c.bounds)
        return pa.Table.from_batches([_table(group.column("doc_id").slice(0, 1).to_pylist(), [_digests(c, pieces)])])

    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = src.where(~is_long).mapInArrow(whole, SCHEMA)
    long = (
        src.where(is_long)
        .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
        .mapInArrow(cut, "rid bigint, doc_id bigint, start bigint, body string")
        .repartition("rid", "start")
        .mapInArrow(scan, "rid bigint, doc_id bigint, start bigint, body string, ends binary")
        .groupBy("rid")
        .applyInArrow(join, SCHEMA)
    )
    return short.unionByName(long)
