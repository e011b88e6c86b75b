"""Parity-sketch join: documents whose word-shingle sets have a Jaccard similarity of at least a threshold.

A shingle set of n elements can only link with sets whose symmetric difference is at most n/4 (similarity 0.8).
Sets fall into bands by size; a set also joins the band above when a partner there is possible. In a band each
shingle is XOR-hashed into one of many 64-bit segments. A differing shingle spoils one segment at most, so of
any d+1 non-empty segments of a set one is left unspoiled by a partner at distance d. Each set therefore emits
its d+1 rarest segments (by corpus-wide counts of hashed shingles, which gives all sets the same order), and
linked sets share an emitted segment: the pigeonhole join loses no link. A set with too few non-empty segments
emits single shingles, by the same argument, in a namespace that such sets share.

A few holders of a segment give all their pairs; of these, sizes and parity bit sketches (whose Hamming distance
never exceeds the symmetric difference) rule most out. More holders are joined to the first of their run by size;
each task joins its own entries first and passes on a few for each size step, so a segment held by very many
sets does not gather in one task. The components of what is left are candidate families.

Each family has a centre, of a few members the one nearest to the others. First every member is verified against the
centre alone, on the whole sets; most families are settled by that. Members that don't link with the centre are open.
Where a family has many of them, all its members are verified against some of the open ones, too, and those outside
the largest component of the links found so far stay open.
Open members are cut into blocks of bounded size by band, and so are the settled ones; a task takes two blocks, at
least one of open members, rules pairs out by size and Hamming distance and verifies the others. Pairs already
connected are skipped, and each task returns a spanning forest of verified links; the components of all links are the
answer. Work and shuffle thus grow with the members and with open times all members / 512; only a family of very many
sets that nearly link, but don't, costs the square. Equal sets count once throughout.

Null, empty and white-space texts have an empty set and link with nothing. Repeated rows are members of one
class. A null doc_id is kept and never is a component's name unless nothing else is there. An empty table gives
an empty result. Only ``doc_id`` and ``text`` are read; ``keep_one`` keeps all columns, whatever their names. Very long
texts are hashed block by block; a task holds their shingle sets (8 bytes a word), two blocks of some 8 MB or two single
sets at a time. Hashes have 64 bits and set fingerprints 64; a chance collision is the only inexactness.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm import textcore as tc
from paneloom.llm.graph import components
from paneloom.session import Scratch, release_shuffles, ship_package

SHINGLE = 5
PERCENT = 80
CELLS = 1 << 20
BLOCK = 512
FEW = 8
PROBES = 16  # members of a family among which its centre is chosen, twice as many at most as a rule
SEEN = 100_000  # fingerprints that a task remembers, some 10 MB; a set met twice is dropped by the reducer
_LAST = np.iinfo(np.int64).max
SPARSE_BAND = 64  # below this size each shingle has a segment of its own


def most_differing(n: int, percent: int = PERCENT) -> int:
    """Greatest symmetric difference of a set of n elements with any set it links to."""
    return n * (100 - percent) // percent


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """The bands (by bit length) in which a set of n elements looks for partners."""
    top = n * 100 // percent
    return [n.bit_length()] + ([top.bit_length()] if top.bit_length() > n.bit_length() else [])


def fingerprint(s: np.ndarray) -> int:
    """64 bits that equal sets share."""
    if not len(s):
        return 0
    return int(tc.mix(np.array([np.bitwise_xor.reduce(tc.mix(s + np.uint64(0x1234567))) + np.uint64(len(s))], np.uint64))[0] ^ np.add.reduce(s))


def signatures(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The emitted segment signatures of a set: in each of its bands the d+1 rarest non-empty segments."""
    n, out = len(s), []
    if not n:
        return np.zeros(0, np.uint64)
    d = most_differing(n, percent)
    rare = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    for band in bands(n, percent):
        if (1 << band) <= SPARSE_BAND:
            out.append(_rarest(tc.mix(s + np.uint64(1)), rare, d + 1))
            continue
        where = (tc.mix(s ^ np.uint64(0xA5A5A5A5)) >> np.uint64(20)) & np.uint64((1 << band) - 1)
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(where[order].astype(np.int64)) != 0]))
        word = np.bitwise_xor.reduceat(tc.mix(s[order]), first)
        least = np.minimum.reduceat(rare[order], first)
        filled = word != 0
        sig = tc.mix(word[filled] + where[order][first][filled] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))
        out.append(_rarest(sig, least[filled], d + 1))
        if len(sig) < d + 1:
            out.append(_rarest(tc.mix(s + np.uint64(1_000_003 * band)), rare, d + 1))
    return np.unique(np.concatenate(out))


def _rarest(sig: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    return sig if len(sig) <= k else sig[np.lexsort((sig, count))[:k]]


def parity_sketch(s: np.ndarray, words: int) -> np.ndarray:
    """Parity bits of a set in words 64-bit words (a power of two); halves fold by XOR to the next smaller size."""
    bit = (tc.mix(s ^ np.uint64(0x5A5A5A5A)) & np.uint64(words * 64 - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def sketch_words(n: int) -> int:
    """64-bit words of the sketch in the band of a set of n elements: two to four bits for each."""
    return 1 << max(0, int(2 * n - 1).bit_length() - 6)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same > 0 and 100 * same >= percent * (len(a) + len(b) - same)


def spanning_links(left: list[int], right: list[int], sets: list[np.ndarray], percent: int = PERCENT, settled: Sequence[int] = ()) -> list[tuple[int, int]]:
    """Verified links that connect all that the links of left x right connect (indices into sets); settled ones are connected from the start.

    First each set against the one that lies nearest to the others, then every pair that is not connected yet
    and that size and Hamming distance leave possible, nearest first.
    """
    members = sorted({*left, *right})
    pos = {m: i for i, m in enumerate(members)}
    size = np.array([len(sets[m]) for m in members], np.int64)
    words = sketch_words(int(size.max()))
    sk = np.stack([parity_sketch(sets[m], words) for m in members])
    root = np.arange(len(members))
    for m in settled:
        root[pos[m]] = pos[settled[0]]
    links: list[tuple[int, int]] = []

    def try_link(i: int, j: int) -> None:
        if root[i] != root[j] and linked(sets[members[i]], sets[members[j]], percent):
            links.append((members[i], members[j]))
            root[root == root[j]] = root[i]

    def far(i: int, js: np.ndarray) -> np.ndarray:
        return np.bitwise_count(sk[js] ^ sk[i]).sum(axis=1, dtype=np.int64)

    r = np.array([pos[m] for m in right])
    probe = np.linspace(0, len(r) - 1, min(16, len(r))).astype(np.int64)
    first = pos[left[int(np.argmin([far(pos[m], r[probe]).sum() for m in left]))]] if len(left) > 2 else pos[left[0]]
    for i in [first, *(pos[m] for m in left if pos[m] != first)]:
        js = r[(root[r] != root[i])]
        js = js[js != i]
        if not len(js):
            continue
        low, high = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
        js = js[100 * low >= percent * high]
        dist = far(i, js)
        fits = dist * (100 + percent) <= (100 - percent) * (size[js] + size[i])
        for j in js[fits][np.argsort(dist[fits], kind="stable")]:
            try_link(i, int(j))
    return links


# --- the plan -------------------------------------------------------------------------------------------------


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else np.asarray(a, np.int64))


def _facts(src: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, fp, sketch) of every row, and counts of all shingles by hashed cell, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for b in tc.tidied(batches):
            n, fp, sketch = [], [], []
            for words in tc.texts_words(b.column(2), lower=True):
                s = tc.shingle_set(words, SHINGLE)
                n.append(len(s))
                fp.append(fingerprint(s))
                sketch.append(parity_sketch(s, sketch_words(len(s))).tobytes() if len(s) else None)
                np.add.at(cells, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], _i64(np.array(n, np.int64)), _i64(np.array(fp, np.uint64)), none, pa.array(sketch, pa.binary())], names)
        for k, part in enumerate(np.split(cells, CELLS_PARTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names)

    names = ["doc_id", "th", "n", "fp", "part", "body"]
    written = scratch.keep(src.mapInArrow(run, "doc_id bigint, th bigint, n bigint, fp bigint, part int, body binary"), "facts")
    return written.where("part is null").selectExpr("doc_id", "th", "n", "fp", "body as sketch"), written.where("part is not null").selectExpr("part", "body as cells")


CELLS_PARTS = 64


def _cell_counts(cells: DataFrame) -> np.ndarray:
    """The corpus-wide counts: 2**20 cells at any corpus size, scaled to 32 bits (8 MB at most to the driver)."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in group.column("cells").combine_chunks())
        return pa.table({"part": group.column("part").slice(0, 1), "cells": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    out = np.zeros(CELLS, np.int64)
    size = CELLS // CELLS_PARTS
    for row in cells.groupBy("part").applyInArrow(add, "part int, cells binary").collect():
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["cells"], "<i8")
    while out.max(initial=0) >= 1 << 31:
        out >>= 1
    return out.astype(np.uint32)


ENTRY = np.dtype([("sig", "<u8"), ("fp", "<u8"), ("n", "<u4")])


_THIN = np.uint32(1 << 31)  # set in n: entries of this signature were left out by a task


def _candidates(e: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: those that stand for all; pairs that may link; edges that connect what may link.

    Up to FEW holders of a signature give all pairs that their sizes allow. More of them are taken by size and
    cut where the sizes of neighbours rule out a link (then nothing on either side of the gap links); each is
    joined to the first of its run. Of these the smallest and the largest of each size step of a tenth stand for
    the holders: whatever may link with one left out may link with one of those.
    """
    e = e[np.lexsort((~e["n"] & _THIN, e["fp"], e["n"] & ~_THIN, e["sig"]))]  # of equal entries a marked one stays
    none = np.zeros((0, 2), np.uint64)
    if not len(e):
        return e, none, none
    e = e[np.concatenate([[True], (e["sig"][1:] != e["sig"][:-1]) | (e["fp"][1:] != e["fp"][:-1])])]
    new = np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]])
    at = np.flatnonzero(new)
    m = np.repeat(np.diff(np.append(at, len(e))), np.diff(np.append(at, len(e))))
    thin = np.repeat(np.maximum.reduceat(e["n"] & _THIN, at) > 0, m[at])
    n = (e["n"] & ~_THIN).astype(np.int64)
    few = (m <= FEW) & ~thin
    pairs = []
    for gap in range(1, FEW):  # each with the one gap places on, in the same group
        i = np.flatnonzero(few[:-gap] & (e["sig"][gap:] == e["sig"][:-gap]) & (100 * n[:-gap] >= percent * n[gap:])) if len(e) > gap else np.zeros(0, np.int64)
        pairs.append(np.stack([e["fp"][i], e["fp"][i + gap]], axis=1))
    run = new | np.concatenate([[True], 100 * n[:-1] < percent * n[1:]])
    head = np.maximum.accumulate(np.where(run, np.arange(len(e)), 0))
    i = np.flatnonzero(~few & ~run)
    edges = np.stack([e["fp"][head[i]], e["fp"][i]], axis=1)
    step = np.floor(np.log(np.maximum(n, 1)) / np.log(1.1)).astype(np.int64)
    edge = new[1:] | (step[1:] != step[:-1]) | run[1:]
    stands = few | np.concatenate([[True], edge]) | np.concatenate([edge, [True]])
    e["n"] = np.where(few, e["n"], e["n"] | _THIN)
    tidy = lambda x: np.unique(np.sort(x, axis=1), axis=0)
    return e[stands], tidy(np.concatenate(pairs)), tidy(edges)


def may_link(n_a: int, a: bytes, n_b: int, b: bytes, percent: int = PERCENT) -> bool:
    """False if sizes or the Hamming distance of the parity sketches rule a link out."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (100 - percent) * (n_a + n_b)


def _families(src: DataFrame, facts: DataFrame, counts: np.ndarray, parts: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all sets that share an emitted segment and may link."""
    spark = src.sparkSession
    held = spark.sparkContext.broadcast(counts)  # 4 MB at any corpus size
    names = ["part", "a", "b", "pair", "blob"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        entries: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            e, pairs, edges = _candidates(np.concatenate(entries))
            entries.clear()
            part = (e["sig"] >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            e = e[order]
            full = [p for p in range(parts) if cut[p + 1] > cut[p]]
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), none, none, pa.nulls(len(full), pa.bool_()), pa.array([e[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary())], names)
            for found, kind in ((pairs, True), (edges, False)):
                if len(found):
                    where = (tc.mix(found[:, 0].copy()) % np.uint64(parts)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(where), _i64(found[:, 0]), _i64(found[:, 1]), pa.array([kind] * len(found)), pa.nulls(len(found), pa.binary())], names)

        for batch in tc.tidied(batches):
            for words in tc.texts_words(batch.column(0), lower=True):
                s = tc.shingle_set(words, SHINGLE)
                fp = fingerprint(s)
                if not len(s) or fp in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                sig = signatures(s, counts)
                own = np.empty(len(sig), ENTRY)
                own["sig"], own["fp"], own["n"] = sig, fp, len(s)
                entries.append(own)
                size += len(sig)
                if size > 400_000:
                    yield from flush()
                    size = 0
        if entries:
            yield from flush()
        tc.tidy()

    def reduce(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), ENTRY) for x in group.column("blob").combine_chunks() if x.is_valid]
        _, pairs, edges = _candidates(np.concatenate(blobs) if blobs else np.zeros(0, ENTRY))
        old = group.filter(pa.compute.is_valid(group.column("a"))).select(["a", "b", "pair"])
        new = [pa.table({"a": x.view(np.int64)[:, 0], "b": x.view(np.int64)[:, 1], "pair": pa.array([kind] * len(x), pa.bool_())}) for x, kind in ((pairs, True), (edges, False)) if len(x)]
        out = pa.concat_tables([old.cast(EDGE), *(t.cast(EDGE) for t in new)])
        tc.tidy()
        return out

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_link(*row) for row in zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    shipped = src.select("text").mapInArrow(emit, "part int, a bigint, b bigint, pair boolean, blob binary")
    found = scratch.keep(shipped.groupBy("part").applyInArrow(reduce, "a bigint, b bigint, pair boolean").groupBy("a", "b").agg(F.bool_and("pair").alias("pair")), "found")
    release_shuffles(spark)
    sketches = facts.where("n > 0").groupBy("fp").agg(F.max("n").alias("n"), F.min("sketch").alias("sk"))
    left = found.where("pair").join(sketches.selectExpr("fp as a", "n as na", "sk as ska"), "a")
    both = left.join(sketches.selectExpr("fp as b", "n as nb", "sk as skb"), "b").select("a", "b", "na", "ska", "nb", "skb")
    return found.where("not pair").select("a", "b").unionByName(both.mapInArrow(near, "a bigint, b bigint"))


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pair", pa.bool_())])


def central(members: list[dict]) -> int:
    """Of (fp, n, sk) the fingerprint whose parity sketch is nearest to the others, by distance for each element."""
    if len(members) < 3:
        return min(m["fp"] for m in members)
    sk = [np.frombuffer(m["sk"], np.uint64) for m in members]
    width = min(map(len, sk))
    folded = []
    for x in sk:
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        folded.append(x)
    table = np.stack(folded)
    cost = [int(np.bitwise_count(table ^ row).sum(dtype=np.int64)) for row in table]
    return min(zip(cost, (m["fp"] for m in members), strict=True))[1]


def _verified(src: DataFrame, facts: DataFrame, family: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links (a, b) between fingerprints that connect all linked sets."""
    # one row of documents for each fingerprint in a family
    reps = facts.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("o"), "th", "doc_id")).alias("r"), F.max("n").alias("n"), F.min("sketch").alias("sk"))
    members = scratch.keep(family.join(reps, family["id"] == reps["fp"]).selectExpr("label", "fp", "r.doc_id as rep", "r.th as rep_th", "n", "sk"), "members")
    sizes = scratch.keep(members.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    inside = members.join(sizes, "label")
    probes = inside.where(f"pmod(xxhash64(fp, label), greatest(1L, m div {PROBES})) = 0").groupBy("label").agg(F.collect_list(F.struct("fp", "n", "sk")).alias("x"))

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([central(x) for x in b.column(1).to_pylist()], pa.int64())], ["label", "centre"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in tc.tidied(batches):
            keep, blob = [], []
            want = b.column(2).to_pylist()
            for i, words in enumerate(tc.texts_words(b.column(0), lower=True)):
                if want[i] in seen:
                    continue  # a row that repeats id and text
                s = tc.shingle_set(words, SHINGLE)
                if fingerprint(s) == want[i] & (2**64 - 1):
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(want[i])
                    keep.append(i)
                    blob.append(s.tobytes())
            rest = pa.RecordBatch.from_arrays(b.columns[1:], b.schema.names[1:]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(blob, pa.binary())], ["label", "fp", "n", "m", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.tidied(batches):
            ok = []
            for fp, head, s, hs in zip(*(b.column(c) for c in range(1, 5)), strict=True):
                same = fp.equals(head)
                ok.append(same or (head.is_valid and linked(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(hs.as_buffer(), np.uint64))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ok, pa.bool_())], ["label", "fp", "head", "settled"])

    chosen = scratch.keep(probes.mapInArrow(centres, "label bigint, centre bigint"), "centres")
    fetched = src.join(inside, (src["th"] == inside["rep_th"]) & src["doc_id"].eqNullSafe(inside["rep"])).select("text", "label", "fp", "n", "m")
    held = scratch.keep(fetched.mapInArrow(sets, "label bigint, fp bigint, n bigint, m bigint, s binary").dropDuplicates(["fp"]), "sets")
    release_shuffles(src.sparkSession)
    heads = scratch.keep(held.alias("h").join(chosen.alias("c"), F.expr("h.label = c.label and h.fp = c.centre")).selectExpr("h.label as label", "fp as head", "s as hs"), "heads")
    star = scratch.keep(held.join(heads, "label", "left").select("label", "fp", "head", "s", "hs").mapInArrow(compare, "label bigint, fp bigint, head bigint, settled boolean"), "star")
    links = star.where("settled and fp != head").selectExpr("head as a", "fp as b")
    still = scratch.keep(star.where("not settled").join(sizes.where("m > 2"), "label", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("k")), "open")
    if still.isEmpty():
        return links
    state = star.select("label", "fp", "settled")
    large = still.where(F.col("k") > BLOCK)
    if not large.isEmpty():
        more, settled = _settle(held, star, large, scratch)
        links = links.unionByName(more)
        state = state.alias("a").join(settled.alias("b"), F.expr("a.fp = b.fp"), "left").selectExpr("a.label as label", "a.fp as fp", "coalesce(b.settled, a.settled) as settled")
    # written, so that a family isn't kept together in one task of what follows
    rest = scratch.keep(held.join(state, ["label", "fp"]).join(still.select("label"), "label", "left_semi"), "rest")
    return links.unionByName(scratch.keep(_open_links(rest), "links"))


def _settle(held: DataFrame, star: DataFrame, large: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For families with many open members: links (a, b) of all their members with some open ones, and (fp, settled): those in the family's largest component."""
    inside = held.join(large, "label")
    opened = inside.join(star.where("not settled").select("label", "fp"), ["label", "fp"], "left_semi")
    probes = scratch.keep(opened.where(f"pmod(xxhash64(fp, label, 2), greatest(1L, k div {PROBES})) = 0").groupBy("label").agg(F.collect_list(F.struct("fp", "s")).alias("ps")), "probes")

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.tidied(batches):
            a, z = [], []
            for fp, s, ps in zip(*(b.column(c) for c in range(3)), strict=True):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                for p in ps.as_py():
                    if p["fp"] != fp.as_py() and linked(np.frombuffer(p["s"], np.uint64), own):
                        a.append(p["fp"])
                        z.append(fp.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    more = scratch.keep(inside.join(probes, "label").select("fp", "s", "ps").mapInArrow(against, "a bigint, b bigint"), "more")
    near = star.join(large.select("label"), "label", "left_semi")
    parts = components(more.unionByName(near.where("settled and fp != head").selectExpr("head as a", "fp as b")), scratch).withColumnRenamed("label", "part")
    named = scratch.keep(near.join(parts, near["fp"] == parts["id"], "left").select("label", "fp", F.coalesce("part", "fp").alias("part")), "named")
    top = named.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max_by("part", F.struct("n", "part")).alias("top"))
    return more, scratch.keep(named.join(top, "label").select("fp", (F.col("part") == F.col("top")).alias("settled")), "settled")


def _open_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of open members with open and with settled ones, a spanning forest for each task; rows: label, fp, n, s, settled."""
    rows = rows.withColumn("band", F.length(F.bin("n")))
    sizes = rows.groupBy("label", "band", "settled").agg(F.count("fp").alias("k"), F.sum("n").alias("elements"))
    nb = f"cast(greatest(ceil(k / {BLOCK}), ceil(elements / 1000000)) as int)"
    listed = lambda flag: F.expr(f"map_from_entries(collect_list(struct(band, {nb})) filter (where settled = {flag}))")
    plan = sizes.groupBy("label").agg(listed("false").alias("nu"), listed("true").alias("ns"))
    placed = rows.join(plan, "label").withColumn("block", F.expr("cast(pmod(xxhash64(fp), if(settled, ns[band], nu[band])) as int)"))
    # A task is two blocks of open members (kind 0), of one band or of a band and the next, or a block of open and one of
    # settled members (kind 1), of one band or of neighbouring ones. side: 1 left, 2 right, 3 both.
    may = {"band + 1": f"n * 100 div {PERCENT} >= shiftleft(1L, band)", "band": "true", "band - 1": f"n * {PERCENT} <= 100 * (shiftleft(1L, band - 1) - 1)"}
    each = lambda nb, other, body: f"if({may[other]} and {nb}[{other}] is not null, transform(sequence(0, {nb}[{other}] - 1), j -> {body}), array())"
    key = lambda kind, x, y, lo, hi, side: f"struct({kind} as kind, {x} as x, {y} as y, {lo} as lo, {hi} as hi, {side} as side)"
    among = [
        each("nu", "band", key(0, "band", "band", "least(block, j)", "greatest(block, j)", "if(j = block, 3, if(block < j, 1, 2))")),
        each("nu", "band + 1", key(0, "band", "band + 1", "block", "j", 1)), each("nu", "band - 1", key(0, "band - 1", "band", "j", "block", 2)),
    ]
    out = [each("ns", other, key(1, "band", other, "block", "j", 1)) for other in may]
    back = [each("nu", other, key(1, other, "band", "j", "block", 2)) for other in may]
    tasks = f"if(settled, concat({', '.join(back)}), concat({', '.join([*among, *out])}))"
    paired = placed.select("label", "fp", "s", "settled", F.expr(f"explode({tasks})").alias("t")).select("label", "fp", "s", "settled", "t.*")

    def verify(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        _, once = np.unique(fps, return_index=True)
        fps = fps[once]
        body = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("s").combine_chunks().take(pa.array(once))]
        side, settled = (group.column(c).to_numpy()[once] for c in ("side", "settled"))
        left, right = (np.flatnonzero(side & k).tolist() for k in (1, 2))
        links = spanning_links(left, right, body, settled=np.flatnonzero(settled).tolist()) if left and right else []
        tc.tidy()
        return pa.table({"a": pa.array([int(fps[i]) for i, _ in links], pa.int64()), "b": pa.array([int(fps[j]) for _, j in links], pa.int64())})

    task = ["label", "kind", "x", "y", "lo", "hi"]
    # dealt by task: a partitioning by family alone would do for the groups, but puts a family in one place
    return paired.repartition(*task).groupBy(*task).applyInArrow(verify, "a bigint, b bigint")


def _classes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, th (text hash), n (set size) and c, the name of its class within this run (null: empty set)."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "neardup")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    facts, cells = _facts(src, scratch)
    counts = _cell_counts(cells)
    # emitted signatures are about a third of the shingles; a part holds some 400,000 of them
    total = facts.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 0.35 / 400_000) + 1)
    links = _verified(src, facts, components(_families(src, facts, counts, parts, scratch), scratch), scratch)
    release_shuffles(spark)
    labels = components(links, scratch).withColumnRenamed("label", "component")
    return facts.join(labels, facts["fp"] == labels["id"], "left").select("doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("component", "fp")).alias("c"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included)."""
    rows = _classes(docs)
    # an empty set is its own component; the others take the smallest doc_id of theirs
    names = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("name")).withColumnRenamed("c", "c2")
    names = Scratch(docs.sparkSession, "neardup").keep(names, "names")  # written, so that the join may split a large class
    return rows.join(names, F.col("c") == F.col("c2"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id (ties: smallest text hash). Documents with an empty set stay; all columns stay."""
    rows = _classes(docs)
    first = rows.where("c is not null").groupBy("c").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("o"), "th", "doc_id")).alias("f")).select("f.doc_id", "f.th")
    chosen = first.unionByName(rows.where("c is null").select("doc_id", "th").distinct()).selectExpr("doc_id as kept_id", "th as kept_th")
    # the input's columns travel in one struct, so no name of theirs can clash with those of the join
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    held = held.select("row", F.col("row.doc_id").cast("bigint").alias("key"), F.xxhash64("row.text").alias("text_hash"))
    found = held.join(chosen, F.col("key").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_th")), "left_semi")
    return found.dropDuplicates(["key", "text_hash"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """The same rows from all pairs of documents that share a shingle, and the closure of their links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, md5(array_to_string(w[i + 1 : i + {SHINGLE}], ' ')) AS h FROM (SELECT rid, w, unnest(range(greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS (SELECT a.rid AS x, b.rid AS y FROM s a JOIN s b USING (h) JOIN n na ON na.rid = a.rid JOIN n nb ON nb.rid = b.rid WHERE a.rid <> b.rid GROUP BY a.rid, b.rid, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(e.doc_id) FROM r JOIN d e ON e.rid = r.y WHERE r.x = d.rid), doc_id)) AS component_id
FROM d LEFT JOIN n USING (rid)
"""
