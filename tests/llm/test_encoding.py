from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paneloom.llm import bpe, packing
from tests.llm.helpers import ODD, empty, extra, frame

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'s", "'re", "1", "é", "。", "$", "\t", "語", " \n", "\x1c", "　"]), max_size=120), st.integers(3, 20), st.integers(2, 14))
def test_pieces_give_the_ids_of_the_whole(parts, chunk, overlap):
    text, c = "".join(parts), bpe.codec(RANKS, P.PATTERN)
    chunks = bpe.split_chunks(text, chunk, overlap)
    pieces = bpe.stitch_pieces(chunks, [c.bounds(b) for _, b in chunks], c.bounds)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in c.encode(p)] == c.encoding.encode_ordinary(text)


def test_a_run_without_a_break_is_not_scanned_again_and_again():
    c, scanned = bpe.codec(RANKS, P.PATTERN), []

    def rescan(text):
        scanned.append(len(text))
        return c.bounds(text)

    text = "a b" + "x" * 60_000 + " c d"
    chunks = bpe.split_chunks(text, 100, 20)
    pieces = bpe.stitch_pieces(chunks, [c.bounds(b) for _, b in chunks], rescan)
    assert "".join(pieces) == text and sum(scanned) < 6 * len(text)
    assert [i for p in pieces for i in c.encode(p)] == c.encoding.encode_ordinary(text)


def test_encode_as_library(spark, library):
    rng = random.Random(4)
    texts = [*ODD, " ".join(rng.choice(["the", "don't", "naïve", "42", "--", "\n"]) for _ in range(9000))]
    got = {r["doc_id"]: r for r in bpe.encode_documents(extra(frame(spark, texts)), RANKS, P.PATTERN, 1000, 60).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), RANKS, P.PATTERN).count() == 0


def test_long_white_space_is_encoded():
    c = bpe.codec(RANKS, P.PATTERN)
    for text in (" " * 1_100_000, "\n" * 900_000 + "x"):
        assert c.decode(c.encode(text)) == text.encode()


def test_fast_ids_are_the_tokenizers_ids():
    from tokenizers import Tokenizer

    slow, rng = Tokenizer.from_file(JSON), random.Random(9)
    alphabet = ["the ", "Ünï", "  ", "\n\n", "'ll", "12", " ", "\x85", "\x1c", "語", "<|endoftext|>", "ɏ", "ɐ", "$%"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert packing.token_ids(text, JSON, RANKS, P.PATTERN).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = packing.hilbert_index(cells, 3)
    assert sorted(key) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pack_cuts_without_loss(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(JSON)
    texts = [*ODD, *["copy of a text"] * 40]
    pieces = packing.pack(extra(frame(spark, texts)), JSON, RANKS, P.PATTERN, with_ids=True).collect()
    ids = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    found = {i: [] for i in ids}
    for p in pieces:
        body = np.frombuffer(p["ids"], "<u4")
        assert len(body) == p["length"] and (ids[p["doc_id"]][p["start"] : p["start"] + p["length"]] == body).all()
        found[p["doc_id"]].append((p["start"], p["length"]))
    for i, spans in found.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == len(ids[i])
    by_seq: dict[int, list] = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    totals = []
    for spans in by_seq.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        totals.append(at)
    assert sorted(totals)[1:] == [2048] * (len(totals) - 1)
    whole = packing.assemble(packing.pack(frame(spark, texts), JSON, RANKS, P.PATTERN, with_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole) and sum(r["n_tokens"] for r in whole) == sum(map(len, ids.values()))
    assert packing.pack(empty(spark), JSON, RANKS, P.PATTERN).count() == 0


def test_copies_are_neighbours(spark):
    rng = random.Random(2)
    body = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta"]) for _ in range(200)) for _ in range(30)]
    pieces = packing.pack(frame(spark, body + body[:1] * 3), JSON, RANKS, P.PATTERN).collect()
    start = {p["doc_id"]: p["sequence_id"] * 2048 + p["offset"] for p in pieces if p["start"] == 0}
    order = sorted(start, key=start.get)
    places = [order.index(i) for i in (0, 30, 31, 32)]
    assert max(places) - min(places) == 3
