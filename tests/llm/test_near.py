from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from paneloom.llm import graph, neardup, suffixes
from paneloom.llm import textcore as tc
from paneloom.session import Scratch
from tests.llm.helpers import ODD, empty, extra, frame, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.choice([1, 2, 4, 5, 6, 8, 12, 30, 70, 150, 400]))) for _ in range(60)]
    for base in list(texts[:25]):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(w)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                k = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(k, "new"), lambda: copy.insert(k, "more"), lambda: copy.pop(k) if len(copy) > 1 else None])()
            texts.append((" ".join(copy)).upper() if rng.random() < 0.2 else "  ".join(copy))
    return texts


def test_components_against_all_pairs(spark):
    for seed in (1, 2):
        texts = corpus(seed) + ODD
        got = {r["doc_id"]: r for r in neardup.near_duplicates(extra(frame(spark, texts))).collect()}
        want, sizes = brute_components(texts)
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_components_with_copies_in_many_tasks(spark):
    texts = corpus(3) * 2
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts).repartition(17)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[0]


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    base = words(rng, 120)
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(copy[: rng.choice([120, 120, 100])]))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[0]


def test_members_that_do_not_link_with_the_centre(spark, monkeypatch):
    """Chains and clusters in one family of candidates: most members are open after the first star, in every path."""
    rng = random.Random(15)
    base = words(rng, 150)
    texts = []
    for c in range(6):  # clusters that share most, but not enough, of the base; some linked by a chain
        own = list(base)
        for k in range(c * 6, c * 6 + 6):
            own[k * 4] = f"c{c}_{k}"
        for _ in range(30):
            copy = list(own)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
    want = brute_components(texts)[0]
    for block in (8, 4096):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts)


def test_emitted_segments_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 1000, neardup.CELLS).astype(np.uint32)
    for n in [1, 2, 4, 5, 9, 20, 63, 64, 65, 100, 127, 128, 300, 1000]:
        for _ in range(25):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            k = int(rng.integers(0, n // 4 + 1))
            drop = int(rng.integers(0, k + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 2**64, k - drop, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if len(b) and neardup.linked(a, b):
                assert len(np.intersect1d(neardup.signatures(a, counts), neardup.signatures(b, counts)))


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(8)
    for n in (3, 50, 400):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**64, n // 6, dtype=np.uint64)]))
        sa, sb = (neardup.parity_sketch(x, neardup.sketch_words(len(x))) for x in (a, b))
        if neardup.linked(a, b):
            assert neardup.may_link(len(a), sa.tobytes(), len(b), sb.tobytes())
        w = min(len(sa), len(sb))
        assert np.bitwise_count(neardup.parity_sketch(a, w) ^ neardup.parity_sketch(b, w)).sum() <= len(np.setxor1d(a, b))


def test_keep_one(spark):
    texts = ["one two three four five six seven"] * 3 + ["other words stand in this line here", "", None]
    df = frame(spark, texts, ids=[7, 3, 3, 9, 1, None])
    kept = neardup.keep_one(extra(df))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect()) == [(False, 1), (False, 3), (False, 9), (True, None)]
    assert kept.columns == extra(df).columns
    assert neardup.keep_one(empty(spark)).count() == 0 and neardup.near_duplicates(empty(spark)).count() == 0


def test_graph_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect())
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- repeated passages


def brute_windows(texts, n=50):
    spots: dict = {}
    body = [(t or "").encode().lower().split() for t in texts]
    for d, w in enumerate(body):
        for i in range(len(w) - n + 1):
            spots.setdefault(tuple(w[i : i + n]), []).append((d, i))
    every, later = ([np.zeros(len(w), bool) for w in body] for _ in range(2))
    for at in spots.values():
        if len(at) > 1:
            for k, (d, i) in enumerate(at):
                every[d][i : i + n] = True
                if k:
                    later[d][i : i + n] = True
    return every, later


def passages(seed):
    rng = random.Random(seed)
    common = [words(rng, n) for n in (49, 50, 51, 75, 120)]
    texts = []
    for _ in range(40):
        body = words(rng, rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(common)
            k = rng.randrange(len(body) + 1)
            cut = rng.randrange(0, 4)
            body[k:k] = p[cut : len(p) - rng.randrange(0, 4)]
        texts.append(" ".join(body))
    return texts + [texts[3], texts[3], "la " * 300, " ".join(common[4]).upper()]


def test_spans_against_all_windows(spark):
    for seed in (1, 2, 3):
        texts = passages(seed) + ODD
        every, later = brute_windows(texts)
        got = [np.zeros(len(x), bool) for x in every]
        removable = [0] * len(texts)
        for r in suffixes.repeats(extra(frame(spark, texts))).collect():
            assert r["n_words"] >= 50
            got[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]] = True
            removable[r["doc_id"]] += r["n_removable"]
        assert all((a == b).all() for a, b in zip(got, every, strict=True))
        assert removable == [int(x.sum()) for x in later]


def test_spans_with_copies_in_many_tasks(spark):
    for seed in (5, 6):
        texts = passages(seed) * 2
        every, later = brute_windows(texts)
        got, removable = [np.zeros(len(x), bool) for x in every], [0] * len(texts)
        for r in suffixes.repeats(frame(spark, texts).repartition(17)).collect():
            got[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]] = True
            removable[r["doc_id"]] += r["n_removable"]
        assert all((a == b).all() for a, b in zip(got, every, strict=True))
        assert removable == [int(x.sum()) for x in later]


def test_remove_repeats_keeps_the_first(spark):
    texts = passages(4) + ODD
    _, later = brute_windows(texts)
    out = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(extra(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        left = [w for w, gone in zip((t or "").encode().split(), later[i], strict=True) if not gone]
        assert (out[i] or "").encode().split() == left
        if not later[i].any():
            assert out[i] == t
    again = brute_windows([out[i] for i in range(len(texts))])[1]
    assert sum(x.sum() for x in again) <= sum(x.sum() for x in later) // 5  # cuts may join what is left
    assert suffixes.repeats(empty(spark)).count() == 0


def test_minimisers_depend_on_content_only():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**64, 80, dtype=np.uint64)
    for left in (0, 7, 60):
        w = np.concatenate([rng.integers(0, 2**64, left, dtype=np.uint64), shared, rng.integers(0, 2**64, 30, dtype=np.uint64)])
        _, at = suffixes.minimisers(w)
        _, own = suffixes.minimisers(shared)
        assert (at[left : left + len(own)] == own + left).all()


def test_null_ids_and_repeated_rows(spark):
    body = " ".join(f"z{i}" for i in range(80))
    df = frame(spark, [body, body, body, body], ids=[None, None, 4, 4])
    got = sorted((r["doc_id"] is None, r["n_removable"]) for r in suffixes.repeats(df).collect())
    assert got == [(False, 0), (False, 0), (True, 80), (True, 80)]
    assert neardup.near_duplicates(df).where(F.col("component_id") == 4).count() == 4


def test_rows_that_repeat_id_and_text_in_a_family(spark):
    rng = random.Random(19)
    base = words(rng, 120)
    texts, ids = [], []
    for k in range(6):
        copy = list(base)
        for j in range(k * 3):
            copy[j * 5] = f"v{k}_{j}"
        texts += [" ".join(copy)] * 40
        ids += [None if k % 2 else k] * 40
    df = frame(spark, texts, ids).repartition(7)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()), key=key)
    want = brute_components(texts)[0]
    smallest = {c: min((i for i, w in zip(ids, want, strict=True) if w == c and i is not None), default=None) for c in set(want)}
    assert got == sorted(((i, smallest[w]) for i, w in zip(ids, want, strict=True)), key=key)
    assert neardup.keep_one(df).count() == len(set(want))


def test_long_texts_are_hashed_by_blocks():
    import pyarrow as pa

    rng = random.Random(12)
    for _ in range(100):
        text = "".join(rng.choice(["a", "Bc", " ", "\n", "é", "語", "xyz" * rng.randrange(1, 30)]) for _ in range(rng.randrange(0, 80)))
        want = next(tc.texts_words(pa.array([text]), True))
        for block in (1, 2, 3, 7, 64):
            assert (tc.long_text_hashes(np.frombuffer(text.encode(), np.uint8), True, block) == want).all()
    long = pa.array(["one", "w " * 400_000 + "x" * 1_500_000, None, "two"])
    got = [len(w) for w in tc.texts_words(long, True)]
    assert got == [1, 400_001, 0, 1]


def test_very_long_texts(spark):
    rng = random.Random(13)
    body = words(rng, 300_000, 50_000)
    copy = list(body)
    for _ in range(2000):
        copy[rng.randrange(len(copy))] = "changed"
    texts = [" ".join(body), " ".join(copy), " ".join(body[:60]), "y" * 3_000_000]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    every, later = brute_windows(texts)
    out = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert out[i].split() == [w for w, gone in zip(t.split(), later[i], strict=True) if not gone]


def test_word_spans_as_python():
    import pyarrow as pa

    texts = ["", None, " a", "b ", "c d\te\x0bf\x0cg\rh", "é　x"]
    assert [len(w) for w in tc.texts_words(pa.array(texts), True)] == [len((t or "").encode().split()) for t in texts]
