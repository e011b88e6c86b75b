from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from paneloom.llm import langid, secrets
from paneloom.session import Scratch
from tests.llm.helpers import ODD, SCHEMA, empty, extra, words
from tests.llm.test_near import brute_components, brute_windows

TOKEN = "3f9c1b7ae04d5526c81fa9032bd7e6481c5f0a9d"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    shared = " ".join(words(rng, 70))
    body = [" ".join(words(rng, rng.randrange(30, 200))) for _ in range(30)]
    near = body[0].split()
    near[3] = "changed"
    own = [" ".join(words(rng, 90)) for _ in range(3)]
    rest = [body[0], " ".join(near), own[0] + " " + shared, shared + " " + own[1] + " end", f'{own[2]} token = "{TOKEN}" more']
    return body + rest + ODD


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def stages(spark, texts):
    scratch, docs, out = Scratch(spark, "test"), extra(table(spark, texts)), []
    for name, stage in cp.STAGES:
        docs = scratch.keep(stage(spark, docs, ""), name)
        out.append(docs)
    return [d.toPandas() for d in out]


def by_id(frame):
    return dict(zip(frame.doc_id, frame.text, strict=True))


def test_stage_columns(stages):
    for s in stages[:-1]:
        assert list(s.columns) == cp.COLUMNS
        assert (s.text.str.len() == s.n_chars).all()


def test_each_stage_against_brute_force(spark, stages, texts):
    told = {r["doc_id"]: r for r in langid.identify(table(spark, texts)).collect()}
    first, second, third, fourth = map(by_id, stages[:4])
    assert first == {i: t for i, t in enumerate(texts) if told[i]["lang_pred"] != "und" and told[i]["score"] >= langid.LEAST_SCORE}
    assert dict(zip(stages[0].doc_id, stages[0].lang, strict=True)) == {i: told[i]["lang_pred"] for i in first}
    assert {i for i, t in enumerate(texts) if not (t and any(map(str.isalpha, t)))}.isdisjoint(first) and len(first) > 20
    ids = sorted(first)
    want, _ = brute_components([first[i] for i in ids])
    assert second == {i: first[i] for k, i in enumerate(ids) if want[k] == k}
    left = sorted(second)
    _, later = brute_windows([second[i] for i in left])
    for k, i in enumerate(left):
        kept = [w for w, gone in zip(second[i].encode().split(), later[k], strict=True) if not gone]
        assert (third.get(i, "")).encode().split() == kept
        assert later[k].any() or third[i] == second[i]
    assert set(fourth) == set(third)
    for i, t in third.items():
        assert fourth[i] == t.replace(TOKEN, secrets.MARK)
    assert sum(TOKEN in t for t in third.values()) == 1 and not any(TOKEN in t for t in fourth.values())


def test_pieces_hold_all_tokens(stages):
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    fourth, pieces = by_id(stages[3]), stages[4]
    n = {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in fourth.items()}
    assert pieces.groupby("doc_id").length.sum().to_dict() == n
    totals = pieces.groupby("sequence_id").length.sum()
    assert (np.sort(totals.to_numpy())[1:] == 2048).all()


def test_empty_table(spark):
    docs = empty(spark)
    scratch = Scratch(spark, "test")
    for name, stage in cp.STAGES:
        docs = scratch.keep(stage(spark, docs, ""), name)
        assert docs.count() == 0
