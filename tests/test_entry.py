"""The driver contract: every SQL belongs to a query, and the flagship query runs."""

from __future__ import annotations

import importlib
import json

import __spark_entry__ as entry_module


def test_contract(spark):
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 90
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.schema == entry_module.entry(spark).schema


def test_bench_names_exist():
    bench = importlib.import_module("bench")
    known = set(entry_module.queries())
    assert [n for n in bench.HEADLINE if n not in known] == []
    assert json.loads(json.dumps(bench.HEADLINE)) == bench.HEADLINE


def test_text_queries_push_down_columns(spark, sf_dir):
    plan = entry_module.queries()["unit_distribution_ranked"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_custkey" in plan


def test_the_subpackage_may_be_missing(monkeypatch):
    """With an import of the subpackage failing, for whatever module, the other queries stay."""
    import builtins
    import sys

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("paneloom.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    again = importlib.import_module("__spark_entry__")
    monkeypatch.undo()
    sys.modules["__spark_entry__"] = entry_module
    assert len(again.queries()) >= 90 and not any(n.startswith("op1") or n == "pipeline" for n in again.queries())
    assert set(again.oracle_sql()) <= set(again.queries())


def test_working_tables_go(spark):
    import os

    from paneloom.session import Scratch, clear_scratch, mark_scratch

    before = Scratch(spark, "before")
    before.keep(spark.range(3), "a")
    mark = mark_scratch(spark)
    after = Scratch(spark, "after")
    after.keep(spark.range(3), "b")
    clear_scratch(spark, mark)
    there = [os.path.isdir(s.root.removeprefix("file://")) for s in (before, after)]
    assert there == [True, False]


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from paneloom.session import shared_root

    class Fake:
        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})()
            self.conf = type("F", (), {"get": staticmethod(lambda *a: None)})()

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_root(Fake(master))
    assert shared_root(Fake("local[4]")).startswith("file:///")
