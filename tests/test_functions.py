"""Expressions against Python's own results on the awkward cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paneloom.functions import numeric as nm
from paneloom.functions import text as tx

ODD = ["a\x1cb\x85c　d e​f", "　\t a \n", "", "  ", "x", " y ", None]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_white_space_as_python(spark):
    df = column(spark, ODD)
    assert values(df, tx.clean("v")) == [(v or "").strip() for v in ODD]
    assert values(df, tx.collapse("v")) == [" ".join((v or "").split()) for v in ODD]


def test_literal_counts(spark):
    df = column(spark, ["aaaa", "政府采购与采购", "", "a.b.c"])
    assert values(df, tx.literal_count("v", "aa")) == [2, 0, 0, 0]
    assert values(df, tx.count_terms("v", ["采购", "政府采购"])) == [0, 3, 0, 0]
    assert values(df, tx.literal_count("v", ".")) == [0, 0, 0, 2]
    assert values(df, F.array_join(tx.matched_terms("v", ["采购", "政府采购", "a"]), ";")) == ["a", "采购;政府采购", "", "a"]


def test_tokens_longest_first(spark):
    df = column(spark, ["银行保险与保险", "政府采购"])
    assert values(df, F.array_join(tx.tokens("v", ["银行", "保险", "银行保险", "采购"]), "|")) == ["银行保险|保险", "采购"]


def test_first_prefix(spark):
    df = column(spark, ["内蒙古自治区通知", "内蒙通知", "通知"])
    pairs = [("内蒙古", "long"), ("内蒙", "short")]
    assert values(df, tx.first_prefix("v", pairs)) == ["long", "short", ""]


def test_casts(spark):
    df = column(spark, ["2", "2.0", " 3 ", "", "x", None])
    assert values(df, nm.to_int("v")) == [2, 2, 3, None, None, None]
    days = column(spark, ["2024-01-05", "2024-1-7", "bad", "", None])
    assert [str(d) for d in values(days, nm.to_date("v"))] == ["2024-01-05", "2024-01-07", "None", "None", "None"]
    assert values(days, nm.in_window(nm.to_date("v"), "2024-01-05", "2024-01-06")) == [True, False, False, False, False]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 10, 15, 30])
def test_round_even(spark, n):
    df = column(spark, [float(n)], "double")
    assert values(df, nm.round_even(F.col("v") * 0.7))[0] == round(n * 0.7)
    assert values(df, nm.round_even(F.col("v") * 0.15))[0] == round(n * 0.15)


def test_clamp_and_truth(spark):
    df = column(spark, ["0.5", "-1", "7", "x", None, "NaN"])
    assert values(df, nm.clamp01("v")) == [0.5, 0.0, 1.0, 0.0, 0.0, 1.0]
    assert values(column(spark, ["TRUE", "1", " yes", "no", None]), tx.truthy("v")) == [True, True, True, False, False]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, b double")
    assert df.agg(nm.correlation("a", "b")).first()[0] is None


@pytest.mark.parametrize("n,sizes", [(7, [2, 2, 3]), (10, [3, 3, 4]), (25, [8, 8, 9]), (31, [10, 10, 11])])
def test_tertile_sizes(spark, n, sizes):
    df = spark.range(1, n + 1).withColumn("t", nm.tertile("id", F.lit(n)))
    assert [r[1] for r in df.groupBy("t").count().orderBy("t").collect()] == sizes


def test_average_rank(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 5.0), (3, 9.0)], "i int, v double")
    assert values(df.withColumn("r", nm.average_rank("v")), F.col("r")) == [2.5, 1.0, 2.5, 4.0]


def test_dates_and_names(spark):
    df = column(spark, ["发布时间：2024年1月5日", "2023-07-09", "none"])
    assert [str(d) for d in values(df, tx.chinese_date("v"))] == ["2024-01-05", "2023-07-09", "None"]
    urls = column(spark, ["https://a.b/c/d.html?x=1"])
    assert values(urls, tx.safe_name("v")) == ["https_a_b_c_d_html_x_1"]
    assert values(urls, tx.origin("v", 1)) == ["https://a.b/c"]
    assert values(column(spark, ["城乡建设、环境保护\\其他\\ "]), tx.split_trim("v", "\\")) == [["城乡建设、环境保护", "其他"]]
