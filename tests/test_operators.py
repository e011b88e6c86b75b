"""Operators on small literal tables: windows, overrides, provenance, panels, splits, metrics, parsing."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from paneloom.operators import crawl, dictionary, keys, labeling, metrics, panel, quality, ranges, rules, sampling, stats
from paneloom.plans.common import TOOLS
from paneloom.sources import io, xlsx
from paneloom.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_required_columns_and_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, v string")
    with pytest.raises(keys.ContractError, match="missing"):
        keys.require_columns(df, ["k", "z"])
    with pytest.raises(keys.ContractError):
        keys.assert_unique(df, ["k"])
    assert keys.duplicate_keys(df, ["k"]).count() == 2
    joined = keys.join_checked(df.select("k"), df, ["k"], validate="m:1")  # fails when it is run, not before
    with pytest.raises(Exception, match="repeated"):
        joined.collect()
    ok = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    assert rows(keys.join_checked(df, ok, ["k"], "left", "m:1"), "v_a") == [(1, "a", "x"), (1, "b", "x"), (None, "c", None), (None, "d", None)]
    assert rows(keys.once_each(ok.withColumn("a.b", F.lit(1)), ["k"]), "v") == [(1, "x", 1), (None, "y", 1)]
    with pytest.raises(Exception, match="repeated"):
        keys.once_each(df, ["k"]).count()


def test_window_relabels_but_keeps(spark):
    df = spark.createDataFrame([("2026-04-21",), ("2025-09-04",), (None,)], "day string").withColumns({"status": F.lit("success"), "review": F.lit("accepted")})
    out = rules.relabel_outside(rules.windowed(df, ["day"], "2020-01-01", "2025-12-31"), "in_window", "status", "review")
    got = {r["day"]: (r["in_window"], r["status"], r["review"]) for r in out.collect()}
    assert got["2025-09-04"] == (True, "success", "accepted")
    assert got["2026-04-21"] == got[None] == (False, "skipped_out_of_scope", "needs_review")


def test_provenance_in_order(spark):
    df = spark.createDataFrame([(1, "u", "专精特新", "batch_a"), (2, "u", "小巨人", "batch_b"), (3, "u", "专精特新", "")], "o int, url string, hit string, batch string")
    out = keys.merge_provenance(df, "url", "o", ["hit", "batch"], ["o"])
    assert rows(out.select("o", "hit", "batch")) == [(1, "专精特新;小巨人", "batch_a;batch_b")]


def test_stop_reasons(spark):
    listed = lambda no, of, *days: json.dumps({"result": {"data": {"pager": {"pageNo": no, "pageCount": of}, "list": [{"publish_time": d} for d in days]}}})
    pages = [("p2", listed(2, 5, "2019-12-31", "2020-01-01")), ("p5", listed(5, 5, "2021-01-01")), ("p1", listed(1, 5, "2021-01-01")), ("undated", listed(3, 5, None, "soon")), ("none", listed(3, 5)), ("no list", "{}"), ("bad", "{x"), ("zero", listed(0, 0, "2021-01-01"))]
    out = rules.stop_reasons(crawl.list_pages(spark.createDataFrame(pages, "page string, body string"), "body"), "2020-01-01")
    assert dict(rows(out.select("page", "stop_reason"))) == {
        "p2": "page_crossed_target_start_date", "p5": "reached_page_count", "p1": "", "undated": "", "none": "empty_list", "no list": "empty_list", "bad": "empty_list", "zero": "reached_page_count",
    }


def test_links_as_the_standard_library_joins_them(spark):
    from urllib.parse import urljoin

    base = "https://www.gov.cn/zhengce/xxgk/"
    links = ["", "a.html", "/a/b.html", "//h.org/c", "../d.html", "../../../e", "./f/./g/../h", "..", ".", "?p=1", "#top", "http://x.org/y", "i/j/?q=a/../b#c/..", "k//l", "/m/../n/.", "https://o.cn"]
    got = dict(rows(spark.createDataFrame([(x,) for x in links], "l string").select("l", crawl.resolve_url(F.col("l"), base))))
    assert got == {x: urljoin(base, x) for x in links}


def test_titles_are_plain(spark):
    assert crawl.plain_title("A &amp; <b> B&nbsp;</b> C ") == "A &BC" and crawl.plain_title(None) == ""


def test_overrides(spark):
    df = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Z")], "id string, unit string")
    o = spark.createDataFrame([("a", "central", "reviewed", "why"), ("b", "W", "", None)], "id string, corrected string, correction_status string, reason string")
    out = keys.apply_overrides(df, o, "id", "unit", "corrected", carry=["reason"])
    assert rows(out.select("id", "unit", "unit_before", "unit_status", "unit_reason"), "id") == [("a", "central", "X", "reviewed", "why"), ("b", "W", "Y", "corrected", ""), ("c", "Z", "Z", "original", "")]


def test_jurisdiction_flags(spark):
    df = spark.createDataFrame([("广东省通知", "财政部", "北京"), (None, None, "北京"), ("通知", "x", None)], "t string, a string, u string")
    out = rules.jurisdiction_flags(df, F.lit(True), "t", "a", "u", [("广东省", "广东")], ["财政部"])
    assert [r["review_suggestion"] for r in out.collect()] == ["广东;central", "", ""]
    assert out.where("needs_review").count() == 1


def test_classified_panel(spark):
    base = [("d1", "北京", 2023, 0.9, 0.1, 0.2, 0.1), ("d2", "北京", 2024, 0.6, 0.8, 0.1, 0.1), ("d3", "北京", 2024, 0.1, 0.2, 0.3, 0.9)]
    df = spark.createDataFrame(base, "id string, unit string, period int, p_supply double, p_demand double, p_environment double, p_other double")
    labelled = panel.hard_labels(df, TOOLS, "other")
    assert rows(labelled.select("supply_label", "demand_label", "environment_label", "other_label", "valid_tool"), "id") == [(1, 0, 0, 0, 1), (1, 1, 0, 0, 1), (0, 0, 0, 1, 0)]
    frame = panel.skeleton(spark.createDataFrame([("北京",), ("上海",)], "unit string"), [2023, 2024], "period").withColumn("period", F.col("period").cast("int"))
    got = {(r["unit"], r["period"]): r for r in panel.intensity(labelled, frame, ["unit", "period"], TOOLS, "other").collect()}
    cell = got["北京", 2024]
    assert len(got) == 4 and (cell["records"], cell["valid_count"], cell["other_count"]) == (2, 1, 1)
    assert cell["filtered_sum_p_supply"] < cell["sum_p_supply"]
    assert all(v == 0 for k, v in got["上海", 2023].asDict().items() if k not in ("unit", "period"))


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 0, 1)), (5, (3, 1, 1)), (10, (7, 2, 1)), (15, (10, 2, 3)), (30, (21, 4, 5))])
def test_split_sizes(spark, n, want):
    train, valid = round(n * 0.7), round(n * 0.15)
    valid = min(valid, max(0, n - train))
    if n >= 3 and train + valid == n:
        valid, train = (valid - 1, train) if valid > 1 else (valid, train - 1)
    out = sampling.stratified_split(spark.range(n).withColumn("g", F.lit("x")), "id", "g").groupBy("split").count()
    got = dict(rows(out))
    assert tuple(got.get(k, 0) for k in ("train", "validation", "test")) == (train, valid, n - train - valid) == want


def test_pool_sample_draws_once(spark):
    df = spark.range(100).withColumns({"a": F.col("id") < 60, "b": F.col("id") >= 40, "p": F.col("id") >= 90})
    got = rows(sampling.pool_sample(df, "id", [("a", "a", None), ("b", "b", "p")], 30))
    assert len({i for i, _ in got}) == len(got) == 60
    assert {i for i, n in got if n == "b"} >= set(range(90, 100))


def test_multilabel_metrics(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (0, 1, 0, 1), (1, 1, 1, 0)], "y_a int, y_b int, z_a int, z_b int")
    got = dict(rows(metrics.multilabel(df, ["a", "b"])))
    assert got["a_f1"] == 1.0 and got["b_recall"] == 0.5 and got["b_precision"] == 1.0
    assert got["samples_jaccard"] == pytest.approx((1 + 1 + 0.5) / 3, abs=1e-6)
    weights = {r["label"]: r["pos_weight"] for r in metrics.class_weights(df, ["a", "b"]).collect()}
    assert weights == {"a": 0.5, "b": 0.5}


def test_trained_model(spark, tmp_path):
    from paneloom.operators import training

    words = {"a": "政策采购补贴", "b": "人才培训服务"}
    data = [(i, (words["a"] if i % 2 else "") + "通知" * (i % 3 + 1) + (words["b"] if i % 3 == 0 else ""), i % 2, int(i % 3 == 0)) for i in range(120)] + [(999, None, 0, 0)]
    df = spark.createDataFrame(data, "id int, text string, y_a int, y_b int")
    model, report = training.fit(df.where("id % 5 < 3"), df.where("id % 5 = 3"), "text", ["a", "b"], penalties=(0.01, 0.1), buckets=1 << 10)
    got = dict(rows(training.evaluate(model, df.where("id % 5 = 4"), "text")))
    assert got["macro_f1"] > 0.95 and report.where("metric = 'macro_f1'").count() == 2
    model.save(str(tmp_path / "m"))
    again = training.TextModel.load(str(tmp_path / "m"), ["a", "b"], 1 << 10)
    assert rows(again.predict(df, "text").select("p_a"), "id") == rows(model.predict(df, "text").select("p_a"), "id")


def test_figures_say_what_they_need(spark, tmp_path):
    from paneloom.operators import figures

    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "x int, y double")
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="matplotlib"):
            figures.lines(df, "x", ["y"], tmp_path / "f.png")
    else:
        assert figures.lines(df, "x", ["y"], tmp_path / "f.png").exists()


def test_fill_groups(spark):
    df = spark.createDataFrame([(None, None, None)], "sum_a double, b_count int, c int")
    assert rows(panel.fill_groups(df, ["sum_"], ["_count"])) == [(0.0, 0, None)]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    d = stats.describe(df, ["x"]).first()
    assert (d["n"], d["missing"], d["p25"], d["p75"], d["zeros"]) == (4, 1, 1.75, 4.75, 0)
    same = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert rows(panel.robust_z(same, ["x"]).select("x_rz")) == [(0.0,), (0.0,)]
    assert rows(panel.zscores(same, ["x"]).select("x_z")) == [(0.0,), (0.0,)]
    dup = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "x string")
    assert rows(stats.duplicate_count(dup, "x")) == [("x", 2)]
    assert dup.agg(quality.duplicates_of("x")).first()[0] == 2


def test_quantiles_by_range_sort(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 40, 501).astype(float), rng.normal(size=501)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y, strict=True)] + [(None, None, None)], "x double, y double, z double")
    ps = [0.0, 0.25, 0.333, 0.5, 0.75, 1.0]
    for small in (0, 10_000):
        got = ranges.quantiles(df, ["x", "y", "z"], ps, small_rows=small, parts=7)
        assert got["x"] == pytest.approx({p: np.quantile(x, p) for p in ps}) and got["y"] == pytest.approx({p: np.quantile(y, p) for p in ps})
        assert got["z"] == dict.fromkeys(ps)


def test_numbers_and_ranks_by_range_sort(spark):
    import pandas as pd

    rng = random.Random(4)
    data = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(30), rng.choice([1.0, 2.0, 2.5, None])) for i in range(700)]
    df = spark.createDataFrame(data, "id int, g string, o int, x double").repartition(5)
    got = [sorted(rows(ranges.numbered(df, ["g"], ["o", "id"], small_rows=small, parts=9).select("id", "_n", "_i"))) for small in (0, 10_000)]
    assert got[0] == got[1] and len(got[0]) == 700
    frame = pd.DataFrame(data, columns=["id", "g", "o", "x"])
    for small in (0, 10_000):
        r = ranges.average_ranks(df, ["o", "x"], small_rows=small, parts=6).toPandas()
        assert sorted(r.o) == sorted(frame.o.rank()) and sorted(r.x) == sorted(frame.x.rank(na_option="bottom"))


def test_gates_stop(spark):
    report = rules.gates(spark, [("a", True, "1"), ("b", False, "2")])
    with pytest.raises(ValueError, match="b"):
        rules.require_gates(report)
    rules.require_gates(report.where("status = 'pass'"))


PAGE = """<html><head><title>某通知_中国政府网</title><meta name="source" content=" 财政部 "></head><body><h1>关于某事的通知_中国政府网</h1>
<table><tr><td>主题分类：</td><td>城乡建设、环境保护\\其他</td></tr></table><article>发布时间：2024年1月5 {body}<script>no()</script></article>
<a href="/f/a.pdf">下载</a><a href="b.html">附件1</a><a href="c.html">x</a></body></html>"""


def test_page_fields():
    p = crawl.parse_page(PAGE.format(body="正文" * 100), "https://g.cn/x/y.html", ("article",))
    assert p["title"] == "关于某事的通知" and p["agency"] == "财政部" and p["publish_date"] == "2024-1-5"
    assert p["subject_categories"] == ["城乡建设、环境保护", "其他"]
    assert p["attachment_urls"] == ["https://g.cn/f/a.pdf", "https://g.cn/x/b.html"]
    assert "no()" not in p["body"]


def test_page_status(spark):
    df = spark.createDataFrame([(1, "https://g.cn/1", PAGE.format(body="x" * 300)), (2, "https://g.cn/2", "<p>short"), (3, None, None)], "page_id int, url string, html string")
    out = crawl.parse_details(df, "page_id", "url", "html", ("article",))
    assert rows(out.select("page_id", "parse_status", "review_status", "document_type"), "page_id") == [(1, "success", "accepted", "policy_document"), (2, "partial", "needs_review", "needs_review"), (3, "partial", "needs_review", "needs_review")]


def test_page_takes_what_it_lacks_from_the_list(spark):
    df = spark.createDataFrame([(1, "https://g.cn/1", "<p>text</p>", "某条例", "国令第1号", "2024-03-02 10:00"), (2, "https://g.cn/2", "<h1>国务院办公厅关于某事</h1>", "x", None, None)], "page_id int, url string, html string, t string, n string, d string")
    out = crawl.parse_details(df, "page_id", "url", "html", title="t", number="n", listed_day="d")
    assert rows(out.select("title", "agency", "publish_date"), "page_id") == [("某条例", "国务院", "2024-03-02"), ("国务院办公厅关于某事", "国务院办公厅", None)]


def test_answers(spark):
    obj = json.dumps({"p_supply": 0.9, "p_other": "x", "ev": [" a ", ""], "is_related": True})
    wrap = lambda c, r=None: json.dumps({"choices": [{"message": {"content": c, "reasoning_content": r}}]})
    raws = [wrap(obj), wrap(f"```json\n{{\"p_supply\": 0}}\n```\n```json\n{obj}\n```"), wrap("", "thinking " + obj), wrap("none"), "{bad", wrap(json.dumps({"p_supply": 3, "ev": "one"}))]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = rows(labeling.parse_answers(df, "raw", ["p_supply", "p_other"], ["ev"], ["is_related"]).select("label_status", "p_supply", "p_other", F.array_join("ev", "|"), "is_related"), "i")
    assert got[:3] == [("success", 0.9, 0.0, "a", True)] * 3
    assert got[3][0] == got[4][0] == "failed"
    assert got[5] == ("success", 1.0, 0.0, "one", False)


def test_context_windows(spark):
    texts = ["x" * 200 + "政府采购" + "y" * 600 + "采购" + "z" * 50, None, "a  b\t" * 2000, "", "采购 " * 3, "p" * 300 + "采购" + " " * 500 + "q" * 100 + "y"]
    terms = ["政府采购", "采购", "y", "b"]
    df = labeling.with_context(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", terms)
    got = dict(rows(df.select("i", "context")))

    def brute(text):  # every window that no accepted one overlaps, until the text is long enough
        body, kept, out = "\n".join((text or "").split()), [], ""
        for term in sorted(terms, key=lambda t: (-len(t), t)):
            at = body.find(term)
            a, z = max(0, at - labeling.LEFT), min(len(body), at + len(term) + labeling.RIGHT)
            if at >= 0 and len(out) < labeling.MOST and all(z <= x or y <= a for x, y in kept):
                kept.append((a, z))
                out = "\n".join(p for p in [out, body[a:z].strip()] if p)
        return out[: labeling.MOST]

    assert got == {i: brute(t) for i, t in enumerate(texts)} and any(got.values())
    assert [r[0] for r in spark.createDataFrame([("b " * 900,)], "t string").select(labeling.context_windows(F.col("t"), ["b"], most=10)).collect()] == ["b b b b b "]


def test_client_keeps_failures(spark):
    def client():
        def ask(r: str) -> str:
            if r == "b":
                raise TimeoutError("no")
            if r == "c":
                raise ValueError("never")
            return r.upper()

        return ask

    out = labeling.call_client(spark.createDataFrame([("a",), ("b",), ("c",)], "q string"), "q", client, retries=2)
    assert rows(out, "q") == [("a", "A", None, 1), ("b", None, "TimeoutError: no", 3), ("c", None, "ValueError: never", 1)]


def test_what_may_be_tried_again():
    class Http(Exception):
        def __init__(self, code):
            self.code = code

    assert [labeling.may_retry(Http(c)) for c in (400, 401, 404, 408, 409, 425, 429, 500, 503, 600)] == [False, False, False, True, True, True, True, True, True, False]
    assert labeling.may_retry(ConnectionError()) and not labeling.may_retry(KeyError())


def test_values_by_their_types(spark):
    values = {"true": (1.0, True, ["True"]), '"false"': (0.0, True, ["false"]), '"0"': (0.0, True, ["0"]), "0": (0.0, False, ["0"]), '""': (0.0, False, []), '"0.5"': (0.5, True, ["0.5"]), "[]": (0.0, False, []), '[" a ", "", null, 2]': (0.0, True, ["a", "None", "2"]), '"[x, y]"': (0.0, True, ["[x, y]"]), "null": (0.0, False, [])}
    raws = [json.dumps({"choices": [{"message": {"content": f'{{"p": {v}, "f": {v}, "e": {v}}}'}}]}) for v in values]
    out = labeling.parse_answers(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"), "raw", ["p"], ["e"], ["f"])
    assert [tuple(r) for r in rows(out.select("p", "f", "e"), "i")] == list(values.values())


def test_labelling_resumes_and_dry_runs(spark):
    answer = json.dumps({"choices": [{"message": {"content": json.dumps({"p_supply": 0.9, "p_other": 0.1, "ev": []})}}]})
    todo = spark.createDataFrame([("a", "q1"), ("b", "q2"), ("c", "bad")], "id string, q string")
    done = spark.createDataFrame([("a", answer)], "id string, raw_response string")

    def client():
        def ask(q: str) -> str:
            if q == "q1":
                raise AssertionError("asked twice")
            return "no json" if q == "bad" else answer

        return ask

    out = labeling.label_rows(todo, "id", "q", client, ["p_supply", "p_other"], ["ev"], done, retries=0)
    assert rows(out.select("id", "label_status", "p_supply"), "id") == [("a", "success", 0.9), ("b", "success", 0.9), ("c", "failed", 0.0)]
    labelled = labeling.binary_labels(out, ["supply"])
    assert rows(labelled.select("y_supply", "y_other"), "id") == [(1, 0), (1, 0), (0, 0)]
    dry = labeling.label_rows(todo, "id", "q", None, ["p_supply"], ["ev"])
    assert {r["label_status"] for r in dry.collect()} == {"dry_run"}


def test_text_surface_and_flags(spark):
    df = spark.createDataFrame([("t", None, 0, 0.0), ("the", "x", 5, 0.9)], "term string, b string, records_hit int, record_hit_share double")
    assert [r[0] for r in df.select(crawl.text_surface("term", "b", separator="。")).collect()] == ["t。", "the。x"]
    assert [r["review_flags"] for r in dictionary.review_flags(df, 2, ["the"]).collect()] == ["zero_coverage;short_term", "high_coverage;broad_term"]


def test_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = str(tmp_path / "book.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="空" sheetId="1" r:id="rId1"/><sheet name="数据" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>标题</t></si><si><r><t>专精</t></r><r><t>特新</t></r><rPh><t>x</t></rPh></si><si><t>发文日期</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"""<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c><c r="AA1" t="inlineStr"><is><t>远</t></is></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2</v></c><c r="C2" s="1"><v>45296</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" s="3"><v>2.5</v></c><c r="C3" s="2"><v>45296.5</v></c><c r="AA3" t="str"><v>z</v></c></row><row r="4"/></sheetData></worksheet>""")
    assert list(xlsx.sheets(path)) == ["空", "数据"] and list(xlsx.rows(path)) == []
    got = io.read_workbook(spark, path, "数据", {"标题": "title", "发文日期": "day", "远": "far"})
    assert rows(got, "day") == [("专精特新", "2024-01-05 00:00:00", None), ("TRUE", "2024-01-05 12:00:00", "z")]
    found = list(xlsx.rows(path, "数据"))
    assert [r[1] for r in found[:3]] == [None, "2", "2.5"] and len(found[0]) == 27 and found[3] == []
    with pytest.raises(ValueError, match="no sheet"):
        list(xlsx.rows(path, "x"))


def test_configurations(tmp_path, spark):
    (tmp_path / "a.toml").write_text('source_id = "x"\n[window]\nstart = "2020-01-01"\n', encoding="utf-8")
    assert io.load_toml(tmp_path / "a.toml")["window"]["start"] == "2020-01-01"
    (tmp_path / "b.csv").write_text("\ufeffbatch,keyword,enabled\n1,k,TRUE\n2,,no\n3,m,yes\n", encoding="utf-8")
    assert [b["batch"] for b in io.load_batches(tmp_path / "b.csv")] == ["1", "3"]
    io.write_artifact(tmp_path / "s_b_page_001.json", {})
    there = io.exists_in(spark)
    assert io.cached_payload(f"file://{tmp_path}", "s", "b", 1, exists=there).endswith("page_001.json") and io.cached_payload(f"file://{tmp_path}", "s", "b", 2, exists=there) is None
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    layout = io.parquet_layout(str(part))
    assert (layout["rows"], layout["columns"], sum(g["rows"] for g in layout["groups"])) == (10, 1, 10)


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    got = io.manifest(spark, tmp_path, [("one", "csv", "*.csv; b/*.json"), ("two", "json", "none/*.json")])
    assert rows(got, "source_id") == [("one", "csv", "*.csv; b/*.json", 1, 1, "found"), ("two", "json", "none/*.json", 0, 0, "missing")]


def test_failed_pages_are_rows(spark):
    df = spark.createDataFrame([(1, "https://g.cn/1", None, "t", "c1", "TimeoutError()")], "page_id int, url string, html string, t string, c string, e string")
    out = crawl.parse_details(df, "page_id", "url", "html", title="t", candidate="c", error="e").first()
    assert (out["parse_status"], out["review_status"], out["title"], out["policy_id"], out["body"], out["document_type"], out["text_hash"]) == ("detail_failed", "needs_review", "t", "c1", "", None, None)


def test_review_candidates_are_typed_when_empty(spark):
    from paneloom.operators import records

    df = spark.createDataFrame([], "record_id string, source_name string, source_label_original string, unit string, publish_date string, publish_year int, title string, agency string, source_url string, review_reason string, review_suggestion string, review_evidence string, needs_review boolean")
    out = records.review_candidates(df)
    assert out.count() == 0 and out.schema["publish_year"].dataType.simpleString() == "int"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,flag\n1,TRUE\n2,\n', encoding="utf-8")
    assert rows(io.read_csv_text(spark, str(tmp_path / "a.csv"), ["id"]), "id") == [("1", "TRUE"), ("2", "")]
    (tmp_path / "b.jsonl").write_text('{"a": 1, "l": [1, 0]}\n\n{"a": 2}\n', encoding="utf-8")
    assert io.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int, l array<int>").count() == 2
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "1.json").write_text('{"a":1}')
    (raw / "2.json").write_text("{oops")
    assert sorted(r["artifact_status"] for r in io.read_artifacts(spark, str(raw)).collect()) == ["bad_json", "ok"]
    lists = spark.createDataFrame([("['a', 'b']",), ("[]",), ("plain",), (None,), ('["c"]',)], "x string")
    assert [r[0] for r in lists.select(io.serialized_list("x")).collect()] == [["a", "b"], [], ["plain"], [], ["c"]]
    assert io.resolve_globs(tmp_path, "*.csv; raw/*.json") == ["a.csv", "raw/1.json", "raw/2.json"]
    files = spark.createDataFrame([("/c/https_g_cn_1.html",)], "path string")
    wanted = spark.createDataFrame([("http://g.cn/1",), ("http://g.cn/2",)], "u string")
    io.write_artifact(io.page_path(str(raw), "s", "b", 1), {"a": "é"})
    assert io.cached_payload(str(raw), "s", "b", 1).endswith("s_b_page_001.json") and io.cached_payload(str(raw), "s", "b", 2, str(tmp_path / "a.csv")) is None
    assert rows(io.cached_pages(wanted, "u", files), "u") == [("http://g.cn/1", "/c/https_g_cn_1.html"), ("http://g.cn/2", None)]


def test_stream_resumes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(src)
    work = lambda df: df.withColumn("x", F.col("id") * 2)
    schema = spark.read.parquet(src).schema
    incremental.process_new(incremental.stream_parquet(spark, src, schema), ["id"], out, work, str(tmp_path / "c1")).awaitTermination()
    spark.range(3, 8).write.mode("append").parquet(src)
    incremental.process_new(incremental.stream_parquet(spark, src, schema), ["id"], out, work, str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_tumbling_plan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = incremental.tumbling(events, "ts", "1 day", "1 hour", ["event_type"], "value")
    assert batch.agg(F.sum("n")).first()[0] == events.count()
