"""Queries of source tables, records and files: sources are generated from orders, written in their formats and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.operators import keys, panel, records as rc
from paneloom.plans.common import ORDERS_SQL, unit_orders
from paneloom.plans.registry import query
from paneloom.session import Scratch, read_table
from paneloom.sources import io

YEARS = range(1995, 1999)
NOW, OLD = ("1996-01-01", "1998-12-31"), ("1995-01-01", "1995-12-31")
CORRECTED = {1: ("国家", "reviewed"), 2: ("新疆维吾尔自治区", ""), 3: ("北京市", "reviewed")}

# What stands in a generated workbook's columns, by order: Spark and SQL.
_LABEL = "CASE WHEN n = 0 THEN '国家' WHEN n = 1 THEN '新疆维吾尔自治区' WHEN n = 2 THEN '新疆生产建设兵团' ELSE unit END"
_COUNT = "CASE WHEN k % 3 = 0 THEN '2.0' WHEN k % 3 = 1 THEN '' ELSE 'x' END"
_TITLE = "CASE WHEN k % 4 = 0 THEN '专精特新通知' WHEN k % 4 = 1 THEN '河北省办法' ELSE '其他' END"
_AGENCY = "CASE WHEN k % 5 = 0 THEN ' 财政部 ' WHEN k % 5 = 1 THEN NULL ELSE '工信厅' END"
_BODY = "CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '专精特新与专精特新' ELSE '全文' END"


def _sources(spark, sf):
    o = unit_orders(spark, sf).withColumnsRenamed({"o_orderkey": "k"}).withColumn("n", F.col("n_regionkey") * 5 + F.col("o_custkey") % 7)
    day = F.when(F.col("k") % 11 == 0, "no day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    url = F.expr("concat(' https://e.com/', k)")
    columns = {"序号": F.col("k").cast("string"), "所属省份": F.expr(_LABEL), "地区名称": F.expr(_LABEL), "发文日期": day, "标题": F.expr(_TITLE), "文号": F.lit(""), "发文机构": F.expr(_AGENCY), "原文链接": url}
    counts = {"关键词数量清单": F.lit("{}"), "关键词总数量": F.expr(_COUNT)}
    now = o.where("k % 2 = 0").select(*(c.alias(x) for x, c in {**columns, **counts, "原文": F.expr(_BODY)}.items()))
    old = o.where("k % 2 = 1").select(*(c.alias(x) for x, c in {**columns, "原文文本": F.expr(_BODY)}.items()))
    return [(now, rc.Source("now", rc.HEADERS, NOW, extra=rc.FULL_TEXT)), (old, rc.Source("old", rc.HEADERS, OLD, has_counts=False, extra=rc.SUPPLEMENT_TEXT))]


def _overrides(spark, sf):
    """Corrections by order: two of the labels stand for another unit, as those of a source may."""
    k = F.col("o_orderkey") % 10
    o = read_table(spark, sf, "orders").where(k.isin(*CORRECTED))
    pick = lambda i: F.coalesce(*(F.when(k == r, F.lit(v[i])) for r, v in CORRECTED.items()))
    rid = F.concat(F.lit("record_"), F.substring(F.sha2(F.expr("concat('https://e.com/', o_orderkey)").cast("binary"), 256), 1, 16))
    return o.select(rid.alias("record_id"), pick(0).alias("corrected_unit"), pick(1).alias("correction_status"), F.lit("why").alias("correction_reason"), F.lit("seen").alias("evidence"))


def _records(spark, sf):
    return rc.combine(_sources(spark, sf), "full_text", _overrides(spark, sf), review=["old"])


_MAP = "CASE WHEN {x} = '国家' THEN 'central' WHEN {x} IN ('新疆维吾尔自治区', '新疆生产建设兵团') THEN '新疆' ELSE {x} END"
_NEW = "CASE k % 10 " + " ".join(f"WHEN {r} THEN '{v[0]}'" for r, v in CORRECTED.items()) + " END"
_STATUS = "CASE k % 10 " + " ".join(f"WHEN {r} THEN '{v[1] or 'corrected'}'" for r, v in CORRECTED.items()) + " ELSE 'original' END"
_HAS = "strpos({x}, '专精特新') > 0"
_RECORDS = f"""(SELECT *, title_has OR text_has AS any_has, CASE WHEN applies AND title = '河北省办法' AND unit <> '河北省' THEN 1 ELSE 0 END AS other, CASE WHEN applies AND agency = '财政部' THEN 1 ELSE 0 END AS centre FROM (
SELECT *, CASE WHEN unit = 'central' THEN 'central' ELSE 'local' END AS kind, source_name = 'old' AND unit <> 'central' AND unit_status = 'original' AS applies,
  coalesce(stated, CAST((length(title || chr(10) || body) - length(replace(title || chr(10) || body, '专精特新', ''))) // 4 AS BIGINT)) AS keyword_count, CASE WHEN stated IS NULL THEN 'derived_from_text' ELSE 'workbook_metadata' END AS count_source,
  {_HAS.format(x='title')} AS title_has, {_HAS.format(x='body')} AS text_has, CAST(year(day) AS INTEGER) AS publish_year, coalesce(day BETWEEN CAST(first AS DATE) AND CAST(last AS DATE), false) AS in_window FROM (
SELECT k, 'record_' || substr(sha256('https://e.com/' || k), 1, 16) AS record_id, CASE WHEN k % 2 = 0 THEN 'now' ELSE 'old' END AS source_name, CASE WHEN k % 2 = 0 THEN '{NOW[0]}' ELSE '{OLD[0]}' END AS first, CASE WHEN k % 2 = 0 THEN '{NOW[1]}' ELSE '{OLD[1]}' END AS last,
  CASE WHEN k % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, {_MAP.format(x=f'({_LABEL})')} AS unit_before, {_MAP.format(x=f'coalesce({_NEW}, {_LABEL})')} AS unit, {_STATUS} AS unit_status,
  CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN CAST(2 AS BIGINT) END AS stated, {_TITLE} AS title, trim(coalesce({_AGENCY}, '')) AS agency, coalesce({_BODY}, '') AS body
FROM (SELECT *, o_orderkey AS k, n_regionkey * 5 + o_custkey % 7 AS n FROM {ORDERS_SQL}))))"""


@query("combined_records", f"SELECT record_id, source_name, unit, unit_before, unit_status, kind, publish_year, in_window, keyword_count, count_source AS keyword_count_source, CAST(length(body) AS INTEGER) AS text_length, body = '' AS text_missing, title_has AS title_has_keyword, text_has AS text_has_keyword, any_has AS any_has_keyword, concat_ws(';', CASE WHEN other = 1 THEN 'title_names_other_unit' END, CASE WHEN centre = 1 THEN 'mentions_centre' END) AS review_reason, concat_ws(';', CASE WHEN other = 1 THEN '河北省' END, CASE WHEN centre = 1 THEN 'central' END) AS review_suggestion FROM {_RECORDS}")
def combined_records(spark, sf):
    """Two sources with their own headers, windows and counts, corrected units, and checks of the older one's local rows."""
    return _records(spark, sf).select("record_id", "source_name", "unit", "unit_before", "unit_status", "kind", "publish_year", "in_window", "keyword_count", "keyword_count_source", "text_length", "text_missing", "title_has_keyword", "text_has_keyword", "any_has_keyword", "review_reason", "review_suggestion")


_CELLS = "title_has AS a, text_has AS b, any_has AS c, body = '' AS d, other + centre > 0 AS e"


@query("record_panel", f"""SELECT u.unit, CAST(y AS INTEGER) AS year, coalesce(records, 0) AS records, CAST(coalesce(keywords, 0) AS BIGINT) AS keywords, coalesce(mean_keywords, 0.0) AS mean_keywords, coalesce(title_n, 0) AS title_has_keyword_count, coalesce(text_n, 0) AS text_has_keyword_count, coalesce(any_n, 0) AS any_has_keyword_count, coalesce(missing_n, 0) AS text_missing_count,
coalesce(review_n, 0) AS needs_review_count, coalesce(no_agency, 0) AS missing_agency_count, coalesce(agencies, 0) AS agency_count, round(ln(1 + coalesce(records, 0)), 6) AS log_records FROM (SELECT DISTINCT unit FROM {_RECORDS} WHERE in_window AND kind = 'local') u CROSS JOIN range({YEARS.start}, {YEARS.stop}) r(y)
LEFT JOIN (SELECT unit, publish_year, count(*) AS records, sum(keyword_count) AS keywords, avg(keyword_count) AS mean_keywords, count(*) FILTER (title_has) AS title_n, count(*) FILTER (text_has) AS text_n, count(*) FILTER (any_has) AS any_n, count(*) FILTER (body = '') AS missing_n, count(*) FILTER (other + centre > 0) AS review_n,
count(*) FILTER (agency = '') AS no_agency, count(DISTINCT nullif(agency, '')) AS agencies FROM {_RECORDS} WHERE in_window AND kind = 'local' GROUP BY ALL) c ON c.unit = u.unit AND c.publish_year = y""")
def record_panel(spark, sf):
    return rc.unit_year_counts(_records(spark, sf).where("in_window"), YEARS)


@query("record_review", f"SELECT record_id, publish_year, unit, title, agency, concat_ws(';', CASE WHEN other = 1 THEN 'title_prefix=河北省' END, CASE WHEN centre = 1 THEN 'central_terms=财政部' END) AS review_evidence FROM {_RECORDS} WHERE in_window AND other + centre > 0")
def record_review(spark, sf):
    """Rows to review, sorted; each record once."""
    once = rc.in_window_records(_records(spark, sf))
    return rc.review_candidates(once).select("record_id", "publish_year", "unit", "title", "agency", "review_evidence")


# --- files: what is written is read again

_TEXT = "replace(replace(coalesce(text, ''), chr(13), ' '), chr(0), ' ')"


def _documents(spark, sf):
    clean = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\x00"), F.lit(" "))
    return read_table(spark, sf, "documents").select("doc_id", "lang", clean.alias("text"), "n_chars")


def _back(spark, name):
    return Scratch(spark, "files").path(name)


@query("csv_text_round_trip", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, sha256({_TEXT}) AS text_sha256, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def csv_text_round_trip(spark, sf):
    """All columns as text from a CSV file with quotes and line breaks in its fields."""
    path = _back(spark, "csv")
    io.write_csv(_documents(spark, sf), path)
    got = io.read_csv_text(spark, path, ["doc_id", "text"])
    return got.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_chars")


@query("csv_typed_round_trip", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def csv_typed_round_trip(spark, sf):
    path, df = _back(spark, "csv"), read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    io.write_csv(df, path)
    return io.read_csv(spark, path, df.schema)


@query("jsonl_round_trip", f"SELECT doc_id, lang, sha256({_TEXT}) AS text_sha256, n_chars FROM documents")
def jsonl_round_trip(spark, sf):
    """JSON lines by split, read again."""
    path, df = _back(spark, "jsonl"), _documents(spark, sf)
    io.write_splits(df.withColumn("split", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train")), path)
    got = io.read_jsonl(spark, f"{path}/*", df.schema)
    return got.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_chars")


@query("partitioned_round_trip", "SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' GROUP BY lang")
def partitioned_round_trip(spark, sf):
    """One partition of a table written by language; the others aren't read."""
    path = _back(spark, "parquet")
    io.write_partitioned(_documents(spark, sf), path, "lang")
    return io.read_parquet(spark, path, ["lang", "n_chars"]).where("lang = 'en'").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query("workbook_export", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS unit FROM nation")
def workbook_export(spark, sf):
    """A sheet's export as text under canonical names."""
    path = _back(spark, "sheet") + ".parquet"
    read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("序号"), F.col("n_name").alias("地区 名称")).write.parquet(path)
    return io.read_workbook(spark, path, "sheet", {"序号": "id", "地区 名称": "unit"})


@query("cached_lookup", r"SELECT page_id, CASE WHEN page_id % 3 < 2 THEN '/cache/' || substr(regexp_replace(regexp_replace(CASE WHEN page_id % 3 = 1 THEN regexp_replace(url, '^http:', 'https:') ELSE url END, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) || '.html' END AS path FROM pages")
def cached_lookup(spark, sf):
    """The file kept for each page, by the safe name of its URL or of its https form; a page in three has none, whatever is kept for other pages of its URL."""
    from paneloom.functions.text import safe_name

    p = read_table(spark, sf, "pages").select("page_id", "url")
    kept = F.when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^http:", "https:")).otherwise(F.col("url"))
    files = p.where("page_id % 3 < 2 AND url IS NOT NULL").select("page_id", F.concat(F.lit("/cache/"), safe_name(kept), F.lit(".html")).alias("path"))
    return io.cached_pages(p, "url", files.distinct(), by=["page_id"]).select("page_id", "path")


@query("variable_map", "SELECT * FROM (VALUES (1, 'panel_id', 'identifier', 'constructed', 'unit and period'), (2, 'unit', 'key', 'nation', ''), (3, 'period', 'key', 'orders', ''), (4, 'orders', 'main', 'orders', 'count')) v(position, variable, role, source, note)")
def variable_map(spark, sf):
    """The map of a panel's columns; the panel itself is cut to them in their order."""
    table = panel.variable_map(spark, {"panel_id": ("identifier", "constructed", "unit and period"), "unit": ("key", "nation", ""), "period": ("key", "orders", ""), "orders": ("main", "orders", "count")})
    cells = unit_orders(spark, sf).groupBy("unit", "period").agg(F.count(F.lit(1)).alias("orders")).withColumn("panel_id", panel.panel_id("unit", "period"))
    if panel.check_variables(cells, table).columns != ["panel_id", "unit", "period", "orders"]:
        raise keys.ContractError("the panel's columns are not those of its map")
    return table


@query("promoted_header", "SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS region FROM region")
def promoted_header(spark, sf):
    """A table whose first row names its columns."""
    body = read_table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("line"), F.col("r_regionkey").cast("string").alias("c1"), F.col("r_name").alias("c2"))
    head = spark.createDataFrame([(0, " id", "region ")], "line bigint, c1 string, c2 string")
    return io.promote_header(body.unionByName(head), "line")
