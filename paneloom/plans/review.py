"""Queries of review rules, overrides, provenance, windows and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import text as tx
from paneloom.functions.numeric import to_date
from paneloom.operators import crawl, keys, rules
from paneloom.plans.registry import query
from paneloom.plans.terms import FEATURES, documents, features
from paneloom.session import read_table

_DAY = "CAST(o_orderdate AS DATE)"


@query("window_flags", f"SELECT o_orderkey, {_DAY} BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AS in_window, (o_orderpriority = '1-URGENT' AND {_DAY} BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') OR (o_orderpriority = '5-LOW' AND {_DAY} BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS in_source_window FROM orders")
def window_flags(spark, sf):
    o = rules.windowed(read_table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")), ["day"], "1996-01-01", "1998-12-31")
    own = rules.source_windows(F.col("o_orderpriority"), F.col("day"), {"1-URGENT": ("1995-01-01", "1996-12-31"), "5-LOW": ("2000-01-01", "2000-12-31")})
    return o.select("o_orderkey", "in_window", own.alias("in_source_window"))


@query("relabel_outside", f"SELECT o_orderkey, CASE WHEN {_DAY} BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' THEN o_orderstatus ELSE 'skipped_out_of_scope' END AS status, CASE WHEN {_DAY} BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' THEN 'accepted' ELSE 'needs_review' END AS review FROM orders")
def relabel_outside(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit("accepted").alias("review"), F.col("o_orderdate").cast("date").alias("day"))
    return rules.relabel_outside(rules.windowed(o, ["day"], "1996-01-01", "1998-12-31"), "in_window", "status", "review").select("o_orderkey", "status", "review")


# Two of the labels stand for another unit, as a source's labels may.
_OVERRIDES = [(3, "moved to FRANCE", "reviewed"), (7, "moved to JAPAN", ""), (11, "moved to PERU", None)]


@query("override_apply", "SELECT s_suppkey, coalesce(v.t, n_name) AS unit, n_name AS unit_before, CASE WHEN v.k IS NULL THEN 'original' ELSE coalesce(nullif(v.s, ''), 'corrected') END AS unit_status FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (VALUES (3, 'moved to FRANCE', 'reviewed'), (7, 'moved to JAPAN', ''), (11, 'moved to PERU', NULL)) v(k, t, s) ON k = s_suppkey")
def override_apply(spark, sf):
    supplier, nation = read_table(spark, sf, "supplier"), read_table(spark, sf, "nation")
    units = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("unit"))
    table = spark.createDataFrame(_OVERRIDES, "s_suppkey bigint, corrected string, correction_status string")
    return keys.apply_overrides(units, table, "s_suppkey", "unit", "corrected")


_REASONS = "concat_ws(';', CASE WHEN n_chars < 200 THEN 'short_text' END, CASE WHEN NOT any_hit THEN 'no_term' END, CASE WHEN supply_hits > 200 THEN 'many_terms' END)"
_SEVERITY = "CAST(CASE WHEN n_chars < 200 THEN 50 ELSE 0 END + CASE WHEN NOT any_hit THEN 100 ELSE 0 END + CASE WHEN supply_hits > 200 THEN 10 ELSE 0 END AS INTEGER)"
_QUEUE = f"(SELECT doc_id, {_REASONS} AS review_reasons, {_SEVERITY} AS severity FROM {FEATURES} WHERE {_REASONS} <> '')"


def queue(spark, sf):
    reasons = {"short_text": (F.col("n_chars") < 200, 50), "no_term": (~F.col("any_hit"), 100), "many_terms": (F.col("supply_hits") > 200, 10)}
    return rules.review_queue(features(spark, sf), reasons).select("doc_id", "review_reasons", "severity")


@query("review_queue", f"SELECT * FROM {_QUEUE}")
def review_queue(spark, sf):
    return queue(spark, sf).orderBy(F.desc("severity"), "doc_id")


@query("review_reason_counts", f"SELECT value, count(*) AS records FROM (SELECT unnest(string_split(review_reasons, ';')) AS value FROM {_QUEUE}) WHERE value <> '' GROUP BY value")
def review_reason_counts(spark, sf):
    return rules.delimited_counts(queue(spark, sf), "review_reasons")


@query("acceptance", r"SELECT doc_id, CASE WHEN n_chars < 20 THEN 'rejected' ELSE 'accepted' END AS review_status, CASE WHEN n_chars < 20 THEN 'parse_failed' WHEN n_chars < 200 THEN 'short_but_official' ELSE '' END AS review_reason, n_chars >= 20 AND lang <> 'es' AND trim(coalesce(text, '')) <> '' AS is_accepted FROM documents")
def acceptance(spark, sf):
    d = documents(spark, sf).withColumn("status", F.when(F.col("n_chars") < 20, "partial").otherwise("success")).withColumn("inside", F.col("lang") != "es")
    decided = rules.review_decisions(d, "status", F.col("n_chars"))
    ok = rules.accepted(decided, "status", "text", "inside").select("doc_id", F.lit(True).alias("yes"))
    return decided.join(ok, "doc_id", "left").select("doc_id", "review_status", "review_reason", F.coalesce("yes", F.lit(False)).alias("is_accepted"))


@query("jurisdiction_review", """SELECT s_suppkey, concat_ws(';', CASE WHEN o THEN 'title_names_other_unit' END, CASE WHEN c THEN 'mentions_centre' END) AS review_reason, concat_ws(';', CASE WHEN o THEN p END, CASE WHEN c THEN 'central' END) AS review_suggestion, o OR c AS needs_review
FROM (SELECT *, p <> '' AND p <> n_name AS o, contains(n_name, 'UNITED') AS c FROM (SELECT s_suppkey, n_name, CASE WHEN s_suppkey % 3 = 0 THEN 'FRANCE' WHEN s_suppkey % 3 = 1 THEN 'PERU' ELSE '' END AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey))""")
def jurisdiction_review(spark, sf):
    supplier, nation = read_table(spark, sf, "supplier"), read_table(spark, sf, "nation")
    d = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"])
    title = F.when(F.col("s_suppkey") % 3 == 0, "France: rules").when(F.col("s_suppkey") % 3 == 1, " Peru: rules").otherwise("rules of France")
    flagged = rules.jurisdiction_flags(d.withColumn("title", title), F.lit(True), "title", "n_name", "n_name", [("France", "FRANCE"), ("Peru", "PERU")], ["UNITED"])
    return flagged.select("s_suppkey", "review_reason", "review_suggestion", "needs_review")


@query("provenance_merge", "SELECT user_id, min_by(event_id, event_id) AS first_event, string_agg(event_type, ';' ORDER BY o) AS event_types, string_agg(event_type, ';' ORDER BY o) AS batches FROM (SELECT user_id, event_type, min(event_id) AS o, min(event_id) AS event_id FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def provenance_merge(spark, sf):
    e = read_table(spark, sf, "events").withColumn("batch", F.col("event_type"))
    out = keys.merge_provenance(e, "user_id", "event_id", ["event_type", "batch"], ["event_id"])
    return out.select("user_id", F.col("event_id").alias("first_event"), F.col("event_type").alias("event_types"), F.col("batch").alias("batches"))


@query("head_per_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def head_per_group(spark, sf):
    return keys.first_per_group(read_table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_id", "event_type")


@query("page_queue_expand", "SELECT n_nationkey, CAST(p AS INTEGER) AS page_no, n_nationkey || '_' || lpad(CAST(p AS VARCHAR), 4, '0') AS page_id FROM (SELECT n_nationkey, unnest(range(1, n_nationkey % 4 + 2)) AS p FROM nation)")
def page_queue_expand(spark, sf):
    return rules.expand_pages(read_table(spark, sf, "nation"), F.col("n_nationkey") % 4 + 1, "n_nationkey").select("n_nationkey", "page_no", "page_id")


@query("outer_indicator", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT doc_id, lang FROM documents WHERE lang <> 'en') d FULL JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id")
def outer_indicator(spark, sf):
    left = documents(spark, sf).where("lang != 'en'").select("doc_id", "lang")
    return keys.outer_indicator(left, read_table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query("joined_suffixes", "SELECT doc_id, a.lang, a.n_chars AS n_chars_a, b.n_chars AS n_chars_b FROM documents a JOIN (SELECT doc_id, lang, length(lower(text)) AS n_chars FROM documents) b USING (doc_id, lang)")
def joined_suffixes(spark, sf):
    d = documents(spark, sf)
    b = d.select("doc_id", "lang", F.length(F.lower("text")).cast("bigint").alias("n_chars"))
    return keys.join_checked(d.select("doc_id", "lang", "n_chars"), b, ["doc_id", "lang"], "inner")


@query("category_normalise", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'home' WHEN c_mktsegment = 'MACHINERY' THEN 'central' ELSE c_mktsegment END AS segment, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'central' ELSE 'local' END AS kind FROM customer")
def category_normalise(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select("c_custkey", keys.label_map(F.col("c_mktsegment"), {"BUILDING": "home", "HOUSEHOLD": "home", "MACHINERY": "central"}).alias("segment"), F.when(F.col("c_mktsegment") == "MACHINERY", "central").otherwise("local").alias("kind"))


@query("date_fallback", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '1999-12-31' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def date_fallback(spark, sf):
    o = read_table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", F.coalesce(to_date(text), F.lit("1999-12-31").cast("date")).cast("string").alias("day"))


@query("safe_names", r"SELECT page_id, substr(regexp_replace(regexp_replace(coalesce(url, ''), '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS name FROM pages")
def safe_names(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", tx.safe_name("url").alias("name"))


@query("text_surfaces", "SELECT doc_id, coalesce(lang, '') || chr(10) || coalesce(source, '') AS surface FROM documents")
def text_surfaces(spark, sf):
    return documents(spark, sf).select("doc_id", crawl.text_surface("lang", "source", separator="\n").alias("surface"))
