"""Queries over corpora and tables: ids, duplicates, profiles, splits, samples, labels, parsing, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import text as tx
from paneloom.functions.numeric import count_if, sigmoid, to_date, to_int
from paneloom.operators import keys, labeling, metrics, panel, quality, rules, sampling, stats
from paneloom.plans.common import CATEGORIES, OTHER, SCORED_SQL, TOOLS, hits_sql, scored_orders
from paneloom.plans.registry import query
from paneloom.plans.terms import FEATURES, documents, features
from paneloom.session import read_table
from paneloom.sources import io

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


@query("stable_ids", rf"SELECT doc_id, 'doc_' || substr(sha256(regexp_replace(coalesce(text, ''), '^{SPACE}+|{SPACE}+$', '', 'g')), 1, 16) AS stable_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g'), '^ +| +$', '', 'g')) AS text_hash, substr(sha1(source), 1, 16) AS source_id FROM documents")
def stable_ids(spark, sf):
    return documents(spark, sf).select("doc_id", tx.stable_id("text", "doc_").alias("stable_id"), tx.text_hash("text").alias("text_hash"), tx.stable_id_sha1("source").alias("source_id"))


_DUP = "SELECT '{c}' AS \"column\", CAST(count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicates FROM documents"


@query("dup_report", " UNION ALL ".join(_DUP.format(c=c) for c in ("doc_id", "text", "source")))
def dup_report(spark, sf):
    d = documents(spark, sf)
    return stats.duplicate_count(d, "doc_id").unionByName(stats.duplicate_count(d, "text")).unionByName(stats.duplicate_count(d, "source"))


@query("qa_long_report", "SELECT 'records' AS metric, CAST(count(*) AS VARCHAR) AS value, 'rows' AS note FROM documents UNION ALL SELECT 'missing_text', CAST(count(*) FILTER (coalesce(trim(text), '') = '') AS VARCHAR), 'null or blank' FROM documents UNION ALL SELECT 'distinct_sources', CAST(count(DISTINCT source) AS VARCHAR), '' FROM documents UNION ALL SELECT 'duplicate_texts', CAST(count(*) - count(DISTINCT text) AS VARCHAR), 'rows beyond the first' FROM documents UNION ALL SELECT 'longest', CAST(max(n_chars) AS VARCHAR), 'characters' FROM documents UNION ALL SELECT 'all_ids_set', CAST(bool_and(doc_id IS NOT NULL) AS VARCHAR), '' FROM documents")
def qa_long_report(spark, sf):
    return quality.report(documents(spark, sf), {
        "records": (F.count(F.lit(1)), "rows"), "missing_text": (count_if(tx.clean("text") == ""), "null or blank"), "distinct_sources": (F.count_distinct("source"), ""),
        "duplicate_texts": (quality.duplicates_of("text"), "rows beyond the first"), "longest": (F.max("n_chars"), "characters"), "all_ids_set": (F.bool_and(F.col("doc_id").isNotNull()), ""),
    })


_PROFILED = ["lang", "source", "n_chars"]


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS n_unique FROM documents" for c in _PROFILED))
def column_profile(spark, sf):
    return stats.column_profile(documents(spark, sf), _PROFILED)


@query("top_values", "SELECT source, count(*) AS records FROM documents GROUP BY source ORDER BY records DESC, source LIMIT 5")
def top_values(spark, sf):
    return stats.top_examples(documents(spark, sf), "source", 5)


@query("text_profile", "SELECT round(avg(length(coalesce(text, ''))), 6) AS mean_length, max(length(coalesce(text, ''))) AS max_length, round(avg(CASE WHEN length(coalesce(text, '')) > 100 THEN 1.0 ELSE 0.0 END), 6) AS long_share FROM documents")
def text_profile(spark, sf):
    return stats.text_profile(documents(spark, sf), "text")


# --- labels, splits, samples

_LABELS = "(SELECT l.doc_id, quality AS y_quality, toxic AS y_toxic, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS z_quality, CASE WHEN contains(text, '###') THEN 1 ELSE 0 END AS z_toxic, CAST(quality AS VARCHAR) || CAST(toxic AS VARCHAR) AS pattern FROM labels l JOIN documents USING (doc_id))"


def labelled(spark, sf):
    joined = read_table(spark, sf, "labels").join(documents(spark, sf), "doc_id").withColumnsRenamed({"quality": "y_quality", "toxic": "y_toxic"})
    out = joined.withColumns({"z_quality": (F.col("n_chars") > 1500).cast("int"), "z_toxic": F.contains("text", F.lit("###")).cast("int")})
    return out.withColumn("pattern", metrics.label_pattern(["quality", "toxic"])).select("doc_id", "y_quality", "y_toxic", "z_quality", "z_toxic", "pattern")


_SPLIT = f"""(SELECT doc_id, pattern, CASE WHEN i <= t2 THEN 'train' WHEN i <= t2 + v2 THEN 'validation' ELSE 'test' END AS split FROM (
SELECT *, CASE WHEN n >= 3 AND t + v = n AND v <= 1 AND t > 1 THEN t - 1 ELSE t END AS t2, CASE WHEN n >= 3 AND t + v = n AND v > 1 THEN v - 1 ELSE v END AS v2 FROM (
SELECT *, least(round_even(n * 0.15::DOUBLE, 0), greatest(n - t, 0)) AS v FROM (
SELECT doc_id, pattern, n, i, round_even(n * 0.7::DOUBLE, 0) AS t FROM (SELECT doc_id, pattern, count(*) OVER (PARTITION BY pattern) AS n, row_number() OVER (PARTITION BY pattern ORDER BY substr(sha256('42:' || doc_id), 1, 32), doc_id) AS i FROM {_LABELS})))))"""


@query("hash_split", f"SELECT * FROM {_SPLIT}")
def hash_split(spark, sf):
    return sampling.stratified_split(labelled(spark, sf).select("doc_id", "pattern"), "doc_id", "pattern")


@query("split_summary", f"SELECT pattern, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM {_SPLIT} GROUP BY pattern")
def split_summary(spark, sf):
    return stats.pivot_counts(hash_split(spark, sf), "pattern", "split", ["train", "validation", "test"])


@query("label_balance", f"SELECT split, pattern, records, round(records / sum(records) OVER (PARTITION BY split), 6) AS share FROM (SELECT split, pattern, count(*) AS records FROM {_SPLIT} GROUP BY ALL)")
def label_balance(spark, sf):
    from pyspark.sql import Window

    n = hash_split(spark, sf).groupBy("split", "pattern").agg(F.count(F.lit(1)).alias("records"))
    return n.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy("split")), 6))


@query("pos_weight", " UNION ALL ".join(f"SELECT '{v}' AS label, CAST(sum(y_{v}) AS BIGINT) AS positive, CAST(count(*) - sum(y_{v}) AS BIGINT) AS negative, round((count(*) - sum(y_{v}))::DOUBLE / greatest(sum(y_{v}), 1), 6) AS pos_weight FROM {_LABELS}" for v in ("quality", "toxic")))
def pos_weight(spark, sf):
    return metrics.class_weights(labelled(spark, sf), ["quality", "toxic"])


def _metrics_sql() -> str:
    names = ["quality", "toxic"]
    sums = ", ".join(f"sum(y_{v} * z_{v})::DOUBLE AS tp_{v}, sum((1 - y_{v}) * z_{v})::DOUBLE AS fp_{v}, sum(y_{v} * (1 - z_{v}))::DOUBLE AS fn_{v}" for v in names)
    both, either = " + ".join(f"y_{v} * z_{v}" for v in names), " + ".join(f"greatest(y_{v}, z_{v})" for v in names)
    p, r, f = {}, {}, {}
    for v in [*names, "micro"]:
        tp, fp, fn = (" + ".join(f"{k}_{u}" for u in names) if v == "micro" else f"{k}_{v}" for k in ("tp", "fp", "fn"))
        p[v], r[v] = f"(({tp}) / greatest({tp} + {fp}, 1.0))", f"(({tp}) / greatest({tp} + {fn}, 1.0))"
        f[v] = f"(2 * {p[v]} * {r[v]} / greatest({p[v]} + {r[v]}, 1e-12))"
    rows = {f"{v}_{n}": d[v] for v in [*names, "micro"] for n, d in (("precision", p), ("recall", r), ("f1", f))}
    rows |= {f"macro_{n}": f"({' + '.join(d[v] for v in names)}) / 2" for n, d in (("precision", p), ("recall", r), ("f1", f))} | {"samples_jaccard": "jaccard"}
    return f"WITH s AS (SELECT {sums}, avg(({both})::DOUBLE / greatest({either}, 1)) AS jaccard FROM {_LABELS}) " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({x}, 6) AS value FROM s" for k, x in rows.items())


@query("multilabel_metrics", _metrics_sql())
def multilabel_metrics(spark, sf):
    return metrics.multilabel(labelled(spark, sf), ["quality", "toxic"])


_POOLS = f"""(SELECT doc_id, supply_hits > 20 AS pool_supply, demand_hits > 30 OR (has_supply AND has_demand AND n_chars > 6000) AS pool_demand, has_environment AS pool_environment, n_chars < 1200 AS pool_other, n_chars < 1200 AND NOT (has_supply AND has_demand AND has_environment) AS pool_other_priority FROM {FEATURES})"""
EACH = 200


def _pools(spark, sf):
    f = features(spark, sf)
    every = F.col("has_supply") & F.col("has_demand") & F.col("has_environment")
    return f.select(
        "doc_id", (F.col("supply_hits") > 20).alias("pool_supply"), F.col("has_environment").alias("pool_environment"),
        ((F.col("demand_hits") > 30) | (F.col("has_supply") & F.col("has_demand") & (F.col("n_chars") > 6000))).alias("pool_demand"),
        (F.col("n_chars") < 1200).alias("pool_other"), ((F.col("n_chars") < 1200) & ~every).alias("pool_other_priority"),
    )


@query("pool_membership", f"SELECT doc_id, has_supply OR supply_hits >= 2 AS pool_supply, has_demand OR supply_hits >= 1 AS pool_demand, n_chars < 400 AS pool_other, has_supply AND has_demand AS all_specific, n_chars < 400 AND NOT (has_supply AND has_demand) AS pool_other_priority FROM {FEATURES}")
def pool_membership(spark, sf):
    f = features(spark, sf).select("doc_id", F.col("supply_hits").alias("supply_specific"), F.col("supply_hits").alias("supply_broad"), F.col("demand_hits").alias("demand_specific"), F.col("supply_hits").alias("demand_broad"), (F.col("n_chars") < 400).cast("int").alias("other_signal"))
    return sampling.pool_flags(f, {"supply": 2, "demand": 1}, "other").select("doc_id", "pool_supply", "pool_demand", "pool_other", "all_specific", "pool_other_priority")


_H = "substr(sha256('42:' || doc_id), 1, 32)"


_DRAWS = [("demand", "pool_demand", None), ("other", "pool_other", "pool_other_priority"), ("supply", "pool_supply", None), ("environment", "pool_environment", None)]


def _draws_sql() -> str:
    with_, done = [f"p AS (SELECT *, {_H} AS h FROM {_POOLS})"], []
    for name, member, priority in _DRAWS:
        unseen = "".join(f" AND doc_id NOT IN (FROM d_{x})" for x in done)
        with_.append(f"d_{name} AS (SELECT doc_id FROM p WHERE {member}{unseen} ORDER BY {f'{priority} DESC, ' if priority else ''}h, doc_id LIMIT {EACH})")
        done.append(name)
    return "WITH " + ", ".join(with_) + " " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS sample_pool FROM d_{n}" for n in done)


@query("pool_sample", _draws_sql())
def pool_sample(spark, sf):
    return sampling.pool_sample(_pools(spark, sf), "doc_id", _DRAWS, EACH)


_TOP3 = "(p_supply + p_demand + p_environment)"
_CONFLICT = "supply_label <> CAST(o_orderkey % 3 = 0 AS INTEGER) OR demand_label <> CAST(o_custkey % 2 = 0 AS INTEGER)"
_RULES = {  # name: (condition, order, rows)
    "near_half": ("max_tool_prob BETWEEN 0.45 AND 0.55", "abs(max_tool_prob - 0.5)", 30),
    "other_strong": ("other_label = 1", "p_other DESC", 30),
    "all_three_high": ("p_supply >= 0.7 AND p_demand >= 0.7 AND p_environment >= 0.7", f"round({_TOP3}, 9) DESC", 30),
    "demand_near_threshold": ("p_demand BETWEEN 0.45 AND 0.55", "p_demand", 30),
    "dictionary_conflict": (_CONFLICT, "p_other DESC", 30),
    "fallback": ("o_orderpriority = '5-LOW' AND o_orderkey % 50 = 7", "o_orderkey", 10),
}


@query("boundary_samples", " UNION ALL ".join(f"SELECT * FROM (SELECT o_orderkey, '{n}' AS reason FROM {SCORED_SQL} WHERE {c} ORDER BY {o}, o_orderkey LIMIT {k})" for n, (c, o, k) in _RULES.items()))
def boundary_samples(spark, sf):
    """Six kinds of rows for a second look."""
    order = lambda o: F.expr(o.removesuffix(" DESC")).desc() if o.endswith(" DESC") else F.expr(o).asc()
    return sampling.boundary_samples(scored_orders(spark, sf), "o_orderkey", {n: (F.expr(c.replace("INTEGER", "INT")), order(o), k) for n, (c, o, k) in _RULES.items()})


@query("confident_labels", f"SELECT o_orderkey, p_supply >= 0.75 AS high_supply, p_demand >= 0.75 AS high_demand, p_environment >= 0.75 AS high_environment, other_label = 1 OR (p_other >= 0.6 AND max_tool_prob < 0.4) AS high_other, valid_tool FROM {SCORED_SQL}")
def confident_labels(spark, sf):
    from paneloom.operators.panel import confident

    return confident(scored_orders(spark, sf), TOOLS, OTHER).select("o_orderkey", *(f"high_{t}" for t in [*TOOLS, OTHER]), "valid_tool")


# --- URLs, JSON, pages

@query("url_origin_counts", r"SELECT regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS origin, count(*) AS pages FROM pages GROUP BY origin")
def url_origin_counts(spark, sf):
    return read_table(spark, sf, "pages").groupBy(tx.origin("url").alias("origin")).agg(F.count(F.lit(1)).alias("pages"))


@query("json_props_parse", "SELECT event_type, count(*) AS events, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total_k, min(CAST(props ->> '$.k' AS BIGINT)) AS min_k, max(CAST(props ->> '$.k' AS BIGINT)) AS max_k FROM events GROUP BY event_type")
def json_props_parse(spark, sf):
    parsed = read_table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("total_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


_P = "(event_id % 100) / 100.0::DOUBLE"


@query("answer_parse", f"SELECT event_id, CASE WHEN event_id % 7 = 3 THEN 'failed' ELSE 'success' END AS label_status, CASE WHEN event_id % 7 = 3 THEN 0.0 ELSE {_P} END AS p_supply, CASE WHEN event_id % 7 = 3 THEN 0.0 ELSE least(1.0, 2 * {_P}) END AS p_other, CASE WHEN event_id % 7 = 3 THEN '' ELSE event_type || ';x' END AS supply_evidence FROM events")
def answer_parse(spark, sf):
    e = read_table(spark, sf, "events")
    p = (F.col("event_id") % 100) / 100.0
    obj = F.to_json(F.struct(p.alias("p_supply"), (2 * p).alias("p_other"), F.array(F.concat(F.lit(" "), F.col("event_type")), F.lit("x"), F.lit("")).alias("supply_evidence")))
    fenced = F.concat(F.lit("first {\"a\": 1}\n```json\n"), obj, F.lit("\n```\n"))
    kind = F.col("event_id") % 7
    content = F.when(kind == 0, obj).when(kind == 1, fenced).when(kind == 2, F.concat(F.lit("so: "), obj, F.lit(" done"))).when(kind == 3, F.lit("no answer")).when(kind == 4, F.lit(" ")).otherwise(obj)
    message = F.struct(content.alias("content"), F.when(kind == 4, obj).alias("reasoning_content"))
    raw = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    out = labeling.parse_answers(e.select("event_id", raw.alias("raw")), "raw", ["p_supply", "p_other"], ["supply_evidence"])
    return out.select("event_id", "label_status", "p_supply", "p_other", F.array_join("supply_evidence", ";").alias("supply_evidence"))


_ORDERED = sorted({t for ts in CATEGORIES.values() for t in ts}, key=lambda t: (-len(t), t))
_WINDOWS = f"""WITH RECURSIVE terms(k, t) AS (VALUES {', '.join(f"({k}, '{t}')" for k, t in enumerate(_ORDERED, 1))}),
body AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{SPACE}+', chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS b FROM documents),
r(doc_id, b, k, w, s) AS (SELECT doc_id, b, 0, CAST([] AS STRUCT(a BIGINT, z BIGINT)[]), '' FROM body
UNION ALL SELECT doc_id, b, k, CASE WHEN free THEN list_append(w, {{'a': a, 'z': z}}) ELSE w END, CASE WHEN NOT free OR piece = '' THEN s WHEN s = '' THEN piece ELSE s || chr(10) || piece END
FROM (SELECT *, trim(substr(b, a + 1, z - a), chr(10)) AS piece, pos >= 0 AND length(s) < 1200 AND len(list_filter(w, lambda x: a < x.z AND x.a < z)) = 0 AS free
FROM (SELECT *, CAST(greatest(0, pos - 120) AS BIGINT) AS a, CAST(least(length(b), pos + length(t) + 260) AS BIGINT) AS z FROM (SELECT r.doc_id, r.b, terms.k AS k, r.w, r.s, t, strpos(b, t) - 1 AS pos FROM r JOIN terms ON terms.k = r.k + 1))))
SELECT doc_id, substr(s, 1, 1200) AS context FROM r WHERE k = {len(_ORDERED)}"""


@query("context_window", _WINDOWS)
def context_window(spark, sf):
    return labeling.with_context(documents(spark, sf).select("doc_id", "text"), "text", [t for ts in CATEGORIES.values() for t in ts]).select("doc_id", "context")


_VALUES = ["0.25", "true", "false", "\"0.75\"", "\"x\"", "3", "-1", "null", "[1]", "{}"]


@query("answer_types", "SELECT event_id, CAST([0.25, 1.0, 0.0, 0.75, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0][event_id % 10 + 1] AS DOUBLE) AS p, [true, true, false, true, true, true, true, false, true, false][event_id % 10 + 1] AS is_set, ['[\"0.25\"]', '[\"True\"]', '[\"False\"]', '[\"0.75\"]', '[\"x\"]', '[\"3\"]', '[\"-1\"]', '[]', '[\"1\"]', '[\"{}\"]'][event_id % 10 + 1] AS evidence, event_id % 3 = 0 AS said_so FROM events")
def answer_types(spark, sf):
    """Values of any JSON type as a probability, a flag and evidence; a text such as "false" is a true flag."""
    value = F.element_at(F.array(*map(F.lit, _VALUES)), (F.col("event_id") % 10 + 1).cast("int"))
    said = F.when(F.col("event_id") % 3 == 0, F.lit('"false"')).otherwise(F.lit('""'))
    content = F.concat(F.lit('{"p": '), value, F.lit(', "is_set": '), value, F.lit(', "evidence": '), value, F.lit(', "said_so": '), said, F.lit("}"))
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    out = labeling.parse_answers(read_table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw", ["p"], ["evidence"], ["is_set", "said_so"], as_json=True)
    return out.select("event_id", "p", "is_set", "evidence", "said_so")


@query("model_text", rf"""SELECT doc_id, concat_ws(chr(10), 'title: ' || source, 'lang: ' || lang, '', 'text:', CASE WHEN b <> '' THEN substr(b, 1, 800) ELSE source END, CASE WHEN b = '' THEN chr(10) || 'note: no text, only metadata.' END) AS model_text FROM (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '{SPACE}+', chr(10), 'g'), '^\n+|\n+$', '', 'g') AS b FROM documents)""")
def model_text(spark, sf):
    return documents(spark, sf).select("doc_id", labeling.model_text(F.col("text"), F.col("source"), {"lang": F.col("lang")}).alias("model_text"))


@query("infer_batch", "SELECT doc_id, " + ", ".join(f"{hits_sql(CATEGORIES[t])} / ({hits_sql(CATEGORIES[t])} + 2.0::DOUBLE) AS p_{t}" for t in TOOLS) + " FROM documents")
def infer_batch(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return labeling.infer(docs, "text", TOOLS, labeling.keyword_model({t: CATEGORIES[t] for t in TOOLS})).drop("text")


_ODD_CASTS = ["12.0", "-3", "", "x1", "7e2"]
_ODD_DAYS = ["2024-02-29", "2023-02-29", "2024-1-5", "yesterday", ""]


@query("odd_casts", "SELECT o_orderkey, CAST([12, -3, NULL, NULL, 700][o_orderkey % 5 + 1] AS BIGINT) AS n, ['2024-02-29', NULL, '2024-01-05', NULL, NULL][o_orderkey % 5 + 1] AS day, ['2024-01-05', '2023-12-31', NULL, '2024-01-05', NULL][o_orderkey % 5 + 1] AS written_day, CAST([2024, 2023, NULL, 2024, 1999][o_orderkey % 5 + 1] AS INTEGER) AS written_year FROM orders")
def odd_casts(spark, sf):
    """Text that is no number or no day, days in Chinese signs, and years in text."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    written = pick(["于2024年1月5日发布", "2023-12-31", "没有日期", "2024年01月05日", "1999年"])
    return read_table(spark, sf, "orders").select("o_orderkey", to_int(pick(_ODD_CASTS)).alias("n"), to_date(pick(_ODD_DAYS)).cast("string").alias("day"), tx.chinese_date(written).cast("string").alias("written_day"), tx.year_in(written).alias("written_year"))


@query("null_rows", "SELECT 'any' AS how, count(*) FILTER (event_id % 3 > 0 AND event_id % 4 > 0) AS records FROM events UNION ALL SELECT 'all', count(*) FILTER (event_id % 12 > 0) FROM events UNION ALL SELECT 'columns', 2")
def null_rows(spark, sf):
    """Rows without a null in any of two columns, rows without nulls in both, and the columns left when one holds nothing."""
    e = read_table(spark, sf, "events").select(F.when(F.col("event_id") % 3 > 0, 1).alias("a"), F.when(F.col("event_id") % 4 > 0, 1).alias("b"), F.lit(None).cast("string").alias("c"))
    n = lambda how, df: df.agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("records"))
    left = len(panel.without_empty_columns(e).columns)
    return n("any", panel.without_nulls(e, ["a", "b"])).unionByName(n("all", panel.without_nulls(e, ["a", "b"], "all"))).unionByName(spark.createDataFrame([("columns", left)], "how string, records bigint"))


@query("logistic_scores", "SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice - 150000) / 50000)), 9) AS p FROM orders")
def logistic_scores(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", F.round(sigmoid((F.col("o_totalprice") - 150000) / 50000), 9).alias("p"))


@query("list_fields", "SELECT event_id, array_to_string(CASE event_id % 4 WHEN 0 THEN ['a', 'b c'] WHEN 1 THEN [] WHEN 2 THEN ['plain'] ELSE ['x', 'y'] END, '|') AS items, array_to_string(CASE WHEN event_id % 2 = 0 THEN ['p', 'q r'] ELSE [] END, '|') AS parts FROM events")
def list_fields(spark, sf):
    """Lists that were written as text, and parts between a separator."""
    kind = F.col("event_id") % 4
    e = read_table(spark, sf, "events").select("event_id", F.when(kind == 0, "['a', 'b c']").when(kind == 1, "[]").when(kind == 2, "plain").otherwise('["x", "y", null]').alias("t"), F.when(F.col("event_id") % 2 == 0, " p ; ;q r;").alias("s"))
    return e.select("event_id", F.array_join(io.serialized_list("t"), "|").alias("items"), F.array_join(tx.split_trim("s", ";"), "|").alias("parts"))


@query("column_examples", "SELECT 'lang' AS \"column\", lang AS value, count(*) AS records FROM documents WHERE lang IS NOT NULL GROUP BY lang QUALIFY row_number() OVER (ORDER BY count(*) DESC, lang) <= 5 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source QUALIFY row_number() OVER (ORDER BY count(*) DESC, source) <= 5")
def column_examples(spark, sf):
    return stats.top_values(documents(spark, sf), ["lang", "source"], 5)


@query("one_row_quality", "SELECT count(*) AS records, count(*) FILTER (coalesce(trim(text), '') = '') AS blank, count(DISTINCT source) AS sources, bool_and(doc_id IS NOT NULL) AS keyed FROM documents")
def one_row_quality(spark, sf):
    return quality.one_row(documents(spark, sf), {"records": F.count(F.lit(1)), "blank": count_if(tx.clean("text") == ""), "sources": F.count_distinct("source"), "keyed": F.bool_and(F.col("doc_id").isNotNull())})


@query("unique_keys", "SELECT doc_id, lang FROM documents")
def unique_keys(spark, sf):
    """The documents by id; fails when it is run if an id repeats."""
    return keys.once_each(documents(spark, sf).select("doc_id", "lang"), ["doc_id"], "documents")


@query("gated_counts", "SELECT lang, count(*) AS records FROM documents GROUP BY lang")
def gated_counts(spark, sf):
    """Counts that are made only if the checks before them pass."""
    d = documents(spark, sf)
    found = d.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("doc_id").isNotNull()).alias("keyed")).first()
    rules.require_gates(rules.gates(spark, [("has_rows", found["n"] > 0, f"rows={found['n']}"), ("keyed", found["keyed"], "")]))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("records"))


@query("typed_casts", "SELECT o_orderkey, CAST(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS BIGINT) AS n, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus = 'F' AS finished FROM (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders)")
def typed_casts(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("t", F.floor("o_totalprice").cast("double"))
    return o.select("o_orderkey", to_int("t").alias("n"), to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string").alias("day"), tx.truthy(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no")).alias("finished"))


@query("resume_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark, sf):
    return keys.resume(documents(spark, sf), read_table(spark, sf, "labels"), ["doc_id"]).select("doc_id")


@query("chat_requests", """SELECT conv_id, turn, CAST(json_object('model', 'm', 'temperature', 0, 'messages', json_array(json_object('role', 'system', 'content', 's'), json_object('role', 'user', 'content', replace(coalesce(text, ''), '/', '|'))), 'response_format', json_object('type', 'json_object')) AS VARCHAR) AS body FROM conversations""")
def chat_requests(spark, sf):
    """Whole request bodies (slashes are replaced, as one engine escapes them in JSON)."""
    body = labeling.chat_request("m", "s", F.replace(F.coalesce("text", F.lit("")), F.lit("/"), F.lit("|")))
    return read_table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))


@query("delimited_flags", f"SELECT value, count(*) AS records FROM (SELECT unnest(string_split(concat_ws(';', CASE WHEN has_supply THEN 'supply' END, CASE WHEN has_demand THEN 'demand' END, CASE WHEN has_environment THEN 'environment' END), ';')) AS value FROM {FEATURES}) WHERE value <> '' GROUP BY value")
def delimited_flags(spark, sf):
    flags = F.concat_ws(";", *(F.when(F.col(f"has_{t}"), F.lit(t)) for t in TOOLS))
    return rules.delimited_counts(features(spark, sf).select(flags.alias("flags")), "flags")


@query("label_model_metrics")
def label_model_metrics(spark, sf):
    """Test metrics of the best of three models fitted on the training rows, with 15 iterations in place of 40."""
    from paneloom.operators import training

    rows = labelled(spark, sf).join(documents(spark, sf).select("doc_id", "text"), "doc_id")
    parts = sampling.stratified_split(rows, "doc_id", "pattern")
    model, _ = training.fit(parts.where("split = 'train'"), parts.where("split = 'validation'"), "text", ["quality", "toxic"], iterations=15)
    return training.evaluate(model, parts.where("split = 'test'"), "text")
