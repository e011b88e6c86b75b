"""Queries of dictionary text mining and TF-IDF over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions.numeric import share_if
from paneloom.operators import dictionary, panel, stats, tfidf
from paneloom.plans.common import CATEGORIES, features_sql, hits_sql
from paneloom.plans.registry import query
from paneloom.session import read_table

NAMES = list(CATEGORIES)
FEATURES = features_sql()
BROAD = ["the", "and"]


def documents(spark, sf):
    return read_table(spark, sf, "documents")


def features(spark, sf):
    return dictionary.row_features(documents(spark, sf), "text", CATEGORIES).drop("text")


_HITS = [f"{n}_hits" for n in NAMES]
_CELL = ", ".join(f"sum({n}_hits) AS {n}_hits, count(*) FILTER (has_{n}) AS {n}_documents" for n in NAMES)
_FILLED = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for n in NAMES for c in (f"{n}_hits", f"{n}_documents"))
_SHARES = ", ".join(f"coalesce({c}::DOUBLE / nullif({' + '.join(_HITS)}, 0), 0.0) AS {c}_share" for c in _HITS)


@query(
    "tool_share_panel",
    f"""SELECT *, {_SHARES}, round(ln(1 + documents), 6) AS log_documents FROM (
SELECT source, lang, CAST(coalesce(documents, 0) AS BIGINT) AS documents, {_FILLED}
FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT DISTINCT lang FROM documents)
LEFT JOIN (SELECT source, lang, count(*) AS documents, {_CELL} FROM {FEATURES} GROUP BY ALL) USING (source, lang))""",
)
def tool_share_panel(spark, sf):
    docs = documents(spark, sf)
    facts = dictionary.panel_features(features(spark, sf), ["source", "lang"], NAMES)
    frame = panel.skeleton(docs.select("source"), docs.select("lang"), "lang")
    zero = ["documents", *(c for n in NAMES for c in (f"{n}_hits", f"{n}_documents"))]
    return panel.shares(panel.balance(frame, facts, ["source", "lang"], zero, {"log_documents": "documents"}), _HITS)


@query("dict_row_features", f"SELECT * FROM {FEATURES}")
def dict_row_features(spark, sf):
    return features(spark, sf)


def _coverage_sql() -> str:
    one = "SELECT '{c}' AS category, '{t}' AS term, count(*) FILTER (h > 0) AS records_hit, CAST(coalesce(sum(h), 0) AS BIGINT) AS total_hits, coalesce(count(*) FILTER (h > 0)::DOUBLE / nullif(count(*), 0), 0.0) AS record_hit_share FROM (SELECT {h} AS h FROM documents)"
    return "(" + " UNION ALL ".join(one.format(c=c, t=t, h=hits_sql([t])) for c, ts in CATEGORIES.items() for t in ts) + ")"


def coverage(spark, sf):
    return dictionary.term_coverage(documents(spark, sf), "text", CATEGORIES)


@query("term_coverage", f"SELECT * FROM {_coverage_sql()}")
def term_coverage(spark, sf):
    return coverage(spark, sf)


@query("keyword_flags", f"SELECT *, concat_ws(';', CASE WHEN records_hit = 0 THEN 'zero_coverage' WHEN record_hit_share < 0.05 THEN 'low_coverage' END, CASE WHEN record_hit_share >= 0.5 THEN 'high_coverage' END, CASE WHEN length(term) <= 3 THEN 'short_term' END, CASE WHEN term IN ('the', 'and') THEN 'broad_term' END) AS review_flags FROM {_coverage_sql()}")
def keyword_flags(spark, sf):
    return dictionary.review_flags(coverage(spark, sf), short=3, broad=BROAD, high=0.5)


@query("coverage_bands", f"SELECT *, CASE WHEN record_hit_share >= 0.8 THEN 'saturated' WHEN record_hit_share >= 0.5 THEN 'high' WHEN record_hit_share >= 0.25 THEN 'medium' WHEN record_hit_share >= 0.05 THEN 'low' ELSE 'rare' END AS coverage_band, CASE WHEN record_hit_share >= 0.8 OR (record_hit_share >= 0.5 AND term IN ('the', 'and')) THEN 'background' WHEN record_hit_share >= 0.05 THEN 'discriminating' WHEN records_hit > 0 THEN 'rare' ELSE 'unused' END AS role FROM {_coverage_sql()}")
def coverage_bands(spark, sf):
    return dictionary.term_role(dictionary.with_band(coverage(spark, sf)), BROAD)


_FLAG = {n: f"has_{n}" for n in NAMES}
_ANY, _ALL = " OR ".join(_FLAG.values()), " AND ".join(_FLAG.values())
_GROUPS = {"any": _ANY, "none": f"NOT ({_ANY})", "all": _ALL} | _FLAG
_GROUPS |= {f"{n}_only": f"{c} AND NOT ({' OR '.join(x for m, x in _FLAG.items() if m != n)})" for n, c in _FLAG.items()}
_GROUPS |= {f"{a}_and_{b}": f"{_FLAG[a]} AND {_FLAG[b]}" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]}


@query("category_overlap", " UNION ALL ".join(f"SELECT '{g}' AS \"group\", count(*) FILTER ({c}) AS records, coalesce(count(*) FILTER ({c})::DOUBLE / nullif(count(*), 0), 0.0) AS share FROM {FEATURES}" for g, c in _GROUPS.items()))
def category_overlap(spark, sf):
    return stats.overlap_groups(features(spark, sf), {n: F.col(f"has_{n}") for n in NAMES})


@query("no_hit_records", f"SELECT doc_id, source, lang, n_chars FROM {FEATURES} WHERE NOT any_hit")
def no_hit_records(spark, sf):
    return features(spark, sf).where("not any_hit").select("doc_id", "source", "lang", "n_chars")


@query("no_hit_summary", f"SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS documents, count(*) FILTER (NOT any_hit) AS no_hit, round(avg(CASE WHEN any_hit THEN 0.0 ELSE 1.0 END), 6) AS no_hit_share FROM {FEATURES} GROUP BY GROUPING SETS ((source), (lang), ())")
def no_hit_summary(spark, sf):
    f = features(spark, sf)
    grouped = f.groupingSets([[F.col("source")], [F.col("lang")], []], F.col("source"), F.col("lang"))
    out = grouped.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(~F.col("any_hit"), 1)).alias("no_hit"), F.round(share_if(~F.col("any_hit")), 6).alias("no_hit_share"))
    return out.withColumn("source", F.coalesce("source", F.lit("all"))).withColumn("lang", F.coalesce("lang", F.lit("all")))


_LOWER = features_sql("lower(coalesce(text, ''))")


def _surfaces(spark, sf):
    """The dictionary's measures of each text as it is and in lower case, from one scan."""
    return dictionary.two_surfaces(documents(spark, sf), F.col("text"), F.lower("text"), CATEGORIES)


@query("surface_transitions", " UNION ALL ".join(f"SELECT '{n}' AS category, {x} AS before_hit, {y} AS after_hit, count(*) FILTER (a.has_{n} = {x} AND b.has_{n} = {y}) AS records FROM {FEATURES} a JOIN {_LOWER} b USING (doc_id)" for n in NAMES for x in ("false", "true") for y in ("false", "true")))
def surface_transitions(spark, sf):
    return dictionary.transitions_within(_surfaces(spark, sf), NAMES)


@query("measure_deltas", "SELECT a.lang, " + ", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b, b.{c} - a.{c} AS {c}_delta" for c in _HITS) + " FROM " + " JOIN ".join(f"(SELECT lang, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _HITS)} FROM {t} GROUP BY lang) {x}" for t, x in ((FEATURES, "a"), (_LOWER, "b"))) + " USING (lang)")
def measure_deltas(spark, sf):
    sums = _surfaces(spark, sf).groupBy("lang").agg(*(F.sum(f"{p}_{c}").alias(f"{c}_{p}") for p in ("a", "b") for c in _HITS))
    return dictionary.deltas_within(sums, _HITS).select("lang", *(f"{c}{x}" for c in _HITS for x in ("_a", "_b", "_delta")))


@query("measure_deltas_joined", "SELECT a.lang, a.n - b.n AS dropped, a.c AS n_chars_a, b.c AS n_chars_b, b.c - a.c AS n_chars_delta FROM (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents GROUP BY lang) a JOIN (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents WHERE n_chars > 400 GROUP BY lang) b USING (lang)")
def measure_deltas_joined(spark, sf):
    both = [documents(spark, sf), documents(spark, sf).where("n_chars > 400")]
    a, b = (d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")) for d in both)
    return dictionary.measure_deltas(a, b, ["lang"], ["n", "n_chars"]).select("lang", (-F.col("n_delta")).alias("dropped"), "n_chars_a", "n_chars_b", "n_chars_delta")


@query("term_text_join", f"SELECT category, term, count(*) AS records, min(doc_id) AS first_doc FROM documents JOIN (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{t}{chr(39)})' for c, ts in CATEGORIES.items() for t in ts)}) v(category, term) ON contains(text, term) GROUP BY ALL")
def term_text_join(spark, sf):
    table = spark.createDataFrame([(c, t) for c, ts in CATEGORIES.items() for t in ts], "category string, term string")
    return dictionary.hits_by_join(documents(spark, sf), "doc_id", "text", table).groupBy("category", "term").agg(F.count(F.lit(1)).alias("records"), F.min("doc_id").alias("first_doc"))


# --- TF-IDF: phrases of the dictionary and a few more; labels are languages, periods the id modulo 6

PHRASES = sorted({t for ts in CATEGORIES.values() for t in ts} | {"tion", "ing", "ción", "eau", "sch", "heit", "ment", "able"})
_ALT = "|".join(sorted(PHRASES, key=lambda t: (-len(t), t)))
_COUNTS = f"(SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '({_ALT})', 1)) AS term FROM documents) GROUP BY ALL)"
_IDF = f"(SELECT term, count(*) AS doc_count, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0, 9) AS idf FROM {_COUNTS} GROUP BY term)"
_WEIGHTS = f"(SELECT doc_id, term, n, doc_count, idf, round(ln(1 + n), 9) * idf AS tfidf FROM {_COUNTS} JOIN {_IDF} USING (term))"
_TERMS_VALUES = ", ".join(f"('{t}')" for t in PHRASES)
_LIFT = f"""(SELECT *, round(mean_tfidf + greatest(tfidf_lift, 0.0) + greatest(share_lift, 0.0), 6) AS score FROM (
SELECT *, round(mean_tfidf - outside_tfidf, 6) AS tfidf_lift, round(label_share - global_share, 6) AS share_lift FROM (
SELECT lang, label_docs, term, CAST(coalesce(label_doc_count, 0) AS BIGINT) AS label_doc_count, CAST(coalesce(global_doc_count, 0) AS BIGINT) AS global_doc_count,
  round(coalesce(in_sum, 0) / label_docs, 6) AS mean_tfidf, round(coalesce((coalesce(all_sum, 0) - coalesce(in_sum, 0)) / nullif((SELECT count(*) FROM documents) - label_docs, 0), 0.0), 6) AS outside_tfidf,
  round(coalesce(label_doc_count, 0) / label_docs, 6) AS label_share, round(coalesce(global_doc_count, 0) / (SELECT count(*) FROM documents), 6) AS global_share
FROM (SELECT lang, count(*) AS label_docs FROM documents GROUP BY lang) CROSS JOIN (VALUES {_TERMS_VALUES}) t(term)
LEFT JOIN (SELECT lang, term, sum(tfidf) AS in_sum, count(*) AS label_doc_count FROM {_WEIGHTS} JOIN documents USING (doc_id) GROUP BY ALL) USING (lang, term)
LEFT JOIN (SELECT term, sum(tfidf) AS all_sum, count(*) AS global_doc_count FROM {_WEIGHTS} GROUP BY term) USING (term))))"""
_TOP = f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, mean_tfidf DESC, label_share DESC, term) AS INTEGER) AS rank FROM {_LIFT}) WHERE rank <= 12)"


def _weights(spark, sf):
    docs = documents(spark, sf)
    counts = tfidf.term_counts(docs, "doc_id", "text", PHRASES)
    n = docs.count()
    return docs, n, counts, tfidf.weigh(counts, tfidf.idf(counts, "doc_id", n))


def _lift(spark, sf):
    docs, n, _, weights = _weights(spark, sf)
    terms = spark.createDataFrame([(t,) for t in PHRASES], "term string")
    return tfidf.label_lift(weights, "doc_id", docs.select("doc_id", "lang"), "lang", n, terms)


@query("tfidf_weights", f"SELECT doc_id, term, n, doc_count, round(tfidf, 6) AS tfidf FROM {_WEIGHTS}")
def tfidf_weights(spark, sf):
    return _weights(spark, sf)[3].select("doc_id", "term", "n", "doc_count", F.round("tfidf", 6).alias("tfidf"))


@query("tfidf_label_lift", f"SELECT * FROM {_LIFT}")
def tfidf_label_lift(spark, sf):
    return _lift(spark, sf)


@query("tfidf_top_terms", f"SELECT * FROM {_TOP}")
def tfidf_top_terms(spark, sf):
    return tfidf.top_terms(_lift(spark, sf), "lang", 12)


@query("tfidf_overlap", f"SELECT term, count(DISTINCT lang) AS n_labels, string_agg(DISTINCT lang, ';' ORDER BY lang) AS labels, min(rank) AS best_rank FROM {_TOP} WHERE rank <= 8 GROUP BY term HAVING count(DISTINCT lang) >= 2")
def tfidf_overlap(spark, sf):
    return tfidf.overlap(tfidf.top_terms(_lift(spark, sf), "lang", 12), "lang", within=8)


_MEMBERS = "(SELECT doc_id, lang, CAST(2019 + doc_id % 6 AS BIGINT) AS year FROM documents)"
_MEANS = f"(SELECT lang, year, term, docs, round(s / docs, 6) AS mean_tfidf FROM (SELECT lang, year, term, sum(tfidf) AS s FROM {_WEIGHTS} JOIN {_MEMBERS} USING (doc_id) GROUP BY ALL) JOIN (SELECT lang, year, count(*) AS docs FROM {_MEMBERS} GROUP BY ALL) USING (lang, year))"
_BASE = f"(SELECT lang, term, docs, round(s / docs, 6) AS mean_tfidf FROM (SELECT lang, term, sum(tfidf) AS s FROM {_WEIGHTS} JOIN {_MEMBERS} USING (doc_id) GROUP BY ALL) JOIN (SELECT lang, count(*) AS docs FROM {_MEMBERS} GROUP BY ALL) USING (lang))"


def _members(docs):
    return docs.select("doc_id", "lang", (2019 + F.col("doc_id") % 6).alias("year"))


@query("yearly_drift", f"""WITH v AS (SELECT * FROM {_MEANS}), b AS (SELECT * FROM {_BASE}), vn AS (SELECT lang, year, sqrt(sum(mean_tfidf * mean_tfidf)) AS x FROM v GROUP BY ALL), bn AS (SELECT lang, sqrt(sum(mean_tfidf * mean_tfidf)) AS x FROM b GROUP BY ALL)
SELECT lang, year, 'baseline' AS against, round(coalesce(d / nullif(vn.x * bn.x, 0), 0.0), 6) AS cosine FROM vn JOIN bn USING (lang) LEFT JOIN (SELECT lang, year, sum(v.mean_tfidf * b.mean_tfidf) AS d FROM v JOIN b USING (lang, term) GROUP BY ALL) USING (lang, year)
UNION ALL SELECT vn.lang, vn.year, 'previous', round(coalesce(d / nullif(vn.x * p.x, 0), 0.0), 6) FROM vn JOIN vn p ON p.lang = vn.lang AND p.year = vn.year - 1 LEFT JOIN (SELECT a.lang, a.year, sum(a.mean_tfidf * c.mean_tfidf) AS d FROM v a JOIN v c ON a.lang = c.lang AND a.term = c.term AND c.year = a.year - 1 GROUP BY ALL) q ON q.lang = vn.lang AND q.year = vn.year""")
def yearly_drift(spark, sf):
    docs, _, _, weights = _weights(spark, sf)
    members = _members(docs)
    means = tfidf.cell_means(weights, "doc_id", members, ["lang", "year"])
    return tfidf.drift(means, tfidf.cell_means(weights, "doc_id", members, ["lang"]), "lang", "year")


@query("year_cell_stats", f"SELECT lang, year, CAST(coalesce(docs, 0) AS BIGINT) AS docs, coalesce(mean_terms, 0.0) AS mean_terms, coalesce(any_term_share, 0.0) AS any_term_share, coalesce(docs, 0) < 10 AS is_thin FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT CAST(y AS BIGINT) AS year FROM range(2019, 2026) r(y)) LEFT JOIN (SELECT lang, year, count(*) AS docs, round(avg(coalesce(n, 0)), 6) AS mean_terms, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_term_share FROM {_MEMBERS} LEFT JOIN (SELECT doc_id, sum(n) AS n FROM {_COUNTS} GROUP BY doc_id) USING (doc_id) GROUP BY ALL) USING (lang, year)")
def year_cell_stats(spark, sf):
    docs, _, counts, _ = _weights(spark, sf)
    grid = panel.skeleton(docs.select("lang"), list(range(2019, 2026)), "year")
    return tfidf.cell_stats(counts, "doc_id", _members(docs), ["lang", "year"], grid)


@query("representative_docs", f"SELECT * FROM (SELECT lang, doc_id, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS hits, max(n_chars) AS n_chars, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, sum(n) DESC, max(n_chars) DESC, doc_id) AS INTEGER) AS rank FROM (SELECT * FROM {_COUNTS} JOIN documents USING (doc_id)) JOIN (SELECT lang, term FROM {_TOP} WHERE rank <= 6) USING (lang, term) GROUP BY lang, doc_id) WHERE rank <= 15")
def representative_docs(spark, sf):
    docs, _, counts, _ = _weights(spark, sf)
    return tfidf.representatives(counts, "doc_id", tfidf.top_terms(_lift(spark, sf), "lang", 12), "lang", docs.select("doc_id", "lang", "n_chars"), "n_chars", 15, 6)


@query("vocabulary_build", "SELECT term, string_agg(DISTINCT source, ';' ORDER BY source) AS source, string_agg(DISTINCT category, ';' ORDER BY category) AS category, CAST(length(term) AS INTEGER) AS term_length FROM (SELECT regexp_replace(p_type, '\\s+|[[:punct:]]', '', 'g') AS term, 'part' AS source, p_brand AS category FROM part UNION ALL SELECT regexp_replace(c_mktsegment, '\\s+|[[:punct:]]', '', 'g'), 'customer', CAST(c_nationkey % 3 AS VARCHAR) FROM customer) WHERE length(term) >= 2 AND term <> 'BUILDING' GROUP BY term")
def vocabulary_build(spark, sf):
    part, customer = read_table(spark, sf, "part"), read_table(spark, sf, "customer")
    sources = [part.select(F.col("p_type").alias("term"), F.lit("part").alias("source"), F.col("p_brand").alias("category")), customer.select(F.col("c_mktsegment").alias("term"), F.lit("customer").alias("source"), (F.col("c_nationkey") % 3).cast("string").alias("category"))]
    return tfidf.vocabulary(sources, "term", ["BUILDING"])


@query("revision_effect", f"SELECT lang, CAST(sum(a.supply_hits) AS BIGINT) AS before_hits, CAST(sum(b.supply_hits) AS BIGINT) AS after_hits, round(coalesce((sum(b.supply_hits) - sum(a.supply_hits))::DOUBLE / nullif(sum(a.supply_hits), 0), 0.0), 6) AS relative_change FROM {FEATURES} a JOIN (SELECT doc_id, supply_hits FROM {_LOWER}) b USING (doc_id) GROUP BY lang")
def revision_effect(spark, sf):
    sums = _surfaces(spark, sf).groupBy("lang").agg(F.sum("a_supply_hits").alias("before_hits"), F.sum("b_supply_hits").alias("after_hits"))
    return sums.withColumn("relative_change", F.round(dictionary.revision_effect(F.col("before_hits"), F.col("after_hits")), 6))


@query("domain_term_totals", f"SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS documents, CAST(max(n) AS BIGINT) AS most FROM {_COUNTS} GROUP BY term")
def domain_term_totals(spark, sf):
    return _weights(spark, sf)[2].groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most"))


@query("vector_top_terms", f"SELECT lang, year, term, mean_tfidf, CAST(row_number() OVER (PARTITION BY lang, year ORDER BY mean_tfidf DESC, term) AS INTEGER) AS rank FROM {_MEANS} WHERE mean_tfidf > 0 QUALIFY row_number() OVER (PARTITION BY lang, year ORDER BY mean_tfidf DESC, term) <= 5")
def vector_top_terms(spark, sf):
    docs, _, _, weights = _weights(spark, sf)
    means = tfidf.cell_means(weights, "doc_id", _members(docs), ["lang", "year"]).select("lang", "year", "term", "mean_tfidf")
    return tfidf.vector_top_terms(means, ["lang", "year"], n=5)
