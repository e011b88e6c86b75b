"""Queries over unit-year panels: balance, pivots, statistics, intensities, final panel."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from paneloom.functions.numeric import count_if
from paneloom.operators import keys, panel, quality, rules, stats
from paneloom.plans.common import ORDERS_SQL, OTHER, SCORED_SQL, TOOLS, YEARS, cells, cells_sql, scored_orders, unit_orders
from paneloom.plans.registry import query
from paneloom.session import read_table

SPARSE = "o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'"
VARS = ["orders", "value", "mean_value", "customers"]


@query("unit_year_panel", f"SELECT * FROM {cells_sql()}")
def unit_year_panel(spark, sf):
    return cells(spark, sf)


@query("unit_year_panel_sparse", f"SELECT * FROM {cells_sql(SPARSE)}")
def unit_year_panel_sparse(spark, sf):
    return cells(spark, sf, unit_orders(spark, sf).where(SPARSE))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("year_trend_pivot", "SELECT period, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in _PRIORITIES) + f" FROM {ORDERS_SQL} GROUP BY period")
def year_trend_pivot(spark, sf):
    return stats.pivot_counts(unit_orders(spark, sf), "period", "o_orderpriority", _PRIORITIES)


@query("unit_distribution_ranked", f"SELECT unit, orders, round(orders / sum(orders) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY orders DESC, unit) AS INTEGER) AS rank FROM (SELECT unit, count(*) AS orders FROM {ORDERS_SQL} GROUP BY unit)")
def unit_distribution_ranked(spark, sf):
    from pyspark.sql import Window

    by_unit = unit_orders(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("orders"))
    return stats.ranked(by_unit.withColumn("share", F.round(F.col("orders") / F.sum("orders").over(Window.partitionBy()), 6)), [F.desc("orders"), F.col("unit")])


@query("heatmap_pivot", "SELECT unit, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (period = {y}), 0.0), 2) AS \"{y}\"" for y in YEARS) + f" FROM {ORDERS_SQL} GROUP BY unit")
def heatmap_pivot(spark, sf):
    return stats.pivot_values(unit_orders(spark, sf), "unit", "period", F.round(F.sum("o_totalprice"), 2), YEARS).na.fill(0.0)


@query("group_comparison", f"SELECT c_mktsegment, count(*) AS orders, round(avg(o_totalprice), 6) AS mean_value, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS finished_share, count(*) FILTER (o_totalprice > 250000) AS large_orders, min(period) AS first_year, max(period) AS last_year FROM {ORDERS_SQL} GROUP BY c_mktsegment")
def group_comparison(spark, sf):
    return unit_orders(spark, sf).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 6).alias("mean_value"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("finished_share"),
        count_if(F.col("o_totalprice") > 250000).alias("large_orders"), F.min("period").alias("first_year"), F.max("period").alias("last_year"),
    )


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, cols: list[str], std: str = "stddev_pop") -> str:
    one = "SELECT '{c}' AS variable, count({c}) AS n, count(*) FILTER ({c} IS NULL) AS missing, round(avg({c}), 6) AS mean, round({std}({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max, count(*) FILTER ({c} = 0) AS zeros FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table, std=std) for c in cols)


@query("describe_stats", _describe_sql("lineitem", _MEASURES))
def describe_stats(spark, sf):
    return stats.describe(read_table(spark, sf, "lineitem"), _MEASURES)


@query("describe_sample_std", _describe_sql("supplier", ["s_acctbal"], "stddev_samp"))
def describe_sample_std(spark, sf):
    return stats.describe(read_table(spark, sf, "supplier"), ["s_acctbal"], ddof=1)


def _pair_sql(a: str, b: str, table: str, name: str = "pearson") -> str:
    x, y = f"{a}::DOUBLE", f"{b}::DOUBLE"
    return f"SELECT '{a}' AS left_variable, '{b}' AS right_variable, round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6) AS {name} FROM {table}"


@query("pearson_pairs", " UNION ALL ".join(_pair_sql(a, b, cells_sql()) for a, b in combinations(VARS, 2)))
def pearson_pairs(spark, sf):
    return stats.pearson(cells(spark, sf), VARS)


@query("pearson_matrix", " UNION ALL ".join(_pair_sql(a, b, "lineitem") for a in _MEASURES for b in _MEASURES))
def pearson_matrix(spark, sf):
    return stats.pearson(read_table(spark, sf, "lineitem"), _MEASURES, "matrix")


_RANKED = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}" for v in VARS) + f" FROM {cells_sql()})"


@query("spearman_pairs", " UNION ALL ".join(_pair_sql(a, b, _RANKED, "spearman") for a, b in combinations(VARS, 2)))
def spearman_pairs(spark, sf):
    return stats.spearman(cells(spark, sf), VARS)


@query("zscore_panel", "SELECT unit, period, " + ", ".join(f"CASE WHEN s_{v} = 0 THEN 0.0 ELSE round(({v} - m_{v}) / nullif(s_{v}, 0), 6) END AS {v}_z" for v in VARS) + f" FROM {cells_sql()}, (SELECT " + ", ".join(f"avg({v}) AS m_{v}, stddev_pop({v}) AS s_{v}" for v in VARS) + f" FROM {cells_sql()})")
def zscore_panel(spark, sf):
    return panel.zscores(cells(spark, sf), VARS).select("unit", "period", *(f"{v}_z" for v in VARS))


def _robust_sql(table: str, key: str, cols: list[str]) -> str:
    med = ", ".join(f"quantile_cont({v}::DOUBLE, 0.5) AS d_{v}, avg({v}) AS m_{v}, stddev_pop({v}) AS s_{v}" for v in cols)
    mad = ", ".join(f"quantile_cont(abs({v} - d_{v}), 0.5) AS a_{v}" for v in cols)
    z = ", ".join(f"round(CASE WHEN a_{v} = 0 THEN CASE WHEN s_{v} = 0 THEN 0.0 ELSE ({v} - m_{v}) / nullif(s_{v}, 0) END ELSE 0.6745 * ({v} - d_{v}) / nullif(a_{v}, 0) END, 6) AS {v}_rz" for v in cols)
    return f"WITH t AS (SELECT * FROM {table}), m AS (SELECT {med} FROM t), a AS (SELECT {mad} FROM t, m) SELECT {key}, {z} FROM t, m, a"


@query("robust_z_outliers", f"SELECT *, greatest(abs(orders_rz), abs(mean_value_rz)) AS max_abs_z FROM ({_robust_sql(cells_sql(SPARSE), 'unit, period', ['orders', 'mean_value'])}) WHERE greatest(abs(orders_rz), abs(mean_value_rz)) >= 2")
def robust_z_outliers(spark, sf):
    sparse = cells(spark, sf, unit_orders(spark, sf).where(SPARSE))
    scored = panel.robust_z(sparse, ["orders", "mean_value"]).select("unit", "period", "orders_rz", "mean_value_rz")
    return panel.outliers(scored, ["orders", "mean_value"], limit=2.0)


@query("dense_rank_units", f"SELECT unit, orders, CAST(dense_rank() OVER (ORDER BY orders DESC) AS INTEGER) AS rank FROM (SELECT unit, count(*) AS orders FROM {ORDERS_SQL} GROUP BY unit)")
def dense_rank_units(spark, sf):
    return stats.dense_ranked(unit_orders(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("orders")), "orders")


_TERTILE = f"(SELECT unit, orders, CAST(CASE WHEN 3 * (r - 1) < n - 1 THEN 1 WHEN 3 * (r - 1) < 2 * (n - 1) THEN 2 ELSE 3 END AS INTEGER) AS tertile FROM (SELECT *, row_number() OVER (ORDER BY orders, unit) AS r, count(*) OVER () AS n FROM (SELECT unit, count(*) AS orders FROM {ORDERS_SQL} GROUP BY unit)))"


def _tertiles(spark, sf):
    return panel.tertiles(unit_orders(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("orders")), "orders", ["unit"])


@query("tertile_units", f"SELECT * FROM {_TERTILE}")
def tertile_units(spark, sf):
    return _tertiles(spark, sf)


@query("region_year_summary", f"SELECT r_name, tertile, period, count(*) AS cells, CAST(sum(c.orders) AS BIGINT) AS orders, round(sum(value), 2) AS value, round(avg(c.customers), 6) AS mean_customers FROM {cells_sql()} c JOIN nation ON n_name = unit JOIN region ON r_regionkey = n_regionkey JOIN (SELECT unit, tertile FROM {_TERTILE}) USING (unit) GROUP BY ALL")
def region_year_summary(spark, sf):
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    cross = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("unit"), "r_name")
    named = keys.join_checked(keys.join_checked(cells(spark, sf), cross, ["unit"], validate="m:1"), _tertiles(spark, sf).select("unit", "tertile"), ["unit"], validate="m:1", unique=("right",))
    return named.groupBy("r_name", "tertile", "period").agg(F.count(F.lit(1)).alias("cells"), F.sum("orders").alias("orders"), F.round(F.sum("value"), 2).alias("value"), F.round(F.avg("customers"), 6).alias("mean_customers"))


@query("crosstab_grid", "SELECT l_returnflag, l_linestatus, CAST(coalesce(records, 0) AS BIGINT) AS records FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(l_returnflag) CROSS JOIN (VALUES ('F'), ('O')) b(l_linestatus) LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS records FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linestatus)")
def crosstab_grid(spark, sf):
    return stats.crosstab(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["A", "N", "R", "X"], ["F", "O"])


_PROB_AGG = ", ".join(f"round(sum(p_{t}), 6) AS sum_p_{t}, round(avg(p_{t}), 6) AS avg_p_{t}, round(sum(p_{t} * valid_tool), 6) AS filtered_sum_p_{t}" for t in [*TOOLS, OTHER])
_PROB_COUNTS = ", ".join(f"sum({t}_label) AS {t}_count, count(*) FILTER (p_{t} >= 0.75) AS high_{t}_count" for t in TOOLS)
_PROB_COLS = [f"{k}{t}" for t in [*TOOLS, OTHER] for k in ("sum_p_", "avg_p_", "filtered_sum_p_")]
_PROB_INTS = ["records", "valid_count", "other_count", *(f"{k}{t}_count" for t in TOOLS for k in ("", "high_"))]
_PROB_SHARES = ", ".join(f"round(coalesce({k}sum_p_{t} / nullif({' + '.join(f'{k}sum_p_{u}' for u in TOOLS)}, 0), 0.0), 6) AS {k}{t}_share" for k in ("", "filtered_") for t in TOOLS)
_PROB_SQL = f"""(SELECT *, {_PROB_SHARES}, round(coalesce(valid_count / nullif(records, 0), 0.0), 6) AS valid_share FROM (
SELECT unit, period, orders, log_orders, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in _PROB_INTS)}, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in _PROB_COLS)}
FROM (SELECT unit, period, orders, log_orders FROM {cells_sql(SPARSE)}) LEFT JOIN (SELECT unit, period, count(*) AS records, sum(valid_tool) AS valid_count, sum(other_label) AS other_count, {_PROB_AGG}, {_PROB_COUNTS} FROM {SCORED_SQL} WHERE {SPARSE} GROUP BY ALL) USING (unit, period)))"""


def _prob_panel(spark, sf):
    frame = cells(spark, sf, unit_orders(spark, sf).where(SPARSE)).select("unit", "period", "orders", "log_orders")
    return panel.intensity(scored_orders(spark, sf).where(SPARSE), frame, ["unit", "period"], TOOLS, OTHER)


@query("prob_panel", f"SELECT * FROM {_PROB_SQL}")
def prob_panel(spark, sf):
    return _prob_panel(spark, sf)


@query("prob_summary", _describe_sql(SCORED_SQL, [f"p_{t}" for t in [*TOOLS, OTHER]]))
def prob_summary(spark, sf):
    return stats.describe(scored_orders(spark, sf), [f"p_{t}" for t in [*TOOLS, OTHER]])


@query("tool_share_by_year", "SELECT period, " + ", ".join(f"round(coalesce(sum(p_{t}) / nullif(sum(p_supply) + sum(p_demand) + sum(p_environment), 0), 0.0), 6) AS {t}_share" for t in TOOLS) + f" FROM {SCORED_SQL} GROUP BY period")
def tool_share_by_year(spark, sf):
    sums = scored_orders(spark, sf).groupBy("period").agg(*(F.sum(f"p_{t}").alias(t) for t in TOOLS))
    return panel.shares(sums, TOOLS).select("period", *(F.round(f"{t}_share", 6).alias(f"{t}_share") for t in TOOLS))


_SELECTED = [f"{t}_intensity" for t in TOOLS]
_SELECT_SQL = f"(SELECT unit, period, concat_ws('_', unit, period) AS panel_id, {', '.join(f'filtered_sum_p_{t} AS {t}_intensity' for t in TOOLS)}, round({' + '.join(f'filtered_sum_p_{t}' for t in TOOLS)}, 6) AS total_intensity, valid_share, records FROM {_PROB_SQL})"


def _selected(spark, sf):
    out = _prob_panel(spark, sf).withColumnsRenamed({f"filtered_sum_p_{t}": f"{t}_intensity" for t in TOOLS})
    total = F.round(F.col("supply_intensity") + F.col("demand_intensity") + F.col("environment_intensity"), 6)
    return out.withColumn("total_intensity", total).withColumn("panel_id", panel.panel_id("unit", "period")).select("unit", "period", "panel_id", *_SELECTED, "total_intensity", "valid_share", "records")


@query("variable_selection", f"SELECT * FROM {_SELECT_SQL}")
def variable_selection(spark, sf):
    return _selected(spark, sf)


_ZCOLS = [*_SELECTED, "total_intensity"]


@query("final_panel", f"SELECT t.*, n_nationkey AS unit_key, r_name, {', '.join(f'CASE WHEN s_{v} = 0 THEN 0.0 ELSE round(({v} - m_{v}) / nullif(s_{v}, 0), 6) END AS {v}_z' for v in _ZCOLS)} FROM {_SELECT_SQL} t JOIN nation ON n_name = unit JOIN region ON r_regionkey = n_regionkey, (SELECT {', '.join(f'avg({v}) AS m_{v}, stddev_pop({v}) AS s_{v}' for v in _ZCOLS)} FROM {_SELECT_SQL})")
def final_panel(spark, sf):
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    cross = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("unit"), F.col("n_nationkey").alias("unit_key"), "r_name")
    return panel.zscores(keys.join_checked(_selected(spark, sf), cross, ["unit"], validate="m:1"), _ZCOLS)


_GATES = f"""WITH c AS (SELECT * FROM {cells_sql()}), s AS (SELECT round(avg(other_label), 4) AS share, bool_and(p_supply BETWEEN 0 AND 1 AND p_demand BETWEEN 0 AND 1 AND p_environment BETWEEN 0 AND 1 AND p_other BETWEEN 0 AND 1) AS valid, count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderkey % 50 = 7) AS fallback FROM {SCORED_SQL}),
b AS (SELECT count(*) AS n, count(*) = count(DISTINCT unit) * count(DISTINCT period) AS ok FROM c), r AS (SELECT round(min(spearman), 3) AS least FROM (SELECT spearman FROM ({_pair_sql('orders', 'customers', _RANKED, 'spearman')}) UNION ALL SELECT spearman FROM ({_pair_sql('orders', 'value', _RANKED, 'spearman')})))
SELECT 'panel_balanced' AS "check", CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, 'cells=' || n AS evidence FROM b
UNION ALL SELECT 'probability_validity', CASE WHEN valid THEN 'pass' ELSE 'fail' END, 'in_range=' || CAST(valid AS VARCHAR) FROM s
UNION ALL SELECT 'fallback_audit', CASE WHEN fallback > 0 THEN 'pass' ELSE 'fail' END, 'fallback=' || fallback FROM s
UNION ALL SELECT 'other_share', CASE WHEN share <= 0.1 THEN 'pass' ELSE 'needs_review' END, 'share=' || printf('%.4f', share) FROM s
UNION ALL SELECT 'dictionary_alignment', CASE WHEN least >= 0.5 THEN 'pass' ELSE 'needs_review' END, 'least=' || printf('%.3f', least) FROM r"""


@query("readiness_gates", _GATES)
def readiness_gates(spark, sf):
    """Balance, probabilities in range, rows that fell back, the share of other, and agreement with counts; every value is computed."""
    panel_cells = cells(spark, sf)
    n = panel_cells.agg(F.count(F.lit(1)).alias("n"), quality.balanced(panel_cells, ["unit", "period"]).alias("b")).first()
    inside = F.lit(True)
    for t in [*TOOLS, OTHER]:
        inside = inside & F.col(f"p_{t}").between(0, 1)
    s = scored_orders(spark, sf).agg(F.round(F.avg("other_label"), 4).alias("share"), F.bool_and(inside).alias("valid"), count_if(F.expr("o_orderpriority = '5-LOW' and o_orderkey % 50 = 7")).alias("fallback")).first()
    pairs = stats.spearman(panel_cells, VARS, digits=9).where("left_variable = 'orders' and right_variable in ('customers', 'value')")
    least = pairs.agg(F.round(F.min("spearman"), 3)).first()[0]
    graded = lambda ok: "pass" if ok else "needs_review"
    return rules.gates(spark, [
        ("panel_balanced", n["b"], f"cells={n['n']}"), ("probability_validity", s["valid"], f"in_range={str(s['valid']).lower()}"), ("fallback_audit", s["fallback"] > 0, f"fallback={s['fallback']}"),
        ("other_share", graded(s["share"] <= 0.1), f"share={s['share']:.4f}"), ("dictionary_alignment", graded(least >= 0.5), f"least={least:.3f}"),
    ])


@query("panel_quality", f"""WITH t AS (SELECT * FROM {cells_sql(SPARSE)}) SELECT 'cells' AS metric, CAST(count(*) AS VARCHAR) AS value, 'rows of the panel' AS note FROM t UNION ALL SELECT 'balanced', CAST(count(*) = count(DISTINCT unit) * count(DISTINCT period) AS VARCHAR), 'every unit in every period' FROM t UNION ALL SELECT 'empty_cells', CAST(count(*) FILTER (orders = 0) AS VARCHAR), 'cells filled with zero' FROM t UNION ALL SELECT 'total', CAST(CAST(sum(orders) AS BIGINT) AS VARCHAR), '' FROM t""")
def panel_quality(spark, sf):
    sparse = cells(spark, sf, unit_orders(spark, sf).where(SPARSE))
    return quality.report(sparse, {"cells": (F.count(F.lit(1)), "rows of the panel"), "balanced": (quality.balanced(sparse, ["unit", "period"]), "every unit in every period"), "empty_cells": (count_if(F.col("orders") == 0), "cells filled with zero"), "total": (F.sum("orders"), "")})


@query("key_diff", f"SELECT n_name AS unit, CAST(y AS INTEGER) AS period, 'missing' AS difference FROM nation, range(1995, 2002) r(y) WHERE (n_name, y) NOT IN (SELECT (unit, period) FROM {ORDERS_SQL} WHERE {SPARSE}) UNION ALL SELECT DISTINCT unit, period, 'extra' FROM {ORDERS_SQL} WHERE {SPARSE} AND period NOT BETWEEN 1995 AND 2001")
def key_diff(spark, sf):
    frame = panel.skeleton(read_table(spark, sf, "nation").select(F.col("n_name").alias("unit")), YEARS, "period").withColumn("period", F.col("period").cast("int"))
    return keys.key_difference(frame, unit_orders(spark, sf).where(SPARSE), ["unit", "period"])


_LISTED = [("orders", "records"), ("orders", "valid_count"), ("log_orders", "sum_p_supply"), ("orders", "supply_count"), ("records", "filtered_sum_p_demand")]
_LISTED_COLS = sorted({c for p in _LISTED for c in p})
_LISTED_RANKS = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}" for v in _LISTED_COLS) + f" FROM {_PROB_SQL})"


@query("source_model_correlation", " UNION ALL ".join(f"SELECT p.left_variable, p.right_variable, pearson, spearman FROM ({_pair_sql(a, b, _PROB_SQL)}) p, ({_pair_sql(a, b, _LISTED_RANKS, 'spearman')}) s" for a, b in _LISTED))
def source_model_correlation(spark, sf):
    p = _prob_panel(spark, sf).select(*_LISTED_COLS)
    chosen = spark.createDataFrame(_LISTED, "left_variable string, right_variable string")
    pairs = stats.pearson(p, _LISTED_COLS, "matrix").join(F.broadcast(chosen), ["left_variable", "right_variable"])
    both = stats.spearman(p, _LISTED_COLS)
    turned = both.unionByName(both.select(F.col("right_variable").alias("left_variable"), F.col("left_variable").alias("right_variable"), "spearman"))
    return pairs.join(turned, ["left_variable", "right_variable"])


@query("panel_coverage", f"SELECT period, count(*) AS cells, count(*) FILTER (orders = 0) AS empty_cells, CAST(sum(orders) AS BIGINT) AS orders, round(avg(CASE WHEN orders > 0 THEN 1.0 ELSE 0.0 END), 6) AS filled_share FROM {cells_sql(SPARSE)} GROUP BY period")
def panel_coverage(spark, sf):
    sparse = cells(spark, sf, unit_orders(spark, sf).where(SPARSE))
    return sparse.groupBy("period").agg(F.count(F.lit(1)).alias("cells"), count_if(F.col("orders") == 0).alias("empty_cells"), F.sum("orders").alias("orders"), F.round(F.avg(F.when(F.col("orders") > 0, 1.0).otherwise(0.0)), 6).alias("filled_share"))
