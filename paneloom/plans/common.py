"""Frames and SQL fragments that several queries share: dictionary, unit-year cells, probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.operators.panel import hard_labels
from paneloom.session import read_table

# Short lists of words that occur in the test corpus, some nested, two that never occur.
CATEGORIES = {
    "supply": ["the", "there", "License", "license", "www"],
    "demand": ["and", "que", "les", "del"],
    "environment": ["der", "und", "to be", "copyright"],
}
TOOLS, OTHER = ["supply", "demand", "environment"], "other"
YEARS = list(range(1995, 2002))
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def hits_sql(terms: list[str], text: str = "coalesce(text, '')") -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}" for t in terms) + ")"


def terms_sql(terms: list[str], text: str = "coalesce(text, '')") -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN contains({text}, '{t}') THEN '{t}' END" for t in terms) + ")"


def features_sql(text: str = "coalesce(text, '')") -> str:
    """A query of doc_id, source, lang and all row features."""
    cols = ", ".join(f"CAST({hits_sql(t, text)} AS BIGINT) AS {c}_hits, {terms_sql(t, text)} AS {c}_terms" for c, t in CATEGORIES.items())
    total = " + ".join(f"{c}_hits" for c in CATEGORIES)
    flags = ", ".join(f"{c}_hits > 0 AS has_{c}" for c in CATEGORIES)
    return f"(SELECT *, {flags}, CAST({total} AS BIGINT) AS total_hits, {total} > 0 AS any_hit FROM (SELECT doc_id, source, lang, n_chars, {cols} FROM documents))"


def unit_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with unit (nation) and period (year). Nation is a table of fixed size."""
    orders, customer, nation = (read_table(spark, sf, t) for t in ("orders", "customer", "nation"))
    named = customer.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", "c_mktsegment", F.col("n_name").alias("unit"), "n_regionkey")
    return orders.join(named, orders["o_custkey"] == named["c_custkey"]).withColumn("period", F.year("o_orderdate"))


ORDERS_SQL = "(SELECT o.*, c.c_mktsegment, n.n_name AS unit, n.n_regionkey, CAST(year(o_orderdate) AS INTEGER) AS period FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey)"


def scored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with made-up probabilities p_* and the labels derived from them."""
    o = unit_orders(spark, sf)
    o = o.withColumns({"p_supply": (F.col("o_orderkey") % 101) / 100.0, "p_demand": (F.col("o_custkey") % 97) / 96.0, "p_environment": (F.col("o_orderkey") % 53) / 52.0, "p_other": ((F.col("o_orderkey") * 7) % 89) / 88.0})
    return hard_labels(o, TOOLS, OTHER)


SCORED_SQL = f"""(SELECT *, CASE WHEN other_label = 0 AND supply_label + demand_label + environment_label > 0 THEN 1 ELSE 0 END AS valid_tool FROM (
  SELECT *, CAST(p_supply >= 0.5 AS INTEGER) AS supply_label, CAST(p_demand >= 0.5 AS INTEGER) AS demand_label, CAST(p_environment >= 0.5 AS INTEGER) AS environment_label,
    greatest(p_supply, p_demand, p_environment) AS max_tool_prob, CAST(p_other >= 0.6 AND greatest(p_supply, p_demand, p_environment) < 0.4 AS INTEGER) AS other_label
  FROM (SELECT *, (o_orderkey % 101) / 100.0::DOUBLE AS p_supply, (o_custkey % 97) / 96.0::DOUBLE AS p_demand, (o_orderkey % 53) / 52.0::DOUBLE AS p_environment, ((o_orderkey * 7) % 89) / 88.0::DOUBLE AS p_other FROM {ORDERS_SQL})))"""


def cells(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The balanced unit-year panel of orders: count, value, mean value, customers, log."""
    from paneloom.operators.panel import balance, skeleton

    o = unit_orders(spark, sf)
    units = read_table(spark, sf, "nation").select(F.col("n_name").alias("unit"))
    facts = (rows if rows is not None else o).groupBy("unit", "period").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.round(F.avg("o_totalprice"), 6).alias("mean_value"), F.count_distinct("o_custkey").alias("customers"))
    return balance(skeleton(units, YEARS, "period").withColumn("period", F.col("period").cast("int")), facts, ["unit", "period"], ["orders", "value", "mean_value", "customers"], {"log_orders": "orders"})


def cells_sql(where: str = "true") -> str:
    return f"""(SELECT unit, period, CAST(coalesce(orders, 0) AS BIGINT) AS orders, coalesce(value, 0.0) AS value, coalesce(mean_value, 0.0) AS mean_value, CAST(coalesce(customers, 0) AS BIGINT) AS customers, round(ln(1 + coalesce(orders, 0)), 6) AS log_orders
FROM (SELECT n_name AS unit, CAST(y AS INTEGER) AS period FROM nation CROSS JOIN range(1995, 2002) r(y))
LEFT JOIN (SELECT unit, period, count(*) AS orders, round(sum(o_totalprice), 2) AS value, round(avg(o_totalprice), 6) AS mean_value, count(DISTINCT o_custkey) AS customers FROM {ORDERS_SQL} WHERE {where} GROUP BY ALL) USING (unit, period))"""
