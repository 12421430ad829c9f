"""Relational smoke queries over the star schema: scans with pushdown, joins, grouping, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pricing_summary(spark, sf):
    li = _read(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def segment_revenue(spark, sf):
    o, c, li = (_read(spark, sf, x) for x in ("orders", "customer", "lineitem"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy("c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def nation_customers(spark, sf):
    n, r, c = (_read(spark, sf, x) for x in ("nation", "region", "customer"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(c, c["c_nationkey"] == n["n_nationkey"], "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"))


def top_orders(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _read(spark, sf, "orders").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 2").select("o_custkey", "o_orderkey", "rank")


QUERIES = {f.__name__: f for f in (pricing_summary, segment_revenue, nation_customers, top_orders)}

ORACLE_SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "segment_revenue": "SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "nation_customers": "SELECT r_name, n_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
    "top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 2",
}
