"""Generic relational queries: joins, aggregates, windows, top-k and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.catalog.synthetic import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
    )


def market_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of every customer."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


def calm_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


def regional_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


QUERIES = {"pricing_summary": pricing_summary, "market_revenue": market_revenue, "top_orders": top_orders, "idle_customers": idle_customers, "calm_customers": calm_customers, "regional_supply": regional_supply}
ORACLES = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
      round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "market_revenue": """SELECT c_nationkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1""",
    "top_orders": """SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
      FROM orders QUALIFY rank <= 3""",
    "idle_customers": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "calm_customers": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "regional_supply": """SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
}
