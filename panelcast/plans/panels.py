"""Panels over the provided tables.

Panel A maps the order tables onto the raw measurement schema: a site is a
nation name, a node is a market segment, the date is the order date and the
load is the order total. Panel B keys the event stream by user and event
type. Both are summed per (code, date) and rounded to cents, which makes the
sums exact and independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.panel import build_panel
from panelcast.plans.joins import dimension_left_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x nation -> (c_custkey, sites, node_desc)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    dim = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
           .select("c_custkey", F.col("n_name").alias("sites"),
                   F.col("c_mktsegment").alias("node_desc")))
    return dim


def order_measurements(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw measurement table ``(time_key, sites, node_desc, ds_load)`` from orders.

    ``orders`` is the large side: only three of its columns (and those in
    ``keep``) are read. Spark broadcasts the customer dimension if its files are
    small, else both sides shuffle on the customer key and AQE splits a skewed one.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", *keep)
    cust = customer_dim(spark, sf_dir)
    return (orders.join(cust, orders.o_custkey == cust.c_custkey)
            .select(F.col("o_orderdate").alias("time_key"), "sites", "node_desc",
                    F.col("o_totalprice").alias("ds_load"), *keep))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Un-aggregated ``(code, dt, Y, ok)``; the order key breaks ties on a date."""
    raw = order_measurements(spark, sf_dir, keep=("o_orderkey",))
    return raw.select(F.concat("sites", "node_desc").alias("code"), F.col("time_key").cast("date").alias("dt"),
                      F.col("ds_load").alias("Y"), F.col("o_orderkey").alias("ok"))


def customer_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its orders, kept when it has none (load and date null)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    cust = customer_dim(spark, sf_dir)
    return (dimension_left_join(cust, orders, "c_custkey", "o_custkey")
            .select(F.col("o_orderdate").alias("time_key"), "sites", "node_desc",
                    F.col("o_totalprice").alias("ds_load")))


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(code, dt, Y)``: order totals per (nation||segment, order date)."""
    return build_panel(order_measurements(spark, sf_dir), aggregate=True, decimals=2)


def event_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    return ev.select(F.col("ts").alias("time_key"), F.col("user_id").alias("sites"),
                     F.col("event_type").alias("node_desc"), F.col("value").alias("ds_load"))


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(code, dt, Y)``: event values per (user||event type, day); many short series."""
    return build_panel(event_measurements(spark, sf_dir), aggregate=True, decimals=2)


# Oracle-side SQL for the same panels (DuckDB, tables pre-registered as views).
PANEL_A_SQL = """
SELECT n_name || c_mktsegment AS code, CAST(o_orderdate AS DATE) AS dt,
       ROUND(SUM(o_totalprice), 2) AS Y
FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2
"""

PANEL_B_SQL = """
SELECT CAST(user_id AS VARCHAR) || event_type AS code, CAST(ts AS DATE) AS dt,
       ROUND(SUM(value), 2) AS Y
FROM events
GROUP BY 1, 2
"""
