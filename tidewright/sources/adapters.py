"""Time-series views of the star-schema tables.

Every view is long: one row per key and time.  Averages are sums of whole cents
over counts, so they don't depend on the order in which rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("long")


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``asset, date, value``: mean order price by priority and day; days may lack."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("date").alias("date")
    ).agg((F.sum(_cents("o_totalprice")) / (F.count("*") * 100.0)).alias("value"))


def daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, value``: one long series, the sum of order prices by day."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.sum(_cents("o_totalprice")) / 100.0).alias("value")
    )


def ticker_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, date, close, volume``: mean unit price and quantity by brand and ship day."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(
        (F.sum(_cents("l_extendedprice")) / (F.sum(F.col("l_quantity").cast("long")) * 100.0)).alias("close"),
        F.sum(F.col("l_quantity").cast("long")).alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``asset, hour, open, close``: first and last event value by type and hour."""
    events = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close")
    )


def weekly_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``report_date, usable_from, value``: weekly quantity, known six days after the week's start."""
    items = table(spark, sf_dir, "lineitem")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    weekly = items.groupBy(week.alias("report_date")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    return weekly.select("report_date", F.date_add("report_date", 6).alias("usable_from"), "value")


def large_order_days(spark: SparkSession, sf_dir: str, least: float = 400_000.0) -> DataFrame:
    """``date``: days with an order of at least ``least``; stands for an event calendar."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") >= least)
    return orders.select(F.col("o_orderdate").cast("date").alias("date")).distinct()


#: The same views for a SQL engine, as bodies of common table expressions.
SQL = {
    "p": """SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS value
      FROM orders GROUP BY 1, 2""",
    "t": """SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS value
      FROM orders GROUP BY 1""",
    "k": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (sum(CAST(l_quantity AS BIGINT)) * 100.0::DOUBLE) AS close,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "b": """SELECT event_type AS asset, date_trunc('hour', ts) AS hour,
      arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2""",
    "wr": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS report_date,
      CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS usable_from, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value
      FROM lineitem GROUP BY 1, 2""",
    "ev": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice >= 400000.0",
}


def with_views(names: str, body: str) -> str:
    """A SQL text with the named views (by their letters) in front of ``body``."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {views}{', ' + body[5:] if body.lstrip().startswith('WITH ') else ' ' + body}"
