"""The input tables as daily facts: counts, scores and prices by day and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BULLISH, BEARISH = 0.02, -0.02


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, day, entity, source, value): an order is a post about its customer's segment."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("c_mktsegment").alias("entity"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("value"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, entity, kind, score): a line is a post about its part's brand; its discount is the score."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.to_date("l_shipdate").alias("day"), F.col("p_brand").alias("entity"), F.col("p_type").alias("kind"), F.col("l_returnflag").alias("source"), (F.col("l_discount") - 0.05).alias("score"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, entity, px): a brand's highest unit price on the days it trades (a maximum is the same in any order of rows)."""
    return scored(spark, sf_dir).groupBy("day", "entity").agg(F.max("px").alias("px"))


# The same facts for the SQL side.
EV = "ev AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, c_mktsegment AS entity, o_orderpriority AS source, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"
CNT = "cnt AS (SELECT day, entity, count(*) AS n FROM ev GROUP BY ALL)"
SPINE = "spine AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM ev)"
WIDE = "wide AS (SELECT s.day, e.entity, coalesce(n, 0) AS n FROM spine s CROSS JOIN (SELECT DISTINCT entity FROM cnt) e LEFT JOIN cnt USING (day, entity))"
BASE = f"WITH RECURSIVE {EV}, {CNT}, {SPINE}, {WIDE}"
SC = "sc AS (SELECT l_shipdate::DATE AS day, p_brand AS entity, p_type AS kind, l_returnflag AS source, l_discount - 0.05 AS score, l_extendedprice / l_quantity AS px FROM lineitem JOIN part ON l_partkey = p_partkey)"
SENT = "sent AS (SELECT day, entity, count(*) AS n_posts, avg(score) AS avg_sentiment, (count(*) FILTER (score > 0.02) - count(*) FILTER (score < -0.02))::DOUBLE / count(*) AS net_bullish FROM sc GROUP BY ALL)"
SSPINE = "sspine AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM sc)"
SWIDE = "swide AS (SELECT s.day, e.entity, coalesce(n_posts, 0) AS n, coalesce(n_posts * net_bullish, 0) AS bp FROM sspine s CROSS JOIN (SELECT DISTINCT entity FROM sent) e LEFT JOIN sent USING (day, entity))"
PX = "px0 AS (SELECT day, entity, max(px) AS px FROM sc GROUP BY ALL), px AS (SELECT s.day, e.entity, last_value(px IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY s.day) AS px FROM sspine s CROSS JOIN (SELECT DISTINCT entity FROM px0) e LEFT JOIN px0 USING (day, entity))"
SBASE = f"WITH RECURSIVE {SC}, {SENT}, {SSPINE}, {SWIDE}, {PX}"
