"""Queries that run as streams over the events table, drained, and as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.sources.tables import read
from tidewatch.streaming import folds as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT ts::DATE AS day, event_type AS entity, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_fold(spark, d):
    posts = S.replay(spark, d, "events.parquet").select(F.to_date("ts").alias("day"), F.col("event_type").alias("entity"))
    return S.daily_fold(posts, S.folder(spark, "fold"), S.folder(spark, "fold-at"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Every event is sent twice; the second is dropped."""
    e = S.replay(spark, d, "events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return S.first_sight(e, ["event_id"], "ts", "2 days", S.folder(spark, "seen"), S.folder(spark, "seen-at")).select("event_id", "user_id", "event_type")


@query("WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS \"user\", strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM r GROUP BY user_id, k")
def session_runs(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"))
    return S.sessions(e).select("user", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("first", "last")), "n")
