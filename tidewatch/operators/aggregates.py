"""Daily aggregates as mergeable state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.tables import BEARISH, BULLISH


def daily_counts(posts: DataFrame, *keys: str) -> DataFrame:
    return posts.groupBy("day", *(keys or ("entity",))).agg(F.count(F.lit(1)).alias("n"))


def daily_sentiment(posts: DataFrame, *keys: str) -> DataFrame:
    """Number of posts, mean score, and (bullish - bearish) / posts."""
    net = F.count_if(F.col("score") > BULLISH) - F.count_if(F.col("score") < BEARISH)
    return posts.groupBy("day", *(keys or ("entity",))).agg(F.count(F.lit(1)).alias("n_posts"), F.avg("score").alias("avg_sentiment"), (net / F.count(F.lit(1))).alias("net_bullish"))


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))


def merge_sentiment(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Means recombined by their numbers of posts."""
    both, n = old.unionByName(new), F.sum("n_posts")
    weighted = [(F.sum(F.col(c) * F.col("n_posts")) / F.nullif(n, F.lit(0))).alias(c) for c in ("avg_sentiment", "net_bullish")]
    return both.groupBy(*keys).agg(n.alias("n_posts"), *weighted)


def splice(old: DataFrame, new: DataFrame, cutoff: str) -> DataFrame:
    """Old rows before the cutoff, new rows from it on."""
    at = F.to_date(F.lit(cutoff))
    return old.where(F.col("day") < at).unionByName(new.where(F.col("day") >= at))


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (map-side combined, no window over a hot key)."""
    rest = [c for c in rows.columns if c not in key]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(pick.alias("r")).select(*key, "r.*")


def last_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
