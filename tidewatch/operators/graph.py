"""Iterations over edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dir(spark) -> None:
    """Checkpoints go to the session's shared folder; a single machine without one gets a temporary folder, a cluster an error."""
    import tempfile

    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))


def resolve_replies(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """comments (id, author, parent_id, link_id), posts (id, author) -> (id, replier, author): whom a comment answers. The parent comment's
    author counts before the parent post's, and that before the linked post's; a reply to oneself or to nobody known is none."""
    known = lambda rows, key, name: rows.select(F.col("id").alias(key), F.col("author").alias(name))
    r = comments.select("id", F.col("author").alias("replier"), "parent_id", "link_id")
    r = r.join(known(comments, "parent_id", "a"), "parent_id", "left").join(known(posts, "parent_id", "b"), "parent_id", "left")
    r = r.join(known(posts, "link_id", "c"), "link_id", "left")
    return r.select("id", "replier", F.coalesce("a", "b", "c").alias("author")).where("author != replier")


def pagerank(edges: DataFrame, steps: int = 50, damping: float = 0.85, every: int = 5) -> DataFrame:
    """edges (u, v, w), undirected; exactly ``steps`` rounds; ranks are checkpointed every few rounds."""
    spark = edges.sparkSession
    _dir(spark)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    degree = both.groupBy("u").agg(F.sum("w").alias("d"))
    out = both.join(degree, "u").select("u", "v", (F.col("w") / F.col("d")).alias("p")).checkpoint()
    n = degree.count()
    rank = degree.select(F.col("u").alias("node"), F.lit(1.0 / n).alias("rank"))
    for k in range(1, steps + 1):
        rank = out.join(rank, out["u"] == rank["node"]).groupBy(F.col("v").alias("node")).agg(((1 - damping) / n + damping * F.sum(F.col("rank") * F.col("p"))).alias("rank"))
        if k % every == 0:
            rank = rank.checkpoint()
    return rank


def without_bots(edges: DataFrame, activity: DataFrame, comments: int = 1000, posts: int = 100, share: float = 0.5, least: int = 50) -> DataFrame:
    """edges (u, v, w) without accounts over a limit of activity (node, n_comments, n_posts), then without those linked to more than a
    share of all others, where the graph has so many nodes."""

    def drop(e: DataFrame, gone: DataFrame) -> DataFrame:
        for end in ("u", "v"):
            e = e.join(gone.select(F.col("node").alias(end)), end, "left_anti")
        return e.select("u", "v", "w")

    kept = drop(edges, activity.where((F.col("n_comments") > comments) | (F.col("n_posts") > posts)).select("node"))
    degree = kept.select("u").unionAll(kept.select("v")).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    n = degree.agg(F.count(F.lit(1)).alias("n"))
    return drop(kept, degree.join(F.broadcast(n)).where((F.col("n") >= least) & (F.col("degree") > share * (F.col("n") - 1))).select("node"))
