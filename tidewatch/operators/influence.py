"""Judging of authors' calls against later moves, author scores, and labels spread over a reply graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import windows as W
from tidewatch.operators.graph import _dir

PRIORS = {"s_conf": 10, "s_z": 5, "s_enh": 10}


def moves(prices: DataFrame, ahead: int = 20, past: int = 90, least: int = 30) -> DataFrame:
    """(entity, day, fwd, tau, z): the move to come against the completed moves of the last days; tau is null until there are enough."""
    fwd = F.lead("px", ahead).over(W.by_entity()) / F.col("px") - 1
    p = prices.select("entity", "day", fwd.alias("fwd")).withColumn("done", F.lag("fwd", ahead).over(W.by_entity()))
    w, done = W.trailing(past), F.col("done")
    p = p.withColumns({"mu": W.at_least(F.avg(done).over(w), done, w, least), "sd": W.at_least(F.stddev_samp(done).over(w), done, w, least)})
    # greatest skips nulls, so a missing deviation is asked for first
    tau = F.when(F.col("sd").isNotNull(), F.greatest(F.lit(0.03), F.col("sd") / 2))
    z = F.coalesce(F.when(F.col("sd") > 0, (F.col("fwd") - F.col("mu")) / F.col("sd")), F.lit(0.0))
    return p.select("entity", "day", "fwd", tau.alias("tau"), z.alias("z"))


def judge(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (entity, day, direction, ...) with outcome correct, wrong, flat or unscored, and whether a correct one beat its own volatility."""
    j = calls.join(moves(prices), ["entity", "day"], "left")
    signed = F.col("fwd") * F.col("direction")
    outcome = F.when(F.col("fwd").isNull(), "unscored").when(signed >= F.col("tau"), "correct").when(signed <= -F.col("tau"), "wrong").otherwise("flat")
    j = j.withColumns({"outcome": outcome, "z": F.coalesce("z", F.lit(0.0))})
    return j.withColumn("enhanced", (F.col("outcome") == "correct") & (F.col("z") * F.col("direction") >= 1))


def shrink(mean, n, prior: int, base):
    return (n * mean + prior * base) / (n + prior)


def board(judged: DataFrame, high: float = 0.66) -> DataFrame:
    """Per author: counts, three shrunk scores scaled to 0..1, their weighted sum, tier, shrunk hit rate. Without a judged call the scores are null."""
    ok = F.col("outcome").isin("correct", "wrong")
    y, conf = F.when(ok, (F.col("outcome") == "correct").cast("double")), F.abs("stance")
    weight = F.least(F.greatest(1 + F.abs("z"), F.lit(0.1)), F.lit(2.0))
    j = judged.withColumns({"y": y, "s_conf": conf * y, "s_z": conf * y * weight, "s_enh": F.when(ok, conf * F.col("enhanced").cast("double"))})
    sums = [F.sum(c).alias(c) for c in PRIORS]
    a = j.groupBy("author").agg(F.count(F.lit(1)).alias("n_calls"), F.count("y").alias("n_judged"), F.coalesce(F.sum("y"), F.lit(0.0)).cast("long").alias("hits"), *sums)
    # one row of totals over the authors' sums
    g = a.agg(F.sum("n_judged").alias("n"), F.sum("hits").alias("h"), *(F.sum(c).alias(f"g_{c}") for c in PRIORS))
    a = a.join(F.broadcast(g))
    n = F.col("n_judged")
    a = a.withColumns({c: F.when(n > 0, shrink(F.col(c) / n, n, k, F.col(f"g_{c}") / F.col("n"))) for c, k in PRIORS.items()})
    a = a.withColumn("score", shrink(F.coalesce(F.try_divide("hits", "n_judged"), F.try_divide("h", "n")), n, 10, F.try_divide("h", "n")))
    lim = a.agg(*(f(c).alias(f"{t}_{c}") for c in PRIORS for t, f in (("lo", F.min), ("hi", F.max))))
    a = a.join(F.broadcast(lim))
    a = a.withColumns({c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))) for c in PRIORS})
    a = a.withColumn("composite", 0.4 * F.col("s_conf") + 0.4 * F.col("s_z") + 0.2 * F.col("s_enh"))
    return a.select("author", "n_calls", "n_judged", "hits", *PRIORS, "composite", F.when(F.col("composite") >= high, "HIGH").otherwise("low").alias("tier"), "score")


def split(rows: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """train, val or test (60/20/20) within each label, in the order of a seeded hash."""
    # ranked by buckets of the hash's leading digits: no task holds a label whole
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label)  # over at most 4096 rows a label
    before = F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(label).alias("_label"), F.col("_b").alias("_c"), before.alias("_start"), F.sum("_n").over(w).alias("_all"))
    k = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    at = (F.col("_start") + F.col("_k") - 1) / F.col("_all")
    ranked = rows.withColumn("_k", k).join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_c")))
    part = F.when(at < 0.6, "train").when(at < 0.8, "val").otherwise("test")
    return ranked.withColumn("part", part).drop("_h", "_b", "_k", "_label", "_c", "_start", "_all")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def neighbour_mean(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """nodes (node, columns) with the weighted mean of their neighbours' columns; zero where there is none."""
    ends = both_ways(edges).select(F.col("u").alias("_u"), F.col("v").alias("node"), F.col("w").alias("_w"))
    near = ends.join(nodes, "node").drop("node")
    means = near.groupBy(F.col("_u").alias("node")).agg(*((F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(f"nb_{c}") for c in columns))
    return nodes.join(means, "node", "left").fillna(0.0, subset=[f"nb_{c}" for c in columns])


def propagate(nodes: DataFrame, edges: DataFrame, steps: int = 30, alpha: float = 0.85, every: int = 5) -> DataFrame:
    """nodes (node, y or null): belief spread along edges; known labels are set anew each round; cut every few rounds."""
    spark = nodes.sparkSession
    _dir(spark)
    out = both_ways(edges).checkpoint()
    base = nodes.agg(F.coalesce(F.avg("y"), F.lit(0.5)).alias("base"))
    state = nodes.join(F.broadcast(base)).select("node", "y", F.coalesce("y", "base").alias("b"))
    for k in range(1, steps + 1):
        near = out.join(state.select(F.col("node").alias("v"), "b"), "v").groupBy(F.col("u").alias("node")).agg((F.sum(F.col("b") * F.col("w")) / F.sum("w")).alias("m"))
        state = state.join(near, "node", "left").select("node", "y", F.coalesce("y", alpha * F.coalesce("m", "b") + (1 - alpha) * F.col("b")).alias("b"))
        if k % every == 0:
            state = state.checkpoint()
    return state.select("node", F.col("b").alias("belief"))
