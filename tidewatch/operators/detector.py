"""Crowd-level detector: components ranked against their own past, gates, alerts. It sees counts and scores only, never prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import windows as W
from tidewatch.operators.spacing import spaced

PARTS = ("e1", "e2", "e3", "e5")
ONSET = ("o1", "o2", "o3", "o4", "e5")


@dataclass(frozen=True)
class Rules:
    """Gates of an alert; the defaults are meant for dense series."""

    coverage: int = 100
    hype: float = 2.0
    attention: float = 0.9
    persistence: float = 0.75
    level: float = 70.0
    relief: float = 10.0
    cooldown: int = 21


def features(daily: DataFrame) -> DataFrame:
    """daily (day, entity, n, nb) on a calendar: n posts, nb bullish less bearish. Raw, unranked series, all trailing."""
    n, nb = F.col("n"), F.col("nb")
    total = F.sum("n").over(Window.partitionBy("day"))
    ratio = lambda w: W.at_least(F.try_divide(F.sum("nb").over(w), F.sum("n").over(w)), n, w, 7)
    month, fortnight = W.trailing(28), W.trailing(14)
    share = F.col("share")
    # little data but much work a row: a fixed number of partitions, which adaptive execution does not merge into one
    parts = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        daily.withColumn("raw", F.try_divide(100.0 * n, total)).repartition(parts, "entity")
        .withColumns({
            "share": W.roll_mean(F.col("raw"), 7), "m7": W.roll_mean(n, 7), "bull28": ratio(month), "share14": ratio(fortnight), "posts28": W.roll_sum(n, 28, 7),
            "persist": F.try_divide(F.sum((nb > 0).cast("long")).over(month), F.sum((n > 0).cast("long")).over(month)),
        })
        .withColumns({"mid": W.roll_median(share, 120, 60), "convex": W.log_convexity(F.col("m7")), "rise28": W.delta(share, 28), "rise14": W.delta(share, 14), "above": share - W.roll_mean(share, 28, 7), "turn14": W.delta(F.col("share14"), 14)})
        .withColumns({"convex": F.when(F.col("convex").isNotNull(), F.greatest("convex", F.lit(0.0))), "hype_raw": F.when(F.col("mid") > 0, share / F.col("mid"))})
    )


def ranked(frame: DataFrame, rules: Rules = Rules(), window: int = 365, least: int = 180) -> DataFrame:
    """Components e1, e2, e3, e5, the fading flag, the onset bank o1 to o4, the level and the gates of each day.

    Values are rounded before they are ranked, so that equal shares stay equal whatever order they were added in.
    """
    names = {"e1": "share", "e2": "bull28", "e3": "rise28", "e5": "convex", "o1": "above", "o2": "hype_raw", "o3": "turn14", "o4": "rise14"}
    frame = frame.withColumns({f"r_{k}": F.round(v, 6) for k, v in names.items()})
    frame = W.pct_ranks(frame, {k: f"r_{k}" for k in names}, window, least)
    frame = frame.withColumn("e2", F.col("e2") * F.coalesce(F.col("persist") >= rules.persistence, F.lit(False)).cast("double"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return frame.withColumns({
        "fade": yes((F.col("e1") >= rules.attention) & (F.col("turn14") < -1e-9)), "hype": yes(F.col("hype_raw") >= rules.hype - 1e-9), "covered": yes(F.col("posts28") >= rules.coverage),
        "level": F.round(100 * mean_of(*PARTS), 6), "onset": F.round(mean_of(*ONSET), 6),
    })


def mean_of(*names: str):
    """Mean of the values that are there; null if none is."""
    there = F.array_compact(F.array(*map(F.col, names)))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, v: s + v) / F.size(there))


def triggers(rules: Rules, level: str = "level", without: str = ""):
    """Whether a day alerts, before spacing; ``without`` names a gate to leave out (hype, attention, persistence or fade)."""
    ok = F.col("covered")
    for gate, test in (("hype", F.col("hype")), ("attention", F.col("e1") >= rules.attention), ("persistence", F.col("e2") > 0)):
        if gate != without:
            ok = ok & test
    high = F.col(level) >= rules.level
    if without != "fade":
        high = high | ((F.col(level) >= rules.level - rules.relief) & F.col("fade"))
    return F.coalesce(ok & high, F.lit(False))


def alerts(frame: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return spaced(frame.where(triggers(rules)).select("entity", "day"), ["entity"], rules.cooldown)


def runs(days: DataFrame, gap: int = 2, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Islands of days (keys, day) that lie at most ``gap`` days apart: first, last, number of days."""
    w = W.by_entity(*keys)
    start = F.coalesce(F.datediff("day", F.lag("day").over(w)) > gap, F.lit(True)).cast("int")
    numbered = days.withColumn("start", start).withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("days")).drop("run")
