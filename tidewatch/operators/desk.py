"""What the desk's tables are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import calendar as C
from tidewatch.operators import windows as W

MIN_DAY_TOTAL, ATTENTION, MOOD, HORIZON = 10, 1.0, 0.10, 5


def conviction(daily: DataFrame, normalise: bool = False, baseline: str = "ewm", half_life: float = W.HALF_LIFE) -> DataFrame:
    """daily (day, entity, n, bp: posts times net mood), gap-free -> n_posts, bull_pressure, conviction_z, attention_z, share, sent_change,
    crowded_top, swarm. ``normalise`` puts pressure and posts in per cent of the day's posts (days of under ten count as silent); the
    baseline is exponentially weighted ("ewm") or the last 84 days ("rolling")."""
    if baseline not in ("ewm", "rolling"):
        raise ValueError(f"no baseline {baseline}")
    # pressure is a count of posts: rounded, so that its sums are exact in any order
    f = daily.select("day", "entity", "n", F.round("bp", 9).alias("bp"))
    if normalise:
        total = f.groupBy("day").agg(F.sum("n").alias("total"))  # one row a day
        f = f.join(total, "day").withColumn("total", F.when(F.col("total") >= MIN_DAY_TOTAL, F.col("total")))
        f = f.withColumns({"x": F.coalesce(100 * F.col("bp") / F.col("total"), F.lit(0.0)), "y": F.coalesce(100.0 * F.col("n") / F.col("total"), F.lit(0.0))})
    else:
        f = f.withColumns({"x": F.col("bp"), "y": F.col("n").cast("double")})
    week = W.trailing(7)
    f = f.withColumns({"x": F.sum("x").over(week), "y": F.sum("y").over(week), "share": F.try_divide(F.sum("bp").over(week), F.sum("n").over(week))})
    if baseline == "ewm":
        f = f.withColumn("i", F.datediff("day", F.min("day").over(Window.partitionBy("entity"))))
        z = lambda c: W.ewm_z(F.col(c), F.col("i"), half_life)
    else:
        z = lambda c: W.trailing_z(F.col(c))
    f = f.withColumns({"conviction_z": z("x"), "attention_z": z("y"), "sent_change": W.delta(F.col("share"), HORIZON)})
    crowd, change = F.col("attention_z") > ATTENTION, F.col("sent_change")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return f.select("day", "entity", F.col("n").alias("n_posts"), F.col("bp").alias("bull_pressure"), "conviction_z", "attention_z", "share", "sent_change", flag(crowd & (change < -MOOD)).alias("crowded_top"), flag(crowd & (change > MOOD)).alias("swarm"))


def rank_by_ewm(z: DataFrame, half_life: float, least: int = 5) -> DataFrame:
    """z (entity, day, z) -> entity, z (exponentially weighted mean up to the newest day), latest, flat_30, rank by the size of z."""
    top = z.agg(F.max("day").alias("top"))  # one row
    f = z.where("z IS NOT NULL").join(F.broadcast(top)).withColumn("age", F.datediff("top", "day"))
    w = F.pow(F.lit(0.5), F.col("age") / half_life)
    e = f.groupBy("entity").agg((F.sum(F.col("z") * w) / F.sum(w)).alias("zz"), F.max_by("z", "day").alias("latest"), F.avg(F.when(F.col("age") < 30, F.col("z"))).alias("flat_30"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("zz"), 6)), "entity"))  # one row a name
    return e.where(F.col("n") >= least).select("entity", F.col("zz").alias("z"), "latest", "flat_30", rank.alias("rank"))


def states(alerts: DataFrame, days: int = 21) -> DataFrame:
    """alerts (entity, day, kind: start or end) of the last days -> the latest of either kind and the state; on a tie the start wins."""
    recent = alerts.join(F.broadcast(alerts.agg(F.max("day").alias("_top")))).where(F.col("day") > F.date_sub("_top", days))
    s = recent.groupBy("entity").agg(*(F.max(F.when(F.col("kind") == k, F.col("day"))).alias(c) for k, c in (("start", "starting"), ("end", "ending"))))
    started = F.col("starting").isNotNull() & (F.col("ending").isNull() | (F.col("starting") >= F.col("ending")))
    return s.withColumn("state", F.when(started, "STARTING").when(F.col("ending").isNotNull(), "ENDING"))


def resolve_anchors(chain: DataFrame, priced: DataFrame) -> DataFrame:
    """chain (theme, pos, symbol), priced (symbol) -> theme, anchor: the first symbol of the chain that has a price; ties by name."""
    return chain.join(priced, "symbol", "left_semi").groupBy("theme").agg(F.min(F.struct("pos", "symbol"))["symbol"].alias("anchor"))


def symbols_to_price(counts: DataFrame, more: list[DataFrame], most: int, days: int = 60, excluded: DataFrame | None = None) -> DataFrame:
    """counts (entity, day, n): the ``most`` named over all days and over the last ones, and the symbols of further frames; blanks, the
    placeholder "?" and excluded symbols (symbol) go."""
    top = counts.agg(F.date_sub(F.max("day"), days).alias("_from"))
    loud = lambda c: c.groupBy("entity").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "entity").limit(most).select(F.col("entity").alias("symbol"))
    out = loud(counts).unionByName(loud(counts.join(F.broadcast(top)).where("day >= _from")))
    for frame in more:
        out = out.unionByName(frame.select("symbol"))
    out = out.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol NOT IN ('', '?')").distinct()
    return out.join(excluded, "symbol", "left_anti") if excluded is not None else out


def robustness(returns: DataFrame, least: int) -> DataFrame:
    """returns (entity, era, pnl) -> eras with enough rows, the worst and the mean era, and the rank by these."""
    e = returns.groupBy("entity", "era").agg(F.avg("pnl").alias("mean"), F.count("pnl").alias("n")).where(F.col("n") >= least)
    s = e.groupBy("entity").agg(F.count(F.lit(1)).cast("int").alias("eras"), F.round(F.min("mean"), 6).alias("worst"), F.round(F.avg("mean"), 6).alias("average"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("worst"), F.desc("average"), "entity")))  # one row a name


def source_breadth(posts: DataFrame) -> DataFrame:
    """posts (day, entity, source): by day and name the sources with posts within seven days, those active within thirty, those that rise."""
    counts = posts.groupBy("day", "entity", "source").agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.select("day", F.struct("entity", "source").alias("entity"), "n")
    f = C.on_spine(keyed, C.day_span(posts), zero=["n"]).withColumn("n7", F.sum("n").over(W.trailing(7)))
    f = f.withColumns({"up": W.delta(F.col("n7"), HORIZON) > 0, "live": F.max("n7").over(W.trailing(30)) > 0})
    active, rising = F.count_if("live"), F.count_if(F.col("live") & F.col("up"))
    return f.groupBy("day", F.col("entity.entity").alias("entity")).agg(F.count_if(F.col("n7") > 0).alias("breadth"), active.alias("active"), rising.alias("rising"), ((active >= 2) & (rising == active)).alias("all_rising"))


def between(rows: DataFrame, start: str | None, end: str | None, groups: list[str] | None = None, column: str = "source") -> DataFrame:
    """Rows from a day on and before another one, of some communities if any are named."""
    if start:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.where(F.col("day") < F.to_date(F.lit(end)))
    return rows.where(F.col(column).isin(groups)) if groups else rows


def compact(x: Column) -> Column:
    return F.when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.1fk", x / 1e3)).otherwise(F.format_string("%.0f", x))


def lookback(days: Column) -> Column:
    return F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 31, "month").otherwise("year")


def short_label(text: Column, most: int = 70) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, most)


def epoch_day(when: Column) -> Column:
    from tidewatch.sources.readers import epoch_of

    return epoch_of(when)
