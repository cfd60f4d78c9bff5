"""A gap-free calendar under daily facts, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day_span(*frames: DataFrame) -> DataFrame:
    """Every day from the first to the last of all frames (one row of bounds is exploded)."""
    bounds = [f.agg(F.min("day").alias("lo"), F.max("day").alias("hi")) for f in frames]
    both = bounds[0]
    for b in bounds[1:]:
        both = both.unionByName(b)
    both = both.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo IS NOT NULL")
    return both.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))


def on_spine(facts: DataFrame, days: DataFrame | None = None, zero: list[str] | None = None) -> DataFrame:
    """facts (day, entity, ...) on every day for every entity; the columns in ``zero`` are 0 on quiet days, others null.

    The calendar is a few thousand rows whatever the facts hold, so each entity gets it as one array, without a cross join of facts.
    """
    days = days if days is not None else day_span(facts)
    calendar = days.agg(F.sort_array(F.collect_list("day")).alias("days"))
    grid = facts.select("entity").distinct().join(F.broadcast(calendar)).select(F.explode("days").alias("day"), "entity")
    out = grid.join(facts, ["day", "entity"], "left")
    return out.fillna(0, subset=zero) if zero else out


def own_series(facts: DataFrame) -> DataFrame:
    """As on_spine, but each entity from its own first to its own last day."""
    grid = facts.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("entity", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return grid.join(facts, ["day", "entity"], "left")


def forward_fill(series: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("day").rowsBetween(-limit if limit is not None else Window.unboundedPreceding, 0)
    return series.withColumn(column, F.last(column, ignorenulls=True).over(w))


def clip(frame: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """Both ends inclusive; None is open."""
    if lo:
        frame = frame.where(F.col("day") >= F.to_date(F.lit(lo)))
    return frame.where(F.col("day") <= F.to_date(F.lit(hi))) if hi else frame


def week_end(day):
    """The Sunday that ends a day's week."""
    return F.next_day(F.date_sub(day, 1), "SUN")
