"""Greedy spacing: an event counts if it lies at least ``gap`` days after the last one that counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spaced_days(days: Column, gap: int) -> Column:
    """Of a sorted array of dates, those that count."""
    return F.aggregate(days, F.slice(days, 1, 0), lambda kept, d: F.when((F.size(kept) == 0) | (F.datediff(d, F.element_at(kept, -1)) >= gap), F.concat(kept, F.array(d))).otherwise(kept))


def spaced(events: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, day) of the events that count. An entity's event days are bounded by its calendar, so each fits one row."""
    days = events.groupBy(*keys).agg(F.sort_array(F.collect_set("day")).alias("days"))
    return days.select(*keys, F.explode(F.when(F.size("days") > 0, spaced_days(F.col("days"), gap))).alias("day"))
