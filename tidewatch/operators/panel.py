"""A panel of communities: who qualifies to join it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def screen(candidates: DataFrame, rates: DataFrame, panel: list[str], referrers: int = 100, share: float = 0.5, most: int = 1) -> DataFrame:
    """candidates (candidate, referrers), rates (community, rate) -> those outside the panel with enough referrers and a rate of at least a share
    of the panel's average, most referrers first. A community without a rate, or a panel without one, never passes."""
    floor = rates.where(F.col("community").isin(panel)).agg(F.avg("rate").alias("_panel"))
    some = candidates.where((F.col("referrers") >= referrers) & ~F.col("candidate").isin(panel))
    some = some.join(rates.withColumnRenamed("community", "candidate"), "candidate").join(F.broadcast(floor))
    return some.where(F.col("rate") >= share * F.col("_panel")).drop("_panel").orderBy(F.desc("referrers"), "candidate").limit(most)
