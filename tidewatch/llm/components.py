"""Connected components by alternating large and small stars, each step a durable table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), both directions for large, u > v for small. Minima are pre-aggregated; the join back is split by AQE where a node is hot."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = edges.join(least, "u")
    if large:
        return joined.where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component) for each linked node; the component is its least node. A durable table."""
    with Scratch(links.sparkSession):
        edges = durable(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            edges = durable(_star(_star(both, True), False).distinct(), "edges")
            # the same edges twice: every node hangs on its least one
            now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 32)))).first()
            if now == before:
                break
            before = now
        top = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return durable(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top), "components", outer=True)
