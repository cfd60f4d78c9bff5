"""Weighted placement on a tree of regions, racks and shards.

Each shard draws ``-ln(u) / weight`` from a hash of (doc_id, shard); a rack's draw is the least of its shards', a region's the
least of its racks'. Such minima are exponential in the summed weights, so every level is a weighted draw, and a document
descends region, rack, shard by the least draw. A subtree's draw changes only if a weight inside it does: a grown weight only
attracts documents into that shard, a shrunk one only releases its own.

Defined cases: null text has size 8 and the crc32 of no bytes; a null doc_id is hashed as a value of its own; equal rows share a
shard and take adjacent slots; very long texts are only measured; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import durable, ranked

Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> Tree:
    """Equal weights; a further shard only adds a leaf at the end."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // shards_per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def _draw(shard: int) -> Column:
    uniform = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(shard), F.lit("draw")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.ln(uniform)


def _least(draws: list[Column]) -> Column:
    return F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0]


def descend(tree: Tree) -> Column:
    """A document's (region, rack, shard): the least draw at each level; ties go to the first name."""

    def leaf(rack: dict[int, float]) -> Column:
        return _least([F.struct((F.col(f"draw{s}") / F.lit(float(rack[s]))).alias("draw"), F.lit(s).alias("shard")) for s in sorted(rack) if rack[s] > 0])

    def within(region: dict[str, dict[int, float]]) -> Column:
        return _least([F.struct(leaf(region[r])["draw"].alias("draw"), F.lit(r).alias("rack"), leaf(region[r])["shard"].alias("shard")) for r in sorted(region) if any(w > 0 for w in region[r].values())])

    live = {g: racks for g, racks in tree.items() if any(w > 0 for r in racks.values() for w in r.values())}
    levels = [within(live[g]) for g in sorted(live)]
    return _least([F.struct(x["draw"].alias("draw"), F.lit(g).alias("region"), x["rack"].alias("rack"), x["shard"].alias("shard")) for g, x in zip(sorted(live), levels, strict=True)])


def leaves(tree: Tree) -> set[int]:
    return {s for racks in tree.values() for rack in racks.values() for s in rack}


def place(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, grown_shard (where ``grown`` is given) and slot (rank within the shard)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    drawn = base.withColumns({f"draw{s}": _draw(s) for s in sorted(leaves(tree) | leaves(grown or {}))})
    at = drawn.withColumn("at", descend(tree))
    at = at.withColumn("grown_shard", (descend(grown)["shard"] if grown else F.lit(None)).cast("int"))
    table = durable(at.select("doc_id", "size", "text_crc32", F.col("at.region").alias("region"), F.col("at.rack").alias("rack"), F.col("at.shard").cast("int").alias("shard"), "grown_shard"), "shards")
    return ranked(table, ["shard"], ["doc_id", "text_crc32", "size"], "slot", table.count())
