"""Structured Streaming folds: daily counts that late rows extend, and removal of rows already seen."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.graph import _dir


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder (a local one only where none is set, as in tests)."""
    _dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="tidewatch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def replay(spark: SparkSession, directory: str, pattern: str, files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    schema = spark.read.parquet(f"{directory}/{pattern}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(directory)


def drain(stream: DataFrame, each, mode: str, checkpoint: str) -> None:
    """Process what is there, then stop; a rerun on the same checkpoint goes on from where it ended."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_fold(posts: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """posts (day, entity): counts in update mode. A batch writes its changed rows under its own number, so a repeated batch overwrites itself; the newest number of a key wins."""
    counts = posts.groupBy("day", "entity").agg(F.count(F.lit(1)).alias("n"))
    drain(counts, lambda b, k: b.write.mode("overwrite").parquet(f"{sink}/batch={k}"), "update", checkpoint)
    spark = posts.sparkSession
    return spark.read.parquet(sink).groupBy("day", "entity").agg(F.max_by("n", "batch").alias("n"))


def first_sight(posts: DataFrame, key: list[str], time: str, late: str, sink: str, checkpoint: str) -> DataFrame:
    """Rows whose key was not seen within the watermark, across runs too."""
    once = posts.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    drain(once, lambda b, k: b.write.mode("overwrite").parquet(f"{sink}/batch={k}"), "append", checkpoint)
    return posts.sparkSession.read.parquet(sink).drop("batch")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """events (user, ts): sessions that end once nothing came for ``gap``; runs on a stream (with a watermark) as on a table."""
    return events.groupBy("user", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).select("user", F.col("s.start").alias("first"), "last", "n")
