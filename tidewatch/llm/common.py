"""Helpers shared by the text operators: durable tables, exact distributed ranks, text access."""

from __future__ import annotations

import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent, a single machine (tests) gets a temporary folder; a cluster gets an error, as its executors do not
    see each other's local folders.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Durable tables written inside ``with Scratch(spark):`` are deleted at its end, but for those written with ``outer=True``, which
    belong to the enclosing block, if any. Whatever leaves the block must not read a deleted table lazily."""

    _threads = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    @classmethod
    def open(cls) -> list[Scratch]:
        """The blocks this thread is in, outermost first."""
        if not hasattr(cls._threads, "open"):
            cls._threads.open = []
        return cls._threads.open

    def __enter__(self) -> Scratch:
        Scratch.open().append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.open().remove(self)
        remove(self.spark, self.paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what was computed survives the loss of any executor and is not computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch-{name}-{uuid.uuid4().hex}"
    if int(spark.conf.get(BATCH)) > 2000:  # whole texts: smaller batches hold less memory on either side; set once for the session
        spark.conf.set(BATCH, "2000")
    blocks = Scratch.open()[: -1 if outer else None]
    if blocks:
        blocks[-1].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Exact 0-based rank of each row within ``keys``, also where one key holds most rows.

    Rows are dealt into hash buckets of ``order``; a key's rows are numbered bucket by bucket, each bucket starting where the
    ones before it end. No task sees more than one bucket of one key, whatever the key's share. ``df`` must be deterministic
    (a durable table), as it is read twice. Rows equal in ``order`` get adjacent ranks in the same bucket.
    """
    buckets = max(256, 4 * shuffle_width(df.sparkSession), rows // 50_000)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(starts, [*keys, "_bucket"]).withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_start", "_row")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column (nulls are empty)."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int):
    """Row ranges holding about ``most`` bytes each; a longer row stands alone."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
