"""Stores of Parquet files: versioned writes, upserts, appends of new rows, replacement of groups, snapshots, and ledgers of what was read.

A store is a folder of versions. A writer writes a whole new version beside the old ones and then names it in a pointer file, which it
renames into place; readers follow the pointer. So no reader sees half a version, a failed write leaves the old one, and a version that
is being read is never overwritten. Older versions than the last ``KEEP`` go after a write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.records import require_text_free

KEEP = 2


class Files:
    """The file system of a path, through Spark's own readers (any store that Spark can reach)."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def listed(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, modified in ms) of a folder's entries, by name; empty where there is none."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self.path(path)))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside and renamed."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self.path(path), False)
        if not self.fs.rename(self.path(beside), self.path(path)):
            raise OSError(f"could not put {path} in place")


def current(spark: SparkSession, store: str) -> str | None:
    """The folder of the version that the store's pointer names."""
    files = Files(spark, store)
    return f"{store}/{files.read(f'{store}/CURRENT').strip()}" if files.exists(f"{store}/CURRENT") else None


def load(spark: SparkSession, store: str) -> DataFrame | None:
    """The store's rows; None where nothing was written yet."""
    at = current(spark, store)
    return spark.read.parquet(at) if at else None


def replace(frame: DataFrame, store: str, guarded: bool = True) -> str:
    """A new version with these rows, which may come from the store itself. Guarded stores take no text and no names."""
    spark, files = frame.sparkSession, Files(frame.sparkSession, store)
    if guarded:
        require_text_free(frame)
    known = [n for n, *_ in files.listed(store) if n.startswith("v")]
    name = f"v{max((int(n[1:9]) for n in known), default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    frame.write.parquet(f"{store}/{name}")
    files.write(f"{store}/CURRENT", name)
    for old in sorted(known)[: 1 - KEEP or None]:
        files.fs.delete(files.path(f"{store}/{old}"), True)
    return name


def upsert(new: DataFrame, store: str, merge: Callable[[DataFrame, DataFrame], DataFrame], guarded: bool = True) -> str:
    """The store merged with new rows; ``merge`` is the aggregate's own (sums, weighted means)."""
    old = load(new.sparkSession, store)
    return replace(merge(old, new) if old is not None else new, store, guarded)


def append_new(new: DataFrame, store: str, key: str, guarded: bool = False) -> int:
    """Rows whose key the store does not have yet, one a key. Returns how many came; fails if the store would lose any."""
    spark = new.sparkSession
    old = load(spark, store)
    fresh = new.dropDuplicates([key]) if old is None else new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns)
    before = 0 if old is None else old.count()
    replace(fresh if old is None else old.unionByName(fresh), store, guarded)
    after = load(spark, store).count()
    if after < before:
        raise RuntimeError(f"{store} had {before} rows and would have {after}")
    return after - before


def replace_groups(new: DataFrame, store: str, keys: list[str], guarded: bool = True) -> str:
    """Groups of the new rows take the place of the store's groups with the same keys."""
    return upsert(new, store, lambda old, rows: old.join(rows.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(rows), guarded)


def splice_tail(new: DataFrame, store: str, days: int, guarded: bool = True) -> str:
    """The store's last days recomputed: rows from ``days`` before its newest day on are those of ``new``."""

    def spliced(old: DataFrame, rows: DataFrame) -> DataFrame:
        top = old.agg(F.date_sub(F.max("day"), days).alias("_cut"))  # one row
        kept, late = (x.join(F.broadcast(top)) for x in (old, rows))
        return kept.where("day <= _cut").drop("_cut").unionByName(late.where("day > _cut").drop("_cut"))

    return upsert(new, store, spliced, guarded)


def snapshot(frame: DataFrame, folder: str, day: str) -> bool:
    """A day's snapshot, written once: a day that is there is never revised."""
    path = f"{folder}/day={day}"
    if Files(frame.sparkSession, folder).exists(f"{path}/_SUCCESS"):
        return False
    require_text_free(frame).write.mode("overwrite").parquet(path)
    return True


def copy_store(spark: SparkSession, source: str, target: str) -> list[str]:
    """Every store below a folder copied, current versions only."""
    done = []
    for name, *_ in Files(spark, source).listed(source):
        frame = load(spark, f"{source}/{name}")
        if frame is not None:
            replace(frame, f"{target}/{name}", guarded=False)
            done.append(name)
    return done


def write_as(frame: DataFrame, path: str) -> None:
    """Parquet, CSV with a header, or JSON lines, as the path's ending says; .gz or .zst compresses the text formats."""
    packed = "gzip" if path.endswith(".gz") else "zstd" if path.endswith(".zst") else "none"
    name = path.removesuffix(".gz").removesuffix(".zst")
    if name.endswith(".parquet"):
        frame.write.mode("errorifexists").parquet(path)
    elif name.endswith(".csv"):
        frame.write.option("header", True).option("escape", '"').option("compression", packed).csv(path)
    elif name.endswith((".jsonl", ".ndjson", ".json")):
        frame.write.option("compression", packed).json(path)
    else:
        raise ValueError(f"no format for {path}")


def append_lines(new: DataFrame, folder: str, key: str) -> int:
    """Records as compressed JSON lines beside those of the folder, without those whose key it has. Returns how many came."""
    spark = new.sparkSession
    fresh = new.dropDuplicates([key])
    if any(n.startswith("part-") for n, *_ in Files(spark, folder).listed(folder)):
        fresh = fresh.join(spark.read.schema(new.schema).json(folder).select(key), key, "left_anti").select(*new.columns)
    before = spark.read.schema(new.schema).json(folder).count() if Files(spark, folder).exists(folder) else 0
    fresh.write.mode("append").option("compression", "gzip").json(folder)
    return spark.read.schema(new.schema).json(folder).count() - before


def newest(rows: DataFrame, by: str, most: int, key: str) -> DataFrame:
    """The newest ``most`` rows of a ledger (that is its point); ties go to the greater key."""
    return rows.orderBy(F.desc(by), F.desc(key)).limit(most)


def new_files(spark: SparkSession, folder: str, ledger: str, suffix: str = "") -> list[str]:
    """Files of a folder that are new or have grown since the ledger was marked; the ledger is a JSON file of names and sizes."""
    files = Files(spark, folder)
    known = json.loads(files.read(ledger)) if files.exists(ledger) else {}
    return [n for n, size, _ in files.listed(folder) if n.endswith(suffix) and known.get(n) != size and not n.startswith(("_", "."))]


def mark_files(spark: SparkSession, folder: str, ledger: str, names: list[str]) -> None:
    files = Files(spark, folder)
    known = json.loads(files.read(ledger)) if files.exists(ledger) else {}
    sizes = {n: size for n, size, _ in files.listed(folder)}
    files.write(ledger, json.dumps(known | {n: sizes[n] for n in names if n in sizes}, sort_keys=True))


def high_water(spark: SparkSession, path: str) -> dict[str, int]:
    files = Files(spark, path)
    return json.loads(files.read(path)) if files.exists(path) else {}


def advance(spark: SparkSession, path: str, source: str, seen: int, complete: bool, overlap: int = 86_400) -> int:
    """The second from which a source is read next: a day before the newest seen. The mark moves only forward, and only after a complete run."""
    marks = high_water(spark, path)
    if complete:
        marks[source] = max(marks.get(source, 0), seen)
        Files(spark, path).write(path, json.dumps(marks, sort_keys=True))
    return max(0, marks.get(source, 0) - overlap)


def since_start(rows: DataFrame, start: str, time: Column | str = "day") -> DataFrame:
    """Rows before the first live day are dropped: that day is fixed once and kept with the store."""
    return rows.where(F.col(time) >= F.to_date(F.lit(start)) if isinstance(time, str) else time >= F.to_date(F.lit(start)))


def staleness(rows: DataFrame, today: str, limit: int = 2) -> DataFrame:
    """source, newest, age, verdict: LIVE up to ``limit`` days, else STALE."""
    s = rows.groupBy("source").agg(F.max("day").alias("newest"))
    s = s.withColumn("age", F.datediff(F.to_date(F.lit(today)), "newest"))
    return s.withColumn("verdict", F.when(F.col("age") <= limit, "LIVE").otherwise("STALE"))


def guard_gap(old_newest, new_newest, stale: int = 90, revert: int = 14) -> None:
    """Stops an update whose input is far behind the store: over ``stale`` days a gap to fill first, ``revert`` days back a lost file."""
    gap = (new_newest - old_newest).days
    if gap > stale:
        raise ValueError(f"the store is {gap} days behind the input")
    if gap < -revert:
        raise ValueError(f"the input ends {-gap} days before the store")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("day"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
