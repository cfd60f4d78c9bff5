"""Sentiment of texts: a rule-based scorer over a small lexicon, and ways to run any scorer over a table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Valences, words that turn them, characters read, strength of a turn and of a mark, and what scales the sum.
LEXICON = {
    "amazing": 2.8, "bad": -2.5, "beat": 1.2, "best": 3.2, "bull": 1.5, "bullish": 2.2, "bear": -1.5, "bearish": -2.2, "crash": -2.6, "fear": -2.2, "fraud": -2.8,
    "gain": 2.0, "good": 1.9, "great": 3.1, "growth": 1.6, "hate": -2.7, "idiot": -2.3, "loss": -1.3, "love": 3.2, "miss": -0.6, "moon": 1.8, "profit": 1.9,
    "risk": -1.1, "rocket": 1.7, "strong": 2.3, "terrible": -2.1, "trash": -2.0, "weak": -1.9, "win": 2.8, "worst": -3.1,
}
NEGATORS = ("not", "no", "never", "without", "isn", "wasn", "don", "didn")
READ, TURN, MARK, SCALE = 300, -0.74, 0.292, 15.0
_words = re.compile("[a-z]+").findall


def layered(*layers: dict[str, float], without: tuple[str, ...] = ()) -> dict[str, float]:
    """One lexicon of several: later layers win, words in ``without`` go (jargon that is no mood, say)."""
    out: dict[str, float] = {}
    for layer in layers:
        out |= {w.lower(): float(v) for w, v in layer.items()}
    return {w: v for w, v in out.items() if w not in without}


def score_text(text: str | None, lexicon: dict[str, float] = LEXICON) -> float:
    """Compound score in [-1, 1] of the first 300 characters; blank or missing texts score 0. A negator turns the word after it; up to four
    exclamation marks push the sum on."""
    if not text or not text.strip():
        return 0.0
    text = text[:READ]
    words = _words(text.lower())
    total = sum(v * (TURN if k and words[k - 1] in NEGATORS else 1.0) for k, w in enumerate(words) if (v := lexicon.get(w)) is not None)
    if total:
        total += MARK * min(4, text.count("!")) * (1 if total > 0 else -1)
    return total / (total * total + SCALE) ** 0.5


def with_sentiment(rows: DataFrame, text: str, scorer: Callable[[str | None], float] = score_text) -> DataFrame:
    """rows with sentiment; ``scorer`` is the place to put another model. Arrow batches; each distinct text of a batch is scored once."""
    import pyarrow as pa

    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = {t: scorer(t) for t in set(texts)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known[t] for t in texts], pa.float64())], names=[*batch.schema.names, "sentiment"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, sentiment double")


def with_cached_sentiment(rows: DataFrame, text: str, store: str, scorer: Callable[[str | None], float] = score_text) -> DataFrame:
    """The same, but texts whose hash is in the store (Parquet: key, sentiment) are not scored again; new scores are added to it."""
    spark: SparkSession = rows.sparkSession
    schema = "key string, sentiment double"
    keyed = rows.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(schema).parquet(store)
    else:
        known = spark.createDataFrame([], schema)
    new = keyed.select(F.col("_key").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"]).join(known, "key", "left_anti")
    with_sentiment(new, "text", scorer).select("key", "sentiment").write.mode("append").parquet(store)
    scored = spark.read.schema(schema).parquet(store)
    return keyed.join(scored.withColumnRenamed("key", "_key"), "_key").drop("_key")


def author_label(label):
    """The author's own label (Bullish or Bearish, any case) as a score; null without one."""
    return F.when(F.lower(label) == "bullish", 1.0).when(F.lower(label) == "bearish", -1.0)
