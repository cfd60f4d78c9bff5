"""Quality scores from two zstandard dictionaries, one built from good and one from bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes; each block is compressed under either dictionary, and its difference
(bad - good) / (bad + good) says which one knows it better. Blocks are short, so that a text's own repetition helps neither. The
median over all blocks of the whole text is calibrated by a logistic curve.

Training reads at most ``SAMPLE`` labelled documents of either label (those with the least hash of doc_id), each whole, in pieces; seven
in ten make the dictionaries, the rest serves calibration, weighted back to the labels' own shares. So what comes to the driver is bounded
by the sample, not by the corpus. Labels are read only where crc32(doc_id) mod 5 is not 0.

Defined cases: null and empty texts have the difference 0; a null doc_id is not held out and has no label; a doc_id with
conflicting labels trains nothing; a labelled id with several texts trains on the least one; repeated rows score alike; very long texts are
scored whole; without labels of both kinds every score is 0.5; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import durable

BLOCK, LEVEL = 128, 3
DICTIONARY = 131_072
SAMPLE, PIECE = 3_000, 512
THRESHOLD, FOLDS = 0.3, 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


@functools.cache
def _compressors(dictionaries: tuple[bytes, bytes]):
    import zstandard as zs

    found = []
    for raw in dictionaries:
        d = zs.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        found.append(zs.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return found


def difference(text: str, dictionaries: tuple[bytes, bytes]) -> float:
    """Median over the text's blocks of (bad - good) / (bad + good), in compressed bytes."""
    good, bad = _compressors(dictionaries)
    raw = text.encode()
    if not raw:
        return 0.0
    parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    if len(parts) > 1 and len(parts[-1]) < BLOCK // 4:  # too short to tell; it joins the block before
        parts[-2:] = [parts[-2] + parts[-1]]
    sizes = np.array([(len(good(p)), len(bad(p))) for p in parts], float)
    return float(np.median((sizes[:, 1] - sizes[:, 0]) / sizes.sum(1)))


def differences(docs: DataFrame, dictionaries: tuple[bytes, bytes], carry: str) -> DataFrame:
    """docs: text and columns to carry (given as a schema)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            x = pa.array([difference(t.as_py() or "", shared.value) for t in batch.column(at)], pa.float64())
            rest = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), x], names=[*(batch.schema.names[k] for k in rest), "difference"])

    return docs.mapInArrow(run, f"{carry}, difference double")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a light pull of the slope towards 0."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    design = np.stack([np.ones_like(x), x / scale], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + [0, 0.1 * w[1]]
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple[bytes, bytes], float, float] | None:
    """Dictionaries (good, bad), intercept and slope; None without labels of both kinds."""
    import pyarrow as pa
    import zstandard as zs

    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    own = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    own = own.where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r[0]: r[1] for r in own.groupBy("label").count().collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return None
    by_hash = [own.where(F.col("label") == k).withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(sample) for k in (0, 1)]
    few = by_hash[0].unionByName(by_hash[1])
    # at most 2 * sample rows of three numbers
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    taken = durable(taken.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled").withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)) < 7)

    def pieces(batches: Iterator) -> Iterator:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                cut = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
                out += [(label, xxh3_64_intdigest(p) >> 1, p) for p in cut]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [(), (), ()], (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["label", "h", "piece"])

    rows = taken.where("fits").select("text", "label").mapInArrow(pieces, "label int, h long, piece binary").collect()
    dictionaries = []
    for k in (1, 0):
        parts = [bytes(r.piece) for r in sorted(rows, key=lambda r: (r.h, r.piece)) if r.label == k]
        try:
            dictionaries.append(zs.train_dictionary(DICTIONARY, parts).as_bytes())
        except zs.ZstdError:  # too little text for a trained dictionary: the text itself is one
            dictionaries.append(b"".join(parts)[-DICTIONARY:] or b" " * 8)
    pair = (dictionaries[0], dictionaries[1])
    rest = differences(taken.where("NOT fits").select("label", "text"), pair, "label int").collect()
    if len({r.label for r in rest}) < 2:
        rest = differences(taken.select("label", "text"), pair, "label int").collect()
    if len({r.label for r in rest}) < 2:  # documents of one kind only
        return None
    y = np.array([r.label for r in rest], float)
    x = np.array([r.difference for r in rest])
    share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.array([share[int(k)] for k in y])
    return pair, *logistic(x, y, weight * len(y) / weight.sum())


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, difference, score, predicted, held_out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels, sample)
    if model is None:
        out = base.select("doc_id", F.lit(0.0).alias("difference"), F.lit(0.5).alias("score"))
    else:
        pair, intercept, slope = model
        out = differences(base, pair, "doc_id long").withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(F.lit(intercept) + F.lit(slope) * F.col("difference"), F.lit(-30.0)), F.lit(30.0)))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))
