"""Removal of every byte covered by a 50-byte string that also starts in a document with a smaller id.

Defined cases: null text is empty; texts under 50 bytes lose nothing; rows with equal ids do not count as smaller than each other;
a null doc_id counts as the smallest of all and comes back null; very long texts are searched whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.repeats import LEAST, Shape, byte_symbols, find, home_spans

SHAPE = Shape(span=50, gram=12)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, begins array<long>, ends array<long>, kept binary"


def total_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)


def remove_repeated(docs: DataFrame, shape: Shape = SHAPE, size: int | None = None) -> DataFrame:
    """Per document its removed runs (begins and ends, in bytes) and the bytes kept."""
    import pyarrow as pa

    def use(row: tuple, begin: np.ndarray, end: np.ndarray) -> tuple:
        text, doc = row[5].as_buffer(), row[3].as_py()
        raw = memoryview(text)
        kept = b"".join(raw[i:j] for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True))
        return None if doc == LEAST else doc, len(raw), len(raw) - len(kept), len(begin), begin.tolist(), end.tolist(), kept

    def finish(batches: Iterator) -> Iterator:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        for done in home_spans(batches, use):
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return find(docs, shape, byte_symbols, finish, RESULT, F.col("text").cast("string"), [], total_bytes(docs) if size is None else size)
