"""Removal of runs of lines that occurred before, in an earlier document or earlier in the same one.

A run is at least ``RUN`` consecutive lines with words, or fewer lines that have ``WORDS`` words together (lines are often paragraphs);
equality is that of a 64-bit hash of the line without outer white space. Lines are winnowed: each window of RUN lines selects its least
hashed pair of lines as fingerprint, so that every run of RUN equal lines shares one. Positions with one fingerprint meet; every window around
it that occurred before is a match, and matches that overlap or touch are joined, so that a match extends both ways as far as it
goes. Every line covered by a later occurrence goes. Each window of fewer lines with WORDS words is a fingerprint
of its own. Order is that of (doc_id, line). Lines without words are no part of a run; they go where the line before them went. A word
is a run of other characters than white space; in scripts without spaces between words, each character counts as one.

Defined cases: null text stays null; texts under RUN lines and under WORDS words lose nothing; a null doc_id is the smallest; rows that share an
id are ordered by the line alone, so equal rows keep their lines; very long texts are cut whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.repeats import LEAST, Shape, find, home_spans
from tidewatch.llm.substring_dedup import total_bytes

RUN, WORDS = 3, 50
#: Where the spans of short runs begin, above any line number.
SHORT = 1 << 32
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
SPACE = " \t\n\v\f\r"


def shape_of(run: int) -> Shape:
    return Shape(span=run, gram=2, width=8, positional=True)


def line_symbols(column) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh3_64_intdigest

    out: list[int] = []
    bounds = [0]
    for text in column:
        out += [xxh3_64_intdigest(s.encode()) for line in (text.as_py() or "").split("\n") if (s := line.strip(SPACE))]
        bounds.append(len(out))
    return np.array(out, np.uint64).view(np.uint8), np.array(bounds, np.int64)


def n_words(line: str) -> int:
    return len(line.split()) if line.isascii() else len(_WORD.findall(line))


def short_symbols(run: int, words: int):
    """Reads windows of less than run lines: symbol (run - 1) * i + m - 1 is that of the m lines from line i, zero without enough words."""

    def read(column) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh3_64_intdigest

        out: list[int] = []
        bounds = [0]
        for text in column:
            lines = [s for line in (text.as_py() or "").split("\n") if (s := line.strip(SPACE))]
            sizes = [n_words(s) for s in lines]
            for i in range(len(lines)):
                for m in range(1, run):
                    long = i + m <= len(lines) and sum(sizes[i : i + m]) >= words
                    out.append((xxh3_64_intdigest("\n".join(lines[i : i + m]).encode(), m) or 1) if long else 0)
            bounds.append(len(out))
        return np.array(out, np.uint64).view(np.uint8), np.array(bounds, np.int64)

    return read


def covered(begin: np.ndarray, end: np.ndarray, run: int) -> set[int]:
    """Numbers of the lines with words in the spans of either kind."""
    gone: set[int] = set()
    for i, j in zip(begin.tolist(), end.tolist(), strict=True):
        if i < SHORT:
            gone.update(range(i, j))
        else:
            for k in range(i - SHORT, j - SHORT):
                line, more = divmod(k, run - 1)
                gone.update(range(line, line + more + 1))
    return gone


def cut(text: str, gone: set[int]) -> tuple[str, list[int]]:
    """The text without the lines that are gone (numbers among those with words); numbers of the lines that went."""
    kept, lost, symbol, drop = [], [], 0, False
    for k, line in enumerate(text.split("\n")):
        if line.strip(SPACE):
            drop = symbol in gone
            symbol += 1
        if drop:
            lost.append(k)
        else:
            kept.append(line)
    return "\n".join(kept), lost


def dedup_lines(docs: DataFrame, run: int = RUN, carry: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_removed, n_runs, removed_lines, and the columns to carry."""
    import pyarrow as pa

    carry = carry or []
    fields = [docs.schema[c] for c in carry]
    taken = docs.select("doc_id", "text", *(F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)))
    taken = taken.withColumn("was_null", F.col("text").isNull())

    def use(row: tuple, begin: np.ndarray, end: np.ndarray) -> tuple:
        doc, text = row[3].as_py(), row[5].as_py()
        gone = covered(begin, end, run)
        left, lost = cut(text, gone) if gone else (text, [])
        runs = sum(k - 1 not in gone for k in gone)
        return None if doc == LEAST else doc, None if row[6].as_py() else left, text.count("\n") + 1, len(lost), runs, lost, *(x.as_py() for x in row[7:])

    schema = "doc_id long, text string, n_lines long, n_removed long, n_runs long, removed_lines array<int>" + "".join(f", carry{k} {f.dataType.simpleString()}" for k, f in enumerate(fields))

    def _batch(done: list, kinds: list):
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), *(k.type for k in kinds)]
        names = ["doc_id", "text", "n_lines", "n_removed", "n_runs", "removed_lines", *(f"carry{k}" for k in range(len(fields)))]
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def finish(batches: Iterator) -> Iterator:
        kinds: list = []

        def seen():
            for b in batches:
                kinds[:] = list(b.schema)[7:]
                yield b

        for done in home_spans(seen(), use):
            yield _batch(done, kinds)

    also = [(Shape(span=1, gram=1, width=8, positional=True, gaps=True, base=SHORT), short_symbols(run, words))] if run > 1 else []
    out = find(taken, shape_of(run), line_symbols, finish, schema, F.col("text").cast("string"), ["was_null", *(f"carry{k}" for k in range(len(carry)))], total_bytes(docs), also=also)
    return out.withColumnsRenamed({f"carry{k}": c for k, c in enumerate(carry)})
