"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths.

A document's ids (plus an end id) are cut into pieces of at most ``max_tokens``; only documents longer than that are cut.
The plan needs no document: best-fit decreasing runs over (length, count) pairs, a group of equally filled sequences being one
item of state. Its result says, for each length, which rank goes to which sequence and offset. Documents take their places by
their exact rank within their length.

Defined cases: null text counts as empty (its only id is the end id); an empty table gives no rows; equal rows each take a
place; very long texts are encoded whole and cut into pieces; a null doc_id is kept as an id of its own; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, durable, ranked, utf8

MAX_TOKENS, END_ID = 4096, 1
GROUP = 25_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts under a tokenizer that lowercases, splits on words and drops white space.

    Texts of Latin letters, digits and punctuation are split at white space here; each distinct run is split by the tokenizer's own
    pattern, and each distinct word is encoded by the tokenizer once. For every other text (other scripts, control characters,
    special tokens) the tokenizer encodes the text itself. Both ways give the same ids, as a word's ids do not depend on its
    neighbours. What is kept is bounded by KEPT entries and starts anew beyond.
    """

    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    OTHER = "[^\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]"
    KEPT = 600_000
    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str):
        import os
        import re

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.other = regex.compile(self.WORDS).findall, re.compile(self.OTHER).search
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _learn(self, runs: Iterable[str]) -> None:
        parts, ended = {}, []
        for r in runs:
            # a mark after a letter is a word of its own, so the run without it and the mark are looked up
            if len(r) > 1 and r[-1] in self.MARKS and r[-2].isalpha():
                ended.append(r)
                if r[:-1] not in self.runs:
                    parts[r[:-1]] = None
                if r[-1] not in self.runs:
                    parts[r[-1]] = None
            else:
                parts[r] = None
        for r in parts:
            parts[r] = [r] if r.isalpha() else self.split(r)
        new = list(dict.fromkeys(w for words in parts.values() for w in words if w not in self.words))
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            raw, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self.words.update(zip(new, (raw[i:j] for i, j in zip([0, *stops], stops, strict=False)), strict=True))
        for run, words in parts.items():
            self.runs[run] = self.words[words[0]] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))
        for run in ended:
            self.runs[run] = self.runs[run[:-1]] + self.runs[run[-1]]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The same for several texts, whose new words are encoded in one call."""
        runs = [None if "<|" in t or self.other(t) else t.lower().split() for t in texts]
        distinct = set().union(*(r for r in runs if r))
        new = distinct.difference(self.runs)
        if new:
            if len(self.words) > self.KEPT:
                self.words.clear()
            if len(self.runs) > self.KEPT:
                self.runs.clear()
                new = distinct
            self._learn(new)
        known = self.runs.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if r is None else b"".join(map(known, r)) for t, r in zip(texts, runs, strict=True)]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker, which keeps its words from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves (binary, little-endian unsigned 32-bit)."""
    import pyarrow as pa

    path, end = path or vocabulary(), np.array([END_ID], "<u4").tobytes()

    def encoded(texts) -> Iterator[bytes]:
        """Of about GROUP bytes of texts at a time; a longer one stands alone."""
        ids_of, (_, bounds) = word_ids(path), utf8(texts)
        for lo, hi in chunks(bounds, GROUP):
            yield from ids_of.many([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])

    def encode(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, PIECES + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over counts: rows (length, first rank, first sequence, pieces a sequence, offset), by length and rank.

    A group is a run of sequences with the same room left. Each length fills the groups with least sufficient room first, then
    opens new sequences. At most three groups arise per length, and one group is used by at most sqrt(2 size) lengths, so the
    plan has at most about 3 * size * 90 rows for size 4096 however many pieces there are.
    """
    rows, rooms, groups, opened = [], [], {}, 0  # groups: room -> heap of (first sequence, sequences)

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            heapq.heappush(groups[room], (first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = heapq.heappop(groups[room])
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = size, opened
                count = -(-left // (size // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            if full:
                rows.append((length, rank, first, each, size - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if left and full < count:
                rows.append((length, rank, first + full, left, size - room))
                put(room - left * length, first + full, 1)
                full, left, rank = full + 1, 0, rank + left
            put(room, first + full, count - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (and, with_ids, their ids)."""
    import pyarrow as pa

    spark = docs.sparkSession
    table = durable(pieces(docs, path, max_tokens, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}  # at most max_tokens rows
    slots = spark.sparkContext.broadcast(plan(histogram, max_tokens))

    def place(batches: Iterator) -> Iterator:
        rows = slots.value
        # ranks of a length start at 0, so (length, rank) is one ascending number
        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, start, first, each, offset = rows[np.searchsorted(keys, length << 48 | rank, "right") - 1].T if len(length) else np.zeros((5, 0), np.int64)
            nth = rank - start
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "rank"), pa.array(first + nth // np.maximum(each, 1)), pa.array(offset + nth % np.maximum(each, 1) * length)], names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    order = ["doc_id", "piece", "ids_crc32"]
    placed = ranked(table, ["length"], order, "rank", sum(histogram.values()))
    return placed.select(*table.columns, "rank").mapInArrow(place, PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: one row per sequence_id with its ids (needs pieces packed with_ids).

    A sequence holds at most max_tokens pieces, so no group is unbounded."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"), F.sum("length").alias("n_tokens"))
