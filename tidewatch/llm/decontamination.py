"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact verification.

Words are runs of letters, digits and other non-ASCII characters, lowercased, so that punctuation and case do not hide a passage. For
each item length, windows of as many words slide over every document word by word. A window can reach the similarity only if
enough of its five-word shingles occur in some item, and windows without them are skipped, which loses nothing. Each other window gets a
64-bit SimHash of its weighted shingles. Eight blocks of eight bits are looked up with up to two wrong bits each: every item whose
fingerprint lies within 23 bits has a block with at most two, so all of them are found. Candidates are verified by the exact
weighted Jaccard similarity of the shingle counts.

Items are taken in blocks of at most ``ITEMS`` items and ``BLOCK_BYTES`` bytes (one longer item is a block of its own), each block being
broadcast; a Python worker builds a block's index once. The document side is never shuffled; it is read once for each block. The benchmark
passes through the driver block by block and is never held there whole.

Defined cases: null and empty texts and items match nothing; an item of under five words has one shingle of all its words; a document
somewhat shorter than an item is one window; very long texts are searched whole; equal items each match; a null item_id is kept; equal rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import minhash
from tidewatch.llm.common import chunks, utf8
from tidewatch.llm.repeats import U, gram_hash

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, PROBE = 23, 2
ITEMS, BLOCK_BYTES = 20_000, 8 << 20
_WORD = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return minhash.word_hashes(np.where(_WORD[data], data, np.uint8(32)), bounds)


def simhash(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 signed sums -> fingerprints."""
    return np.packbits(bits > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


def signs(grams: np.ndarray) -> np.ndarray:
    return np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


class Sized:
    """Items of one length in words: fingerprints by Hamming blocks, and shingle counts."""

    NEAR = [[v ^ m for m in range(256) if bin(m).count("1") <= PROBE] for v in range(256)]

    def __init__(self, length: int):
        self.length, self.k = length, min(SHINGLE, length)
        self.ids: list[int] = []
        self.counts: list[Counter] = []
        self.prints: list[int] = []
        self.blocks: list[dict[int, list[int]]] = [{} for _ in range(8)]

    def add(self, item: int, grams: np.ndarray) -> None:
        f = int(simhash(signs(grams).sum(0)[None])[0])
        for b, block in enumerate(self.blocks):
            for v in self.NEAR[f >> (8 * b) & 255]:
                block.setdefault(v, []).append(len(self.ids))
        self.ids.append(item)
        self.counts.append(Counter(grams.tolist()))
        self.prints.append(f)

    def near(self, f: int) -> list[int]:
        found = set().union(*(block.get(f >> (8 * b) & 255, ()) for b, block in enumerate(self.blocks)))
        return [i for i in sorted(found) if (f ^ self.prints[i]).bit_count() <= RADIUS]


class Items:
    def __init__(self, rows: list[tuple[int, str]]):
        self.sizes: dict[int, Sized] = {}
        grams: dict[int, list] = {}
        for item, text in rows:
            raw = np.frombuffer(text.lower().encode(), np.uint8)
            h, _ = words(raw, np.array([0, len(raw)]))
            if len(h):
                sized = self.sizes.setdefault(len(h), Sized(len(h)))
                g = gram_hash(h, sized.k)
                sized.add(item, g)
                grams.setdefault(sized.k, []).append(g)
        self.known = {k: np.unique(np.concatenate(g)) for k, g in grams.items()}
        self.quick = {}
        for k, g in self.known.items():
            self.quick[k] = np.zeros(1 << 22, bool)
            self.quick[k][(g >> U(42)).astype(np.int64)] = True

    def search(self, data: np.ndarray, bounds: np.ndarray, similarity: float = SIMILARITY) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(document, item) -> (similarity, first word, words) of the best window."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        h, doc = words(data, bounds)
        first = np.searchsorted(doc, np.arange(len(bounds)))
        for k, known in self.known.items():
            if len(h) < k:
                continue
            g = gram_hash(h, k)
            maybe = np.flatnonzero(self.quick[k][(g >> U(42)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, g[maybe]), len(known) - 1)
            maybe = maybe[(known[place] == g[maybe]) & (doc[maybe] == doc[maybe + k - 1])]
            cut = np.flatnonzero(np.r_[True, np.diff(doc[maybe]) != 0, True]) if len(maybe) else np.zeros(1, np.int64)
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                d = int(doc[maybe[i]])
                self._document(d, g[first[d] : first[d + 1] - k + 1], maybe[i:j] - first[d], int(first[d + 1] - first[d]), k, similarity, best)
        return best

    def _document(self, d: int, g: np.ndarray, hits: np.ndarray, length: int, k: int, similarity: float, best: dict) -> None:
        hit = np.zeros(len(g) + 1, np.int64)
        hit[hits + 1] = 1
        hit = np.cumsum(hit)
        lead = None
        for sized in self.sizes.values():
            full = sized.length - k + 1  # shingles of an item
            n = min(full, len(g))  # and of a window
            if sized.k != k or len(hits) < similarity * full or n < similarity * full:
                continue
            # J >= s needs an intersection of at least s (full + n) / (1 + s)
            least = similarity * (full + n) / (1 + similarity) - 1e-9
            starts = np.flatnonzero(hit[n:] - hit[: len(hit) - n] >= least)
            if not len(starts):
                continue
            if lead is None:  # running bit sums, over the stretch of the hits only
                lo, hi = max(0, int(hits[0]) - max(self.sizes)), min(len(g), int(hits[-1]) + max(self.sizes))
                lead = np.zeros((hi - lo + 1, 64), np.int32)
                np.cumsum(signs(g[lo:hi]), axis=0, out=lead[1:])
            for start, f in zip(starts.tolist(), simhash(lead[starts + n - lo] - lead[starts - lo]).tolist(), strict=True):
                near = sized.near(f)
                if near:
                    mine = Counter(g[start : start + n].tolist())
                    for i in near:
                        both = sum((mine & sized.counts[i]).values())
                        j = both / (full + n - both)
                        if j >= similarity and j > best.get((d, sized.ids[i]), (0.0,))[0]:
                            best[(d, sized.ids[i])] = (j, start, min(sized.length, length))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        more = 4 * len(r[1])
        if block and (len(block) >= ITEMS or size + more > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += more
    if block:
        yield block


_kept: dict[str, Items] = {}


def indexed(name: str, block) -> Items:
    """The index of a block, built once by each worker; the last one is kept."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Items(block.value)
    return _kept[name]


def _searched(text_column, items: Items, similarity: float) -> Iterator[tuple[int, dict]]:
    import pyarrow.compute as pc

    data, bounds = utf8(pc.utf8_lower(text_column))
    for lo, hi in chunks(bounds, 1_000_000):
        yield lo, items.search(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], similarity)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document and item."""
    import pyarrow as pa

    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        shared = base.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator, shared=shared, name=uuid.uuid4().hex) -> Iterator:
            items = indexed(name, shared)
            for batch in batches:
                rows = [(batch.column(0)[lo + d].as_py(), item, *x) for lo, found in _searched(batch.column(1), items, similarity) for (d, item), x in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        out = out.unionByName(base.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that hold a benchmark passage; all columns."""
    import pyarrow as pa

    at = docs.columns.index("text")
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator, shared=shared, name=uuid.uuid4().hex) -> Iterator:
            items = indexed(name, shared)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, found in _searched(batch.column(at), items, similarity):
                    keep[[lo + d for d, _ in found]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
