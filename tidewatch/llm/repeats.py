"""Exact removal of what repeats an earlier document, by a partitioned sort of sampled suffixes.

Texts are sequences of symbols (bytes; or line hashes). A window of ``span`` symbols is a repeat if it also occurs earlier. Suffixes
are taken at anchors only: the least hashed ``gram`` symbols of a window, leftmost among equals. Equal windows have equal anchors
at equal places, so every pair of equal windows meets among the suffixes that start with that gram, with the symbols before and
after it. All windows with one anchor travel as one unit (the anchor, up to ``span - gram`` symbols on either side).

* Splitters sampled from anchors cut the range of leading symbols into at most ``RANGES`` ranges, and a hash of the gram cuts ranges into
  buckets where there is more data. A gram lies in one bucket, so no group straddles a boundary and buckets need no comparison
  with their neighbours. Each map flush sends a unit of equal symbols once, for its least document; the others are settled where they are. So a
  passage shared by any number of documents sends one unit a flush.
* A bucket settles units of equal symbols, sorts the rest by multikey quicksort over their leading symbols, eight bytes being one
  character, and compares them window by window within their gram: a window is a repeat if the least document that has it is smaller.
  All units of one gram are one group of one task: copies are settled before, but a gram with very many different contexts is not split.
* Spans return to their document by a hash bucket of its id and are merged there.

Equality within a gram rests on the gram's own bytes and on a 64-bit hash of the window or unit and its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, shuffle_width, utf8

U = np.uint64
ODD = 0xD1342543DE82EF95
MASK = (1 << 64) - 1
LEAST = -(1 << 63)
#: Most ranges between splitters: what the driver holds of them does not grow with the data.
RANGES = 4096


@dataclass(frozen=True)
class Shape:
    """span and gram in symbols of ``width`` bytes; positional: an earlier place in the same document counts as earlier too; gaps: no
    window holds a symbol of zero bytes; base: what is added to the places of spans, so that those of several shapes stay apart."""

    span: int
    gram: int
    width: int = 1
    positional: bool = False
    gaps: bool = False
    base: int = 0

    @property
    def side(self) -> int:
        return self.span - self.gram

    @property
    def columns(self) -> int:
        return -(-(2 * self.side + self.gram) * self.width // 8) * 8


@dataclass
class Units:
    """ctx: symbols around each anchor, zero outside of left..right; members: places of a unit (its index, document, anchor)."""

    ctx: np.ndarray
    left: np.ndarray
    right: np.ndarray
    unit: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(29))


BYTE = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(ODD))


def gram_hash(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive symbol values, by doubling."""
    done, out, step, size = 0, None, symbols, 1
    while n:
        if n & 1:
            out = step if out is None else out[: len(step) - done] * U(pow(ODD, size, 1 << 64)) + step[done:]
            done += size
        n >>= 1
        if n:
            step, size = step[:-size] * U(pow(ODD, size, 1 << 64)) + step[size:], 2 * size
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(data: np.ndarray, bounds: np.ndarray, shape: Shape) -> Units | None:
    """Units of the texts data[bounds[i]:bounds[i+1]] (symbols); documents are numbered from 0."""
    n = len(bounds) - 1
    total = int(bounds[-1])
    if total < shape.span:
        return None
    values = BYTE[data] if shape.width == 1 else mix(data.reshape(-1, 8).view(np.uint64)[:, 0] + U(1))
    key = gram_hash(values, shape.gram) & U(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)
    anchor = (sliding_min(key, shape.side + 1) & U(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(bounds)
    doc_of = np.repeat(np.arange(n, dtype=np.int32), lengths)
    first = np.flatnonzero(doc_of[: len(anchor)] == doc_of[shape.span - 1 :])  # windows within one text
    if shape.gaps:
        void = np.r_[0, np.cumsum(~data.reshape(-1, shape.width).any(axis=1))]
        first = first[void[first + shape.span] == void[first]]
    if not len(first):
        return None
    anchor, owner = anchor[first], doc_of[first]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    last = first[np.r_[new[1:], len(first)] - 1]
    at, begin = anchor[new], first[new]
    left, right = (at - begin), (last + shape.span - at - shape.gram)
    w, side = shape.width, shape.side
    padded = np.zeros((total + 2 * side + shape.gram) * w + shape.columns, np.uint8)
    padded[side * w : side * w + total * w] = data
    ctx = np.lib.stride_tricks.sliding_window_view(padded, shape.columns)[at * w]
    units = Units(ctx, left.astype(np.uint8), right.astype(np.uint8), np.arange(len(at)), owner[new].astype(np.int64), at - bounds[owner[new]])
    units.ctx = ctx * inside(units, shape)
    return units


def content_hash(units: Units) -> np.ndarray:
    words = np.ascontiguousarray(units.ctx).view(np.uint64)
    h = units.left.astype(np.uint64) << U(8) | units.right.astype(np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * U(ODD)
        h ^= h >> U(31)
    return mix(h)


def settle(units: Units, rank: np.ndarray, shape: Shape) -> tuple[Units, np.ndarray, np.ndarray]:
    """Merges units of equal symbols. rank: order of each document. Returns the merged units with their least members, the rows of
    the members that came later, and the least key by unit."""
    h = content_hash(units)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
    merged = np.empty(len(h), np.int64)
    merged[order] = np.cumsum(new) - 1
    unit = merged[units.unit]
    key = rank[units.doc] << 32 | (units.at if shape.positional else 0)
    least = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, unit, key)
    later = key > least[unit]
    if shape.positional:  # equal keys are equal rows: one of them stays
        pass
    keep = order[new]
    stay = ~later
    return Units(units.ctx[keep], units.left[keep], units.right[keep], unit[stay], units.doc[stay], units.at[stay]), np.flatnonzero(later), least


def gram_words(ctx: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """The gram as big-endian 64-bit characters, first to last."""
    size = shape.gram * shape.width
    own = np.zeros((len(ctx), -(-size // 8) * 8), np.uint8)
    own[:, :size] = ctx[:, shape.side * shape.width : shape.side * shape.width + size]
    words = own.view(">u8").astype(np.uint64)
    return [words[:, k] for k in range(words.shape[1])]


SMALL = 4096


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Rows in the order of their characters words[0], words[1], ... by multikey quicksort: rows are parted into those less than, equal to and
    greater than a pivot, and the equal ones go on with the next character. Parts of at most SMALL rows are finished by a library sort."""
    out: list[np.ndarray] = []
    parts = [(np.arange(len(words[0])), 0)]
    while parts:
        rows, depth = parts.pop()
        if depth == len(words):
            out.append(rows)
        elif len(rows) <= SMALL:
            out.append(rows[np.lexsort([w[rows] for w in reversed(words[depth:])])])
        else:
            c = words[depth][rows]
            pivot = np.sort(c[[0, len(c) // 2, -1]])[1]
            less, more = c < pivot, c > pivot
            parts += [(rows[more], depth), (rows[~less & ~more], depth + 1), (rows[less], depth)]
    return np.concatenate(out)


def compare(units: Units, least: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Per unit the least and the greatest number of symbols before the anchor of a window that occurs earlier (greatest -1: none)."""
    m = len(units.left)
    low, high = np.full(m, 1 << 30), np.full(m, -1)
    words = gram_words(units.ctx, shape)
    order = multikey_order(words)
    new = np.zeros(m, bool)
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    if m:
        new[0] = True
    group = np.cumsum(new) - 1
    rows = order[np.bincount(group)[group] > 1] if m else order
    groups = group[np.bincount(group)[group] > 1] if m else group
    lo = 0
    while lo < len(rows):  # whole groups, about 2 million windows at once
        hi = min(len(rows), lo + max(1, 2_000_000 // (shape.side + 1)))
        while hi < len(rows) and groups[hi] == groups[hi - 1]:
            hi += 1
        _windows(units, least, shape, rows[lo:hi], groups[lo:hi], low, high)
        lo = hi
    return low, high


def _windows(units: Units, least: np.ndarray, shape: Shape, rows: np.ndarray, groups: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    size = 2 * shape.side + shape.gram
    symbols = units.ctx[rows]
    values = BYTE[symbols[:, :size]] if shape.width == 1 else mix(np.ascontiguousarray(symbols).view(np.uint64)[:, :size] + U(1))
    powers = np.array([pow(ODD, size - c, 1 << 64) for c in range(size)], np.uint64)
    sums = np.zeros((len(rows), size + 1), np.uint64)
    np.cumsum(values * powers, axis=1, out=sums[:, 1:])
    before = units.left[rows].astype(np.int64)
    after = shape.side - units.right[rows].astype(np.int64)  # windows begin after..before symbols ahead of the anchor
    counts = before - after + 1
    row = np.repeat(np.arange(len(rows)), counts)
    j = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + after[row]
    start = shape.side - j
    lift = np.array([pow(ODD, c, 1 << 64) for c in range(size + 1)], np.uint64)
    h = (sums[row, start + shape.span] - sums[row, start]) * lift[start]
    h = mix(h ^ mix((groups[row].astype(np.uint64) << U(8)) + j.astype(np.uint64)))
    key = least[rows][row] - (j if shape.positional else 0)
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    first = np.minimum.reduceat(key[order], new)
    found = np.empty(len(h), bool)
    found[order] = key[order] > np.repeat(first, np.diff(np.r_[new, len(h)]))
    np.minimum.at(low, rows[row[found]], j[found])
    np.maximum.at(high, rows[row[found]], j[found])


def union(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjacent spans of a document as one."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    shift = np.int64(max(end.max(), 1) + 1)
    reach = np.maximum.accumulate(end + (np.r_[0, np.cumsum(doc[1:] != doc[:-1])]) * shift)
    base = np.r_[0, np.cumsum(doc[1:] != doc[:-1])] * shift
    new = np.flatnonzero(np.r_[True, begin[1:] + base[1:] > reach[:-1]])
    return doc[new], begin[new], (reach - base)[np.r_[new[1:], len(doc)] - 1]


PACKED = "bucket int, spans boolean, payload binary"


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (of differences, where the values ascend), compressed."""
    import pickle

    import zstandard

    planes = {}
    for name, a in arrays.items():
        step = name in ("unit", "begin")
        a = np.ascontiguousarray(np.diff(a.astype(np.int64), prepend=0) if step else a)
        planes[name] = (a.dtype.str, a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(planes, protocol=5))


def _unpack(payload: bytes) -> dict[str, np.ndarray]:
    import pickle

    import zstandard

    out = {}
    for name, (kind, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(payload)).items():
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]
        out[name] = np.cumsum(a) if name in ("unit", "begin") else a
    return out


def home_of(ids: np.ndarray, homes: int) -> np.ndarray:
    return ((ids % 1000003) * 7919 + ((ids.view(np.uint64) >> U(20)).astype(np.int64) % 1000003) * 104729) % homes


def home_column(ids: Column, homes: int) -> Column:
    """home_of as a column."""
    return F.pmod(F.pmod(ids, F.lit(1000003)) * 7919 + F.pmod(F.shiftrightunsigned(ids, 20), F.lit(1000003)) * 104729, F.lit(homes)).cast("int")


def inside(units: Units, shape: Shape) -> np.ndarray:
    """Which bytes of ctx belong to the unit."""
    column = np.arange(shape.columns) // shape.width
    return (column >= (shape.side - units.left.astype(np.int64))[:, None]) & (column < (shape.side + shape.gram + units.right.astype(np.int64))[:, None])


class Spans:
    """Gathers spans of documents and hands them out by document bucket."""

    MOST = 1_000_000

    def __init__(self, emit: Callable[[int, bool, bytes], None], homes: int, base: int = 0):
        self.emit, self.homes, self.base, self.parts, self.size = emit, homes, base, [], 0

    def add(self, docs: dict[str, np.ndarray], doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        if len(doc):
            doc, begin, end = union(doc, begin, end)
            self.parts.append((docs["id"][doc], docs["text"][doc], begin + self.base, end + self.base))
            self.size += len(doc)
            if self.size > self.MOST:
                self.flush()

    def flush(self) -> None:
        if self.parts:
            ids, text, begin, end = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            home = home_of(ids, self.homes)
            order = np.lexsort((begin, text, ids, home))
            cut = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0, True])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                rows = order[lo:hi]
                self.emit(int(home[rows[0]]), True, _pack(id=ids[rows], text=text[rows], begin=begin[rows], end=end[rows]))
        self.parts, self.size = [], 0


def _rank(ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.unique(ids), ids).astype(np.int64)


def _batches(out: list, kinds: dict) -> Iterator:
    import pyarrow as pa

    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
        out.clear()


def _kinds() -> dict:
    import pyarrow as pa

    return {"bucket": pa.int32(), "spans": pa.bool_(), "payload": pa.binary()}


def send(shape: Shape, read: Callable, splitters: np.ndarray, each: int, homes: int, flush_at: int) -> Callable:
    """Map side: units by bucket and the spans settled on the way. Columns: id, text hash, text."""

    def run(batches: Iterator) -> Iterator:
        out: list = []
        spans = Spans(lambda *x: out.append(x), homes, shape.base)
        held: list[Units] = []
        docs: dict[str, list] = {"id": [], "text": []}
        count = [0, 0]

        def flush() -> None:
            if not held:
                return
            known = {k: np.concatenate(v) for k, v in docs.items()}
            offset = np.r_[0, np.cumsum([len(u.left) for u in held])[:-1]]
            units = Units(*(np.concatenate([getattr(u, f) for u in held]) for f in ("ctx", "left", "right")), np.concatenate([u.unit + o for u, o in zip(held, offset, strict=True)]), np.concatenate([u.doc for u in held]), np.concatenate([u.at for u in held]))
            held.clear()
            kept, later, _ = settle(units, _rank(known["id"]), shape)
            u = units.unit[later]
            spans.add(known, units.doc[later], units.at[later] - units.left[u], units.at[later] + shape.gram + units.right[u])
            del units
            words = gram_words(kept.ctx, shape)
            lead = words[0]
            bucket = np.searchsorted(splitters, lead, "right")
            if each > 1:
                spread = np.zeros(len(lead), np.uint64)
                for w in words:
                    spread = mix((spread ^ w) * U(ODD))
                bucket = bucket * each + ((spread >> U(8)) % U(each)).astype(np.int64)
            order = np.lexsort((lead, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            by = np.argsort(place[kept.unit], kind="stable")
            member = place[kept.unit][by]
            cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                rows = order[lo:hi]
                own = by[np.searchsorted(member, lo) : np.searchsorted(member, hi)]
                unit, at, owner = place[kept.unit[own]] - lo, kept.at[own], kept.doc[own]
                few = Units(kept.ctx[rows], kept.left[rows], kept.right[rows], unit, owner, at)
                out.append((int(bucket[rows[0]]), False, _pack(ctx=few.ctx[inside(few, shape)], left=few.left, right=few.right, unit=unit, at=at, id=known["id"][owner], text=known["text"][owner])))
            for v in docs.values():
                v.clear()
            count[:] = [0, 0]

        for batch in batches:
            data, bounds = read(batch.column(2))
            ids, text = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for lo, hi in chunks(bounds * shape.width, 2_000_000):
                units = anchors(data[bounds[lo] * shape.width : bounds[hi] * shape.width], bounds[lo : hi + 1] - bounds[lo], shape)
                if units:
                    units.doc += count[0]
                    held.append(units)
                    count[1] += len(units.left)
                for k, v in (("id", ids), ("text", text)):
                    docs[k].append(v[lo:hi])
                count[0] += hi - lo
                if count[1] > flush_at:
                    flush()
                    yield from _batches(out, _kinds())
        flush()
        spans.flush()
        yield from _batches(out, _kinds())

    return run


def meet(shape: Shape, homes: int) -> Callable:
    """Reduce side, rows sorted by bucket: units of one bucket are compared; spans pass."""

    def run(batches: Iterator) -> Iterator:
        out: list = []
        spans = Spans(lambda *x: out.append(x), homes, shape.base)
        state: list = [None, []]

        def flush() -> None:
            parts, state[1] = state[1], []
            if not parts:
                return
            docs = {k: np.concatenate([p[k] for p in parts]) for k in ("id", "text")}
            offset = np.r_[0, np.cumsum([len(p["left"]) for p in parts])]
            units = Units(np.zeros(0), *(np.concatenate([p[f] for p in parts]) for f in ("left", "right")), np.concatenate([p["unit"] + o for p, o in zip(parts, offset, strict=False)]), np.arange(len(docs["id"])), np.concatenate([p["at"] for p in parts]))
            units.ctx = np.zeros((len(units.left), shape.columns), np.uint8)
            units.ctx[inside(units, shape)] = np.concatenate([p["ctx"] for p in parts])
            parts.clear()
            kept, later, least = settle(units, _rank(docs["id"]), shape)
            low, high = compare(kept, least, shape)
            u = units.unit[later]
            some = high[kept.unit] >= 0
            v, doc, at = kept.unit[some], kept.doc[some], kept.at[some]
            spans.add(docs, np.r_[units.doc[later], doc], np.r_[units.at[later] - units.left[u], at - high[v]], np.r_[units.at[later] + shape.gram + units.right[u], at - low[v] + shape.span])

        for batch in batches:
            for bucket, is_spans, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if is_spans:
                    out.append((bucket, True, payload))
                    continue
                if bucket != state[0]:
                    flush()
                    state[0] = bucket
                state[1].append(_unpack(payload))
            yield from _batches(out, _kinds())
        flush()
        spans.flush()
        yield from _batches(out, _kinds())

    return run


def home_spans(batches: Iterator, use: Callable) -> Iterator:
    """Rows sorted by home, spans before texts: calls use(row, begins, ends) for each text, in batches."""
    home, known = None, None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(c) for c in range(batch.num_columns)), strict=True):
            at, payload = row[0].as_py(), row[2].as_py()
            if at != home:
                home, parts, known = at, [], None
            if payload is not None:
                parts.append(_unpack(payload))
                continue
            if known is None:
                known = {}
                if parts:
                    full = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                    pair, group = np.unique(np.stack([full["id"], full["text"]], 1), axis=0, return_inverse=True)
                    group, begin, end = union(group.ravel(), full["begin"], full["end"])
                    cut = np.searchsorted(group, np.arange(len(pair) + 1))
                    known = {tuple(p): (begin[i:j], end[i:j]) for p, i, j in zip(pair.tolist(), cut[:-1], cut[1:], strict=True)}
            none = np.zeros(0, np.int64)
            done.append(use(row, *known.get((row[3].as_py(), row[4].as_py()), (none, none))))
        yield done


def find(docs: DataFrame, shape: Shape, read: Callable, finish: Callable, schema: str, text: Column, extra: list[str], size: int, sample: int = 1000, also: list[tuple[Shape, Callable]] | None = None) -> DataFrame:
    """finish: batches of [home, is text, payload, id, text hash, text, *extra] -> batches of ``schema``, see home_spans.

    ``also``: further shapes, each with its reader of symbols, whose spans come back beside those of ``shape``.

    ``size``: bytes of all texts, from which bucket counts follow. ``sample``: documents from which splitters are drawn (they set the
    balance of buckets, not the result).
    """
    spark = docs.sparkSession
    parts = max(shuffle_width(spark), size // 32_000_000)
    homes, buckets = 8 * parts, 8 * parts
    ranges = max(2, min(buckets, RANGES))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.coalesce(text, F.lit("")).alias("text"), *extra)
    # rows that share an id but not the text are told apart by a hash of the text
    twice = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = rows.select("id", (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("hash"), home_column(F.col("id"), homes).alias("home"), "text", *extra)

    def found_by(shape: Shape, read: Callable) -> DataFrame:
        def lead(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                data, bounds = read(batch.column(0))
                found = [anchors(data[bounds[lo] * shape.width : bounds[hi] * shape.width], bounds[lo : hi + 1] - bounds[lo], shape) for lo, hi in chunks(bounds * shape.width, 2_000_000)]
                first = np.concatenate([np.zeros(0, np.uint64), *(np.unique(gram_words(u.ctx, shape)[0]) for u in found if u)])
                h = mix(first ^ U(ODD))
                first = first[np.argsort(h)][:4096]
                yield pa.RecordBatch.from_arrays([pa.array((first >> U(1)).astype(np.int64))], names=["lead"])

        picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, size // (3000 * sample)))) == 0).select("text")
        leads = picked.mapInArrow(lead, "lead long").where(F.pmod(F.xxhash64("lead"), F.lit(max(1, sample // 250))) == 0)
        at = F.lit([k / ranges for k in range(1, ranges)])
        cuts = leads.agg(F.percentile_approx("lead", at, F.lit(20_000))).first()[0] or []
        splitters = np.unique(np.array(cuts, np.int64)).astype(np.uint64) << U(1)

        sent = rows.select("id", "hash", "text").mapInArrow(send(shape, read, splitters, -(-buckets // ranges), homes, 300_000), PACKED)
        return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet(shape, homes), PACKED)

    met = found_by(shape, read)
    for another in also or []:
        met = met.unionByName(found_by(*another))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.select("id", "hash", "text", *extra).schema]
    back = met.select(F.col("bucket").alias("home"), F.lit(False).alias("is_text"), "payload", *nothing)
    own = rows.select("home", F.lit(True).alias("is_text"), F.lit(None).cast("binary").alias("payload"), "id", "hash", "text", *extra)
    return back.unionByName(own).repartition(parts, "home").sortWithinPartitions("home", "is_text").mapInArrow(finish, schema)


def byte_symbols(column) -> tuple[np.ndarray, np.ndarray]:
    return utf8(column)
