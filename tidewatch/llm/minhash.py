"""Near duplicates: probability MinHash, banding, exact verification, classes.

* Words are runs without ASCII white space, lowercased. A document's elements are its distinct shingles of five words (a shorter
  document has one shingle of all its words), of equal weight however often they occur, as links are judged by sets.
* ProbMinHash: each element's arrivals form a Poisson process with its weight as rate, each arrival falling on a random register; a
  register keeps the element that arrives first. Registers of two documents agree with the Jaccard similarity of their shingle
  sets, which is the probability Jaccard of equal weights. A document stops when no element can arrive before its latest register.
* Bands of five registers put documents into buckets. Equal texts (same words) are one node, the rest of this works on nodes.
* Candidates: in each bucket all members are compared with a pivot (the member that shares most buckets). Jaccard distance d is a
  metric, so a member with d > 0.4 to the pivot links to none that is within 0.2 of it; one between is compared with those within 0.2,
  where they are not in one class yet. So large groups of copies cost one comparison a member.
* What did not link to a bucket's pivot is joined by prefixes, whatever the size of its bucket: with shingles ordered from rare to frequent,
  two sets of Jaccard similarity s share one of the first n - ceil(s n) + 1 shingles of either. Texts that merely share a common line or
  passage have rare shingles of their own and do not meet. Groups of one prefix shingle first exchange counts of shingles by hash class,
  which bound the overlap from above; only members with a partner within the bound exchange their shingles. Both steps are exact
  and work in blocks of ``BLOCK`` members, so no group is held whole by a task; only members and links come out, never pairs.
* Links are pairs with an exact set Jaccard of at least 0.8; classes are their connected components.

Of 32 bands of five registers a pair of similarity 0.8 shares one or more with probability 0.999997. Node ids are 64-bit hashes of the words,
shingles 32-bit hashes. Very long texts are sketched in whole: a text is one row, and its shingles are held by the task that has the row.

Defined cases: null, empty and blank texts are each their own class; repeated rows and equal texts share a class; rows that share an id but
not the text are judged each by its own text; a null doc_id takes the class of its text's least id; ties for a class's first row go to the
least id, then the least hash of the text; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, chunks, durable, shuffle_width, utf8
from tidewatch.llm.components import components
from tidewatch.llm.repeats import BYTE, MASK, ODD, U, gram_hash, mix

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
BLOCK = 128
PARTS = 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_INVERSE = pow(ODD, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse, for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 22)
        for k, base in enumerate((ODD, _INVERSE)):
            steps = np.full(size, base & MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of each word."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.r_[False, solid[:-1]] & ~edge[:-1]
    after = np.r_[solid[1:], False] & ~edge[1:]
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * power[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, (np.searchsorted(bounds, start, "right") - 1)


def shingles(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, occurrences) of distinct shingles, by document and shingle; hash of all words and their number by document."""
    n = len(bounds) - 1
    h, doc = word_hashes(data, bounds)
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    at = np.arange(len(h)) - first[doc]
    key = np.zeros(n, np.uint64)
    some = np.flatnonzero(counts)
    if len(h):
        key[some] = mix(np.add.reduceat(h * powers(int(at.max()) + 1)[0][at], first[some]) + counts[some].astype(np.uint64))
    docs, grams = [], []
    if len(h) >= k:
        g = gram_hash(h, k)
        own = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
        docs.append(doc[own])
        grams.append(g[own])
    for m in range(1, k):
        few = np.flatnonzero(counts == m)
        if len(few):
            docs.append(few)
            grams.append(gram_hash(h, m)[first[few]] ^ U(m))
    if not docs:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, key, counts
    d, g = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])])
    return d[new], g[new], np.diff(np.r_[new, len(d)]), key, counts


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers: the element that arrives first at each register (0 for documents without elements)."""
    arrival = np.full(docs * registers, np.inf)
    kept = np.zeros(docs * registers, np.uint64)
    time = np.zeros(len(doc))
    k = 0
    while len(doc):
        seed = mix(element + U((k * 0x9E3779B97F4A7C15 + 0x1234567) & MASK))
        time = time - np.log(((seed >> U(11)) + 0.5) * 2.0**-53) / weight
        at = doc * registers + (((mix(seed ^ U(0x5851F42D4C957F2D)) >> U(32)) * U(registers)) >> U(32)).astype(np.int64)
        np.minimum.at(arrival, at, time)
        won = arrival[at] == time
        kept[at[won]] = element[won]
        # an element whose clock has passed its document's latest register has no more to say
        go = time < arrival.reshape(docs, registers).max(1)[doc]
        doc, element, weight, time = doc[go], element[go], weight[go], time[go]
        k += 1
    return kept.reshape(docs, registers)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (hash of the text), node (hash of the words; null without words), bands (bucket ids), shingles (sorted 32-bit hashes)."""
    import pyarrow as pa

    schema = "doc_id long, mark long, node long, bands array<long>, shingles binary"

    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        for batch in batches:
            data, bounds = utf8(pc.utf8_lower(batch.column(1)))
            for lo, hi in chunks(bounds, 2_000_000):
                base = bounds[lo]
                doc, g, _, key, counts = shingles(data[base : bounds[hi]], bounds[lo : hi + 1] - base)
                kept = prob_minhash(doc, g, np.ones(len(g)), hi - lo, bands * rows).reshape(hi - lo, bands, rows)
                bucket = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    bucket = mix((bucket ^ kept[:, :, r]) * U(ODD) + U(r + 1))
                bucket = mix(bucket + np.arange(bands, dtype=np.uint64) * U(0x632BE59BD9B4E019)).view(np.int64)
                small = (g >> U(32)).astype(np.uint32)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets = [np.unique(small[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                empty = counts == 0
                offsets = pa.array(np.arange(0, bands * (hi - lo) + 1, bands, dtype=np.int32))
                columns = [
                    batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(key.view(np.int64), mask=empty),
                    pa.ListArray.from_arrays(offsets, pa.array(bucket.ravel())), pa.array(sets, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "bands", "shingles"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(run, schema)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with their Jaccard distance d."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            d = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                d.append(1 - both / max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], names=["a", "b", "d"])

    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    full = left.join(nodes.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return durable(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, d double"), "verified")


def linked(sets: list[np.ndarray], own: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different classes (and, where there are two sides, from both) with at least that Jaccard similarity; of each member one to
    each class, which connects as much as all do."""
    sizes = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    member, code = member[shared], np.unique(code[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        i, j = np.searchsorted(code, [lo, lo + 4096])
        incidence = np.zeros((len(sets), 4096), np.float32)
        incidence[member[i:j], code[i:j] - lo] = 1
        both += incidence @ incidence.T
    i, j = np.nonzero(np.triu(within(both, sizes, own, side, similarity), 1))
    # classes are numbered, so that (member, class) is one number
    named = np.unique(own, return_inverse=True)[1]
    first = np.unique(i * len(sets) + named[j], return_index=True)[1] if len(i) else np.zeros(0, np.int64)
    return i[first], j[first]


def within(both: np.ndarray, sizes: np.ndarray, own: np.ndarray, side: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of different classes (and sides, if there are two) reach the similarity with that much in common."""
    close = both >= similarity * (sizes[:, None] + sizes - both) - 1e-6
    close &= own[:, None] != own
    if len(set(side.tolist())) > 1:
        close &= side[:, None] != side
    return close


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows: bucket, node, own (class), n (members). A bucket of n members is cut into n / BLOCK blocks, and each two blocks have a meeting."""
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = rows.withColumn("block", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    key = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    return cut.select("bucket", "node", "own", F.when(F.col("block") == F.col("other"), 0).otherwise(F.col("block")).alias("side"), key.alias("meeting"))


def compared(rows: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among the members of each bucket."""
    return _meet(in_blocks(rows), held, similarity)


def compared_sides(near: DataFrame, ring: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the two sides of each bucket, block by block; either: bucket, node, own."""

    def sized(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    both = sized(near, "b0").join(sized(ring, "b1"), "bucket")
    sides = []
    for side, rows in enumerate((near, ring)):
        own, other = f"b{side}", f"b{1 - side}"
        cut = rows.join(both, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        key = F.xxhash64("bucket", *(("block", "other") if side == 0 else ("other", "block")))
        sides.append(cut.select("bucket", "node", "own", F.lit(side).alias("side"), key.alias("meeting")))
    return _meet(sides[0].unionByName(sides[1]), held, similarity)


def met(rows: DataFrame, judge: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """rows: meeting, ...; ``judge`` gets the members of one meeting (without its number) at a time."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        meeting, members, out = None, [], []

        def batch_of() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
            out.clear()
            return done

        for batch in batches:
            for at, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != meeting:
                    if len(members) > 1:
                        out.extend(judge(members))
                    meeting, members = at, []
                members.append(member)
            if out:
                yield batch_of()
        if len(members) > 1:
            out.extend(judge(members))
        if out:
            yield batch_of()

    parts = shuffle_width(rows.sparkSession)
    return rows.repartition(parts, "meeting").sortWithinPartitions("meeting").mapInArrow(run, schema)


def _meet(rows: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """rows: bucket, meeting, node, own, side."""

    def judge(members: list) -> Iterable[tuple]:
        node, own, side, sets = zip(*members, strict=True)
        node = np.array(node)
        i, j = linked([np.frombuffer(x, np.uint32) for x in sets], np.array(own), np.array(side), similarity)
        return zip(node[i].tolist(), node[j].tolist(), strict=True)

    return met(rows.join(held, "node").select("meeting", "node", "own", "side", "shingles"), judge, "a long, b long")


def promising(rows: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """Members (bucket, node, own) of each bucket that may link to another class; rows: bucket, node, own, n; counts: node, counts (shingles by
    hash class). Two sets have no more in common than the sum of the lesser counts."""

    def judge(members: list) -> Iterable[tuple]:
        bucket, node, own, side, counted = zip(*members, strict=True)
        parts = np.array([np.frombuffer(x, np.uint16) for x in counted]).astype(np.int32)
        both = np.zeros((len(parts), len(parts)), np.int32)
        for k in range(parts.shape[1]):
            both += np.minimum(parts[:, k, None], parts[:, k])
        some = within(both, parts.sum(1), np.array(own), np.array(side), similarity).any(1)
        return [(b, n, o) for b, n, o, ok in zip(bucket, node, own, some, strict=True) if ok]

    cut = in_blocks(rows).join(counts, "node").select("meeting", "bucket", "node", "own", "side", "counts")
    return met(cut, judge, "bucket long, node long, own long").distinct()


def several(rows: DataFrame) -> DataFrame:
    """Buckets (bucket, node, own) with members of several classes, one of those that have the same members; n: members."""
    g = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("lo"), F.max("own").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", "node"), F.lit(1 << 32))).alias("s"))
    one = g.where("lo != hi").groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket"))
    return rows.join(one.select("bucket", "n"), "bucket")


def prefix_links(rest: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """All links (a, b) needed among rest (node, own: its class so far), by a prefix join."""
    import pyarrow as pa

    def tokens(batches: Iterator) -> Iterator:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            node, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for lo, hi in chunks(np.r_[0, np.cumsum([len(x) for x in sets])], 200_000):
                size = [len(x) for x in sets[lo:hi]]
                rows = [np.repeat(node[lo:hi], size), np.repeat(own[lo:hi], size), np.concatenate(sets[lo:hi]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["node", "own", "token"])

    def counted(batches: Iterator) -> Iterator:
        for batch in batches:
            sets = [np.bincount(np.frombuffer(x.as_buffer(), np.uint32) % PARTS, minlength=PARTS) for x in batch.column(1)]
            # a count beyond 16 bits stays the greatest, so that it bounds nothing
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.minimum(c, 65535).astype(np.uint16).tobytes() for c in sets], pa.binary())], names=["node", "counts"])

    own = durable(rest.join(held, "node").select("node", "own", "shingles"), "rest")
    counts = durable(own.select("node", "shingles").mapInArrow(counted, "node long, counts binary"), "counts")
    rows = durable(own.mapInArrow(tokens, "node long, own long, token long"), "tokens")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = rows.join(often, "token", "left").groupBy("node", "own").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("all"))
    size = F.size("all")
    prefix = F.slice("all", 1, (size - F.ceil(size * similarity - 1e-9) + 1).cast("int"))
    groups = ranked.select("node", "own", F.explode(prefix).alias("t")).where("t.n > 1").select(F.col("t.token").alias("bucket"), "node", "own")
    some = durable(promising(several(durable(groups, "prefixes")), counts, similarity), "promising")
    return compared(several(some), own.select("node", "shingles"), similarity)


def near_links(nodes: DataFrame, shingles_of: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """Links (a, b) that connect all nodes of a class; nodes: node, bands; shingles_of: node, shingles. None without candidates."""
    far = 1 - similarity + 1e-12
    with Scratch(nodes.sparkSession):
        rows = nodes.select("node", F.explode("bands").alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = durable(rows.join(sizes, "bucket"), "buckets")
        if shared.isEmpty():
            return None
        score = durable(shared.groupBy("node").agg(F.sum("n").alias("score")), "scores")
        active = shared.select("bucket", "node").join(score, "node")
        held = durable(shingles_of.join(score.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")
        pivot = active.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot"))
        tested = durable(active.select("bucket", "node").join(pivot, "bucket").where("node != pivot"), "tested")
        found = verified(tested.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), held)
        links = found.where(F.col("d") <= far).select("a", "b")
        classes = components(links)
        by_node, by_pivot = classes.withColumnRenamed("component", "own"), classes.select(F.col("node").alias("pivot"), F.col("component").alias("its"))
        judged = tested.join(found.withColumnsRenamed({"a": "node", "b": "pivot"}), ["node", "pivot"])
        judged = judged.join(by_node, "node", "left").join(by_pivot, "pivot", "left").withColumn("own", F.coalesce("own", "node")).withColumn("its", F.coalesce("its", "pivot"))
        judged = durable(judged.select("bucket", "node", "d", "own", "its"), "judged")
        # between one and two radii of the pivot and not of its class: against those within one
        ring = judged.where((F.col("d") > far) & (F.col("d") <= 2 * far) & (F.col("own") != F.col("its"))).select("bucket", "node", "own")
        near = judged.where((F.col("d") > 0) & (F.col("d") <= far)).select("bucket", "node", "own")
        if not ring.isEmpty():
            links = links.unionByName(compared_sides(near, ring, held, similarity))
        # those that did not link to the pivot of a bucket that they share with another class of the kind
        rest = durable(several(judged.where(F.col("d") > far).select("bucket", "node", "own")).select("node", "own").distinct(), "unlinked")
        if not rest.isEmpty():
            links = links.unionByName(prefix_links(rest, held, similarity))
        return durable(links.distinct(), "links", outer=True)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, mark (hash of the text), class_id (the least doc_id of its class), has_words, leads (the class's first row, and rows equal to it)."""
    table = durable(sketches(docs), "sketches")
    ids = table.select("doc_id", "mark", "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    nodes = durable(table.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), first, F.first("bands").alias("bands")), "nodes")
    links = near_links(nodes.select("node", "bands"), table.select("node", "shingles"), similarity)
    classes = nodes.select("node", F.col("least").alias("class_id"), "first")
    if links is not None:
        named = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        top = named.groupBy("component").agg(F.min("least").alias("class_id"), F.min("first").alias("first"))
        classes = named.select("node", "component").join(top, "component").select("node", "class_id", "first")
    named, without = ids.join(classes, "node", "left"), F.col("node").isNull()
    leads = without | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    return named.select("doc_id", "mark", F.when(without, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (~without).alias("has_words"), leads.alias("leads"))
