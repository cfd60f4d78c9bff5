"""Packing, sharding and quality rules against brute force on small tables."""

import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import packing, quality_rules, sharding

ODD = [None, "", " \n\t", "a b c", "It's we'll DON'T 'S x''s 12½ª² naïve STRASSE İstanbul ŉ ſ", "ΟΔΟΣ Σ 你好 <|endoftext|> é", "x y\u0085z\x1cq", "!!'s ?'T —'d ­"]


def test_word_ids_equal_tokenizer():
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(packing.vocabulary()), packing.WordIds(packing.vocabulary())
    rng = random.Random(5)
    letters = "\xa0aAbB'sStTdDéÉßñÑüÜ 12³½.,!?-\n\t |#$%&*<>()ıŁłŒŸ"
    texts = [x or "" for x in ODD] + ["".join(rng.choices(letters, k=rng.randrange(1, 120))) for _ in range(800)]
    for t in texts:
        assert np.frombuffer(mine(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    together = packing.WordIds(packing.vocabulary())
    together.KEPT = 20  # what is kept starts anew all the time
    for k in range(0, len(texts), 7):
        assert together.many(texts[k : k + 7]) == [mine(t) for t in texts[k : k + 7]]
    assert together.many([]) == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(30)}
    rows = packing.plan(counts, 64)
    seen: dict[int, list] = {}
    for length, n in counts.items():
        own = rows[rows[:, 0] == length]
        for rank in range(n):
            _, start, first, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            seen.setdefault(first + (rank - start) // each, []).append((offset + (rank - start) % each * length, length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    rooms = []  # best-fit decreasing, one piece at a time
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((64 if fit is None else fit) - length)
    assert len(seen) == len(rooms)


def test_pack(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "word " * 9000), (51, "word " * 4095), (51, "word " * 4095), (None, "x")]
    out = packing.pack(documents(rows), with_ids=True).collect()
    by = {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 4096
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert [(r.piece, r.start, r.length) for r in sorted(out, key=lambda r: r.piece) if r.doc_id == 50] == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert len(out) == len(rows) + 2
    assert packing.pack(documents([])).count() == 0
    total = packing.sequences(packing.pack(documents(rows), with_ids=True)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in total)


def test_shards(spark, documents):
    rows = [(i, "ab" * (i % 7)) for i in range(3000)] + [(7, None), (7, None), (None, "é")]
    grown = sharding.even_tree(25)
    out = sharding.place(documents(rows), sharding.even_tree(24), grown).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 60 < sum(r.grown_shard == 24 for r in out) < 190
    assert {r.text_crc32 for r in out if r.doc_id is None} == {zlib.crc32("é".encode())}
    assert sharding.place(documents([]), sharding.even_tree(24), grown).count() == 0
    # a weight that changes in one region moves rows only into or out of that region's shard
    heavy = sharding.even_tree(24)
    heavy["region1"]["rack2"][9] = 3.0
    moved = [r for r in sharding.place(documents(rows), sharding.even_tree(24), heavy).collect() if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 9 for r in moved)


def brute(text):
    words = text.encode().split()
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)})


def test_rules(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(0, 90))), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, "bad", "spam") for i in range(40)] + [(200, " ".join(f"w{k}" for k in range(50)), "spam"), (201, None, None), (201, None, None), (202, " \n#\n#\n é|<é \x0b ", None)]
    rows += [(300 + i, " ".join(f"w{k + i}" for k in range(50)), "fine") for i in range(30)]
    out = quality_rules.judge(documents(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id < 60:
            text = rows[r.doc_id][1]
            assert r.n_repeat_words == brute(text) and r.n_words == len(text.split())
        assert r.kept == (not r.base_failed and not r.host_rejected)
        assert r.host_rejected == (r.host == "spam" or r.host is None or r.host_rejected)
    got = {r.doc_id: r for r in out}
    assert got[200].host_rejected and not got[200].base_failed and got[300].kept
    assert (got[202].n_words, got[202].word_chars, got[202].n_symbols, got[202].n_dup_lines) == (3, 6, 4, 1)
    assert quality_rules.judge(documents([])).count() == 0


def test_places_against_plain_python(spark, documents):
    """Every draw again, one hash at a time; levels descended one by one on a tree of uneven weights and an emptied rack."""
    import math

    import xxhash

    tree = {"a": {"r1": {0: 1.0, 1: 2.5}, "r2": {2: 0.5}}, "b": {"r3": {3: 4.0, 4: 0.0}, "r4": {5: 0.0}}, "c": {"r5": {6: 1.0, 7: 1.0, 8: 1.0}}}
    rows = [(i * 7919 - 3000, "x" * (i % 50) + "ж" * (i % 3)) for i in range(1500)] + [(1, None), (1, "other"), (None, "y" * 300_000), (1, None)]

    def draw(doc, shard):
        seed = 42 if doc is None else xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(b"draw", xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed))
        return -math.log((h % (1 << 52) + 0.5) / (1 << 52))

    def descend(doc):
        at = lambda rack: min((draw(doc, s) / w, s) for s, w in rack.items() if w > 0)
        live = {g: {r: x for r, x in racks.items() if any(x.values())} for g, racks in tree.items()}
        region = min((min(at(x) for x in racks.values())[0], g) for g, racks in live.items() if racks)[1]
        rack = min((at(x)[0], r) for r, x in live[region].items())[1]
        return region, rack, at(live[region][rack])[1]

    out = sharding.place(documents(rows), tree).collect()
    assert len(out) == len(rows)
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), *descend(d)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.region, r.rack, r.shard) for r in out), key=str) == want
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.shard for r in out} == {0, 1, 2, 3, 6, 7, 8}


@pytest.mark.parametrize("name", ["node", "row", "found", "new", "bucket", "own", "mark", "carry0", "host", "digest"])
def test_clashing_names(spark, documents, name):
    """A column of documents that is called like one of an operator's own."""
    from tidewatch.llm import decontamination, licenses, line_dedup, minhash, pii, quality_classifier, substring_dedup

    docs = documents([(1, "the same words as in the other text here"), (2, "the same words as in the other text here"), (3, None)]).withColumnRenamed("length", name)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(9, "the same words as in the other text")], "item_id long, text string")
    assert {r.class_id for r in minhash.near_duplicates(docs).collect()} == {1, 3}
    assert quality_rules.keep(docs).columns == docs.columns
    for out in (packing.pack(docs), sharding.place(docs, sharding.even_tree(4)), quality_rules.judge(docs), quality_classifier.score(docs, labels), substring_dedup.remove_repeated(docs), line_dedup.dedup_lines(docs, carry=[name]), pii.pseudonymise(docs, "key", [name])):
        assert out.count() == 3
    assert licenses.scan(docs).count() == 0 and decontamination.leaks(docs, bench).count() == 2
