"""Substring and line removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidewatch.llm import line_dedup, repeats, substring_dedup


def brute_bytes(rows, span):
    """(doc_id, text) -> sorted (doc_id, n_bytes, begins, ends)."""
    least = {}
    raw = [(-(1 << 63) if d is None else d, d, (t or "").encode()) for d, t in rows]
    for k, _, b in raw:
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            least[w] = min(least.get(w, k), k)
    out = []
    for k, d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if least[b[i : i + span]] < k:
                gone[i : i + span] = b"\1" * span
        edges = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(gone), np.uint8), 0]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), edges[::2].tolist(), edges[1::2].tolist(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(30)) for _ in range(rng.randrange(1, 7))]
        rows.append((rng.randrange(1000), rng.choice("\n ").join(parts)[rng.randrange(5) :]))
    rows += [(5000 + i, "The " * 60) for i in range(4)] + [(7, "ab" * 200), (8, "b" + "ab" * 100)]
    rows += [(1, None), (2, ""), (None, passages[0] * 2), (3, passages[0]), rows[0], rows[0], (rows[1][0], rows[2][1]), (rows[1][0], rows[3][1] + "x")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_substrings(spark, documents, seed):
    rows = corpus(seed)
    got = substring_dedup.remove_repeated(documents(rows)).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.begins, r.ends, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    assert mine == brute_bytes(rows, 50)
    assert all(r.n_removed == sum(r.ends) - sum(r.begins) and r.n_spans == len(r.begins) for r in got)


def test_no_texts(spark, documents):
    assert substring_dedup.remove_repeated(documents([])).count() == 0
    assert [tuple(r)[:4] for r in substring_dedup.remove_repeated(documents([(1, None)])).collect()] == [(1, 0, 0, 0)]
    assert line_dedup.dedup_lines(documents([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 12, 25])
def test_gram_hash_and_minimum(n):
    x = np.random.default_rng(n).integers(0, 1 << 63, 200).astype(np.uint64)
    h = repeats.gram_hash(x, n)
    assert len(h) == 200 - n + 1
    again = repeats.gram_hash(np.r_[x[50:90], x[50:90]], n)
    assert (h[50 : 50 + 40 - n + 1] == again[: 40 - n + 1]).all() and (again[40:][: 40 - n + 1] == again[: 40 - n + 1]).all()
    assert (repeats.sliding_min(x, n) == [x[i : i + n].min() for i in range(200 - n + 1)]).all()


def brute_lines(rows, run):
    seen, places = {}, []
    for d, t in rows:
        k = -(1 << 63) if d is None else d
        lines = [s for s in ((x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")) if s]
        places.append((k, lines))
        for i in range(len(lines) - run + 1):
            w = tuple(lines[i : i + run])
            seen[w] = min(seen.get(w, (k, i)), (k, i))
    out = []
    for (d, t), (k, lines) in zip(rows, places, strict=True):
        gone = {i + x for i in range(len(lines) - run + 1) if seen[tuple(lines[i : i + run])] < (k, i) for x in range(run)}
        kept, s, drop = [], 0, False
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\v\f\r"):
                drop = s in gone
                s += 1
            if not drop:
                kept.append(line)
        out.append((d, None if t is None else "\n".join(kept), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_lines(spark, documents, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        lines = [rng.choice(["", " "]) if rng.random() < 0.1 else f"line {min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(0, 14))]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, "same\n" * 20), (None, "line 1\nline 2\nline 3"), (202, "  line 1 \n\nline 2\nline 3"), rows[5], (203, rows[5][1])]
    got = line_dedup.dedup_lines(documents(rows), carry=["source", "length"]).collect()
    assert {(r.source, r.length) for r in got} == {("src0", "x")}
    texts = {(r.doc_id, r.text) for r in got}
    assert texts == {x[:2] for x in brute_lines(rows, 3)}
    assert len(got) == len(rows)


def brute_runs(rows, words=50):
    """Lines in an earlier window of three lines, or of one or two lines with so many words."""
    strip = lambda t: [s for s in (x.strip(" \t\n\v\f\r") for x in (t or "").split("\n")) if s]
    lines = {d: strip(t) for d, t in rows}
    windows = lambda x: [(i, m) for i in range(len(x)) for m in (1, 2, 3) if i + m <= len(x) and (m == 3 or len(" ".join(x[i : i + m]).split()) >= words)]
    seen = {}
    for d, x in lines.items():
        for i, m in windows(x):
            w = tuple(x[i : i + m])
            seen[w] = min(seen.get(w, (d, i)), (d, i))
    out = set()
    for d, x in lines.items():
        gone = {k for i, m in windows(x) if seen[tuple(x[i : i + m])] < (d, i) for k in range(i, i + m)}
        out.add((d, "\n".join(s for k, s in enumerate(x) if k not in gone), len(gone), sum(k - 1 not in gone for k in gone)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_short_runs_of_many_words(spark, documents, seed):
    """One or two long lines between different neighbours are repeats too; short ones are not."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (3, 20, 25, 30, 49, 50, 51, 80)]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {d} {k}" for k in range(rng.randrange(1, 7)))) for d in range(80)]
    rows += [(100, pool[7]), (101, f"before\n{pool[2]}\n{pool[3]}\nafter"), (102, pool[4]), (103, "字" * 60 + "\n猫"), (104, "犬\n" + "字" * 60)]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    mine = {(r.doc_id, r.text, r.n_removed, r.n_runs) for r in got}
    assert {x for x in mine if x[0] < 103} == {x for x in brute_runs(rows) if x[0] < 103}
    assert {x for x in mine if x[0] >= 103} == {(103, rows[-2][1], 0, 0), (104, "犬", 1, 1)}


def test_multikey_quicksort(monkeypatch):
    rng = np.random.default_rng(1)
    for small in (1, 50, 10_000):
        monkeypatch.setattr(repeats, "SMALL", small)
        for n, high in ((0, 5), (1, 5), (700, 3), (700, 1 << 60)):
            words = [rng.integers(0, high, n).astype(np.uint64) for _ in range(3)]
            order = repeats.multikey_order(words)
            assert sorted(order.tolist()) == list(range(n))
            rows = [tuple(w[k] for w in words) for k in order]
            assert rows == sorted(rows)


def test_ranges_cut_by_hash(spark, documents, monkeypatch):
    """Few ranges and many buckets, or one range of all: the result stays."""
    rng = random.Random(11)
    shared = ["".join(rng.choices("abcdefghij ", k=rng.randrange(50, 300))) for _ in range(6)]
    rows = [(i, "".join(rng.choices("klmnopqrst ", k=80)) + rng.choice(shared) + "".join(rng.choices("uvwxyz ", k=40))) for i in range(60)]
    seen = []
    for ranges in (repeats.RANGES, 3, 1):
        monkeypatch.setattr(repeats, "RANGES", ranges)
        seen.append(sorted((r.doc_id, r.n_removed, r.begins) for r in substring_dedup.remove_repeated(documents(rows)).collect()))
    assert seen[0] == seen[1] == seen[2] and sum(n for _, n, _ in seen[0]) > 1000


def test_very_long_texts_and_shared_ids(spark, documents):
    """Texts of megabytes; two texts under one id are told apart."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=300_000))
    passage = " ".join(rng.choices(words, k=60))
    rows = [(1, long), (2, passage), (3, long[1_000_000:1_200_000] + passage), (3, "other words " + passage), (4, long[:500_000] + "\n" + passage)]
    got = sorted((r.doc_id, r.n_bytes, r.begins, r.ends) for r in substring_dedup.remove_repeated(documents(rows)).collect())
    assert [(d, n, b[0], e[-1]) for d, n, b, e in got if b] == [(3, len(rows[3][1]), 12, len(rows[3][1])), (3, len(rows[2][1]), 0, len(rows[2][1])), (4, len(rows[4][1]), 0, len(rows[4][1]))]
    lines = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(40_000))
    tail = "\n".join(lines.split("\n")[20_000:30_000])
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents([(1, lines), (2, "own words\n" + tail + "\nlast words")])).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == 10_000 and out[2].text == "own words\nlast words"
