"""Near duplicates against brute-force classes; the sketch against exact probability Jaccard."""

import random

import numpy as np

from tidewatch.llm import minhash


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) or (rows[i][0] == rows[j][0] and not sets[i] and not sets[j]):
                parent[root(i)] = root(j)
    return {frozenset(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows))}


def test_classes(spark, documents):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for g in range(14):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.choice([1, 2, 3, 45])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy).title()))
        chain = list(base)  # each close to the one before only
        for _ in range(5 if g % 3 == 0 else 0):
            chain = list(chain)
            for _ in range(max(1, len(base) // 60)):
                chain[rng.randrange(len(chain))] = word()
            rows.append((len(rows), " ".join(chain)))
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "Hi"), (1004, "hi"), (1005, "a b c d"), (1006, "A\tb c d"), (1007, "a b c d e"), rows[0]]
    got = minhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(x) for x in by.values()} == brute(rows)
    assert all(k == min(v) for k, v in by.items())
    assert minhash.near_duplicates(documents([])).count() == 0
    assert [(r.doc_id, r.class_id) for r in minhash.near_duplicates(documents([(None, "x y"), (None, None)])).collect()] == [(None, None)] * 2


def test_unlinked_members_of_large_buckets(spark, documents, monkeypatch):
    rng = random.Random(6)
    common = " ".join(rng.choices("abcdefgh", k=30))
    rows = [(i, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([2, 8, 12])))) for i in range(300)]
    rows += [(1000 + i, t + " end") for i, t in rows[:40]]
    want = brute(rows)
    for block in (128, 8):
        monkeypatch.setattr(minhash, "BLOCK", block)
        by = {}
        for r in minhash.near_duplicates(documents(rows)).collect():
            by.setdefault(r.class_id, set()).add(r.doc_id)
        assert {frozenset(x) for x in by.values()} == want


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    element = rng.integers(1, 1 << 63, 90).astype(np.uint64)
    a, b = np.arange(0, 60), np.arange(20, 90)
    wa, wb = rng.choice([1.0, 2.0, 3.5], 60), rng.choice([1.0, 2.0], 70)
    full = minhash.prob_minhash(np.repeat([0, 1], [60, 70]), element[np.r_[a, b]], np.r_[wa, wb], 2, 20_000)
    x, y = np.zeros(90), np.zeros(90)
    x[a], y[b] = wa, wb
    exact = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(90)) for i in range(20, 60))
    assert abs((full[0] == full[1]).mean() - exact) < 0.012
    assert set(full[0]) == set(element[a])


def test_repeats_do_not_hide_a_pair(spark, documents):
    """Pairs of set Jaccard 0.82 whose own shingles occur 200 times each."""
    rows = []
    for k in range(20):
        shared = [f"s{k}x{i}" for i in range(230)]
        rows += [(2 * k + side, " ".join(shared + [f"o{k}x{side}x{i}" for i in range(20)] * 200)) for side in (0, 1)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
