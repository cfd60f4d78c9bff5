"""The pipeline against a brute-force version on a small table."""

import random

import corpus_pipeline
from tests.llm import test_leaks_pii, test_minhash, test_repeats, test_simple
from tidewatch.llm import packing


def test_pipeline(spark, documents, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 7)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    shared = [line() for _ in range(6)]
    items = [(i, line(25)) for i in range(8)]
    rows = []
    for d in range(80):
        body = [line() for _ in range(rng.randrange(2, 8))]
        if d % 4 == 0:
            body[1:1] = shared[: rng.choice([2, 3, 5])]
        if d % 9 == 0:
            body.append(rng.choice(items)[1])
        if d % 10 == 3:
            body = ["short"]
        rows.append((d, "\n".join(body), f"s{d % 3}"))
    rows += [(100 + k, rows[k][1].replace("\n", " ").replace(" ", " zz ", 1), "s1") for k in range(20)]
    rows += [(200, None, "s1"), (201, line(200), "s2"), (202, rows[5][1], None), rows[5]]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in rows if len((r[1] or "").split()) >= 20 and 100 * test_simple.brute(r[1]) <= 30 * len(r[1].split())]
    kept = [(d, t) for d, t, _ in test_repeats.brute_lines([r[:2] for r in kept], 3) if t.strip()]
    classes = test_minhash.brute(kept)
    kept = sorted({(d, t) for d, t in kept if any(min(c) == d for c in classes)})
    leaked = {d for d, _ in test_leaks_pii.brute(kept, items)}
    kept = [(d, t) for d, t in kept if d not in leaked]
    ids = packing.WordIds(packing.vocabulary())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((d, len(ids(t)) // 4 + 1) for d, t in kept)
    assert 30 < len(kept) < 90 and leaked
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rows_that_share_an_id_are_judged_each(spark, documents, tmp_path):
    rng = random.Random(3)
    line = lambda n=30: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    good, other, alone, nameless = line(), line(), line(), line(400)
    rows = [(5, good), (5, "short"), (7, other), (7, other + " end"), (7, alone), (7, alone), (None, nameless), (8, None), (9, " \n")]
    docs = documents(rows).select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for r in rows if len((r[1] or "").split()) >= 20], key=str)
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    texts = sorted((r.text or "") for r in left)
    assert len([t for t in texts if t.startswith(other)]) == 1 and texts.count(alone) == 1 and good in texts and nameless in texts
    near = documents([(None, nameless), (3, nameless + " end"), (4, alone)]).select(*corpus_pipeline.COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, near, str(tmp_path)).collect()) == [3, 4]
    empty = documents([]).select(*corpus_pipeline.COLUMNS)
    assert [f(spark, empty, str(tmp_path)).count() for f in (corpus_pipeline.quality, corpus_pipeline.near_duplicates)] == [0, 0]
