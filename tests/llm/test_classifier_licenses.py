"""Quality classifier (held-out accuracy) and licence scan."""

import hashlib
import math
import random
import re
import statistics
import zlib

import zstandard

from pyspark.sql import functions as F

from tidewatch.llm import licenses, quality_classifier


def test_classifier(spark, documents):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(["the", "river", "house", "over", "green", "walked", "slowly", "and", "then"], k=120)) + "."
    bad = lambda: " ".join(rng.choices(["$$$", "###", "BUY!!", "CLICK%%%", "&&&", "WIN***"], k=120))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    more = rows + [(1000, None), (1001, ""), (None, good()), rows[0]]
    out = quality_classifier.score(documents(more), labels).collect()
    assert len(out) == len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    by = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert 50 < len(held) < 110 and all((r.score > 0.5) == (r.doc_id % 3 > 0) for r in held)
    assert by[1000].score == by[1001].score and by[None].held_out is False
    none = quality_classifier.score(documents(rows), labels.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.score(documents([]), labels).count() == 0


def test_scores_against_plain_python(spark, documents):
    """The whole score again: training in plain Python from the labelled rows, then blocks, medians and the logistic curve one by one."""
    rng = random.Random(8)
    words = {1: "the river house over green walked slowly and then".split(), 0: "$$$ ### BUY CLICK WIN now free cheap".split()}
    rows = [(i, " ".join(rng.choices(words[i % 2], k=rng.randrange(1, 200)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "ж" * 700), (303, "the river house " * 20_000), (304, "x" * 129)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    (good, bad), intercept, slope = quality_classifier.fit(documents(rows), labels)
    out = {r.doc_id: r for r in quality_classifier.score(documents(rows), labels).collect()}
    sizes = {}
    for name, raw in (("good", good), ("bad", bad)):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[name] = lambda block, packer=packer: len(packer.compress(block))
    for doc, text in rows:
        raw = (text or "").encode()
        blocks = [raw[i : i + 128] for i in range(0, len(raw), 128)]
        if len(blocks) > 1 and len(blocks[-1]) < 32:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        parts = [(sizes["bad"](b) - sizes["good"](b)) / (sizes["bad"](b) + sizes["good"](b)) for b in blocks]
        x = statistics.median(parts) if parts else 0.0
        want = 1 / (1 + math.exp(-max(-30, min(30, intercept + slope * x))))
        assert abs(out[doc].score - want) < 1e-9
        assert out[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_every_block_of_a_sampled_text_trains(spark, documents, monkeypatch):
    """Good and bad texts differ only past their first 20,000 bytes."""
    rng = random.Random(9)
    common = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)) for _ in range(24)]
    tail = {0: "zz qq vv ww " * 2500, 1: "the river house over green " * 1200}
    rows = [(i, common[i] + tail[i % 2]) for i in range(24)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    (good, bad), _, _ = quality_classifier.fit(documents(rows), labels)
    assert b"river house" in good and b"river house" not in bad and b"zz qq" in bad


def test_labels_of_held_out_rows_are_not_read(spark, documents):
    rows = [(i, f"good words here {i} " * 20 if i % 2 else f"### $$$ {i} " * 20) for i in range(200)]
    one = [(i, i % 2, 0) for i in range(200)]
    held = {r.doc_id for r in documents(rows).select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("h")).where("h").collect()}
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in one]
    a, b = (sorted((r.doc_id, r.score) for r in quality_classifier.score(documents(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (one, flipped))
    assert a == b


def normal(text):
    """The normalisation again, on the text as a whole."""
    t = re.sub(r"(?mi)^[ \t>*#/;-]*(?:copyright \(c\)|©)[^\n]*$", " ", text).lower()
    t = re.sub(r"[\W_]+", " ", t)
    for a, b in [*licenses.SPELLINGS, ("copyright holder", "copyright owner")]:
        t = t.replace(a, b)
    bare = re.sub(r" +", " ", t.replace("all rights reserved", " ")).strip()
    return bare or t.strip()


def test_scan(spark, documents):
    odd = licenses.MIT.upper().replace("SUBLICENSE", "sublicence").replace(",", " ;").replace("\n\n", "\n//\n")
    rows = [
        (1, f"Copyright (c) 2020 A. Person\n\n{licenses.MIT}"), (2, odd), (3, f"intro words\n\n{licenses.ISC}\n\nmore words"), (4, "text\nReleased  under the MIT-Licence!\nx\nreleased under the mit license"),
        (5, None), (6, ""), (7, "no licence at all"), (8, "All Rights Reserved."), (9, "some words\nall rights reserved\nLicensed under CC BY-NC 4.0."), (None, "Licensed under CC BY 4.0"), (4, "Released under the MIT License."),
        (10, licenses.MIT + " and more"), (11, "© 2020 x\n© 2021 y"), (12, "Released under the MIT License. " * 2),
    ]
    got = sorted(map(tuple, licenses.scan(documents(rows)).collect()), key=str)
    digest = {}
    for name, text in licenses.KNOWN:
        digest.setdefault(hashlib.sha256(normal(text).encode()).hexdigest(), set()).add(name)
    want = []
    for doc, text in rows:
        text = text or ""
        blocks, lines = re.split(r"\n\s*\n", text), text.split("\n")
        units = [("text", text)] + [("paragraph", p) for p in blocks if len(blocks) > 1] + [("line", s) for s in lines if len(lines) > 1]
        found = {}
        for scope, unit in units:
            if (n := normal(unit)) and (name := digest.get(hashlib.sha256(n.encode()).hexdigest())):
                found.setdefault(" OR ".join(sorted(name)), {}).setdefault(scope, []).append(unit)
        for name, by in found.items():
            if " OR " in name and set(name.split(" OR ")) & set(found):
                continue
            scope = min(by, key=["text", "paragraph", "line"].index)
            want.append((doc, name, scope, len(by[scope])))
    assert got == sorted(want, key=str) and {g[0] for g in got} == {1, 2, 3, 4, 8, 9, 10, None}
    assert licenses.scan(documents([])).count() == 0
    own = spark.createDataFrame([("Own-1.0", "no license at all")], "license string, text string")
    assert [tuple(r) for r in licenses.scan(documents(rows), own).collect()] == [(7, "Own-1.0", "text", 1)]


def test_wrapped_and_full_texts(spark, documents):
    """A licence is found however its lines are wrapped: no wrapped line is taken for a notice."""
    import textwrap

    wrap = lambda t, w: "\n\n".join(textwrap.fill(" ".join(p.split()), w) for p in re.split(r"\n\s*\n", t))
    full = [("MIT", licenses.MIT), ("ISC", licenses.ISC), ("BSD-2-Clause", licenses.BSD_2), ("BSD-3-Clause", licenses.BSD_3), ("Unlicense", licenses.UNLICENSE), ("Apache-2.0", licenses.APACHE), ("MIT-0", licenses.MIT_0), ("0BSD", licenses.ZERO_BSD), ("Zlib", licenses.ZLIB)]
    cases = [(name, notice + wrap(text, w)) for name, text in full for w in range(44, 100) for notice in ("", "Copyright 2020 A. Person\nCopyright (c) B\n\n", "Copyright Acme Inc.\n(c) Acme\n\n")]
    assert any(re.search("(?m)^copyright notice and this permission", t) for _, t in cases) and any(re.search("(?m)^COPYRIGHT HOLDERS", t) for _, t in cases)
    got = {(r.doc_id, r.license, r.scope) for r in licenses.scan(documents([(k, t) for k, (_, t) in enumerate(cases)])).collect()}
    missed = {(cases[k][0], k) for k in range(len(cases))} - {(g[1], g[0]) for g in got if g[2] == "text"}
    assert not missed
    assert {g for g in got if g[2] == "text"} == {(k, name, "text") for k, (name, _) in enumerate(cases)} and not any(" OR " in g[1] for g in got)
    part = documents([(1, f"some words\n\n{licenses.BSD_2}"), (2, f"some words\n\n{licenses.BSD_3}")])
    assert {(r.doc_id, r.license) for r in licenses.scan(part).collect()} == {(1, "BSD-2-Clause OR BSD-3-Clause"), (2, "BSD-3-Clause")}


def test_long_and_related_licences(spark, documents):
    """Texts as published, inside very long documents too; licences that share a paragraph keep their own names; ties give sorted names."""
    rows = [(k, licenses.LONG[n]) for k, n in enumerate(sorted(licenses.LONG))]
    paragraph = licenses.MIT.split("\n\n")[2]
    rows += [(20, "words\n\n" + paragraph), (21, licenses.MIT_0), (22, "x\n\n" + licenses.MIT), (23, "words here\n" * 200_000 + "\n" + licenses.ISC + "\n\nmore")]
    got = {}
    for r in licenses.scan(documents(rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.scope))
    for k, name in enumerate(sorted(licenses.LONG)):
        assert (name, "text") in got[k] and not any(s == "text" and n != name for n, s in got[k])
    assert got[20] == {("MIT OR MIT-0", "paragraph")} and got[21] == {("MIT-0", "text")} and got[22] == {("MIT", "paragraph")} and got[23] == {("ISC", "paragraph")}
    tie = spark.createDataFrame([("B-1", "same words"), ("A-1", "Same  words.")], "license string, text string")
    assert [r.license for r in licenses.scan(documents([(1, "SAME WORDS"), (1, "same, words")]), tie).collect()] == ["A-1 OR B-1"] * 2
