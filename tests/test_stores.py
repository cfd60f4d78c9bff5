"""Stores, ledgers, readers and the desk's operators on small cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import desk, stores
from tidewatch.operators.panel import screen
from tidewatch.sources import readers

DAY = datetime.date(2021, 3, 1)


def on(k):
    return DAY + datetime.timedelta(k)


def test_versions_and_guard(spark, tmp_path):
    store = f"{tmp_path}/counts"
    rows = lambda *r: spark.createDataFrame(r, "day date, entity string, n long")
    assert stores.load(spark, store) is None
    stores.replace(rows((on(0), "a", 1)), store)
    first = stores.load(spark, store)
    stores.replace(first.withColumn("n", F.col("n") + 1), store)  # read and written at once
    assert first.collect()[0].n == 1 and stores.load(spark, store).collect()[0].n == 2
    with pytest.raises(ValueError, match="author"):
        stores.replace(rows((on(0), "a", 1)).withColumn("Author", F.lit("x")), store)
    stores.replace_groups(rows((on(0), "a", 9), (on(1), "b", 5)), store, ["day", "entity"])
    assert {tuple(r) for r in stores.load(spark, store).collect()} == {(on(0), "a", 9), (on(1), "b", 5)}
    broken = rows((on(0), "a", 1)).withColumn("n", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        stores.replace(broken, store)
    assert stores.load(spark, store).count() == 2  # the pointer still names the version before
    assert len([n for n, *_ in stores.Files(spark, store).listed(store) if n.startswith("v")]) <= 4


def test_append_snapshot_and_gap(spark, tmp_path):
    ids = lambda *r: spark.createDataFrame([(i,) for i in r], "id long")
    store = f"{tmp_path}/ids"
    assert [stores.append_new(ids(*r), store, "id") for r in ((1, 2, 2), (2, 3), (3,))] == [2, 1, 0]
    assert stores.snapshot(ids(1), f"{tmp_path}/snap", "2021-03-01") and not stores.snapshot(ids(2), f"{tmp_path}/snap", "2021-03-01")
    stores.guard_gap(on(0), on(90))
    for k in (91, -15):
        with pytest.raises(ValueError):
            stores.guard_gap(on(0), on(k))
    assert [r.day for r in stores.since_start(spark.createDataFrame([(on(k),) for k in range(3)], "day date"), "2021-03-02").orderBy("day").collect()] == [on(1), on(2)]


def test_ledgers(spark, tmp_path):
    folder, ledger = f"{tmp_path}/in", f"{tmp_path}/ledger.json"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("{}\n")
    assert stores.new_files(spark, folder, ledger, ".jsonl") == ["a.jsonl"]
    stores.mark_files(spark, folder, ledger, ["a.jsonl"])
    assert stores.new_files(spark, folder, ledger) == []
    (tmp_path / "in" / "a.jsonl").write_text("{}\n{}\n")  # grown
    (tmp_path / "in" / "b.jsonl").write_text("{}\n")
    assert stores.new_files(spark, folder, ledger) == ["a.jsonl", "b.jsonl"]
    marks = f"{tmp_path}/marks.json"
    assert stores.advance(spark, marks, "s", 500_000, complete=False) == 0 and stores.high_water(spark, marks) == {}
    assert stores.advance(spark, marks, "s", 500_000, complete=True) == 500_000 - 86_400
    assert stores.advance(spark, marks, "s", 400_000, complete=True) == 500_000 - 86_400
    assert json.loads((tmp_path / "marks.json").read_text()) == {"s": 500_000}


def test_readers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"id": 1}\n{"id": \nnot json\n[1]\n\n{"id": 2, "t": "\xff"}\n')
    (tmp_path / "y.csv").write_text('id,t\n1,"a\nb"\n2,"say ""so"""\n')
    (tmp_path / "z.txt").write_text("no input")
    assert [p.rsplit("/", 1)[1] for p in readers.find_inputs(spark, str(tmp_path))] == ["x.jsonl", "y.csv"]
    assert readers.find_inputs(spark, f"{tmp_path}/x.jsonl") == [f"{tmp_path}/x.jsonl"] and readers.find_inputs(spark, f"{tmp_path}/none") == []
    got = [json.loads(r.raw)["id"] for r in readers.read_lines(spark, [f"{tmp_path}/x.jsonl"]).collect()]
    assert got == [1, 2] and readers.read_lines(spark, []).count() == 0
    assert sorted(tuple(r) for r in readers.read_csv(spark, [f"{tmp_path}/y.csv"]).collect()) == [("1", "a\nb"), ("2", 'say "so"')]
    with pytest.raises(ValueError):
        readers.tweets(spark.range(1), "other")
    assert readers.cashtag_queries(["B", "A", "C"], "2021-01-01", 2) == ["($A OR $B) since:2021-01-01", "($C) since:2021-01-01"]
    assert readers.price_chunks(["c", "a", "b", "a"], 2) == [["a", "b"], ["c"]]
    assert readers.fetch_plan({"K": "1", "L": " "}, {"x": ["K"], "y": ["K", "L"]}) == {"x": True, "y": False}
    assert [readers.lookback_bucket(k) for k in (1, 2, 8, 32)] == ["day", "week", "month", "year"]
    t = spark.createDataFrame([("Ann Lee on X: hi",), ("Bo (@bo) / post",), ("none",)], "t string").select(readers.embed_author(F.col("t")).alias("a"))
    assert [r.a for r in t.collect()] == ["Ann Lee", "Bo", None]
    e = spark.createDataFrame([("1700000000",), ("2023-11-14T22:13:20",), ("soon",), (None,)], "w string").select(readers.epoch_of(F.col("w")).alias("e"))
    assert [r.e for r in e.collect()] == [1700000000, 1700000000, None, None]


def test_states_ranks_and_panel(spark):
    a = spark.createDataFrame([("x", on(0), "start"), ("x", on(0), "end"), ("y", on(0), "start"), ("y", on(5), "end"), ("z", on(-30), "start"), ("w", on(6), "start")], "entity string, day date, kind string")
    assert {r.entity: r.state for r in desk.states(a).collect()} == {"x": "STARTING", "y": "ENDING", "w": "STARTING"}
    z = spark.createDataFrame([("a", on(k), -3.0) for k in range(40)] + [("b", on(k), 4.0 if k > 38 else 0.0) for k in range(40)] + [("c", on(39), 9.0)], "entity string, day date, z double")
    got = desk.rank_by_ewm(z, 10).orderBy("rank").collect()
    assert [(r.entity, r.rank) for r in got] == [("a", 1), ("b", 2)] and got[0].z == pytest.approx(-3) and got[1].latest == 4
    c = spark.createDataFrame([("p", 500), ("q", 120), ("r", 130), ("s", 99), ("t", 400)], "candidate string, referrers long")
    rates = spark.createDataFrame([("p", 0.4), ("q", 0.2), ("r", 0.19), ("s", 0.9)], "community string, rate double")
    assert [r.candidate for r in screen(c, rates, ["p"]).collect()] == ["q"]
    assert screen(c, rates, ["none"]).count() == 0


def test_ewm_conviction_equals_its_query(spark):
    from tidewatch.plans import registry

    small = "/root/testdata/sf0.001"
    a = {(r.day, r.entity): r.z for r in registry.QUERIES["conviction_ewm"](spark, small).collect()}
    b = registry.QUERIES["conviction_set_ewm"](spark, small).collect()
    assert len(a) == len(b) and all((r.conviction_z is None) == (a[r.day, r.entity] is None) and (r.conviction_z is None or abs(r.conviction_z - a[r.day, r.entity]) < 6e-4) for r in b)


def test_formats_and_appended_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b\nc")], "id long, t string")
    for name, back in (("x.parquet", spark.read.parquet), ("x.jsonl.gz", spark.read.json)):
        stores.write_as(rows, f"{tmp_path}/{name}")
        assert sorted(tuple(r) for r in back(f"{tmp_path}/{name}").collect()) == [(1, "a"), (2, "b\nc")]
    stores.write_as(rows, f"{tmp_path}/x.csv")
    assert {r.t for r in readers.read_csv(spark, [f"{tmp_path}/x.csv"]).collect()} == {"a", "b\nc"}
    with pytest.raises(ValueError):
        stores.write_as(rows, f"{tmp_path}/x.txt")
    assert [stores.append_lines(r, f"{tmp_path}/lines", "id") for r in (rows, rows, rows.unionByName(spark.createDataFrame([(3, "d"), (3, "d")], "id long, t string")))] == [2, 0, 1]
    counts = spark.createDataFrame([("a ", on(0), 5), ("b", on(0), 3), ("c", on(-90), 9)], "entity string, day date, n long")
    more = spark.createDataFrame([("?",), ("",), ("z",), ("gone",)], "symbol string")
    out = desk.symbols_to_price(counts, [more], 1, excluded=spark.createDataFrame([("GONE",)], "symbol string"))
    assert sorted(r.symbol for r in out.collect()) == ["A", "C", "Z"]
