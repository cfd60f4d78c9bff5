"""Models, evaluation and perturbation against plain Python; the command line; reports; the paged source."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import cli, reports
from tidewatch.functions import scoring
from tidewatch.operators import research as X
from tidewatch.sources import rest


def test_evaluation(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(40)), int(rng.random() < 0.3)) for _ in range(300)]
    got = X.evaluate(spark.createDataFrame(rows, "score double, y int"), recall=0.2).first()
    pos = sum(y for _, y in rows)
    above = lambda s: [y for x, y in rows if x >= s]
    levels = sorted({x for x, _ in rows}, reverse=True)
    ap = sum(sum(y for x, y in rows if x == s) / pos * sum(above(s)) / len(above(s)) for s in levels)
    pairs = [(a, b) for a, y in rows for b, z in rows if y and not z]
    auroc = sum(1.0 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs)
    best = max((sum(above(s)) / len(above(s)), sum(above(s)), s) for s in levels if sum(above(s)) >= 0.2 * pos)
    assert got.average_precision == pytest.approx(ap) and got.auroc == pytest.approx(auroc)
    assert (got.precision, got.threshold) == (pytest.approx(best[0]), best[2]) and got.recall == pytest.approx(best[1] / pos)


def test_a_score_is_worked_out_once(spark):
    """Read for the cuts, the starts and the sums, and compared with each cut, but made once a row."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        calls.add(1)
        return float(x * 37 % 101)

    rows = spark.range(500).select(score("id").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    assert X.evaluate(rows).first().auroc is not None and calls.value == 500


def test_noise_is_drawn_once_for_all_scales(spark, tmp_path):
    from tidewatch.plans.registry import QUERIES

    df = QUERIES["perturbation_curve"](spark, "/root/testdata/sf0.001")
    assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()  # it lies before what is written
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["perturbation_curve"](spark, str(tmp_path)).count() == 0  # as the SQL, which has no groups then


def test_evaluation_by_groups(spark):
    rng = random.Random(5)
    rows = [(g, round(rng.gauss(m, s), 1), int(rng.random() < 0.3)) for g, m, s in (("a", 0, 1), (None, 500, 40), ("c", -3, 0)) for _ in range(400)]
    f = spark.createDataFrame(rows, "g string, score double, y int")
    got = {r.g: tuple(r)[1:] for r in X.evaluate(f, by=("g",)).collect()}
    assert set(got) == {"a", None, "c"}
    for g, have in got.items():
        assert have == pytest.approx(tuple(X.evaluate(f.where(F.col("g").eqNullSafe(F.lit(g)))).first()))


def test_models_learn_what_there_is(spark):
    rng = random.Random(3)
    rows = [(k, a, b, int((a > 0.5) != (b > 0.5))) for k in range(400) for a, b in [(rng.random(), rng.random())]]
    f = spark.createDataFrame(rows, "k int, a double, b double, y int")
    auroc = {m: X.evaluate(X.fit_scores(f.where("k < 300"), f.where("k >= 300"), ["a", "b"], m)).first().auroc for m in X.MODELS}
    assert auroc["boosted"] > 0.9 > 0.75 > auroc["logistic"] and 0.3 < auroc["random"] < 0.7
    with pytest.raises(ValueError, match="label"):
        X.fit_scores(f, f, ["a", "y"])
    assert {r.score for r in X.fit_scores(f.where("y = 1"), f, ["a", "b"], "boosted").select("score").distinct().collect()} == {1.0}


def test_noise_and_rewiring(spark):
    f = spark.createDataFrame([(k, float(k % 10)) for k in range(2000)], "k int, x double")
    sd = lambda d: d.agg(F.stddev_samp("x")).first()[0]
    assert sd(X.noised(f, ["x"], 1.0, "k")) == pytest.approx(2**0.5 * sd(f), rel=0.05) and X.noised(f, ["x"], 0, "k") is f
    e = spark.createDataFrame([(a, b, 1.0) for a in range(60) for b in range(a + 1, 60) if (a * 7 + b) % 5 == 0], "u long, v long, w double")
    ends = lambda d: {tuple(r) for r in d.select("u", "v").collect()}
    assert ends(X.rewired(e, 0.0)) == ends(e)
    new = X.rewired(e, 0.5)
    kept = len(ends(new) & ends(e)) / e.count()
    assert 0.4 < kept < 0.85 and all(u < v for u, v in ends(new)) and ends(X.rewired(e, 0.5)) == ends(new)


def test_rules():
    assert X.search_due(None, 2020) and X.search_due({"thresholds": {"2019": 1}}, 2020) and not X.search_due({"thresholds": {"2020": 1}}, 2020)
    old, new = {"utility": 1, "recent": 2, "total": 3}, {"utility": 2, "recent": 2, "total": 3}
    assert X.adopted(old, new) and not X.adopted(new, old) and not X.adopted(old, new | {"total": 2})
    r = [{"name": "a", "score": 0.900, "features": 9}, {"name": "b", "score": 0.893, "features": 3}, {"name": "c", "score": 0.88, "features": 1}]
    assert X.parsimonious(r)["name"] == "b" and X.parsimonious([]) is None
    assert X.review_due(None, "2024-05-01") and X.review_due("2024-04-30", "2024-05-01") and not X.review_due("2024-05-01", "2024-05-31")
    assert scoring.layered({"Moon": 1.0, "beta": 2.0}, {"moon": 3.0}, without=("beta",)) == {"moon": 3.0}


def test_command_line(spark, tmp_path, capsys):
    tables, out = "/root/testdata/sf0.001", f"{tmp_path}/out"
    assert cli.main(["list"]) == 0 and "conviction_set" in capsys.readouterr().out
    assert cli.main(["query", "--tables", tables, "--out", out], spark) == 2
    assert cli.main(["query", "daily_entity_counts", "--tables", tables, "--out", out, "--start", "1996-01-01", "--end", "1996-12-31"], spark) == 0
    report = json.loads((tmp_path / "out" / "query.json").read_text())["daily_entity_counts"]
    from tidewatch.operators.stores import load

    rows = load(spark, f"{out}/daily_entity_counts")
    assert report["rows"] == rows.count() > 0 and {r.day.year for r in rows.collect()} == {1996}
    assert (tmp_path / "out" / "query.md").read_text().startswith("# daily_entity_counts")
    with pytest.raises(ValueError, match="no query nothing"):
        cli.run(spark, ["nothing"], tables, out)
    from tidewatch.plans import registry

    assert all(n in registry.QUERIES for g in cli.GROUPS.values() for n in g)
    assert reports.markdown("t", []) == "# t\n\nNo rows.\n" and "a\\|b" in reports.markdown("t", [{"x": "a|b", "y": None}])


def test_paged_source(spark, tmp_path):
    for q in ("a", "b c"):
        (tmp_path / f"{q}.json").write_text(json.dumps({"items": [{"id": f"{q}1"}, {"id": f"{q}2"}], "next": f"{q}-2.json".replace(" ", "%20")}))
        (tmp_path / f"{q}-2.json").write_text(json.dumps({"items": [{"id": f"{q}3"}]}))
    spark.dataSource.register(rest.Pages)
    got = spark.read.format("pages").option("url", f"file://{tmp_path}/{{query}}.json").option("queries", json.dumps(["a", "b c"])).load()
    assert sorted((r.query, r.page, json.loads(r.raw)["id"]) for r in got.collect()) == [(q, p, f"{q}{k}") for q in ("a", "b c") for p, k in ((0, 1), (0, 2), (1, 3))]
    with pytest.raises(Exception, match="No such file|urlopen"):
        spark.read.format("pages").option("url", f"file://{tmp_path}/none.json").option("queries", '["x"]').option("wait", "0").load().collect()
