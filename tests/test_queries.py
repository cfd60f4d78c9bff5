"""Every query with SQL gives the SQL's rows; some invariants of the operators."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import check
from tidewatch.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    check(spark, name, registry.QUERIES[name], registry.ORACLES[name], SMALL)


def series(spark, values):
    import datetime

    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame([(day + datetime.timedelta(k), "a", None if v is None else float(v)) for k, v in enumerate(values)], "day date, entity string, x double")


def test_z_warms_up_and_does_not_look_ahead(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators import windows as W

    z = lambda v: [r.z for r in series(spark, v).withColumn("z", W.trailing_z(F.col("x"))).orderBy("day").collect()]
    assert z([3] * 45) == [None] * 45
    rising = [2 * k + (k * k) % 5 for k in range(64)]
    early, late = z(rising), z(rising + [900, 0, 900])
    assert late[:64] == early and early[:27] == [None] * 27 and late[64] > 3 > abs(early[63])


def test_crossings(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators import windows as W

    days = lambda v, f, k: [i for i, r in enumerate(series(spark, v).withColumn("c", f(F.col("x"), k)).orderBy("day").collect()) if r.c]
    assert days([1.5, 4.0, 6.0, 4.5, 0.5, -2.0, 7.0, 7.5], W.crosses_above, 3.0) == [1, 6]
    assert days([None, 5.0, 5.5, None, 6.0], W.crosses_above, 3.0) == []


def test_spacing_is_greedy(spark):
    from tidewatch.operators.spacing import spaced

    import datetime

    day = datetime.date(2020, 1, 1)
    e = spark.createDataFrame([("a", day + datetime.timedelta(k)) for k in (0, 10, 20, 21, 41, 42, 70)], "entity string, day date")
    assert sorted((r.day - day).days for r in spaced(e, ["entity"], 21).collect()) == [0, 21, 42, 70]


def test_extraction(spark):
    from pyspark.sql import functions as F

    from tidewatch.functions import text as T

    rows = [("1", "Sold QRST, kept $wxy", "then $QRST again"), ("2", "a CUTE idea, NOTE it", "$cute $note"), ("3", "PLAN PLAN", None), ("4", "no caps here", "ABCDEF ABC")]
    posts = spark.createDataFrame(rows, "id string, title string, body string")
    universe = spark.createDataFrame([(s,) for s in ("QRST", "WXY", "CUTE", "NOTE", "PLAN")], "symbol string")
    got = {tuple(r) for r in T.mentions(posts, universe, ["NOTE"], ["CUTE"]).select("id", "place", "ticker", "n").collect()}
    assert got == {("1", "title", "QRST", 1), ("1", "title", "WXY", 1), ("1", "body", "QRST", 1), ("2", "body", "CUTE", 1), ("3", "title", "PLAN", 2)}
    t = spark.createDataFrame([("see /r/first_one, (r/second) but nor/third or r/ab",)], "t string").select(T.referrals(F.col("t")).alias("r")).first()
    assert t.r == ["first_one", "second"]


def test_themes(spark):
    from tidewatch.functions import text as T

    posts = spark.createDataFrame([("1", "Smart-phone prices"), ("2", "the art phone"), ("3", "phones"), ("4", None)], "id string, t string")
    keys = spark.createDataFrame([("exact", "phone"), ("part", "art-phone"), ("part", "art phone"), ("none", "price")], "theme string, keyword string")
    assert {tuple(r) for r in T.themes(posts, keys).collect()} == {("1", "exact"), ("1", "part"), ("2", "exact"), ("2", "part")}


def test_scorer():
    from tidewatch.functions.scoring import score_text

    assert score_text(None) == score_text(" ") == score_text("the table") == 0
    assert score_text("good") == -score_text("good") * -1 > 0 > score_text("not good") and score_text("great!!") > score_text("great!") > score_text("great")
    assert score_text("x" * 300 + " great") == 0 and -1 < score_text("terrible " * 30) < -0.9
