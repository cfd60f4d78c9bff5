"""Operators on small planted series."""

import datetime

import pytest

DAY = datetime.date(2020, 1, 1)


def on(k):
    return DAY + datetime.timedelta(k)


def test_runs_are_islands(spark):
    from tidewatch.operators.detector import runs

    days = spark.createDataFrame([("a", on(k)) for k in (0, 1, 3, 6, 7)] + [("b", on(0))], "entity string, day date")
    assert sorted((r.entity, (r["first"] - DAY).days, (r["last"] - DAY).days, r.days) for r in runs(days).collect()) == [("a", 0, 3, 3), ("a", 6, 7, 2), ("b", 0, 0, 1)]
    assert runs(days.limit(0)).collect() == []


def test_detector_does_not_look_ahead(spark):
    from tidewatch.operators import detector as D

    def of(n):
        rows = [(on(k), e, 5 + (k * p) % 7, (k * p) % 3 - 1) for k in range(n) for e, p in (("a", 3), ("b", 5))]
        f = D.ranked(D.features(spark.createDataFrame(rows, "day date, entity string, n long, nb long")))
        return {(r.entity, r.day): (r.e1, r.e3, r.e5, r.level) for r in f.where(f.day < on(300)).collect()}

    assert of(300) == of(360)


def test_rank_ties_and_nulls(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators import windows as W

    values = [1.0, 2.0, None, 2.0, 0.0, -0.0, 2.0]
    s = spark.createDataFrame([(on(k), "a", v) for k, v in enumerate(values)], "day date, entity string, x double")
    got = [r.p for r in W.pct_ranks(s, {"p": "x"}, 4, 2).orderBy("day").collect()]

    def want(k):
        past = [v for v in values[max(0, k - 3) : k + 1] if v is not None]
        x = values[k]
        return None if x is None or len(past) < 2 else (sum(v < x for v in past) + (sum(v == x for v in past) + 1) / 2) / len(past)

    assert got == pytest.approx([want(k) for k in range(len(values))])


def test_prominent_turns_equal_brute_force():
    import random

    import numpy as np

    from tidewatch.operators.inflection import prominent

    rnd = random.Random(5)
    for _ in range(200):
        x = np.array([rnd.randrange(6) for _ in range(rnd.randrange(0, 25))], float)
        want, n = [], len(x)
        for i in range(1, n - 1):
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if not (x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]):
                continue
            left = max([k for k in range(i) if x[k] > x[i]], default=-1)
            right = min([k for k in range(j, n) if x[k] > x[i]], default=n)
            if x[i] - max(x[left + 1 : i + 1].min(), x[j:right].min()) >= 2:
                want.append((i + j) // 2)
        assert prominent(x, 2) == want


def test_judging_needs_history_and_scales_by_volatility(spark):
    from tidewatch.operators.influence import judge

    px = [("q", on(k), 100.0 + 0.5 * k) for k in range(200)] + [("w", on(k), 100.0 * (1.5 if k % 40 >= 20 else 1.0)) for k in range(200)]
    calls = spark.createDataFrame([(1, "q", on(100), 1, 0.5), (2, "q", on(100), -1, -0.5), (3, "q", on(190), 1, 0.5), (4, "q", on(10), 1, 0.5), (5, "none", on(10), 1, 0.5)], "id int, entity string, day date, direction int, stance double")
    out = {r.id: (r.outcome, r.tau) for r in judge(calls, spark.createDataFrame(px, "entity string, day date, px double")).collect()}
    assert [out[k][0] for k in range(1, 6)] == ["correct", "wrong", "unscored", "flat", "unscored"]
    assert out[1][1] == 0.03 and out[4][1] is None


def test_board_without_judged_calls(spark):
    from tidewatch.operators.influence import board

    j = spark.createDataFrame([("a", "correct", 0.5, 1.0, True), ("a", "wrong", 0.5, 0.0, False), ("b", "unscored", 0.9, 0.0, False)], "author string, outcome string, stance double, z double, enhanced boolean")
    b = {r.author: r for r in board(j).collect()}
    assert (b["a"].n_judged, b["a"].hits) == (2, 1) and b["b"].composite is None and b["b"].tier == "low" and b["b"].score == 0.5


def test_raw_records(spark):
    from tidewatch.sources.records import normalise, require_text_free, symbols

    lines = ['{"id": 1, "created_utc": 1577923200, "title": "x", "author": {"name": "n"}, "ups": "7"}', "not json", '{"id": 1, "created_utc": 1577836800, "title": "early"}', '{"id": 2, "title": "no time"}', '{"id": 3, "created_at": "2020-01-05T10:00:00Z", "title": " "}', '{"id": 4, "created_at": "2020-01-05T10:00:00Z", "body": "b", "author": "s"}', '{"id": 5, "date": "12", "title": "t"}', None]
    got = {r.id: r for r in normalise(spark.createDataFrame([(x,) for x in lines], "raw string"), prefix="p_").collect()}
    assert sorted(got) == ["p_1", "p_4"] and got["p_1"].title == "early" and str(got["p_4"].day) == "2020-01-05" and got["p_4"].author == "s" and got["p_4"].selftext == "b"
    listing = spark.createDataFrame([("Symbol|Name|X|Test",), ("ABC|n|x|N",), ("TST|n|x|Y",), ("A.B|n|x|N",), ("File Creation Time",)], "value string")
    assert [r.symbol for r in symbols(listing).collect()] == ["ABC"]
    with pytest.raises(ValueError):
        require_text_free(spark.createDataFrame([("x",)], "Body string"))


def test_missing_spans(spark):
    from tidewatch.sources.records import missing_spans

    have = spark.createDataFrame([("A", on(10)), ("A", on(20)), ("B", on(1)), ("B", on(29))], "symbol string, day date")
    want = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    got = sorted((str(r.span_start), str(r.span_end), r.symbols) for r in missing_spans(want, have, "2020-01-01", "2020-01-31").collect())
    assert got == [("2020-01-01", "2020-01-10", "A"), ("2020-01-01", "2020-01-31", "C"), ("2020-01-22", "2020-01-31", "A")]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewatch.streaming import folds as S

    def send(name, rows):
        spark.createDataFrame(rows, "id long, day date, entity string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def feed():
        return spark.readStream.schema("id long, day date, entity string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def fold():
        return sorted((r.day, r.n) for r in S.daily_fold(feed(), str(tmp_path / "out"), str(tmp_path / "at")).collect())

    def seen():
        e = feed().withColumn("ts", F.col("day").cast("timestamp"))
        return sorted(r.id for r in S.first_sight(e, ["id"], "ts", "30 days", str(tmp_path / "out2"), str(tmp_path / "at2")).collect())

    send("1", [(1, on(0), "a"), (2, on(1), "a")])
    assert fold() == [(on(0), 1), (on(1), 1)] and seen() == [1, 2]
    send("2", [(2, on(1), "a"), (3, on(0), "a")])
    assert fold() == [(on(0), 2), (on(1), 2)] and seen() == [1, 2, 3]


def test_walk_forward_learns_from_the_past_only(spark):
    from tidewatch.operators.learn import walk_forward

    rows = [(2000 + k // 40, float(k % 2), k % 2) for k in range(80)] + [(2002, float(k % 2), 1 - k % 2) for k in range(40)]
    f = spark.createDataFrame(rows, "year int, x double, y int")
    out = walk_forward(f, ["x"]).collect()
    assert len(out) == 80 and all((r.score > 0.5) == (r.x > 0.5) for r in out)
    assert walk_forward(f.where("year = 2000"), ["x"]).count() == 0


def test_whole_rounds_and_no_bots(spark, tmp_path):
    """Ranks and beliefs of all rounds, without accounts over a limit; a chain is far from settled after ten rounds."""
    import datetime

    import numpy as np

    from tidewatch.plans import registry

    n = 30
    at = datetime.datetime(2020, 1, 1, 12)
    # one thread, in which each answers the one before; author 99 opens and closes it, and fills another one alone
    chain = [(5 * k + 1, at + datetime.timedelta(minutes=k), k, "view" if k % 2 else "click", float(k), "a") for k in range(n)]
    rows = [(i, t, u, "error", v, p) for i, t, u, _, v, p in chain] + [(5000 + i, at + datetime.timedelta(hours=2, seconds=i), 99, "click", 1.0, "b") for i in range(1001)]
    rows += [(4001, at - datetime.timedelta(minutes=1), 99, "error", 0.0, "a"), (4006, at + datetime.timedelta(minutes=n), 99, "error", 0.0, "a")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    link = np.zeros((n, n))
    for k in range(n - 1):
        link[k, k + 1] = link[k + 1, k] = 1
    rank = np.full(n, 1 / n)
    for _ in range(50):
        rank = 0.15 / n + 0.85 * (rank / link.sum(1)) @ link
    got = {r.author: r.rank for r in registry.QUERIES["pagerank_50"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(n)) and all(abs(got[k] - rank[k]) < 1e-6 for k in range(n))
    loud = {r.author for r in registry.QUERIES["loud_but_wrong"](spark, str(tmp_path)).collect()}
    assert loud == set(range(n))
    whole = np.zeros((n + 1, n + 1))
    whole[:n, :n] = link
    whole[n, 0] = whole[0, n] = whole[n, n - 1] = whole[n - 1, n] = 1
    from tidewatch.plans.influence import priors

    y = {r.node: r.y for r in priors(spark, str(tmp_path)).collect()}
    y = np.array([np.nan if (v := y[99 if k == n else k]) is None else v for k in range(n + 1)])
    belief = np.where(np.isnan(y), np.nanmean(y), y)
    for _ in range(30):
        belief = np.where(np.isnan(y), 0.85 * (whole @ belief) / whole.sum(1) + 0.15 * belief, y)
    got = {r.node: r.belief for r in registry.QUERIES["label_propagation_30"](spark, str(tmp_path)).collect()}
    assert all(abs(got[99 if k == n else k] - belief[k]) < 2e-6 for k in range(n + 1))


def test_stars_go_in_a_large_graph_only(spark):
    from tidewatch.operators.graph import without_bots

    nobody = spark.createDataFrame([], "node long, n_comments long, n_posts long")
    for n, kept in ((49, True), (50, False)):
        e = spark.createDataFrame([(0, k, 1.0) for k in range(1, n)] + [(k, k + 1, 1.0) for k in range(1, n - 1)], "u long, v long, w double")
        assert (without_bots(e, nobody).where("u = 0").count() > 0) == kept


def test_every_signal_is_judged(spark):
    """No day of the calendar is left out: all days with a high count and a side, three weeks apart."""
    from tidewatch.plans import daily, detect, registry

    small = "/root/testdata/sf0.01"
    want, last = set(), {}
    for r in daily.pressure(spark, small).where("n7 >= 8").orderBy("day").collect():
        side = (r.entity, r.bp7 > 0)
        if round(r.bp7, 6) and (side not in last or (r.day - last[side]).days >= 21):
            last[side] = r.day
            want.add((r.entity, r.day, r.bp7 > 0))
    assert want and {(r.entity, r.day, r.buy) for r in detect.signals(spark, small).collect()} == want
    for name in ("asof_returns", "onset_judge"):
        rows = {(r.entity, r.day) for r in registry.QUERIES[name](spark, small).collect()}
        assert rows == {w[:2] for w in want}
    assert len({r.day.toordinal() % 17 for r in registry.QUERIES["top_judge"](spark, small).collect()}) > 1


def test_replies_resolve_by_precedence(spark):
    from tidewatch.operators.graph import resolve_replies

    posts = spark.createDataFrame([("t3_p", "pia"), ("t3_q", "quinn"), ("t1_x", "wrong")], "id string, author string")
    rows = [("t1_x", "xeno", "t3_p", "t3_p"), ("t1_y", "yuri", "t1_x", "t3_p"), ("t1_z", "pia", "t1_gone", "t3_p"), ("t1_w", "wim", "t1_gone", "t3_q"), ("t1_v", "vera", "gone", "gone"), ("t1_u", "ulf", None, "t3_q"), ("t1_t", "xeno", "t1_x", "t3_p")]
    got = {(r.id, r.replier, r.author) for r in resolve_replies(spark.createDataFrame(rows, "id string, author string, parent_id string, link_id string"), posts).collect()}
    assert got == {("t1_x", "xeno", "pia"), ("t1_y", "yuri", "xeno"), ("t1_w", "wim", "quinn"), ("t1_u", "ulf", "quinn")}


def test_running_sums(spark):
    import random

    from tidewatch.operators.windows import running_sums

    rng = random.Random(4)
    values = rng.sample(range(10_000), 700)
    rows = [(float(v), rng.randrange(5)) for v in values]
    got = {r.x: r.run_n for r in running_sums(spark.createDataFrame(rows, "x double, n long"), "x", ["n"], 16).collect()}
    total = 0
    for x, n in sorted(rows):
        total += n
        assert got[x] == total
    assert running_sums(spark.createDataFrame([], "x double, n long"), "x", ["n"]).count() == 0
