"""Queries over the crowd detector, its desk scores and the decision engine."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import calendar as C
from tidewatch.operators import detector as D
from tidewatch.operators import windows as W
from tidewatch.operators.spacing import spaced
from tidewatch.plans import daily
from tidewatch.plans.daily import SBASE, filled_prices, r
from tidewatch.plans.detect import CONV
from tidewatch.sources.tables import BEARISH, BULLISH, scored

QUERIES, ORACLES = {}, {}
#: the test tables hold about one line a day and brand, so the gates are set for thin series
THIN = D.Rules(coverage=20, hype=1.2, persistence=0.35, level=60.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def crowd(spark, d):
    """(day, entity, n, nb) on the calendar: posts, and bullish less bearish posts."""
    posts = scored(spark, d)
    nb = F.count_if(F.col("score") > BULLISH) - F.count_if(F.col("score") < BEARISH)
    return C.on_spine(posts.groupBy("day", "entity").agg(F.count(F.lit(1)).alias("n"), nb.alias("nb")), zero=["n", "nb"])


def detector(spark, d):
    return D.ranked(D.features(crowd(spark, d)), THIN)


def cut_detector(spark, d):
    """The detector's columns written once (days by names, so small beside the posts), for queries that read them more than once."""
    from tidewatch.operators.graph import _dir

    _dir(spark)
    return detector(spark, d).select("entity", "day", *D.PARTS, "level", "fade", "hype", "covered").checkpoint()


_RANKS = {"e1": "share", "e2": "bull28", "e3": "rise28", "e5": "convex", "o1": "above", "o2": "hype_raw", "o3": "turn14", "o4": "rise14"}


def _mean(names, scale=1):
    return f"round({scale} * list_avg(list_filter([{', '.join(names)}], lambda v: v IS NOT NULL)), 6)"


CROWD = "cw0 AS (SELECT day, entity, count(*) AS n, count(*) FILTER (score > 0.02) - count(*) FILTER (score < -0.02) AS nb FROM sc GROUP BY ALL), cw AS (SELECT s.day, e.entity, coalesce(n, 0) AS n, coalesce(nb, 0) AS nb FROM sspine s CROSS JOIN (SELECT DISTINCT entity FROM cw0) e LEFT JOIN cw0 USING (day, entity))"
_W = ", ".join(f"w{k} AS (PARTITION BY entity ORDER BY day ROWS {k - 1} PRECEDING)" for k in (7, 14, 28))
FEATURES = f"""f0 AS (SELECT *, 100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY day), 0) AS raw FROM cw),
f1 AS (SELECT day, entity, n, nb, avg(raw) OVER w7 AS share, avg(n) OVER w7 AS m7, CASE WHEN count(*) OVER w28 >= 7 THEN sum(nb) OVER w28 / nullif(sum(n) OVER w28, 0)::DOUBLE END AS bull28, CASE WHEN count(*) OVER w14 >= 7 THEN sum(nb) OVER w14 / nullif(sum(n) OVER w14, 0)::DOUBLE END AS share14, CASE WHEN count(*) OVER w28 >= 7 THEN sum(n) OVER w28 END AS posts28, sum((nb > 0)::INT) OVER w28 / nullif(sum((n > 0)::INT) OVER w28, 0)::DOUBLE AS persist FROM f0 WINDOW {_W}),
f2 AS (SELECT *, CASE WHEN count(share) OVER w120 >= 60 THEN median(share) OVER w120 END AS mid, {CONV} AS convex0, share - lag(share, 28) OVER o AS rise28, share - lag(share, 14) OVER o AS rise14, share - CASE WHEN count(share) OVER w28 >= 7 THEN avg(share) OVER w28 END AS above, share14 - lag(share14, 14) OVER o AS turn14 FROM f1 WINDOW o AS (PARTITION BY entity ORDER BY day), w28 AS (PARTITION BY entity ORDER BY day ROWS 27 PRECEDING), w120 AS (PARTITION BY entity ORDER BY day ROWS 119 PRECEDING)),
f3 AS (SELECT *, CASE WHEN convex0 IS NOT NULL THEN greatest(convex0, 0) END AS convex, CASE WHEN mid > 0 THEN share / mid END AS hype_raw, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM f2)"""


def det_sql(names: str = "e1 e2 e3 e5", rules: D.Rules = THIN) -> str:
    """CTEs up to ``det``: only the ranks asked for are worked out."""
    use = {k: v for k, v in _RANKS.items() if k in names.split()}
    cols = ", ".join(f"round({v}, 6) AS r_{k}" for k, v in use.items())
    tallies = ", ".join(f"count(b.r_{k}) AS n_{k}, count(*) FILTER (b.r_{k} < a.r_{k}) AS lt_{k}, count(*) FILTER (b.r_{k} = a.r_{k}) AS eq_{k}" for k in use)
    ranks = ", ".join(f"CASE WHEN n_{k} >= 180 AND eq_{k} > 0 THEN (lt_{k} + (eq_{k} + 1) / 2.0::DOUBLE) / n_{k} END" + (f" * coalesce(persist >= {rules.persistence}, false)::INT" if k == "e2" else "") + f" AS {k}" for k in use)
    level = f", {_mean(D.PARTS, 100)} AS level, coalesce(e1 >= {rules.attention} AND turn14 < -1e-9, false) AS fade" if set(D.PARTS) <= set(use) else ""
    onset = f", {_mean(D.ONSET)} AS onset" if set(D.ONSET) <= set(use) else ""
    return f"""{CROWD}, {FEATURES}, f4 AS MATERIALIZED (SELECT entity, day, i, {cols} FROM f3), rk AS MATERIALIZED (SELECT a.entity, a.day, {tallies} FROM f4 a JOIN f4 b ON a.entity = b.entity AND b.i BETWEEN a.i - 364 AND a.i GROUP BY a.entity, a.day),
d0 AS (SELECT f3.*, {ranks}, coalesce(hype_raw >= {rules.hype} - 1e-9, false) AS hype, coalesce(posts28 >= {rules.coverage}, false) AS covered FROM f3 JOIN rk USING (entity, day)), det AS MATERIALIZED (SELECT *{level}{onset} FROM d0)"""


def trigger_sql(rules: D.Rules = THIN) -> str:
    return f"coalesce(covered AND hype AND e1 >= {rules.attention} AND e2 > 0 AND (level >= {rules.level} OR (level >= {rules.level - rules.relief} AND fade)), false)"


def spacing_sql(source: str, keys: list[str], gap: int, out: str) -> str:
    """Recursive CTEs that keep events of ``source`` (keys, day) at least ``gap`` days apart."""
    k, on = ", ".join(keys), " AND ".join(f"e.{c} = w.{c}" for c in keys)
    return f"{out}_e AS MATERIALIZED (SELECT {k}, day, row_number() OVER (PARTITION BY {k} ORDER BY day) AS k FROM {source}), {out}_w AS (SELECT {k}, day, k, day AS kept FROM {out}_e WHERE k = 1 UNION ALL SELECT {', '.join('e.' + c for c in keys)}, e.day, e.k, CASE WHEN e.day - w.kept >= {gap} THEN e.day ELSE w.kept END FROM {out}_w w JOIN {out}_e e ON {on} AND e.k = w.k + 1), {out} AS MATERIALIZED (SELECT DISTINCT {k}, kept AS day FROM {out}_w)"


@query(f"{SBASE}, {det_sql()} SELECT entity, day, e1, e2, e3, e5, level, fade, hype, covered FROM det")
def euphoria_level(spark, d):
    return detector(spark, d).select("entity", "day", *D.PARTS, "level", "fade", "hype", "covered")


@query(f"{SBASE}, {det_sql()}, trig AS (SELECT entity, day FROM det WHERE {trigger_sql()}), {spacing_sql('trig', ['entity'], 21, 'alert')} SELECT entity, day FROM alert")
def euphoria_alerts(spark, d):
    return D.alerts(detector(spark, d), THIN)


DENSE = D.Rules()


@query(f"{SBASE}, {det_sql(rules=DENSE)} SELECT entity, day, e1, e2, e3, e5, level, fade, hype, covered FROM det")
def euphoria_level_dense(spark, d):
    """The level under the operator's own gates, which are those for dense series."""
    f = D.ranked(D.features(crowd(spark, d)), DENSE)
    return f.select("entity", "day", *D.PARTS, "level", "fade", "hype", "covered")


@query(f"{SBASE}, {det_sql(rules=DENSE)}, trig AS (SELECT entity, day FROM det WHERE {trigger_sql(DENSE)}), {spacing_sql('trig', ['entity'], 21, 'alert')} SELECT entity, day FROM alert")
def euphoria_alerts_dense(spark, d):
    """Alerts under the same gates; on thin tables there are none."""
    return D.alerts(D.ranked(D.features(crowd(spark, d)), DENSE), DENSE)


@query(f"{SBASE}, {det_sql('o1 o2 o3 o4 e5')}, br AS (SELECT day, entity, count(*) FILTER (s > 0) AS breadth FROM (SELECT s.day, e.entity, e.source, sum(coalesce(n, 0)) OVER (PARTITION BY e.entity, e.source ORDER BY s.day ROWS 6 PRECEDING) AS s FROM sspine s CROSS JOIN (SELECT DISTINCT entity, source FROM sc) e LEFT JOIN (SELECT day, entity, source, count(*) AS n FROM sc GROUP BY ALL) c USING (day, entity, source)) GROUP BY ALL) SELECT entity, day, o1, o2, o3, o4, e5 AS o5, onset AS onset_score, round(hype_raw, 8) AS hype_raw, breadth FROM det JOIN br USING (entity, day)")
def onset_features(spark, d):
    """Bank of five ranks, their mean, and the number of sources that posted within seven days."""
    from tidewatch.operators.desk import source_breadth

    b = source_breadth(scored(spark, d).select("day", "entity", "source")).select("day", "entity", "breadth")
    f = detector(spark, d).select("entity", "day", *(F.col(c).alias(f"o{k}") for k, c in enumerate(D.ONSET, 1)), F.col("onset").alias("onset_score"), F.round("hype_raw", 8).alias("hype_raw"))
    return f.join(b, ["day", "entity"])


BOOM = "bm AS (SELECT day, entity, coalesce(px / (CASE WHEN count(px) OVER w >= 60 THEN min(px) OVER w END) - 1 >= 0.25, false) AS boom FROM px WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 119 PRECEDING))"


def boom(spark, d):
    low = W.at_least(F.min("px").over(W.trailing(120)), F.col("px"), W.trailing(120), 60)
    return filled_prices(spark, d).select("day", "entity", F.coalesce(F.col("px") / low - 1 >= 0.25, F.lit(False)).alias("boom"))


@query(f"{SBASE}, {det_sql('e1 e2 e3 e5 o1 o2 o3 o4')}, {BOOM}, fr AS (SELECT *, coalesce(e1 >= 0.9 AND e2 > 0, false) AS ending, {_mean(['e1', 'e2', 'e3', 'e5', 'fade::INT::DOUBLE'])} AS raw FROM det JOIN bm USING (entity, day) WHERE covered AND e1 IS NOT NULL AND e2 IS NOT NULL AND e3 IS NOT NULL AND e5 IS NOT NULL AND o1 IS NOT NULL AND o2 IS NOT NULL AND o3 IS NOT NULL AND o4 IS NOT NULL), ds AS (SELECT entity, day, 'OUT' AS desk, CASE WHEN ending THEN raw ELSE 0 END AS s FROM fr WHERE hype AND boom UNION ALL SELECT entity, day, 'IN', onset FROM fr WHERE hype_raw >= 1 - 1e-9 AND NOT ending) SELECT entity, day, desk, round(avg(s) OVER (PARTITION BY entity, desk ORDER BY day ROWS 6 PRECEDING), 9) AS score FROM ds")
def desk_scores(spark, d):
    """Exit and entry desks: each smooths its score over the last seven rows that are candidates, not over days."""
    need = [*D.PARTS, "o1", "o2", "o3", "o4"]
    f = detector(spark, d).where("covered").dropna(subset=need).join(boom(spark, d), ["day", "entity"])
    ending = F.coalesce((F.col("e1") >= 0.9) & (F.col("e2") > 0), F.lit(False))
    f = f.withColumns({"ending": ending, "faded": F.col("fade").cast("double")}).withColumn("raw", F.round(D.mean_of(*D.PARTS, "faded"), 6))
    out = f.where("hype AND boom").select("entity", "day", F.lit("OUT").alias("desk"), F.when(F.col("ending"), F.col("raw")).otherwise(0.0).alias("s"))
    into = f.where((F.col("hype_raw") >= 1 - 1e-9) & ~F.col("ending")).select("entity", "day", F.lit("IN").alias("desk"), F.col("onset").alias("s"))
    w = W.trailing(7, "entity", "desk")
    return out.unionByName(into).select("entity", "day", "desk", F.round(F.avg("s").over(w), 9).alias("score"))


@query(f"{SBASE}, {CROWD}, {FEATURES}, {BOOM}, dd AS (SELECT entity, day FROM f3 JOIN bm USING (entity, day) WHERE coalesce(hype_raw >= {THIN.hype} - 1e-9, false) AND boom), st AS (SELECT *, coalesce(day - lag(day) OVER (PARTITION BY entity ORDER BY day) > 2, true)::INT AS s FROM dd), rn AS (SELECT *, sum(s) OVER (PARTITION BY entity ORDER BY day) AS run FROM st) SELECT entity, min(day) AS first, max(day) AS last, count(*) AS days FROM rn GROUP BY entity, run")
def danger_runs(spark, d):
    """Runs of days on which a name is talked up while its price has boomed."""
    f = D.features(crowd(spark, d)).where(F.col("hype_raw") >= THIN.hype - 1e-9).select("entity", "day")
    return D.runs(f.join(boom(spark, d).where("boom").select("entity", "day"), ["entity", "day"]))


KD = 1.5
DECIDE = f"""{daily.PRESS}, {daily.RISING}, dsh AS (SELECT day, entity, avg(raw) OVER (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING) AS v FROM (SELECT day, entity, CASE WHEN sum(n) OVER (PARTITION BY day) >= 10 THEN 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY day) END AS raw FROM swide)),
dvv AS (SELECT day, entity, avg(v) OVER (PARTITION BY entity ORDER BY day ROWS 4 PRECEDING) AS dv FROM (SELECT day, entity, v - lag(v) OVER (PARTITION BY entity ORDER BY day) AS v FROM dsh)),
dz AS (SELECT day, entity, CASE WHEN count(*) OVER w >= 28 THEN (n7 - avg(n7) OVER w) / nullif(stddev_samp(n7) OVER w, 0) END AS az, CASE WHEN count(*) OVER w >= 28 THEN (bp7 - avg(bp7) OVER w) / nullif(stddev_samp(bp7) OVER w, 0) END AS cz, share - lag(share, 5) OVER (PARTITION BY entity ORDER BY day) AS chg FROM ps WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 83 PRECEDING)),
dx AS (SELECT dz.*, round(dv, 9) AS dv, coalesce(az > 1 AND chg < -0.10, false) AS crowded, coalesce(da > 0 AND db > 0 AND live > 0, false) AS rising FROM dz JOIN dvv USING (day, entity) JOIN r30 USING (day, entity)),
dt AS (SELECT *, coalesce(az > {KD} AND lag(az) OVER o <= {KD}, false) OR coalesce(cz > {KD} AND lag(cz) OVER o <= {KD}, false) AS up, coalesce(cz < -{KD} AND lag(cz) OVER o >= -{KD}, false) OR (crowded AND NOT coalesce(lag(crowded) OVER o, false)) AS down FROM dx WINDOW o AS (PARTITION BY entity ORDER BY day)),
sd AS (SELECT *, CASE WHEN up AND dv > 0 THEN 'BUY' WHEN down AND dv < 0 THEN 'SELL' END AS side FROM dt),
sk AS (SELECT *, 1 + coalesce(az > {KD}, false)::INT + coalesce(CASE WHEN side = 'BUY' THEN cz > {KD} ELSE cz < -{KD} END, false)::INT + (CASE WHEN side = 'BUY' THEN NOT crowded ELSE crowded END)::INT + rising::INT AS score FROM sd WHERE side IS NOT NULL),
ok AS (SELECT * FROM sk WHERE score >= 4)"""


def decisions(spark, d, k: float = KD, least: int = 4, cooldown: int = 21):
    """Scored days before spacing: a trigger, the gate of the chatter's direction, five checks.

    The SQL side compares equal sums, so the direction is rounded before it is compared with zero.
    """
    p = daily.pressure(spark, d)
    z = {"az": W.trailing_z(F.col("n7").cast("double")), "cz": W.trailing_z(F.col("bp7")), "chg": W.delta(F.col("share"), 5)}
    total = F.sum("n").over(Window.partitionBy("day"))
    p = p.withColumn("raw", F.when(total >= 10, 100.0 * F.col("n") / total)).withColumns(z).withColumn("chatter", W.roll_mean(F.col("raw"), 7))
    p = p.withColumn("step", W.delta(F.col("chatter"))).withColumns({"dv": F.round(W.roll_mean(F.col("step"), 5), 9), "crowded": F.coalesce((F.col("az") > 1) & (F.col("chg") < -0.10), F.lit(False))})
    az, cz, crowded = F.col("az"), F.col("cz"), F.col("crowded")
    p = p.withColumns({"up": W.crosses_above(az, k) | W.crosses_above(cz, k), "down": W.crosses_below(cz, -k) | W.newly(crowded)})
    side = F.when(F.col("up") & (F.col("dv") > 0), "BUY").when(F.col("down") & (F.col("dv") < 0), "SELL")
    s = p.withColumn("side", side).where("side IS NOT NULL").join(daily.cross_source_rising(spark, d), ["day", "entity"])
    buy, yes = F.col("side") == "BUY", lambda c: F.coalesce(c, F.lit(False))
    checks = {"attention": yes(az > k), "conviction": yes(F.when(buy, cz > k).otherwise(cz < -k)), "crowding": F.when(buy, ~crowded).otherwise(crowded), "sources": F.col("rising")}
    s = s.withColumn("score", sum((c.cast("int") for c in checks.values()), F.lit(1)))
    parts = [F.when(checks["attention"], F.format_string("attention %+.2f", az)), F.when(buy, "chatter rising").otherwise("chatter falling"), F.when(checks["conviction"], F.format_string("conviction %+.2f", cz)), F.when(checks["crowding"], F.when(buy, "not crowded").otherwise("crowded")), F.when(checks["sources"], "sources agree")]
    s = s.withColumn("reason", F.concat_ws(" + ", *parts)).where(F.col("score") >= least)
    return s.join(spaced(s.select("entity", "side", "day"), ["entity", "side"], cooldown), ["entity", "side", "day"])


REASON = f"concat_ws(' + ', CASE WHEN az > {KD} THEN printf('attention %+.2f', az) END, CASE side WHEN 'BUY' THEN 'chatter rising' ELSE 'chatter falling' END, CASE WHEN side = 'BUY' AND cz > {KD} OR side = 'SELL' AND cz < -{KD} THEN printf('conviction %+.2f', cz) END, CASE WHEN side = 'BUY' AND NOT crowded THEN 'not crowded' WHEN side = 'SELL' AND crowded THEN 'crowded' END, CASE WHEN rising THEN 'sources agree' END)"
TRADES = f"{DECIDE}, {spacing_sql('ok', ['entity', 'side'], 21, 'kp')}, tr AS MATERIALIZED (SELECT ok.* FROM ok JOIN kp USING (entity, side, day))"


@query(f"{SBASE}, {TRADES} SELECT entity, side, day AS signal_day, day + 1 AS action_day, score::INT AS score, {REASON} AS reason FROM tr")
def trade_decisions(spark, d):
    return decisions(spark, d).select("entity", "side", F.col("day").alias("signal_day"), F.date_add("day", 1).alias("action_day"), "score", "reason")


@query(f"{SBASE}, {TRADES} SELECT entity, side, day, round(score + least(abs(cz), 3) + greatest(0, 1 - ((SELECT max(day) FROM tr) - day) / 90.0::DOUBLE), 4) AS certainty FROM tr WHERE cz IS NOT NULL")
def certainty_rank(spark, d):
    """Score, capped conviction and freshness against the newest decision."""
    t = decisions(spark, d)
    newest = t.agg(F.max("day").alias("newest"))
    age = F.datediff("newest", "day")
    return t.where("cz IS NOT NULL").join(F.broadcast(newest)).select("entity", "side", "day", F.round(F.col("score") + F.least(F.abs("cz"), F.lit(3.0)) + F.greatest(F.lit(0.0), 1 - age / 90.0), 4).alias("certainty"))


@query(f"{SBASE}, {TRADES} SELECT t.entity, t.side, t.day, coalesce((SELECT min(z.day) FROM dz z WHERE z.entity = t.entity AND z.day BETWEEN t.day + 1 AND t.day + 61 AND CASE WHEN t.side = 'BUY' THEN z.cz < 0.5 ELSE z.cz > -0.5 END), t.day + 61) AS exit_day FROM tr t")
def crossing_exits(spark, d):
    """The first day within sixty of the entry on which conviction is back near zero, else the sixtieth."""
    t = decisions(spark, d).select("entity", "side", "day", F.date_add("day", 1).alias("entry"))
    z = daily.pressure(spark, d).select(F.col("entity").alias("e"), F.col("day").alias("at"), W.trailing_z(F.col("bp7")).alias("cz"))
    back = F.when(F.col("side") == "BUY", F.col("cz") < 0.5).otherwise(F.col("cz") > -0.5)
    j = t.join(z, (F.col("entity") == F.col("e")) & F.col("at").between(F.col("entry"), F.date_add("entry", 60)) & back, "left")
    return j.groupBy("entity", "side", "day", "entry").agg(F.min("at").alias("at")).select("entity", "side", "day", F.coalesce("at", F.date_add("entry", 60)).alias("exit_day"))


@query(f"{daily.BASE}, i0 AS MATERIALIZED (SELECT entity, day, n, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM wide), iw AS (SELECT entity, day, i, n::DOUBLE AS a, 1.0::DOUBLE AS b FROM i0 WHERE i = 1 UNION ALL SELECT x.entity, x.day, x.i, x.n + 0.75 * w.a, 1 + 0.75 * w.b FROM iw w JOIN i0 x ON x.entity = w.entity AND x.i = w.i + 1), iv AS (SELECT entity, day, a / b AS s, coalesce(a / b - lag(a / b) OVER (PARTITION BY entity ORDER BY day), 0) AS v FROM iw) SELECT entity, day, round(s, 5) AS smoothed, v > avg(v) OVER w + 2 * stddev_samp(v) OVER w AND v > 0 AS rise, v < avg(v) OVER w - 2 * stddev_samp(v) OVER w AND v < 0 AS fall FROM iv WINDOW w AS (PARTITION BY entity)")
def inflection_flags(spark, d):
    from tidewatch.operators.inflection import inflection

    return inflection(daily.wide(spark, d)).select("entity", "day", F.round("smoothed", 5).alias("smoothed"), "rise", "fall")


@query()
def prominent_turns(spark, d):
    """Held against a brute-force version in the tests."""
    from tidewatch.operators.inflection import inflection

    return inflection(daily.wide(spark, d)).where("peak OR trough").select("entity", "day", "peak", "trough")
