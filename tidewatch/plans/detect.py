"""Queries over trailing ranks, prices, episodes and alert judging."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import windows as W
from tidewatch.operators.spacing import spaced
from tidewatch.plans.daily import BASE, SBASE, filled_prices, r, scored, share, swide, wide
from tidewatch.plans import daily
from tidewatch.sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


RANK = f"{daily.SHARE}, num AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM share), rk AS (SELECT a.entity, a.day, count(b.share) AS n, count(*) FILTER (b.share < a.share) AS lt, count(*) FILTER (b.share = a.share) AS eq, any_value(a.share) AS share FROM num a JOIN num b ON a.entity = b.entity AND b.i BETWEEN a.i - 364 AND a.i GROUP BY a.entity, a.day), pr AS (SELECT entity, day, share, CASE WHEN n >= 180 AND share IS NOT NULL THEN (lt + (eq + 1) / 2.0::DOUBLE) / n END AS rank FROM rk)"
#: both engines sum a frame in their own order; ranks are taken of rounded shares, so that equal values stay equal
RANK = RANK.replace("num AS (SELECT *,", "num AS (SELECT day, entity, round(share, 6) AS share,")


def ranked_share(spark, d):
    s = share(spark, d).withColumn("share", F.round("share", 6))
    return W.pct_ranks(s, {"rank": "share"})


@query(f"{BASE}, {RANK} SELECT day, entity, round(rank, 6) AS rank FROM pr")
def pct_rank_365(spark, d):
    return ranked_share(spark, d).select("day", "entity", F.round("rank", 6).alias("rank"))


CONV = "(" + " + ".join(f"{w!r}::DOUBLE * lag(ln(1 + m7), {59 - k}) OVER o" for k, w in enumerate(W.convexity_weights())) + ")"


@query(f"{BASE}, m AS (SELECT day, entity, avg(n) OVER (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING) AS m7 FROM wide) SELECT day, entity, round({CONV}, 5) + 0.0 AS convexity FROM m WINDOW o AS (PARTITION BY entity ORDER BY day)")
def log_convexity(spark, d):
    m = wide(spark, d).withColumn("m7", W.roll_mean(F.col("n"), 7))
    return m.select("day", "entity", r(W.log_convexity(F.col("m7")), 5).alias("convexity"))


@query(f"{BASE}, {daily.SHARE}, g AS (SELECT day, entity, share, CASE WHEN count(share) OVER w >= 60 THEN median(share) OVER w END AS mid FROM share WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 119 PRECEDING)) SELECT day, entity, round(mid, 4) AS mid, coalesce(mid > 0 AND share >= 1.2 * mid, false) AS hype FROM g")
def rolling_median_gate(spark, d):
    s = share(spark, d).withColumn("mid", W.roll_median(F.col("share"), 120, 60))
    return s.select("day", "entity", F.round("mid", 4).alias("mid"), F.coalesce((F.col("mid") > 0) & (F.col("share") >= 1.2 * F.col("mid")), F.lit(False)).alias("hype"))


@query(f"{SBASE}, b AS (SELECT day, entity, px, CASE WHEN count(px) OVER w >= 60 THEN min(px) OVER w END AS low FROM px WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 119 PRECEDING)) SELECT day, entity, coalesce(px / low - 1 >= 0.25, false) AS boom FROM b")
def boom_state(spark, d):
    low = W.at_least(F.min("px").over(W.trailing(120)), F.col("px"), W.trailing(120), 60)
    return filled_prices(spark, d).select("day", "entity", F.coalesce(F.col("px") / low - 1 >= 0.25, F.lit(False)).alias("boom"))


SIG = (
    f"{daily.PRESS}, sg AS (SELECT entity, day, bp7 > 0 AS buy, row_number() OVER (PARTITION BY entity, bp7 > 0 ORDER BY day) AS k FROM pr WHERE n7 >= 8 AND round(bp7, 6) != 0),"
    " sgw AS (SELECT entity, buy, day, k, day AS kept FROM sg WHERE k = 1 UNION ALL"
    " SELECT n.entity, n.buy, n.day, n.k, CASE WHEN n.day - w.kept >= 21 THEN n.day ELSE w.kept END FROM sgw w JOIN sg n ON n.entity = w.entity AND n.buy = w.buy AND n.k = w.k + 1),"
    " sig AS (SELECT DISTINCT entity, kept AS day, buy FROM sgw)"
)


def signals(spark, d):
    """All days of which the seven-day count is high, spaced by 21 days within name and side. The side is that of the seven days'
    pressure; days on which it is zero have none and give no signal."""
    p = daily.pressure(spark, d).where((F.col("n7") >= 8) & (F.round("bp7", 6) != 0)).select("entity", "day", (F.col("bp7") > 0).alias("buy"))
    return spaced(p, ["entity", "buy"], 21)


def returns(spark, d):
    """Entry the day after the signal, exit 20 days on; as of the last price where the calendar ends (prices are filled, so an equi-join)."""
    px = filled_prices(spark, d).select("entity", "day", "px")
    last = px.groupBy("entity").agg(F.max("day").alias("last"))
    s = signals(spark, d).join(last, "entity")
    s = s.withColumns({"entry": F.least(F.date_add("day", 1), "last"), "out": F.least(F.date_add("day", 21), "last")})
    s = s.join(px.select("entity", F.col("day").alias("entry"), F.col("px").alias("p0")), ["entity", "entry"], "left").join(px.select("entity", F.col("day").alias("out"), F.col("px").alias("p1")), ["entity", "out"], "left")
    move = 100 * (F.col("p1") / F.col("p0") - 1)
    return s.select("entity", "day", F.when(F.col("buy"), "BUY").otherwise("SELL").alias("action"), "out", F.when(F.col("buy"), move).otherwise(-move).alias("pnl"))


RET = f"{SIG}, lastd AS (SELECT max(day) AS last FROM px), pos AS (SELECT entity, day, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS action, day + 1 AS e, day + 21 AS x FROM sig), ret AS (SELECT p.entity, p.day, p.action, least(p.x, last) AS out, (CASE WHEN action = 'BUY' THEN 1 ELSE -1 END) * 100 * (b.px / a.px - 1) AS pnl FROM pos p CROSS JOIN lastd ASOF LEFT JOIN px a ON a.entity = p.entity AND a.day <= p.e ASOF LEFT JOIN px b ON b.entity = p.entity AND b.day <= p.x)"


@query(f"{SBASE}, {RET} SELECT entity, day, action, round(pnl, 3) + 0.0 AS pnl FROM ret")
def asof_returns(spark, d):
    return returns(spark, d).select("entity", "day", "action", r(F.col("pnl"), 3).alias("pnl"))


@query(f"{SBASE}, {RET} SELECT coalesce(action, 'ALL') AS action, count(pnl) AS n, CASE WHEN count(pnl) > 1 THEN round(avg(pnl), 4) + 0.0 END AS mean, CASE WHEN count(pnl) > 1 THEN round(sum(pnl), 3) + 0.0 END AS total, CASE WHEN count(pnl) > 1 THEN round(100.0 * count(*) FILTER (pnl > 0) / count(pnl), 4) END AS hit, CASE WHEN count(pnl) > 1 THEN round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252 / 20.0), 4) + 0.0 END AS sharpe FROM ret GROUP BY GROUPING SETS ((), (action))")
def signal_scorecard(spark, d):
    n = F.count("pnl")
    measures = (n.alias("n"), F.when(n > 1, r(F.avg("pnl"))).alias("mean"), F.when(n > 1, r(F.sum("pnl"), 3)).alias("total"), F.when(n > 1, F.round(100.0 * F.count_if(F.col("pnl") > 0) / n, 4)).alias("hit"), F.when(n > 1, r(F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * (252 / 20.0) ** 0.5)).alias("sharpe"))
    # the total stands even without any trade, which a rollup of no rows would drop
    rows = returns(spark, d)
    return rows.groupBy("action").agg(*measures).unionByName(rows.agg(*measures).withColumn("action", F.lit("ALL")))


@query(f"{SBASE}, {RET} SELECT entity, day, action, out, out >= last AS open, greatest(0, day + 21 - last)::INT AS days_left, round(pnl, 3) + 0.0 AS pnl FROM ret CROSS JOIN lastd")
def trade_ledger(spark, d):
    t = returns(spark, d)
    last = filled_prices(spark, d).agg(F.max("day").alias("last"))
    return t.join(F.broadcast(last)).select("entity", "day", "action", "out", (F.col("out") >= F.col("last")).alias("open"), F.greatest(F.lit(0), F.datediff(F.date_add("day", 21), "last")).cast("int").alias("days_left"), r(F.col("pnl"), 3).alias("pnl"))


@query(f"{SBASE}, {daily.PRESS}, a AS (SELECT p.entity, p.day, bp7 - lag(bp7) OVER w AS chg, px / lag(px) OVER w - 1 AS ret FROM pr p JOIN px USING (entity, day) WINDOW w AS (PARTITION BY p.entity ORDER BY p.day)), l AS (SELECT unnest(range(-15, 16)) AS lag) SELECT x.entity, lag::INT AS lag, round(corr(x.chg, y.ret), 4) + 0.0 AS corr, count(*) AS n FROM l JOIN a x ON true JOIN a y ON x.entity = y.entity AND y.day = x.day + lag::INT WHERE x.chg IS NOT NULL AND y.ret IS NOT NULL GROUP BY x.entity, lag")
def lead_lag_corr(spark, d):
    p = daily.pressure(spark, d).join(filled_prices(spark, d).select("day", "entity", "px"), ["day", "entity"])
    a = p.select("day", "entity", W.delta(F.col("bp7")).alias("chg"), (F.col("px") / F.lag("px").over(W.by_entity()) - 1).alias("ret"))
    x = a.where("chg IS NOT NULL").select("entity", "day", "chg", F.explode(F.sequence(F.lit(-15), F.lit(15))).alias("lag")).withColumn("at", F.expr("date_add(day, lag)"))
    y = a.where("ret IS NOT NULL").select("entity", F.col("day").alias("at"), "ret")
    return x.join(y, ["entity", "at"]).groupBy("entity", "lag").agg(r(F.corr("chg", "ret")).alias("corr"), F.count(F.lit(1)).alias("n"))


FLIP = f"{daily.PRESS}, v AS (SELECT entity, day, bp7 - lag(bp7) OVER (PARTITION BY entity ORDER BY day) AS v FROM pr), e AS (SELECT *, 0.25 * stddev_samp(v) OVER (PARTITION BY entity) AS eps FROM v), s AS (SELECT entity, day, last_value(CASE WHEN v > eps THEN 1 WHEN v < -eps THEN -1 END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day) AS state FROM e), f AS (SELECT entity, day, state FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY entity ORDER BY day), 0) AS before FROM s) WHERE state != before), k AS (SELECT *, row_number() OVER (PARTITION BY entity, state ORDER BY day) AS k FROM f), walk AS (SELECT entity, state, day, k, day AS kept FROM k WHERE k = 1 UNION ALL SELECT k.entity, k.state, k.day, k.k, CASE WHEN k.day - w.kept >= 7 THEN k.day ELSE w.kept END FROM walk w JOIN k ON k.entity = w.entity AND k.state = w.state AND k.k = w.k + 1)"


@query(f"{SBASE}, {FLIP} SELECT DISTINCT entity, state::INT AS state, kept AS day FROM walk")
def direction_flips(spark, d):
    """Hysteresis: the state turns where the change leaves a band; marks of one direction keep seven days."""
    v = daily.pressure(spark, d).withColumn("v", W.delta(F.col("bp7")))
    v = v.withColumn("eps", 0.25 * F.stddev_samp("v").over(Window.partitionBy("entity")))
    s = v.withColumn("state", F.last(F.when(F.col("v") > F.col("eps"), 1).when(F.col("v") < -F.col("eps"), -1), ignorenulls=True).over(W.by_entity()))
    flips = s.withColumn("before", F.coalesce(F.lag("state").over(W.by_entity()), F.lit(0))).where("state != before")
    return spaced(flips.select("entity", "state", "day"), ["entity", "state"], 7)


PEAK = "c AS (SELECT entity, day, px, max(px) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 21 PRECEDING AND 21 FOLLOWING) AS top, count(px) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 21 PRECEDING AND 21 FOLLOWING) AS n, min(px) OVER (PARTITION BY entity ORDER BY day ROWS 120 PRECEDING) AS low, count(px) OVER (PARTITION BY entity ORDER BY day ROWS 120 PRECEDING) AS nl, min(px) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN CURRENT ROW AND 90 FOLLOWING) AS after, count(px) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN CURRENT ROW AND 90 FOLLOWING) AS na FROM px), cand AS (SELECT entity, day, px, row_number() OVER (PARTITION BY entity ORDER BY day) AS k FROM c WHERE n >= 22 AND px = top AND nl >= 60 AND px >= 1.25 * low AND na >= 5 AND after <= 0.85 * px), pw AS (SELECT entity, k, [{'day': day, 'px': px}] AS kept FROM cand WHERE k = 1 UNION ALL SELECT n.entity, n.k, CASE WHEN n.day - w.kept[-1].day >= 30 THEN list_append(w.kept, {'day': n.day, 'px': n.px}) WHEN n.px > w.kept[-1].px THEN list_append(w.kept[:-2], {'day': n.day, 'px': n.px}) ELSE w.kept END FROM pw w JOIN cand n ON n.entity = w.entity AND n.k = w.k + 1), pk0 AS (SELECT entity, arg_max(kept, k) AS kept FROM pw GROUP BY entity), pk AS (SELECT entity, unnest(kept).day AS peak, unnest(kept).px AS px FROM pk0)"


def peaks(spark, d, boom: float = 0.25, bust: float = 0.15):
    """Centred maxima after a boom and before a bust; of peaks within 30 days the higher stays."""
    px = F.col("px")
    frame = lambda a, b: W.by_entity().rowsBetween(a, b)
    mid, past, ahead = frame(-21, 21), frame(-120, 0), frame(0, 90)
    ok = (F.count(px).over(mid) >= 22) & (px == F.max(px).over(mid)) & (F.count(px).over(past) >= 60) & (px >= (1 + boom) * F.min(px).over(past)) & (F.count(px).over(ahead) >= 5) & (F.min(px).over(ahead) <= (1 - bust) * px)
    found = filled_prices(spark, d).withColumn("ok", ok).where("ok").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("day", "px"))).alias("all"))

    def fold(kept, x):
        last = F.element_at(kept, -1)
        apart = (F.size(kept) == 0) | (F.datediff(x["day"], last["day"]) >= 30)
        higher = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(x))
        return F.when(apart, F.concat(kept, F.array(x))).when(x["px"] > last["px"], higher).otherwise(kept)

    kept = F.aggregate("all", F.slice("all", 1, 0), fold)
    return found.select("entity", F.explode(kept).alias("p")).select("entity", F.col("p.day").alias("peak"), F.col("p.px").alias("px"))


@query(f"{SBASE}, {PEAK} SELECT entity, peak, px FROM pk")
def ground_truth_peaks(spark, d):
    return peaks(spark, d).select("entity", "peak", "px")


EPI = f"{PEAK}, ep AS (SELECT p.entity, p.peak, any_value(p.px) AS px, arg_min(x.day, (x.px, x.day)) AS trough, min(x.px) AS low FROM pk p JOIN px x ON x.entity = p.entity AND x.day BETWEEN p.peak - 120 AND p.peak AND x.px IS NOT NULL GROUP BY ALL), eb AS (SELECT e.*, (SELECT min(x.day) FROM px x WHERE x.entity = e.entity AND x.day BETWEEN e.peak AND e.peak + 90 AND x.px / e.px - 1 <= -0.15) AS bust FROM ep e)"


def episodes(spark, d):
    px = filled_prices(spark, d).where("px IS NOT NULL").select("entity", "day", F.col("px").alias("p"))
    pk = peaks(spark, d)
    near = pk.join(px, (pk["entity"] == px["entity"]) & (px["day"] >= F.date_sub("peak", 120)) & (px["day"] <= F.date_add("peak", 90))).drop(px["entity"])
    before = F.col("day") <= F.col("peak")
    return near.groupBy("entity", "peak", "px").agg(F.min_by(F.when(before, F.col("day")), F.when(before, F.struct("p", "day"))).alias("trough"), F.min(F.when(before, F.col("p"))).alias("low"), F.min(F.when((F.col("day") >= F.col("peak")) & (F.col("p") / F.col("px") - 1 <= -0.15), F.col("day"))).alias("bust"))


@query(f"{SBASE}, {EPI} SELECT entity, trough, peak, bust, round(px / low - 1, 4) AS boom, (peak - trough)::INT AS run_days, least(trough + 45, peak) AS onset_hi FROM eb")
def episode_catalog(spark, d):
    return episodes(spark, d).select("entity", "trough", "peak", "bust", F.round(F.col("px") / F.col("low") - 1, 4).alias("boom"), F.datediff("peak", "trough").alias("run_days"), F.least(F.date_add("trough", 45), "peak").alias("onset_hi"))


AL = f"{EPI}, al AS (SELECT entity, day FROM sig)"


@query(f"{SBASE}, {SIG}, {AL}, j AS (SELECT a.entity, a.day, max(CASE WHEN a.day BETWEEN e.trough AND least(e.trough + 45, e.peak) THEN 1 ELSE 0 END) AS hit, max(CASE WHEN a.day > least(e.trough + 45, e.peak) AND a.day <= e.peak THEN 1 ELSE 0 END) AS late FROM al a LEFT JOIN eb e ON e.entity = a.entity AND a.day BETWEEN e.trough AND e.peak GROUP BY ALL) SELECT entity, day, CASE WHEN hit = 1 THEN 'HIT' WHEN late = 1 THEN 'LATE' ELSE 'FA' END AS verdict FROM j")
def onset_judge(spark, d):
    """Alerts against episodes by entity: few episodes each, so the range is checked within the entity."""
    a, e = signals(spark, d).select("entity", "day"), episodes(spark, d).withColumn("hi", F.least(F.date_add("trough", 45), "peak")).withColumnRenamed("entity", "e")
    j = a.join(e, (F.col("entity") == F.col("e")) & F.col("day").between(F.col("trough"), F.col("peak")), "left")
    g = j.groupBy("entity", "day").agg(F.bool_or(F.col("day") <= F.col("hi")).alias("hit"), F.count("peak").alias("n"))
    return g.select("entity", "day", F.when(F.col("hit"), "HIT").when(F.col("n") > 0, "LATE").otherwise("FA").alias("verdict"))


@query(f"{SBASE}, {SIG}, {AL} SELECT a.entity, a.day, CASE WHEN EXISTS (FROM pk p WHERE p.entity = a.entity AND a.day BETWEEN p.peak - 30 AND p.peak + 1) THEN 'HIT' WHEN NOT EXISTS (FROM pk p WHERE p.entity = a.entity AND p.peak BETWEEN a.day AND a.day + 45) THEN 'FA' ELSE 'NEITHER' END AS verdict FROM al a")
def top_judge(spark, d):
    a, p = signals(spark, d).select("entity", "day"), peaks(spark, d).select(F.col("entity").alias("e"), "peak")
    j = a.join(p, (F.col("entity") == F.col("e")) & F.col("peak").between(F.date_sub("day", 1), F.date_add("day", 45)), "left")
    hit = F.bool_or(F.col("day").between(F.date_sub("peak", 30), F.date_add("peak", 1)))
    near = F.bool_or(F.col("peak") >= F.col("day"))
    g = j.groupBy("entity", "day").agg(F.coalesce(hit, F.lit(False)).alias("hit"), F.coalesce(near, F.lit(False)).alias("near"))
    return g.select("entity", "day", F.when(F.col("hit"), "HIT").when(~F.col("near"), "FA").otherwise("NEITHER").alias("verdict"))


@query(f"{SBASE}, {SIG}, {PEAK} SELECT s.entity, s.day FROM sig s WHERE NOT EXISTS (FROM pk p WHERE p.entity = s.entity AND p.peak BETWEEN s.day AND s.day + 45)")
def false_alarm_anti(spark, d):
    a, p = signals(spark, d).select("entity", "day"), peaks(spark, d).select(F.col("entity").alias("e"), "peak")
    return a.join(p, (F.col("entity") == F.col("e")) & F.col("peak").between(F.col("day"), F.date_add("day", 45)), "left_anti")


@query("WITH s AS (SELECT event_id, value AS score, (event_type = 'purchase')::INT AS y FROM events), g AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT score, p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(p) OVER () AS pos, sum(n) OVER () AS tot, sum(n) OVER (ORDER BY score) - (n - 1) / 2.0::DOUBLE AS rank FROM g) SELECT round(sum(p / pos * (tp / k)), 6) AS average_precision, round((sum(p * rank) - any_value(pos) * (any_value(pos) + 1) / 2.0) / (any_value(pos) * (any_value(tot) - any_value(pos))), 6) AS auroc FROM c".replace("sum(p / pos * (tp / k))", "sum(p::DOUBLE / pos * (tp::DOUBLE / k))"))
def auroc_ap(spark, d):
    """Counts by score first, so that the running sums go over distinct scores, range by range."""
    s = read(spark, d, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    g = W.running_sums(s.groupBy("score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")), "score", ["p", "n"])
    c = g.join(F.broadcast(g.agg(F.sum("p").alias("pos"), F.sum("n").alias("tot"))))  # one row of totals
    pos, tot = F.first("pos"), F.first("tot")
    tp, k, rank = F.col("pos") - F.col("run_p") + F.col("p"), F.col("tot") - F.col("run_n") + F.col("n"), F.col("run_n") - (F.col("n") - 1) / 2
    precision = F.sum(F.col("p") / F.col("pos") * tp / k)
    return c.agg(F.round(precision, 6).alias("average_precision"), F.round((F.sum(F.col("p") * rank) - pos * (pos + 1) / 2) / (pos * (tot - pos)), 6).alias("auroc"))
