"""Queries that judge alerts: labels, thresholds chosen on the past, ablation, calibration, resampling, event studies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import detector as D
from tidewatch.operators import windows as W
from tidewatch.operators.spacing import spaced
from tidewatch.plans import crowd as K
from tidewatch.plans import detect as P
from tidewatch.plans.daily import SBASE, filled_prices, pressure, r
from tidewatch.plans import daily

QUERIES, ORACLES = {}, {}
LEVELS = tuple(range(50, 90, 5))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def days_between(lo, hi, label: str):
    """An interval as its days: episodes are few and short, so range conditions become equi-joins on the day."""
    return F.transform(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<date>")), lambda x: F.struct(x.alias("day"), F.lit(label).alias("label")))


def labels(spark, d):
    e = P.episodes(spark, d).withColumn("hi", F.least(F.date_add("trough", 45), "peak"))
    spans = F.concat(days_between(F.col("trough"), F.col("hi"), "onset"), days_between(F.date_add("hi", 1), F.col("peak"), "late"), days_between(F.date_sub("peak", 30), F.date_add("peak", 1), "top"))
    marks = e.select("entity", F.explode(spans).alias("m")).groupBy("entity", F.col("m.day").alias("day")).agg(*(F.bool_or(F.col("m.label") == x).cast("int").alias(f"y_{x}") for x in ("onset", "late", "top")))
    out = filled_prices(spark, d).where("px IS NOT NULL").select("entity", "day").join(marks, ["entity", "day"], "left")
    return out.fillna(0, subset=["y_onset", "y_late", "y_top"])


EP = f"{P.EPI}, epi AS MATERIALIZED (SELECT entity, trough, least(trough + 45, peak) AS hi, peak FROM eb)"
LABEL = f"{EP}, lb AS MATERIALIZED (SELECT x.entity, x.day, coalesce(max((x.day BETWEEN trough AND hi)::INT), 0) AS y_onset, coalesce(max((x.day > hi AND x.day <= peak)::INT), 0) AS y_late, coalesce(max((x.day BETWEEN peak - 30 AND peak + 1)::INT), 0) AS y_top FROM px x LEFT JOIN epi e ON e.entity = x.entity AND x.day BETWEEN least(trough, peak - 30) AND peak + 1 WHERE x.px IS NOT NULL GROUP BY ALL)"


@query(f"{SBASE}, {LABEL} SELECT entity, day, y_onset::INT AS y_onset, y_late::INT AS y_late, y_top::INT AS y_top FROM lb")
def label_days(spark, d):
    return labels(spark, d)


def detectable(spark, d):
    """Peaks with whether the name was covered on any of the thirty days before."""
    pk = P.peaks(spark, d).select("entity", "peak")
    covered = D.features(K.crowd(spark, d)).where(F.col("posts28") >= K.THIN.coverage).select("entity", "day")
    hit = pk.select("entity", "peak", F.explode(F.sequence(F.date_sub("peak", 30), F.col("peak"))).alias("day")).join(covered, ["entity", "day"], "left_semi").select("entity", "peak").distinct().withColumn("seen", F.lit(True))
    return pk.join(hit, ["entity", "peak"], "left").fillna(False, subset=["seen"])


SEEN = f"p28 AS (SELECT entity, day, CASE WHEN count(*) OVER w >= 7 THEN sum(n) OVER w END AS posts28 FROM cw WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 27 PRECEDING)), seen AS MATERIALIZED (SELECT p.entity, p.peak, coalesce(bool_or(c.posts28 >= {K.THIN.coverage}), false) AS seen FROM pk p LEFT JOIN p28 c ON c.entity = p.entity AND c.day BETWEEN p.peak - 30 AND p.peak GROUP BY ALL)"


@query(f"{SBASE}, {K.CROWD}, {P.PEAK}, {SEEN} SELECT entity, peak, seen FROM seen")
def coverage_detectable(spark, d):
    return detectable(spark, d)


def in_window(spark, d, alerts):
    """Alerts between a name's first price and 45 days before its last."""
    lim = filled_prices(spark, d).where("px IS NOT NULL").groupBy("entity").agg(F.min("day").alias("lo"), F.date_sub(F.max("day"), 45).alias("hi"))
    return alerts.join(lim, "entity").where(F.col("day").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def judged(alerts, peaks, keys):
    """Captured peaks (keys, entity, peak, day) and alerts with the year of the nearest peak within 45 days on."""
    p = peaks.select(F.col("entity").alias("e"), "peak")
    j = alerts.join(p, (F.col("entity") == F.col("e")) & F.col("peak").between(F.date_sub("day", 1), F.date_add("day", 45)), "left")
    caught = j.where(F.col("peak") <= F.date_add("day", 30)).select(*keys, "entity", "peak", "day")
    return caught, j.groupBy(*keys, "entity", "day").agg(F.min(F.when(F.col("peak") >= F.col("day"), F.year("peak"))).alias("near"))


ALL_LEVELS = f"lv AS (SELECT unnest({list(LEVELS)}) AS thr), tg AS (SELECT entity, thr, day FROM det, lv WHERE coalesce(covered AND hype AND e1 >= {K.THIN.attention} AND e2 > 0 AND (level >= thr OR (level >= thr - 10 AND fade)), false)), {K.spacing_sql('tg', ['entity', 'thr'], 21, 'al0')}, lim AS (SELECT entity, min(day) AS lo, max(day) - 45 AS hi FROM px WHERE px IS NOT NULL GROUP BY entity), al1 AS MATERIALIZED (SELECT a.* FROM al0 a JOIN lim USING (entity) WHERE day BETWEEN lo AND hi)"
WALK = f"""{SBASE}, {K.det_sql()}, {P.PEAK}, {SEEN}, {ALL_LEVELS}, dp AS (SELECT entity, peak FROM seen WHERE seen),
ys0 AS (SELECT DISTINCT year(day) AS y FROM det WHERE level IS NOT NULL), ys AS (SELECT y FROM ys0 WHERE y > (SELECT min(y) FROM ys0)),
cp AS MATERIALIZED (SELECT a.thr, a.entity, p.peak, min(greatest(year(a.day), year(p.peak))) AS cy, bool_or(year(a.day) = year(p.peak)) AS same FROM al1 a JOIN dp p ON p.entity = a.entity AND a.day BETWEEN p.peak - 30 AND p.peak + 1 GROUP BY ALL),
fa AS MATERIALIZED (SELECT a.thr, a.entity, a.day, year(a.day) AS ay, (SELECT min(year(p.peak)) FROM dp p WHERE p.entity = a.entity AND p.peak BETWEEN a.day AND a.day + 45) AS near FROM al1 a),
tr AS (SELECT y, thr, (SELECT count(*) FROM cp WHERE cp.thr = lv.thr AND cy < y) - (SELECT count(*) FROM fa WHERE fa.thr = lv.thr AND ay < y AND (near IS NULL OR near >= y)) AS u FROM ys, lv),
bt AS (SELECT y, arg_max(thr, (u, thr)) AS thr FROM tr GROUP BY y)
SELECT y::INT AS year, thr::INT AS threshold, (SELECT count(*) FROM pk WHERE year(peak) = y) AS peaks, (SELECT count(*) FROM dp WHERE year(peak) = y) AS detectable, (SELECT count(*) FROM cp WHERE cp.thr = bt.thr AND year(peak) = y AND same) AS captured, (SELECT count(*) FROM fa WHERE fa.thr = bt.thr AND ay = y AND (near IS NULL OR near != y)) AS false_alarms FROM bt"""


@query(WALK)
def walk_forward_threshold(spark, d):
    """Each year's level is the one that did best on the years before (captured peaks less false alarms; ties to the higher level)."""
    f = K.cut_detector(spark, d)
    levels = F.array(*map(F.lit, LEVELS))
    tried = f.withColumn("thr", F.explode(levels))
    ok = F.col("covered") & F.col("hype") & (F.col("e1") >= K.THIN.attention) & (F.col("e2") > 0) & ((F.col("level") >= F.col("thr")) | ((F.col("level") >= F.col("thr") - 10) & F.col("fade")))
    a = in_window(spark, d, spaced(tried.where(ok).select("entity", "thr", "day"), ["entity", "thr"], 21))
    pk = detectable(spark, d)
    caught, near = judged(a, pk.where("seen"), ["thr"])
    c = caught.groupBy("thr", "entity", "peak").agg(F.min(F.greatest(F.year("day"), F.year("peak"))).alias("cy"), F.bool_or(F.year("day") == F.year("peak")).alias("same"))
    c = c.groupBy("thr", "cy", F.year("peak").alias("py"), "same").agg(F.count(F.lit(1)).alias("k"))
    false = near.groupBy("thr", F.year("day").alias("ay"), "near").agg(F.count(F.lit(1)).alias("k"))
    ys = f.where("level IS NOT NULL").select(F.year("day").alias("y")).distinct()
    ys = ys.join(F.broadcast(ys.agg(F.min("y").alias("y0")))).where("y > y0").select("y", F.explode(levels).alias("thr"))
    # tallies are a few rows per level and year, so the sides stay small whatever the corpus
    hits = ys.join(c, "thr").groupBy("y", "thr").agg(F.sum(F.when(F.col("cy") < F.col("y"), F.col("k"))).alias("hits"), F.sum(F.when((F.col("py") == F.col("y")) & F.col("same"), F.col("k"))).alias("captured"))
    wrong = ys.join(false, "thr").groupBy("y", "thr").agg(F.sum(F.when((F.col("ay") < F.col("y")) & (F.col("near").isNull() | (F.col("near") >= F.col("y"))), F.col("k"))).alias("fas"), F.sum(F.when((F.col("ay") == F.col("y")) & (F.col("near").isNull() | (F.col("near") != F.col("y"))), F.col("k"))).alias("false_alarms"))
    t = ys.join(hits, ["y", "thr"], "left").join(wrong, ["y", "thr"], "left").fillna(0)
    best = t.groupBy("y").agg(F.max_by(F.struct("thr", "captured", "false_alarms"), F.struct(F.col("hits") - F.col("fas"), F.col("thr"))).alias("b"))
    n = pk.groupBy(F.year("peak").alias("y")).agg(F.count(F.lit(1)).alias("peaks"), F.count_if("seen").alias("detectable"))
    return best.join(n, "y", "left").select(F.col("y").alias("year"), F.col("b.thr").alias("threshold"), F.coalesce("peaks", F.lit(0)).alias("peaks"), F.coalesce("detectable", F.lit(0)).alias("detectable"), "b.captured", "b.false_alarms")


GATES = {"full": "", "no_e1": "e1", "no_e2": "e2", "no_e3": "e3", "no_e5": "e5", "no_hype": "hype", "no_attention": "attention", "no_persistence": "persistence", "no_fade": "fade"}


def _variant_sql(name: str, gone: str) -> str:
    level = K._mean([p for p in D.PARTS if p != gone], 100) if gone in D.PARTS else "level"
    gates = [g for k, g in (("hype", "hype"), ("attention", f"e1 >= {K.THIN.attention}"), ("persistence", "e2 > 0")) if k != gone]
    high = f"{level} >= {K.THIN.level}" + ("" if gone == "fade" else f" OR ({level} >= {K.THIN.level - 10} AND fade)")
    return f"SELECT '{name}' AS variant, entity, day FROM det WHERE coalesce(covered AND {' AND '.join(gates)} AND ({high}), false)"


@query(f"{SBASE}, {K.det_sql()}, {P.PEAK}, {SEEN}, ab AS ({' UNION ALL '.join(_variant_sql(*v) for v in GATES.items())}), {K.spacing_sql('ab', ['variant', 'entity'], 21, 'av')}, dp AS (SELECT entity, peak FROM seen WHERE seen), tl AS (SELECT variant, count(*) AS alerts, count(*) FILTER (NOT EXISTS (FROM dp p WHERE p.entity = av.entity AND p.peak BETWEEN av.day AND av.day + 45)) AS false_alarms FROM av GROUP BY variant), ct AS (SELECT variant, count(DISTINCT (p.entity, p.peak)) AS captured FROM av JOIN dp p ON p.entity = av.entity AND av.day BETWEEN p.peak - 30 AND p.peak + 1 GROUP BY variant), al AS (SELECT variant, alerts, coalesce(captured, 0) AS captured, false_alarms FROM tl LEFT JOIN ct USING (variant)) SELECT *, captured - (SELECT captured FROM al WHERE variant = 'full') AS captured_change, false_alarms - (SELECT false_alarms FROM al WHERE variant = 'full') AS false_alarm_change FROM al")
def ablation_level(spark, d):
    """The detector without one component or gate at a time."""
    f = K.detector(spark, d)
    for p in D.PARTS:
        f = f.withColumn(f"level_{p}", F.round(100 * D.mean_of(*(x for x in D.PARTS if x != p)), 6))
    on = [F.when(D.triggers(K.THIN, f"level_{gone}" if gone in D.PARTS else "level", gone), F.lit(name)) for name, gone in GATES.items()]
    a = spaced(f.select("entity", "day", F.explode(F.array_compact(F.array(*on))).alias("variant")), ["variant", "entity"], 21)
    caught, near = judged(a, detectable(spark, d).where("seen"), ["variant"])
    t = near.groupBy("variant").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("near").isNull()).alias("false_alarms"))
    t = t.join(caught.groupBy("variant").agg(F.countDistinct("entity", "peak").alias("captured")), "variant", "left").fillna(0)
    full = t.where("variant = 'full'").select(F.col("captured").alias("c0"), F.col("false_alarms").alias("f0"))
    return t.join(F.broadcast(full), how="left").select("variant", "alerts", "captured", "false_alarms", (F.col("captured") - F.col("c0")).alias("captured_change"), (F.col("false_alarms") - F.col("f0")).alias("false_alarm_change"))


QUANTILES = [k / 1000 for k in range(500, 1000, 25)]
BUDGET = 2.0


@query(f"{SBASE}, {K.det_sql()}, {P.PEAK}, {SEEN}, ty AS (SELECT max(year(day)) AS last, count(DISTINCT year(day)) - 1 AS years, count(DISTINCT entity) AS names FROM det WHERE level IS NOT NULL), sc0 AS (SELECT entity, day, level FROM det, ty WHERE level IS NOT NULL AND year(day) < last), gr AS (SELECT DISTINCT round(unnest(quantile_cont(level, {QUANTILES})), 5) AS thr FROM sc0), bg AS (SELECT thr, entity, day FROM sc0, gr WHERE level >= thr), {K.spacing_sql('bg', ['entity', 'thr'], 21, 'ba')}, bf AS (SELECT thr, count(*) FILTER (NOT EXISTS (FROM pk p WHERE p.entity = ba.entity AND p.peak BETWEEN ba.day AND ba.day + 45) AND NOT EXISTS (FROM pk p WHERE p.entity = ba.entity AND ba.day BETWEEN p.peak - 30 AND p.peak + 1)) AS false_alarms FROM ba GROUP BY thr), bc AS (SELECT thr, count(DISTINCT (p.entity, p.peak)) AS captured FROM ba JOIN seen p ON p.entity = ba.entity AND ba.day BETWEEN p.peak - 30 AND p.peak + 1 CROSS JOIN ty WHERE p.seen AND year(p.peak) < last GROUP BY thr), bt AS (SELECT thr, coalesce(captured, 0) AS captured, false_alarms, false_alarms / (names * years)::DOUBLE AS rate FROM bf LEFT JOIN bc USING (thr) CROSS JOIN ty) SELECT round(thr, 4) AS threshold, captured, false_alarms, round(rate, 6) AS rate, thr = coalesce((SELECT arg_max(thr, (captured, thr)) FROM bt WHERE rate <= {BUDGET}), (SELECT max(thr) FROM bt)) AS chosen FROM bt")
def budget_threshold(spark, d):
    """Of the percentiles of the past scores, the one that captures most within a budget of false alarms per name and year; else the highest."""
    s = K.cut_detector(spark, d).where("level IS NOT NULL").select("entity", "day", "level")
    ty = s.agg(F.max(F.year("day")).alias("last"), (F.countDistinct(F.year("day")) - 1).alias("years"), F.countDistinct("entity").alias("names"))
    past = s.join(F.broadcast(ty)).where(F.year("day") < F.col("last"))
    grid = past.agg(F.array_distinct(F.transform(F.percentile("level", F.array(*map(F.lit, QUANTILES))), lambda x: F.round(x, 5))).alias("grid"))
    tried = past.join(F.broadcast(grid)).select("entity", "day", "level", F.explode("grid").alias("thr")).where("level >= thr")
    a = spaced(tried.select("entity", "thr", "day"), ["entity", "thr"], 21)
    p = detectable(spark, d).select(F.col("entity").alias("e"), "peak", "seen")
    j = a.join(p, (F.col("entity") == F.col("e")) & F.col("peak").between(F.date_sub("day", 1), F.date_add("day", 45)), "left")
    none = j.groupBy("thr", "entity", "day").agg(F.count("peak").alias("k")).groupBy("thr").agg(F.count_if(F.col("k") == 0).alias("false_alarms"))
    ok = j.where("seen").where(F.col("peak") <= F.date_add("day", 30)).join(F.broadcast(ty)).where(F.year("peak") < F.col("last"))
    t = none.join(ok.groupBy("thr").agg(F.countDistinct("entity", "peak").alias("captured")), "thr", "left").fillna(0).join(F.broadcast(ty))
    t = t.withColumn("rate", F.col("false_alarms") / (F.col("names") * F.col("years")))
    pick = t.agg(F.coalesce(F.max_by("thr", F.when(F.col("rate") <= BUDGET, F.struct("captured", "thr"))), F.max("thr")).alias("pick"))
    return t.join(F.broadcast(pick)).select(F.round("thr", 4).alias("threshold"), "captured", "false_alarms", F.round("rate", 6).alias("rate"), (F.col("thr") == F.col("pick")).alias("chosen"))


@query(f"{SBASE}, {K.det_sql()}, {LABEL} SELECT least(floor(level / 10), 9)::INT AS bucket, count(*) AS days, round(avg(y_top::DOUBLE), 6) AS rate FROM det JOIN lb USING (entity, day) WHERE level IS NOT NULL GROUP BY 1")
def calibration_buckets(spark, d):
    f = K.detector(spark, d).where("level IS NOT NULL").select("entity", "day", "level").join(labels(spark, d), ["entity", "day"])
    return f.groupBy(F.least(F.floor(F.col("level") / 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("y_top"), 6).alias("rate"))


_EDGES = [k / 10 for k in range(1, 10)]


@query(f"{SBASE}, {daily.PRESS}, fw AS (SELECT p.entity, round(bp7, 6) AS x, lead(px, 20) OVER w / px - 1 AS y FROM pr p JOIN px USING (entity, day) WINDOW w AS (PARTITION BY p.entity ORDER BY p.day)), fe AS (SELECT quantile_cont(x, {_EDGES}) AS edges FROM fw WHERE y IS NOT NULL) SELECT len(list_filter(list_distinct(edges), lambda e: e < x))::INT AS decile, count(*) AS n, round(avg(y), 6) + 0.0 AS mean FROM fw, fe WHERE y IS NOT NULL GROUP BY 1")
def forward_decile(spark, d):
    """Forward moves by decile of pressure; equal edges fall together."""
    p = pressure(spark, d).join(filled_prices(spark, d).select("day", "entity", "px"), ["day", "entity"])
    f = p.select(F.round("bp7", 6).alias("x"), (F.lead("px", 20).over(W.by_entity()) / F.col("px") - 1).alias("y")).where("y IS NOT NULL")
    edges = f.agg(F.array_distinct(F.percentile("x", F.array(*map(F.lit, _EDGES)))).alias("edges"))
    decile = F.size(F.filter("edges", lambda e: e < F.col("x")))
    return f.join(F.broadcast(edges)).groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("y"), 6).alias("mean"))


POISSON = (0.36788, 0.73576, 0.9197, 0.98101, 0.99634)
DRAWS = 200


@query(f"{SBASE}, {P.RET}, nm AS (SELECT entity, sum(pnl) AS s, count(pnl) AS n FROM ret GROUP BY entity), dw AS (SELECT entity, s, n, b, ('0x' || substr(md5(entity || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM nm, (SELECT unnest(range({DRAWS})) AS b)), ww AS (SELECT *, {' + '.join(f'(u >= {p})::INT' for p in POISSON)} AS w FROM dw), ms AS (SELECT b, sum(w * s) / nullif(sum(w * n), 0) AS m FROM ww GROUP BY b) SELECT count(m) AS draws, round(quantile_cont(m, 0.05), 5) + 0.0 AS low, round(quantile_cont(m, 0.5), 5) + 0.0 AS mid, round(quantile_cont(m, 0.95), 5) + 0.0 AS high FROM ms")
def cluster_bootstrap(spark, d):
    """Interval of the mean return with names drawn as clusters: per-name sums first, then Poisson weights from a hash of name and draw."""
    names = P.returns(spark, d).groupBy("entity").agg(F.sum("pnl").alias("s"), F.count("pnl").alias("n"))
    x = names.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "entity", "b")), 1, 8), 16, 10).cast("long") / 4294967296.0
    x = x.withColumn("u", u).withColumn("w", sum(((F.col("u") >= p).cast("int") for p in POISSON), F.lit(0)))
    m = x.groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    return m.agg(F.count("m").alias("draws"), *(r(F.percentile("m", F.lit(q)), 5).alias(c) for q, c in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))))


STARTS = f"{P.SIG}, sx AS (SELECT entity, day, buy FROM sig)"


@query(f"{SBASE}, {STARTS} SELECT s.entity, s.day, EXISTS (FROM sx e WHERE NOT e.buy AND e.entity = s.entity AND s.day - e.day BETWEEN 0 AND 20) AS dropped, EXISTS (FROM sx e WHERE NOT e.buy AND e.entity = s.entity AND e.day - s.day BETWEEN 0 AND 21) AS adjacent FROM sx s WHERE s.buy")
def start_end_coherence(spark, d):
    """Starts within three weeks after an end are dropped; starts with an end within three weeks after count as adjacent."""
    s = P.signals(spark, d)
    e = s.where("NOT buy").select(F.col("entity").alias("e"), F.col("day").alias("end"))
    j = s.where("buy").join(e, (F.col("entity") == F.col("e")) & F.col("end").between(F.date_sub("day", 20), F.date_add("day", 21)), "left")
    gap = F.datediff("day", "end")
    return j.groupBy("entity", "day").agg(F.coalesce(F.bool_or(gap.between(0, 20)), F.lit(False)).alias("dropped"), F.coalesce(F.bool_or(gap.between(-21, 0)), F.lit(False)).alias("adjacent"))


@query(f"{SBASE}, {P.SIG}, {EP}, fx AS (SELECT s.entity, s.day FROM sig s WHERE NOT EXISTS (FROM epi e WHERE e.entity = s.entity AND s.day BETWEEN e.trough AND e.peak)) SELECT CASE WHEN EXISTS (FROM epi e WHERE e.entity = f.entity AND e.trough - f.day BETWEEN 1 AND 90) THEN 'early' WHEN EXISTS (FROM epi e WHERE e.entity = f.entity AND f.day - e.peak BETWEEN 1 AND 90) THEN 'post_peak' ELSE 'isolated' END AS kind, count(*) AS n FROM fx f GROUP BY 1")
def fa_anatomy(spark, d):
    a = P.onset_judge(spark, d).where("verdict = 'FA'").select("entity", "day")
    e = P.episodes(spark, d).select(F.col("entity").alias("e"), "trough", "peak")
    j = a.join(e, (F.col("entity") == F.col("e")) & (F.col("trough").between(F.date_add("day", 1), F.date_add("day", 90)) | F.col("peak").between(F.date_sub("day", 90), F.date_sub("day", 1))), "left")
    k = j.groupBy("entity", "day").agg(F.bool_or(F.datediff("trough", "day").between(1, 90)).alias("early"), F.count("peak").alias("k"))
    return k.groupBy(F.when(F.col("early"), "early").when(F.col("k") > 0, "post_peak").otherwise("isolated").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{SBASE}, {EP} SELECT year(e.peak)::INT AS year, count(*) AS episodes, count(e.bust) AS busts, round(avg((e.peak - e.trough)::DOUBLE), 4) AS run_days FROM eb e GROUP BY 1")
def episodes_per_year(spark, d):
    return P.episodes(spark, d).groupBy(F.year("peak").alias("year")).agg(F.count(F.lit(1)).alias("episodes"), F.count("bust").alias("busts"), F.round(F.avg(F.datediff("peak", "trough")), 4).alias("run_days"))


@query(f"WITH tj AS ({P.ORACLES['top_judge']}) SELECT entity, count(*) AS alerts, count(*) FILTER (verdict = 'HIT') AS hits, count(*) FILTER (verdict = 'FA') AS false_alarms FROM tj GROUP BY entity")
def per_name_table(spark, d):
    return P.top_judge(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("verdict") == "HIT").alias("hits"), F.count_if(F.col("verdict") == "FA").alias("false_alarms"))


@query(f"{SBASE}, {P.SIG}, ko AS (SELECT unnest(range(-21, 85))::INT AS k), pt AS (SELECT s.entity, k, avg(b.px / a.px) AS m FROM sig s JOIN px a ON a.entity = s.entity AND a.day = s.day JOIN ko ON true JOIN px b ON b.entity = s.entity AND b.day = s.day + k WHERE a.px IS NOT NULL AND b.px IS NOT NULL GROUP BY ALL) SELECT k, count(*) AS names, round(avg(m), 6) AS mean, round(median(m), 6) AS median FROM pt GROUP BY k")
def event_study(spark, d):
    """Price paths around alerts: per name first, then across names."""
    px = filled_prices(spark, d).where("px IS NOT NULL").select("entity", "day", "px")
    a = P.signals(spark, d).select("entity", "day").join(px, ["entity", "day"]).select("entity", F.col("px").alias("p0"), "day", F.explode(F.sequence(F.lit(-21), F.lit(84))).alias("k"))
    a = a.select("entity", "p0", "k", F.expr("date_add(day, k)").alias("day"))
    m = a.join(px, ["entity", "day"]).groupBy("entity", "k").agg(F.avg(F.col("px") / F.col("p0")).alias("m"))
    return m.groupBy("k").agg(F.count(F.lit(1)).alias("names"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.5)), 6).alias("median"))


_H = (3, 10, 21, 84)
_FW = ", ".join(f"lead(px, {h}) OVER o / px - 1 AS f{h}" for h in _H)


@query(f"{SBASE}, {P.SIG}, dr AS (SELECT entity, day, px, coalesce(min(px) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) <= 0.9 * px, false) AS c, {_FW} FROM px WINDOW o AS (PARTITION BY entity ORDER BY day)), cl AS (SELECT *, bool_or(c) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING) AS cliff, EXISTS (FROM sig s WHERE s.entity = dr.entity AND s.day = dr.day) AS alert FROM dr) SELECT alert, count(*) AS days, round(avg(cliff::INT::DOUBLE), 6) AS cliff_rate, {', '.join(f'round(avg(f{h}), 6) + 0.0 AS f{h}' for h in _H)} FROM cl WHERE px IS NOT NULL GROUP BY alert")
def forward_table(spark, d):
    """Forward moves and the rate of cliffs (a tenth lost within a week that starts within thirty days) on alert days and others."""
    o = W.by_entity()
    p = filled_prices(spark, d).select("entity", "day", "px")
    p = p.withColumns({"c": F.coalesce(F.min("px").over(o.rowsBetween(1, 7)) <= 0.9 * F.col("px"), F.lit(False)), **{f"f{h}": F.lead("px", h).over(o) / F.col("px") - 1 for h in _H}})
    p = p.withColumn("cliff", F.bool_or("c").over(o.rowsBetween(0, 30))).where("px IS NOT NULL")
    a = P.signals(spark, d).select("entity", "day", F.lit(True).alias("alert"))
    p = p.join(a, ["entity", "day"], "left").fillna(False, subset=["alert"])
    return p.groupBy("alert").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(F.col("cliff").cast("int")), 6).alias("cliff_rate"), *(r(F.avg(f"f{h}"), 6).alias(f"f{h}") for h in _H))


@query(f"{SBASE}, xy AS (SELECT s.entity, s.n::DOUBLE AS x, round(px, 6) AS y FROM swide s JOIN px USING (entity, day) WHERE px IS NOT NULL), rx AS (SELECT entity, x, y, rank() OVER (PARTITION BY entity ORDER BY x) + (count(*) OVER (PARTITION BY entity, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY entity ORDER BY y) + (count(*) OVER (PARTITION BY entity, y) - 1) / 2.0::DOUBLE AS b FROM xy) SELECT entity, count(*) AS n, round(corr(x, y), 5) + 0.0 AS pearson, round(corr(a, b), 5) + 0.0 AS spearman FROM rx GROUP BY entity")
def correlations(spark, d):
    f = daily.swide(spark, d).join(filled_prices(spark, d).select("entity", "day", F.round("px", 6).alias("y")), ["entity", "day"]).where("y IS NOT NULL").withColumn("x", F.col("n").cast("double"))
    rank = lambda c: F.rank().over(Window.partitionBy("entity").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("entity", c)) - 1) / 2
    f = f.withColumns({"a": rank("x"), "b": rank("y")})
    return f.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), r(F.corr("x", "y"), 5).alias("pearson"), r(F.corr("a", "b"), 5).alias("spearman"))


@query(f"{SBASE}, {P.RET} SELECT CASE WHEN year(day) <= 1996 THEN 'early' WHEN year(day) <= 1998 THEN 'middle' ELSE 'late' END AS era, action, count(pnl) AS n, CASE WHEN count(pnl) >= 4 THEN round(avg(pnl), 4) + 0.0 END AS mean, CASE WHEN count(pnl) >= 4 THEN round(100.0 * count(*) FILTER (pnl > 0) / count(pnl), 4) END AS hit FROM ret GROUP BY ALL")
def era_stats(spark, d):
    y, n = F.year("day"), F.count("pnl")
    era = F.when(y <= 1996, "early").when(y <= 1998, "middle").otherwise("late")
    return P.returns(spark, d).groupBy(era.alias("era"), "action").agg(n.alias("n"), F.when(n >= 4, r(F.avg("pnl"))).alias("mean"), F.when(n >= 4, F.round(100.0 * F.count_if(F.col("pnl") > 0) / n, 4)).alias("hit"))
