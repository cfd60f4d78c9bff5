"""Queries over daily counts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import aggregates as A
from tidewatch.operators import calendar as C
from tidewatch.operators import windows as W
from tidewatch.operators.spacing import spaced
from tidewatch.sources.tables import BASE, SBASE, mentions, read, scored

QUERIES, ORACLES = {}, {}
CUT = "1998-06-01"
K = 2.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 4):
    return F.round(c, digits) + F.lit(0.0)


def wide(spark, d):
    return C.on_spine(A.daily_counts(mentions(spark, d)), zero=["n"])


def swide(spark, d):
    sent = A.daily_sentiment(scored(spark, d))
    full = C.on_spine(sent.select("day", "entity", F.col("n_posts").alias("n"), (F.col("n_posts") * F.col("net_bullish")).alias("bp")), zero=["n"])
    return full.withColumn("bp", F.coalesce("bp", F.lit(0.0)))


@query(f"{BASE} SELECT day, entity, n FROM cnt")
def daily_entity_counts(spark, d):
    return A.daily_counts(mentions(spark, d))


@query(f"{BASE} SELECT day, entity, source, count(*) AS n FROM ev GROUP BY ALL")
def daily_counts_by_source(spark, d):
    return A.daily_counts(mentions(spark, d), "entity", "source")


@query(f"{SBASE}, m AS (SELECT DISTINCT p_brand AS entity, p_type AS theme FROM part WHERE p_size <= 5) SELECT day, theme, sum(n_posts)::BIGINT AS n FROM sent JOIN m USING (entity) GROUP BY ALL")
def theme_rollup(spark, d):
    """One brand feeds several themes."""
    themes = read(spark, d, "part").where("p_size <= 5").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("theme")).distinct()
    return A.daily_counts(scored(spark, d)).join(themes, "entity").groupBy("day", "theme").agg(F.sum("n").alias("n"))


@query(f"{SBASE}, a AS (SELECT day, kind, count(*) AS n FROM sc WHERE source = 'R' GROUP BY ALL), b AS (SELECT day, kind, count(*) AS n FROM sc WHERE source = 'A' GROUP BY ALL) SELECT day, kind, coalesce(a.n, 0) AS keyword, coalesce(b.n, 0) AS inferred, coalesce(a.n, 0) + coalesce(b.n, 0) AS combined FROM a FULL JOIN b USING (day, kind)")
def combined_signals(spark, d):
    posts = scored(spark, d)
    a, b = (A.daily_counts(posts.where(F.col("source") == s), "kind").withColumnRenamed("n", name) for s, name in (("R", "keyword"), ("A", "inferred")))
    both = a.join(b, ["day", "kind"], "outer").fillna(0, subset=["keyword", "inferred"])
    return both.withColumn("combined", F.col("keyword") + F.col("inferred"))


@query(f"{BASE} SELECT day, entity, n FROM cnt")
def counts_merge(spark, d):
    posts = mentions(spark, d)
    old, new = (A.daily_counts(posts.where(F.pmod("id", F.lit(3)) == k) if k else posts.where(F.pmod("id", F.lit(3)) != 1)) for k in (0, 1))
    return A.merge_counts(old, new, ["day", "entity"])


@query(f"{SBASE} SELECT day, entity, n_posts, round(avg_sentiment, 6) + 0.0 AS avg_sentiment, round(net_bullish, 6) + 0.0 AS net_bullish FROM sent")
def sentiment_merge(spark, d):
    posts = scored(spark, d)
    out = A.merge_sentiment(A.daily_sentiment(posts.where("source = 'N'")), A.daily_sentiment(posts.where("source != 'N'")), ["day", "entity"])
    return out.select("day", "entity", "n_posts", r(F.col("avg_sentiment"), 6).alias("avg_sentiment"), r(F.col("net_bullish"), 6).alias("net_bullish"))


@query(f"{BASE} SELECT day, entity, n FROM cnt WHERE day < DATE '{CUT}' UNION ALL SELECT day, entity, count(*) FROM ev WHERE day >= DATE '{CUT}' AND source != '1-URGENT' GROUP BY ALL")
def tail_splice(spark, d):
    posts = mentions(spark, d)
    return A.splice(A.daily_counts(posts), A.daily_counts(posts.where("source != '1-URGENT'")), CUT)


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY ALL".replace("min(event_id) AS event_id", "arg_min(event_id, (ts, event_id)) AS event_id"))
def first_seen_dedup(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return A.first_seen(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def last_wins_dedup(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return A.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"{BASE} SELECT day, entity, n FROM wide")
def calendar_spine_counts(spark, d):
    return wide(spark, d)


@query(f"{SBASE} SELECT day, entity, px FROM px")
def price_ffill(spark, d):
    return filled_prices(spark, d).select("day", "entity", "px")


def filled_prices(spark, d):
    from tidewatch.sources.tables import prices

    posts = scored(spark, d)
    return C.forward_fill(C.on_spine(prices(spark, d), C.day_span(posts)), "px")


@query(f"{SBASE}, {BASE.split('RECURSIVE ')[1].split(', cnt')[0]} SELECT min(day) AS lo, max(day) AS hi, count(*) AS days FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM (SELECT day FROM ev UNION ALL SELECT day FROM sc))")
def shared_day_span(spark, d):
    return C.day_span(mentions(spark, d), scored(spark, d)).agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count(F.lit(1)).alias("days"))


SHARE = "sh AS (SELECT day, entity, n, sum(n) OVER (PARTITION BY day) AS total, CASE WHEN sum(n) OVER (PARTITION BY day) >= 3 THEN 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY day) END AS raw FROM wide), share AS (SELECT *, avg(raw) OVER (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING) AS share FROM sh)"


def share(spark, d, thin: int = 3):
    """Share of the day's total in percent, thin days masked, smoothed over seven days."""
    total = F.sum("n").over(Window.partitionBy("day"))
    raw = wide(spark, d).withColumn("raw", F.when(total >= thin, 100.0 * F.col("n") / total))
    return raw.withColumn("share", W.roll_mean(F.col("raw"), 7))


@query(f"{BASE}, {SHARE} SELECT day, entity, round(share, 4) + 0.0 AS share FROM share")
def mention_share(spark, d):
    return share(spark, d).select("day", "entity", r(F.col("share")).alias("share"))


@query(f"{BASE}, {SHARE.replace('>= 3 THEN', '>= 30 THEN')} SELECT day, entity, round(share, 4) + 0.0 AS share FROM share")
def mention_share_30(spark, d):
    """With the floor for dense series: days of under 30 posts have no share."""
    return share(spark, d, 30).select("day", "entity", r(F.col("share")).alias("share"))


@query(f"{BASE}, {SHARE}, dv AS (SELECT day, entity, share - lag(share) OVER (PARTITION BY entity ORDER BY day) AS v FROM share) SELECT day, entity, round(avg(v) OVER (PARTITION BY entity ORDER BY day ROWS 4 PRECEDING), 4) + 0.0 AS change FROM dv")
def chatter_derivative(spark, d):
    v = share(spark, d).withColumn("v", W.delta(F.col("share")))
    return v.select("day", "entity", r(W.roll_mean(F.col("v"), 5)).alias("change"))


@query(f"{BASE}, {SHARE}, dv AS (SELECT day, entity, share - lag(share) OVER (PARTITION BY entity ORDER BY day) AS v FROM share), rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS k FROM dv WHERE v IS NOT NULL) SELECT entity, round(avg(v), 5) + 0.0 AS pace, count(*) AS days FROM rk WHERE k <= 14 GROUP BY entity")
def emerging_rank(spark, d):
    v = share(spark, d).withColumn("v", W.delta(F.col("share"))).where("v IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("day")))
    return v.withColumn("k", k).where("k <= 14").groupBy("entity").agg(r(F.avg("v"), 5).alias("pace"), F.count(F.lit(1)).alias("days"))


@query(f"{SBASE} SELECT entity, sum(n_posts)::BIGINT AS n FROM sent GROUP BY entity ORDER BY n DESC, entity LIMIT 10")
def top_trends(spark, d):
    return A.daily_counts(scored(spark, d)).groupBy("entity").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity").limit(10)


_NAMES = "q AS (SELECT entity FROM sent GROUP BY entity HAVING sum(n_posts) >= {floor}), p AS (SELECT DISTINCT entity FROM px0) SELECT entity, sum(n_posts)::BIGINT AS n FROM sent SEMI JOIN q USING (entity) SEMI JOIN p USING (entity) GROUP BY entity ORDER BY n DESC, entity LIMIT 25"


def largest_names(spark, d, floor: int):
    """The 25 most named that have a price and that many posts; ties by name."""
    from tidewatch.sources.tables import prices

    total = A.daily_counts(scored(spark, d)).groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") >= floor)
    return total.join(prices(spark, d).select("entity").distinct(), "entity", "left_semi").orderBy(F.desc("n"), "entity").limit(25)


@query(f"{SBASE}, {_NAMES.format(floor=100)}")
def single_name_universe(spark, d):
    return largest_names(spark, d, 100)


@query(f"{SBASE}, {_NAMES.format(floor=3000)}")
def single_name_universe_3000(spark, d):
    return largest_names(spark, d, 3000)


ZQ = "s7 AS (SELECT day, entity, n, sum(n) OVER (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING) AS s FROM wide), zz AS (SELECT day, entity, n, s, CASE WHEN count(s) OVER w >= 28 THEN (s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0) END AS z FROM s7 WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 83 PRECEDING))"


def z_frame(spark, d):
    s = wide(spark, d).withColumn("s", F.sum("n").over(W.trailing(7)).cast("double"))
    return s.withColumn("z", W.trailing_z(F.col("s")))


@query(f"{BASE}, {ZQ} SELECT day, entity, s::BIGINT AS s, round(z, 4) + 0.0 AS z FROM zz")
def trailing_z(spark, d):
    return z_frame(spark, d).select("day", "entity", F.col("s").cast("long").alias("s"), r(F.col("z")).alias("z"))


@query(f"{BASE}, {ZQ}, p AS (SELECT *, lag(z) OVER (PARTITION BY entity ORDER BY day) AS before FROM zz) SELECT entity, day AS signal_day, day + 1 AS action_day, round(z, 4) AS z FROM p WHERE z > {K} AND before <= {K}")
def zscore_crossings(spark, d):
    z = z_frame(spark, d).withColumn("up", W.crosses_above(F.col("z"), K))
    return z.where("up").select("entity", F.col("day").alias("signal_day"), F.date_add("day", 1).alias("action_day"), F.round("z", 4).alias("z"))


@query(f"{BASE}, {ZQ}, f AS (SELECT *, coalesce(z > 1, false) AS f FROM zz), g AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY entity ORDER BY day), false) AS before FROM f) SELECT entity, day FROM g WHERE f AND NOT before")
def newly_crowded(spark, d):
    return z_frame(spark, d).withColumn("new", W.newly(F.col("z") > 1)).where("new").select("entity", "day")


COOL = "e AS (SELECT entity, day, row_number() OVER (PARTITION BY entity ORDER BY day) AS k FROM zz WHERE z > 1.5), walk AS (SELECT entity, day, k, day AS kept FROM e WHERE k = 1 UNION ALL SELECT e.entity, e.day, e.k, CASE WHEN e.day - w.kept >= 21 THEN e.day ELSE w.kept END FROM walk w JOIN e ON e.entity = w.entity AND e.k = w.k + 1)"


@query(f"{BASE}, {ZQ}, {COOL} SELECT DISTINCT entity, kept AS day FROM walk")
def cooldown_alerts(spark, d):
    return spaced(z_frame(spark, d).where("z > 1.5").select("entity", "day"), ["entity"], 21)


PRESS = "pr AS (SELECT day, entity, n, bp, sum(bp) OVER w AS bp7, sum(n) OVER w AS n7 FROM swide WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING)), ps AS (SELECT *, bp7 / nullif(n7, 0) AS share FROM pr)"


def pressure(spark, d):
    w = W.trailing(7)
    p = swide(spark, d).withColumns({"bp7": F.sum("bp").over(w), "n7": F.sum("n").over(w)})
    return p.withColumn("share", F.try_divide("bp7", "n7"))


@query(f"{SBASE}, {PRESS} SELECT day, entity, round(bp7, 4) + 0.0 AS pressure, round(share, 4) + 0.0 AS share FROM ps")
def bull_pressure_share(spark, d):
    return pressure(spark, d).select("day", "entity", r(F.col("bp7")).alias("pressure"), r(F.col("share")).alias("share"))


@query(f"{SBASE}, {PRESS} SELECT day, entity, round(share - lag(share, 5) OVER (PARTITION BY entity ORDER BY day), 4) + 0.0 AS change FROM ps")
def sentiment_change(spark, d):
    return pressure(spark, d).select("day", "entity", r(W.delta(F.col("share"), 5)).alias("change"))


EWM = "k AS (SELECT *, day - (SELECT min(day) FROM swide) AS i FROM pr), w AS (SELECT a.entity, a.day, a.bp7 AS s, sum(pow(2, (b.i - a.i) / 42.0)) AS t, sum(pow(4, (b.i - a.i) / 42.0)) AS q, sum(pow(2, (b.i - a.i) / 42.0) * b.bp7) AS m, min(b.bp7) AS lo, max(b.bp7) AS hi, count(*) AS n FROM k a JOIN k b ON a.entity = b.entity AND b.day <= a.day GROUP BY ALL), v AS (SELECT a.entity, a.day, sum(pow(2, (b.i - x.i) / 42.0) * (b.bp7 - a.m / a.t) * (b.bp7 - a.m / a.t)) AS ss FROM w a JOIN k x USING (entity, day) JOIN k b ON a.entity = b.entity AND b.day <= a.day GROUP BY ALL)"


@query(f"{SBASE}, {PRESS}, {EWM} SELECT w.day, w.entity, CASE WHEN n >= 28 AND lo < hi THEN round((s - m / t) / sqrt(ss / t * t * t / (t * t - q)), 3) + 0.0 END AS z FROM w JOIN v USING (entity, day)")
def conviction_ewm(spark, d):
    p = pressure(spark, d)
    i = F.datediff("day", F.min("day").over(Window.partitionBy("entity")))
    return p.withColumn("i", i).select("day", "entity", r(W.ewm_z(F.col("bp7"), F.col("i")), 3).alias("z"))


@query(f"{SBASE}, {PRESS}, t AS (SELECT day, entity, share, n7, share - lag(share, 5) OVER (PARTITION BY entity ORDER BY day) AS chg, CASE WHEN count(n7) OVER w >= 28 THEN (n7 - avg(n7) OVER w) / nullif(stddev_samp(n7) OVER w, 0) END AS az FROM ps WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 83 PRECEDING)) SELECT day, entity, coalesce(az > 1 AND chg < -0.10, false) AS crowded, coalesce(az > 1 AND chg > 0.10, false) AS swarm FROM t")
def conviction_flags(spark, d):
    p = pressure(spark, d).withColumns({"chg": W.delta(F.col("share"), 5), "az": W.trailing_z(F.col("n7").cast("double"))})
    return p.select("day", "entity", F.coalesce((F.col("az") > 1) & (F.col("chg") < -0.10), F.lit(False)).alias("crowded"), F.coalesce((F.col("az") > 1) & (F.col("chg") > 0.10), F.lit(False)).alias("swarm"))


@query(f"{SBASE} SELECT entity, (date_trunc('week', day) + INTERVAL 6 DAY)::DATE AS week, sum(n_posts)::BIGINT AS n, CASE WHEN sum(n_posts) >= 10 THEN round(sum(n_posts * net_bullish) / sum(n_posts), 4) + 0.0 END AS net FROM sent GROUP BY ALL")
def weekly_heatmap(spark, d):
    s = A.daily_sentiment(scored(spark, d)).withColumn("week", C.week_end(F.col("day")))
    n = F.sum("n_posts")
    return s.groupBy("entity", "week").agg(n.alias("n"), F.when(n >= 10, r(F.sum(F.col("n_posts") * F.col("net_bullish")) / n)).alias("net"))


@query(f"{SBASE}, {PRESS} SELECT entity, last_day(day) AS month, round(avg(bp7), 4) + 0.0 AS pressure, round(avg(n7), 4) + 0.0 AS volume FROM ps GROUP BY ALL")
def monthly_snail_trail(spark, d):
    return pressure(spark, d).groupBy("entity", F.last_day("day").alias("month")).agg(r(F.avg("bp7")).alias("pressure"), r(F.avg("n7")).alias("volume"))


@query(f"{SBASE} SELECT year(day)::INT AS year, " + ", ".join(f"coalesce(sum(n) FILTER (month(day) = {m}), 0)::BIGINT AS m{m}" for m in range(1, 13)) + " FROM swide GROUP BY ALL")
def coverage_pivot(spark, d):
    out = swide(spark, d).withColumns({"year": F.year("day"), "m": F.concat(F.lit("m"), F.month("day"))}).groupBy("year").pivot("m", [f"m{m}" for m in range(1, 13)]).agg(F.sum("n"))
    return out.fillna(0)


@query(f"{BASE} SELECT entity, count(DISTINCT day) AS days, round(100.0 * count(DISTINCT day) / (SELECT max(day) - min(day) + 1 FROM ev), 4) AS pct FROM ev GROUP BY entity")
def window_coverage(spark, d):
    span = mentions(spark, d).agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("span"))
    days = mentions(spark, d).groupBy("entity").agg(F.countDistinct("day").alias("days"))
    return days.join(F.broadcast(span)).select("entity", "days", F.round(100.0 * F.col("days") / F.col("span"), 4).alias("pct"))


RISING = "src AS (SELECT entity, day, count(*) FILTER (source = 'R') AS a, count(*) FILTER (source = 'N') AS b FROM sc GROUP BY ALL), f AS (SELECT s.day, e.entity, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM sspine s CROSS JOIN (SELECT DISTINCT entity FROM src) e LEFT JOIN src USING (day, entity)), r7 AS (SELECT *, sum(a) OVER w AS a7, sum(b) OVER w AS b7 FROM f WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING)), r30 AS (SELECT *, a7 - lag(a7, 5) OVER o AS da, b7 - lag(b7, 5) OVER o AS db, max(b7) OVER (PARTITION BY entity ORDER BY day ROWS 29 PRECEDING) AS live FROM r7 WINDOW o AS (PARTITION BY entity ORDER BY day))"


@query(f"{SBASE}, {RISING} SELECT day, entity, coalesce(da > 0 AND db > 0 AND live > 0, false) AS rising FROM r30")
def cross_source_rising(spark, d):
    posts = scored(spark, d)
    by = posts.groupBy("day", "entity").agg(F.count_if(F.col("source") == "R").alias("a"), F.count_if(F.col("source") == "N").alias("b"))
    f = C.on_spine(by, C.day_span(posts), zero=["a", "b"])
    f = f.withColumns({"a7": F.sum("a").over(W.trailing(7)), "b7": F.sum("b").over(W.trailing(7))})
    live = F.max("b7").over(W.trailing(30)) > 0
    return f.select("day", "entity", F.coalesce((W.delta(F.col("a7"), 5) > 0) & (W.delta(F.col("b7"), 5) > 0) & live, F.lit(False)).alias("rising"))
