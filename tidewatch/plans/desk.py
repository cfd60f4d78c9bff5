"""Queries behind the desk's tables: the conviction set and its ranking, states, anchors, the universe to price, pivots and formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import calendar as C
from tidewatch.operators import desk as D
from tidewatch.operators import influence as I
from tidewatch.operators import stores as K
from tidewatch.operators import windows as W
from tidewatch.plans import crowd, daily, detect, influence, people
from tidewatch.plans.daily import SBASE, filled_prices, r, scored, swide
from tidewatch.sources.tables import BASE, mentions, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ewm_sql(table: str, x: str, out: str, half_life: int = 42) -> str:
    """z of x against its exponentially weighted past, as in conviction_ewm."""
    w = f"pow(2, (b.i - a.i) / {half_life}.0)"
    return (
        f"{out}k AS (SELECT entity, day, {x} AS x, day - (SELECT min(day) FROM {table}) AS i FROM {table}),"
        f" {out}w AS (SELECT a.entity, a.day, a.x AS s, sum({w}) AS t, sum({w} * {w}) AS q, sum({w} * b.x) AS m, min(b.x) AS lo, max(b.x) AS hi, count(*) AS n FROM {out}k a JOIN {out}k b ON a.entity = b.entity AND b.day <= a.day GROUP BY ALL),"
        f" {out}v AS (SELECT a.entity, a.day, sum(pow(2, (b.i - c.i) / {half_life}.0) * (b.x - a.m / a.t) * (b.x - a.m / a.t)) AS ss FROM {out}w a JOIN {out}k c USING (entity, day) JOIN {out}k b ON a.entity = b.entity AND b.day <= a.day GROUP BY ALL),"
        f" {out} AS (SELECT entity, day, CASE WHEN n >= 28 AND lo < hi THEN (s - m / t) / sqrt(ss / t * t * t / (t * t - q)) END AS z FROM {out}w JOIN {out}v USING (entity, day))"
    )


#: the pressure and posts of a day as a share of all its scored posts, where there are ten
SET = f"""tot AS (SELECT day, CASE WHEN sum(n) >= 10 THEN sum(n) END AS total FROM swide GROUP BY day),
nr AS (SELECT day, entity, n, bp, coalesce(100 * bp / total, 0) AS sbp, coalesce(100.0::DOUBLE * n / total, 0) AS sn FROM (SELECT day, entity, n, round(bp, 9) AS bp FROM swide) JOIN tot USING (day)),
ns AS (SELECT *, sum(sbp) OVER w AS sbp7, sum(sn) OVER w AS sn7, sum(bp) OVER w AS bp7, sum(n) OVER w AS n7 FROM nr WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING)),
nz AS (SELECT *, bp7 / nullif(n7, 0) AS share, CASE WHEN count(sbp7) OVER w >= 28 THEN (sbp7 - avg(sbp7) OVER w) / nullif(stddev_samp(sbp7) OVER w, 0) END AS cz,
CASE WHEN count(sn7) OVER w >= 28 THEN (sn7 - avg(sn7) OVER w) / nullif(stddev_samp(sn7) OVER w, 0) END AS az FROM ns WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 83 PRECEDING)),
nc AS (SELECT *, share - lag(share, 5) OVER (PARTITION BY entity ORDER BY day) AS chg FROM nz)"""


@query(f"{SBASE}, {SET} SELECT day, entity, n::BIGINT AS n_posts, round(bp, 4) + 0.0 AS bull_pressure, round(cz, 3) + 0.0 AS conviction_z, round(az, 3) + 0.0 AS attention_z, round(share, 8) + 0.0 AS share, round(chg, 8) + 0.0 AS sent_change, coalesce(az > 1 AND chg < -0.10, false) AS crowded_top, coalesce(az > 1 AND chg > 0.10, false) AS swarm FROM nc")
def conviction_set(spark, d):
    """The eight columns, normalised by the day's posts, against a rolling baseline."""
    c = D.conviction(swide(spark, d), normalise=True, baseline="rolling")
    return c.select("day", "entity", "n_posts", r(F.col("bull_pressure")).alias("bull_pressure"), r(F.col("conviction_z"), 3).alias("conviction_z"), r(F.col("attention_z"), 3).alias("attention_z"), r(F.col("share"), 8).alias("share"), r(F.col("sent_change"), 8).alias("sent_change"), "crowded_top", "swarm")


@query()
def conviction_set_ewm(spark, d):
    """The same by the default: raw pressure against an exponentially weighted baseline. Its SQL is that of conviction_ewm; a test compares them."""
    return D.conviction(swide(spark, d))


@query(f"{SBASE}, {SET}, l AS (SELECT entity, day, cz, (SELECT max(day) FROM nc) - day AS age FROM nc WHERE cz IS NOT NULL), e AS (SELECT entity, sum(cz * pow(0.5, age / 10.0)) / sum(pow(0.5, age / 10.0)) AS z, arg_max(cz, day) AS latest, avg(cz) FILTER (age < 30) AS flat, count(*) AS n FROM l GROUP BY entity) SELECT entity, round(z, 3) + 0.0 AS z, round(latest, 3) + 0.0 AS latest, round(flat, 3) + 0.0 AS flat_30, row_number() OVER (ORDER BY round(abs(z), 6) DESC, entity)::INT AS rank FROM e WHERE n >= 5")
def conviction_rank(spark, d):
    """Names by the size of their exponentially weighted conviction (half-life ten days)."""
    out = D.rank_by_ewm(D.conviction(swide(spark, d), normalise=True, baseline="rolling").select("entity", "day", F.col("conviction_z").alias("z")), 10)
    return out.select("entity", *(r(F.col(c), 3).alias(c) for c in ("z", "latest", "flat_30")), "rank")


CROSS = f"{SET}, cx0 AS (SELECT entity, day, round(cz, 6) AS z, lag(round(cz, 6)) OVER (PARTITION BY entity ORDER BY day) AS b FROM nc), cx AS (SELECT entity, day, z > 0 AS up FROM cx0 WHERE (z >= 1.5 AND b < 1.5) OR (z <= -1.5 AND b > -1.5))"


@query(f"{SBASE}, {CROSS}, {crowd.spacing_sql('cx', ['entity', 'up'], 21, 'cs')} SELECT entity, up, day FROM cs")
def conviction_crossings(spark, d):
    """Days on which conviction crosses 1.5 either way, three weeks apart within name and side."""
    from tidewatch.operators.spacing import spaced

    c = D.conviction(swide(spark, d), normalise=True, baseline="rolling").select("entity", "day", F.round("conviction_z", 6).alias("z"))
    c = c.withColumn("b", F.lag("z").over(W.by_entity()))
    hit = c.where("(z >= 1.5 AND b < 1.5) OR (z <= -1.5 AND b > -1.5)").select("entity", (F.col("z") > 0).alias("up"), "day")
    return spaced(hit, ["entity", "up"], 21)


@query(f"{SBASE}, {detect.SIG}, mx AS (SELECT max(day) AS m FROM sig), la AS (SELECT entity, max(day) FILTER (buy) AS s, max(day) FILTER (NOT buy) AS e FROM sig, mx WHERE day > m - 60 GROUP BY entity) SELECT entity, s AS starting, e AS ending, CASE WHEN s IS NOT NULL AND (e IS NULL OR s >= e) THEN 'STARTING' WHEN e IS NOT NULL THEN 'ENDING' END AS state FROM la")
def latest_states(spark, d):
    """Of the alerts of the last days: the latest of either kind, and the state they give; a tie is a start."""
    return D.states(detect.signals(spark, d).select("entity", "day", F.when(F.col("buy"), "start").otherwise("end").alias("kind")), 60)


@query(f"{SBASE} SELECT entity, max(day) AS day, arg_max(n, day)::BIGINT AS n FROM swide GROUP BY entity")
def latest_rows(spark, d):
    return K.latest(swide(spark, d).select("entity", "day", "n"), ["entity"])


ANCHORS = "fb AS (SELECT DISTINCT p_type AS theme, p_size AS pos, p_brand AS symbol FROM part), priced AS (SELECT DISTINCT entity AS symbol FROM px0 WHERE entity < 'Brand#2')"


@query(f"{SBASE}, {ANCHORS} SELECT theme, arg_min(symbol, (pos, symbol)) AS anchor FROM fb JOIN priced USING (symbol) GROUP BY theme")
def anchors(spark, d):
    """The first symbol of a theme's chain of anchors that has a price."""
    chain = read(spark, d, "part").select(F.col("p_type").alias("theme"), F.col("p_size").alias("pos"), F.col("p_brand").alias("symbol"))
    priced = scored(spark, d).where("entity < 'Brand#2'").select(F.col("entity").alias("symbol")).distinct()
    return D.resolve_anchors(chain, priced)


@query(f"{SBASE}, {detect.SIG}, c AS (SELECT entity, day, n_posts AS n FROM sent), u AS (SELECT entity FROM (SELECT entity, sum(n) AS s FROM c GROUP BY 1 ORDER BY s DESC, entity LIMIT 10) UNION SELECT entity FROM (SELECT entity, sum(n) AS s FROM c WHERE day >= (SELECT max(day) FROM c) - 60 GROUP BY 1 ORDER BY s DESC, entity LIMIT 10) UNION SELECT p_brand FROM part WHERE p_size = 1 UNION SELECT entity FROM sig WHERE day >= DATE '1999-12-01') SELECT upper(trim(entity)) AS symbol FROM u")
def universe_to_price(spark, d):
    """The most named of all days and of the last sixty, all anchors, and whatever signals name."""
    counts = scored(spark, d).groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"))
    more = [read(spark, d, "part").where("p_size = 1").select(F.col("p_brand").alias("symbol")), detect.signals(spark, d).where("day >= DATE '1999-12-01'").select(F.col("entity").alias("symbol"))]
    return D.symbols_to_price(counts, more, 10)


@query(f"{SBASE} SELECT source, {', '.join(f'count(*) FILTER (year(day) = {y}) AS y{y}' for y in range(1995, 2001))} FROM sc GROUP BY source")
def source_year_pivot(spark, d):
    s = scored(spark, d).where(F.year("day").between(1995, 2000)).withColumn("y", F.concat(F.lit("y"), F.year("day")))
    return s.groupBy("source").pivot("y", [f"y{y}" for y in range(1995, 2001)]).agg(F.count(F.lit(1))).fillna(0)


_ERAS = [(1996, "1996"), (1997, "1997"), (1998, "1998"), (1999, "1999")]


@query(f"{SBASE}, {detect.RET}, er AS (SELECT entity, year(day) AS era, avg(pnl) AS mean, count(pnl) AS n FROM ret WHERE year(day) BETWEEN 1996 AND 1999 GROUP BY ALL HAVING count(pnl) >= 4), rb AS (SELECT entity, count(*)::INT AS eras, round(min(mean), 6) AS worst, round(avg(mean), 6) AS average FROM er GROUP BY entity) SELECT entity, eras, round(worst, 4) + 0.0 AS worst, round(average, 4) + 0.0 AS average, row_number() OVER (ORDER BY worst DESC, average DESC, entity)::INT AS rank FROM rb")
def era_robustness(spark, d):
    """Names by their worst era's mean return, then by the mean of eras; an era counts from four signals on."""
    p = detect.returns(spark, d).select("entity", F.year("day").alias("era"), "pnl").where(F.col("era").between(1996, 1999))
    return D.robustness(p, 4).select("entity", "eras", r(F.col("worst")).alias("worst"), r(F.col("average")).alias("average"), "rank")


@query(f"{SBASE}, bm AS (SELECT s.entity, s.n::DOUBLE AS x, (px > avg(px) OVER (PARTITION BY s.entity))::INT::DOUBLE AS y FROM swide s JOIN px USING (entity, day) WHERE px IS NOT NULL) SELECT entity, round(corr(x, y), 5) + 0.0 AS point_biserial FROM bm GROUP BY entity")
def point_biserial(spark, d):
    """The correlation of a count with a yes or no: Pearson's on 0 and 1."""
    f = swide(spark, d).join(filled_prices(spark, d).where("px IS NOT NULL").select("entity", "day", "px"), ["entity", "day"])
    f = f.withColumn("y", (F.col("px") > F.avg("px").over(Window.partitionBy("entity"))).cast("double"))
    return f.groupBy("entity").agg(r(F.corr(F.col("n").cast("double"), "y"), 5).alias("point_biserial"))


@query(f"{SBASE}, {detect.SIG}, dd AS (SELECT s.entity, s.day, max(px) AS x FROM sig s JOIN px USING (entity, day) GROUP BY ALL) SELECT d.entity, d.day, round(min(p.px) / any_value(d.x) - 1, 5) + 0.0 AS drawdown FROM dd d JOIN px p ON p.entity = d.entity AND p.day BETWEEN d.day AND d.day + 90 WHERE d.x IS NOT NULL GROUP BY d.entity, d.day")
def drawdown_after(spark, d):
    """The deepest fall below the price of the signal's day within 90 days."""
    px = filled_prices(spark, d).select("entity", "day", "px")
    low = px.withColumn("low", F.min("px").over(W.by_entity().rowsBetween(0, 90))).where("px IS NOT NULL")
    return detect.signals(spark, d).select("entity", "day").distinct().join(low, ["entity", "day"]).select("entity", "day", r(F.col("low") / F.col("px") - 1, 5).alias("drawdown"))


@query(f"{SBASE} SELECT entity, day, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS k FROM swide) WHERE k % 30 = 1")
def every_30th(spark, d):
    """Every thirtieth day of each name, the first included: a sampling operator."""
    return swide(spark, d).withColumn("k", F.row_number().over(W.by_entity())).where("k % 30 = 1").select("entity", "day", "n")


@query(f"{SBASE}, e AS (SELECT DISTINCT entity, source FROM sc), c AS (SELECT day, entity, source, count(*) AS n FROM sc GROUP BY ALL), f AS (SELECT s.day, e.entity, e.source, coalesce(n, 0) AS n FROM sspine s CROSS JOIN e LEFT JOIN c USING (day, entity, source)), w AS (SELECT *, sum(n) OVER v AS n7 FROM f WINDOW v AS (PARTITION BY entity, source ORDER BY day ROWS 6 PRECEDING)), x AS (SELECT *, n7 - lag(n7, 5) OVER o > 0 AS up, max(n7) OVER (PARTITION BY entity, source ORDER BY day ROWS 29 PRECEDING) > 0 AS live FROM w WINDOW o AS (PARTITION BY entity, source ORDER BY day)) SELECT day, entity, count(*) FILTER (n7 > 0) AS breadth, count(*) FILTER (live) AS active, count(*) FILTER (live AND up) AS rising, count(*) FILTER (live) >= 2 AND count(*) FILTER (live AND up) = count(*) FILTER (live) AS all_rising FROM x GROUP BY ALL")
def source_breadth(spark, d):
    """Of whatever sources there are: how many posted within seven days, were active within thirty, and rise; and whether all active ones do."""
    return D.source_breadth(scored(spark, d).select("day", "entity", "source"))


@query(f"{SBASE} SELECT entity, round(avg(n), 6) AS mean FROM swide GROUP BY entity HAVING avg(n) >= 1.02")
def volume_floor(spark, d):
    """Names whose mean daily posts, quiet days included, reach a floor."""
    return swide(spark, d).groupBy("entity").agg(F.round(F.avg("n"), 6).alias("mean"), F.avg("n").alias("m")).where("m >= 1.02").drop("m")


@query(f"{SBASE}, ow AS (SELECT entity, min(day) AS lo, max(day) AS hi FROM sent GROUP BY entity), dy AS (SELECT entity, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM ow) SELECT entity, day, coalesce(n_posts, 0)::BIGINT AS n FROM dy LEFT JOIN sent USING (entity, day) WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def own_span_series(spark, d):
    """Each name from its own first to its own last day, clipped to a year, both ends included."""
    s = C.own_series(scored(spark, d).groupBy("day", "entity").agg(F.count(F.lit(1)).alias("n"))).fillna(0, subset=["n"])
    return C.clip(s, "1996-01-01", "1996-12-31").select("entity", "day", "n")


@query(f"{BASE} SELECT day, entity, n FROM cnt WHERE day >= DATE '1997-01-01' AND day < DATE '1998-01-01' AND entity IN ('BUILDING', 'FURNITURE')")
def input_window(spark, d):
    """Posts of some communities from a day on and before another one."""
    return D.between(mentions(spark, d), "1997-01-01", "1998-01-01", ["BUILDING", "FURNITURE"], "entity").groupBy("day", "entity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_brand AS symbol FROM part EXCEPT SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49 AND l_discount > 0.09")
def uncovered(spark, d):
    """What is in one set and not in the other."""
    lines, part = read(spark, d, "lineitem"), read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return part.select("symbol").exceptAll(part.select("symbol").limit(0)).distinct().join(lines.where("l_quantity > 49 AND l_discount > 0.09").join(part, "l_partkey").select("symbol"), "symbol", "left_anti")


@query("SELECT o_orderkey, CASE WHEN x >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.1fk', x / 1e3) ELSE printf('%.0f', x) END AS compact, CASE WHEN (o_orderkey % 400) <= 1 THEN 'day' WHEN (o_orderkey % 400) <= 7 THEN 'week' WHEN (o_orderkey % 400) <= 31 THEN 'month' ELSE 'year' END AS bucket, round_even(o_totalprice / 1000, 0)::BIGINT AS thousands, left(regexp_replace(o_orderpriority || '  x ' || chr(10) || o_orderstatus, '\\s+', ' ', 'g'), 12) AS label, epoch(o_orderdate::TIMESTAMP)::BIGINT AS seconds, (o_orderdate::DATE - 1) AS last_day FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 100) * 100 ELSE floor(o_totalprice / 10000) * 100000 END AS x FROM orders)".replace("\\\\", "\\"))
def desk_formats(spark, d):
    """Compact numbers (of one decimal, so that no tie is rounded), lookback buckets, rounding half to even, collapsed and cut labels, days as seconds, exclusive ends as inclusive ones."""
    o, x, k = read(spark, d, "orders"), F.col("o_totalprice"), F.col("o_orderkey") % 400
    return o.select(
        "o_orderkey", D.compact(F.when(F.col("o_orderkey") % 2 == 0, F.floor(x / 100) * 100).otherwise(F.floor(x / 10000) * 100000).cast("double")).alias("compact"), D.lookback(k).alias("bucket"), F.bround(x / 1000, 0).cast("long").alias("thousands"),
        D.short_label(F.concat("o_orderpriority", F.lit("  x \n"), "o_orderstatus"), 12).alias("label"), D.epoch_day(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("seconds"), F.date_sub(F.to_date("o_orderdate"), 1).alias("last_day"),
    )


@query(f"WITH bd AS ({influence.ORACLES['influence_board']}), au AS ({people.ORACLES['audience']}), pk0 AS ({people.ORACLES['pagerank_50']}), lc AS ({people.ORACLES['latest_calls']}), bb AS ({influence.ORACLES['boom_bust_record']}) SELECT author, n_calls, composite, tier, coalesce(repliers, 0) AS repliers, rank, latest, coalesce(called_tops, 0) AS called_tops, coalesce(bought_tops, 0) AS bought_tops, coalesce(rank >= (SELECT quantile_cont(rank, 0.75) FROM bd LEFT JOIN pk0 USING (author)) AND composite < (SELECT quantile_cont(composite, 0.5) FROM bd), false) AS loud FROM bd LEFT JOIN au USING (author) LEFT JOIN pk0 USING (author) LEFT JOIN lc USING (author) LEFT JOIN bb USING (author)")
def influence_full(spark, d):
    """The board with audience, rank in the reply graph, latest calls and the record at tops; loud are those of high rank and low composite."""
    b = influence.influence_board(spark, d).select("author", "n_calls", "composite", "tier")
    for more in (people.audience(spark, d).select("author", "repliers"), people.pagerank_50(spark, d), people.latest_calls(spark, d), influence.boom_bust_record(spark, d)):
        b = b.join(more, "author", "left")
    b = b.checkpoint()
    cuts = b.agg(F.percentile("rank", F.lit(0.75)).alias("high"), F.percentile("composite", F.lit(0.5)).alias("mid"))
    loud = (F.col("rank") >= F.col("high")) & (F.col("composite") < F.col("mid"))
    return b.fillna(0, subset=["repliers", "called_tops", "bought_tops"]).join(F.broadcast(cuts)).withColumn("loud", F.coalesce(loud, F.lit(False))).drop("high", "mid")
