"""Queries over authors' calls and the labels of a reply graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import influence as I
from tidewatch.plans import detect as P
from tidewatch.plans import people as N
from tidewatch.plans.daily import SBASE, filled_prices, r
from tidewatch.sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def calls(spark, d):
    """A line is a call of its supplier about its part's brand: long or short by its discount."""
    lines, part = read(spark, d, "lineitem"), read(spark, d, "part")
    c = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("stance", F.round((F.col("l_discount") - 0.05) / 0.05, 4))
    return c.where(F.abs("stance") >= 0.2).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("author"), F.to_date("l_shipdate").alias("day"), F.col("p_brand").alias("entity"), "stance", F.when(F.col("stance") > 0, 1).otherwise(-1).alias("direction"))


CALLS = """cl AS (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS author, l_shipdate::DATE AS day, p_brand AS entity, round((l_discount - 0.05) / 0.05, 4) AS stance FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(round((l_discount - 0.05) / 0.05, 4)) >= 0.2),
mv AS (SELECT entity, day, lead(px, 20) OVER (PARTITION BY entity ORDER BY day) / px - 1 AS fwd FROM px), mv1 AS (SELECT *, lag(fwd, 20) OVER (PARTITION BY entity ORDER BY day) AS done FROM mv),
mv2 AS (SELECT entity, day, fwd, CASE WHEN count(done) OVER w >= 30 THEN avg(done) OVER w END AS mu, CASE WHEN count(done) OVER w >= 30 THEN stddev_samp(done) OVER w END AS sd FROM mv1 WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 89 PRECEDING)),
cj AS (SELECT cl.*, CASE WHEN stance > 0 THEN 1 ELSE -1 END AS direction, fwd, CASE WHEN sd IS NOT NULL THEN greatest(0.03::DOUBLE, sd / 2) END AS tau, coalesce(CASE WHEN sd > 0 THEN (fwd - mu) / sd END, 0) AS z FROM cl LEFT JOIN mv2 USING (entity, day)),
jd0 AS (SELECT *, CASE WHEN fwd IS NULL THEN 'unscored' WHEN fwd * direction >= tau THEN 'correct' WHEN fwd * direction <= -tau THEN 'wrong' ELSE 'flat' END AS outcome FROM cj), jd AS (SELECT *, outcome = 'correct' AND z * direction >= 1 AS enhanced FROM jd0)"""


def judged(spark, d):
    return I.judge(calls(spark, d), filled_prices(spark, d).select("entity", "day", "px"))


@query(f"{SBASE}, {CALLS} SELECT id, line, author, outcome, enhanced, round(z, 5) + 0.0 AS z FROM jd")
def call_judging(spark, d):
    return judged(spark, d).select("id", "line", "author", "outcome", "enhanced", r(F.col("z"), 5).alias("z"))


_S = {"s_conf": "abs(stance) * y", "s_z": "abs(stance) * y * least(greatest(1 + abs(z), 0.1), 2)", "s_enh": "CASE WHEN y IS NOT NULL THEN abs(stance) * enhanced::INT END"}
BOARD = f"""{CALLS}, jy AS (SELECT *, CASE outcome WHEN 'correct' THEN 1.0::DOUBLE WHEN 'wrong' THEN 0 END AS y FROM jd), ja AS (SELECT author, count(*) AS n_calls, count(y) AS n_judged, coalesce(sum(y), 0)::BIGINT AS hits, {', '.join(f'avg({v}) AS m_{k}' for k, v in _S.items())} FROM jy GROUP BY author), jg AS (SELECT avg(y) AS base, {', '.join(f'avg({v}) AS g_{k}' for k, v in _S.items())} FROM jy),
js AS (SELECT author, n_calls, n_judged, hits, {', '.join(f'(n_judged * m_{k} + {p} * g_{k}) / (n_judged + {p}) AS {k}' for k, p in I.PRIORS.items())}, (n_judged * coalesce(hits / nullif(n_judged, 0)::DOUBLE, base) + 10 * base) / (n_judged + 10) AS score FROM ja, jg),
jn AS (SELECT author, n_calls, n_judged, hits, score, {', '.join(f'CASE WHEN {k} IS NOT NULL THEN coalesce(({k} - min({k}) OVER ()) / nullif(max({k}) OVER () - min({k}) OVER (), 0), 0) END AS {k}' for k in _S)} FROM js)"""


@query(f"{SBASE}, {BOARD} SELECT author, n_calls, n_judged, hits, round(s_conf, 5) AS s_conf, round(s_z, 5) AS s_z, round(s_enh, 5) AS s_enh, round(0.4 * s_conf + 0.4 * s_z + 0.2 * s_enh, 5) AS composite, CASE WHEN 0.4 * s_conf + 0.4 * s_z + 0.2 * s_enh >= 0.66 THEN 'HIGH' ELSE 'low' END AS tier, round(score, 5) AS score FROM jn")
def influence_board(spark, d):
    b = I.board(judged(spark, d))
    return b.select("author", "n_calls", "n_judged", "hits", *(F.round(c, 5).alias(c) for c in (*I.PRIORS, "composite")), "tier", F.round("score", 5).alias("score"))


@query(f"{SBASE}, {P.PEAK}, {CALLS} SELECT author, count(*) FILTER (direction < 0) AS called_tops, count(*) FILTER (direction > 0) AS bought_tops FROM cj WHERE EXISTS (FROM pk p WHERE p.entity = cj.entity AND cj.day BETWEEN p.peak - 30 AND p.peak + 5) GROUP BY author")
def boom_bust_record(spark, d):
    """A call counts once, however many peaks it is near: the peaks' windows become days first."""
    near = P.peaks(spark, d).select("entity", F.explode(F.sequence(F.date_sub("peak", 30), F.date_add("peak", 5))).alias("day")).distinct()
    c = calls(spark, d).join(near, ["entity", "day"], "left_semi")
    return c.groupBy("author").agg(F.count_if(F.col("direction") < 0).alias("called_tops"), F.count_if(F.col("direction") > 0).alias("bought_tops"))


NODES = "nd AS (SELECT user_id AS node, count(*)::DOUBLE AS n, round(avg(value), 6) AS v, (avg((event_type IN ('click', 'purchase'))::INT::DOUBLE) >= 0.4)::INT AS y FROM events GROUP BY user_id), sp0 AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(node || ':42'), node) - 1) / (count(*) OVER (PARTITION BY y))::DOUBLE AS pos FROM nd), sp AS (SELECT node, n, v, y, CASE WHEN pos < 0.6 THEN 'train' WHEN pos < 0.8 THEN 'val' ELSE 'test' END AS part FROM sp0)"


def nodes(spark, d):
    ok = F.col("event_type").isin("click", "purchase").cast("int")
    return read(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("value"), 6).alias("v"), (F.avg(ok) >= 0.4).cast("int").alias("y"))


@query(f"WITH {NODES} SELECT node, y::INT AS y, part FROM sp")
def stratified_split(spark, d):
    return I.split(nodes(spark, d), "node", "y").select("node", "y", "part")


@query(f"WITH {N.EDGES}, {NODES} SELECT nd.node, coalesce(round(sum(x.n * w) / sum(w), 5), 0) AS nb_n, coalesce(round(sum(x.v * w) / sum(w), 5), 0) AS nb_v FROM nd LEFT JOIN both_ ON both_.u = nd.node LEFT JOIN nd x ON x.node = both_.v GROUP BY nd.node")
def neighbour_mean(spark, d):
    out = I.neighbour_mean(nodes(spark, d).select("node", "n", "v"), N.edges(spark, d), ["n", "v"])
    return out.select("node", F.round("nb_n", 5).alias("nb_n"), F.round("nb_v", 5).alias("nb_v"))


def priors(spark, d):
    return I.split(nodes(spark, d), "node", "y").select("node", F.when(F.col("part") == "train", F.col("y").cast("double")).alias("y"))


SPREAD = """k0 AS (SELECT node, CASE WHEN part = 'train' THEN y::DOUBLE END AS y FROM sp),
lp AS (SELECT 0 AS k, node, y, coalesce(y, (SELECT avg(y) FROM k0)) AS b FROM k0 UNION ALL
SELECT s.k + 1, s.node, s.y, coalesce(s.y, 0.85 * coalesce(m, s.b) + 0.15 * s.b) FROM lp s LEFT JOIN (SELECT e.u, sum(x.b * e.w) / sum(e.w) AS m FROM both_ e JOIN lp x ON x.node = e.v GROUP BY e.u) q ON q.u = s.node WHERE s.k < 30)"""


@query(f"WITH RECURSIVE {N.EDGES}, {NODES}, {SPREAD} SELECT node, round(b, 6) AS belief FROM lp WHERE k = 30")
def label_propagation_30(spark, d):
    return I.propagate(priors(spark, d), N.edges(spark, d)).select("node", F.round("belief", 6).alias("belief"))


@query(f"WITH sc AS ({N.ORACLES['author_scores']}), pg AS ({N.ORACLES['pagerank_50']}) SELECT author, rank >= (SELECT quantile_cont(rank, 0.75) FROM pg) AND scaled < (SELECT quantile_cont(scaled, 0.5) FROM sc) AS loud_but_wrong FROM sc JOIN pg USING (author)")
def loud_but_wrong(spark, d):
    """By the ranks of pagerank_50; authors the graph filters drop have no rank and no row."""
    return loud(N.author_scores(spark, d), N.pagerank_50(spark, d).checkpoint())


def loud(s, g):
    mid, high = s.agg(F.percentile("scaled", F.lit(0.5)).alias("mid")), g.agg(F.percentile("rank", F.lit(0.75)).alias("high"))
    return s.join(g, "author").join(F.broadcast(mid)).join(F.broadcast(high)).select("author", ((F.col("rank") >= F.col("high")) & (F.col("scaled") < F.col("mid"))).alias("loud_but_wrong"))


@query("SELECT user_id AS author, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0)::DOUBLE, 6) AS ratio FROM events GROUP BY user_id")
def participation(spark, d):
    p = read(spark, d, "events").groupBy(F.col("user_id").alias("author")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"))
    return p.withColumn("ratio", F.round(F.try_divide("clicks", "views"), 6))


@query("WITH c AS (SELECT p_brand AS symbol, min(l_shipdate::DATE) AS lo, max(l_shipdate::DATE) AS hi FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1), s AS (SELECT symbol, DATE '1994-12-01' AS a, coalesce(lo - 1, DATE '2001-12-31') AS b FROM c WHERE lo IS NULL OR DATE '1994-12-01' < lo - 3 UNION ALL SELECT symbol, hi + 1, DATE '2001-12-31' FROM c WHERE DATE '2001-12-31' > hi + 3) SELECT a AS span_start, b AS span_end, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM s GROUP BY a, b")
def incremental_plan(spark, d):
    """Spans of a window that each symbol still lacks (three days' tolerance), and the symbols that share a span."""
    from tidewatch.sources.records import missing_spans

    have = calls_days(spark, d)
    return missing_spans(read(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct(), have, "1994-12-01", "2001-12-31")


def calls_days(spark, d):
    lines, part = read(spark, d, "lineitem"), read(spark, d, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("day"))


@query("SELECT 'st_' || event_id AS id, ts::DATE AS day, 'u' || user_id AS author, event_type AS title, (props::JSON ->> 'k')::INT AS score FROM events WHERE event_id % 10 != 9")
def normalise_records(spark, d):
    """Events as raw JSON records: epoch or ISO times, authors as text or object, one in ten without a time and dropped."""
    from tidewatch.sources.records import normalise

    e = read(spark, d, "events")
    k = F.pmod("event_id", F.lit(10))
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    when = F.when(k < 5, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")).when(k < 9, iso)
    name = F.concat(F.lit("u"), F.col("user_id"))
    raw = F.to_json(F.struct("event_id", when.alias("created_at"), F.when(k % 2 == 0, name).alias("author"), F.when(k % 2 == 1, F.struct(name.alias("username"))).alias("user"), F.col("event_type").alias("title"), F.get_json_object("props", "$.k").alias("score")))
    return normalise(e.select(raw.alias("raw")), {"id": ["id", "event_id"]}, prefix="st_").select("id", "day", "author", "title", "score")
