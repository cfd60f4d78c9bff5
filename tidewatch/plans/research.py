"""Queries that compare models, perturb what goes into them, and vary what counts as truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import influence as I
from tidewatch.operators import research as X
from tidewatch.plans import detect as P
from tidewatch.plans import influence as A
from tidewatch.plans import people as N
from tidewatch.plans.daily import SBASE, filled_prices
from tidewatch.sources.tables import read
from tidewatch.streaming import folds as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, d, edges=None):
    """Authors with their own columns and their neighbours' means, split by label."""
    n = A.nodes(spark, d)
    x = I.neighbour_mean(n.select("node", "n", "v"), N.edges(spark, d) if edges is None else edges, ["n", "v"])
    return x.join(I.split(n, "node", "y").select("node", "y", "part"), "node").checkpoint()


@query()
def model_tournament(spark, d):
    """Models of authors side by side on the part that no model was fitted on."""
    x, out = table(spark, d), None
    for model in X.MODELS:
        scored = X.fit_scores(x.where("part = 'train'"), x.where("part != 'train'"), ["n", "v", "nb_n", "nb_v"], model)
        row = X.evaluate(scored).select(F.lit(model).alias("model"), "average_precision", "auroc", "threshold", "precision", "recall")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def graph_ablation(spark, d):
    """The neighbour model without neighbours, without own columns, and on graphs of which a share of the edges was dealt anew."""
    e = N.edges(spark, d).checkpoint()
    whole = table(spark, d, e)
    cases = [("whole", whole, ["n", "v", "nb_n", "nb_v"]), ("own only", whole, ["n", "v"]), ("neighbours only", whole, ["nb_n", "nb_v"])]
    cases += [(f"rewired {share}", table(spark, d, X.rewired(e, share)), ["n", "v", "nb_n", "nb_v"]) for share in (0.2, 0.5, 1.0)]
    out = None
    for name, x, columns in cases:
        scored = X.fit_scores(x.where("part = 'train'"), x.where("part != 'train'"), columns)
        row = X.evaluate(scored).select(F.lit(name).alias("variant"), "average_precision", "auroc")
        out = row if out is None else out.unionByName(row)
    return out


_U = "(('0x' || substr(md5(event_id || ':42:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""WITH s AS (SELECT c.scale, round(value + c.scale * sum({_U} - 0.5), 4) AS score, any_value((event_type = 'purchase')::INT) AS y, event_id FROM events, (SELECT unnest([0.0, 20.0, 100.0])::DOUBLE AS scale) c, (SELECT unnest(range(4)) AS k) GROUP BY event_id, value, c.scale),
g AS (SELECT scale, score, sum(y) AS p, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT scale, p, sum(p) OVER (PARTITION BY scale ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY scale ORDER BY score DESC) AS k, sum(p) OVER (PARTITION BY scale) AS pos, sum(n) OVER (PARTITION BY scale) AS tot, sum(n) OVER (PARTITION BY scale ORDER BY score) - (n - 1) / 2.0::DOUBLE AS rank FROM g)
SELECT scale, round(sum(p::DOUBLE / pos * (tp::DOUBLE / k)), 6) AS average_precision, round((sum(p * rank) - any_value(pos) * (any_value(pos) + 1) / 2.0) / (any_value(pos) * (any_value(tot) - any_value(pos))), 6) AS auroc FROM c GROUP BY scale""")
def perturbation_curve(spark, d):
    """How precision falls as noise is added to a score; the draws are hashes, so every run has the same."""
    noise = sum((X.uniform(F.col("event_id").cast("string"), f"42:{k}") - 0.5 for k in range(4)), F.lit(0.0))
    e = read(spark, d, "events").select("value", (F.col("event_type") == "purchase").cast("int").alias("y"), noise.alias("noise"))
    e = e.withColumn("scale", F.explode(F.lit([0.0, 20.0, 100.0])))  # one draw an event for all scales
    scored = e.select("scale", F.round(F.col("value") + F.col("scale") * F.col("noise"), 4).alias("score"), "y")
    return X.evaluate(scored, by=("scale",)).select("scale", *(F.round(c, 6).alias(c) for c in ("average_precision", "auroc")))


#: rise to a peak and fall after it, in per cent
SETTINGS = [(20, 10), (25, 15), (40, 25)]


def _peaks_sql(boom: int, bust: int) -> str:
    return P.PEAK.replace("1.25 * low", f"{1 + boom / 100} * low").replace("0.85 * px", f"{1 - bust / 100} * px")


@query(" UNION ALL ".join(f"(SELECT {a}::INT AS boom, {b}::INT AS bust, count(*) AS peaks, count(*) FILTER (called) AS called FROM ({SBASE}, {P.SIG}, {_peaks_sql(a, b)} SELECT pk.entity, pk.peak, EXISTS (FROM sig s WHERE NOT s.buy AND s.entity = pk.entity AND s.day BETWEEN pk.peak - 30 AND pk.peak + 1) AS called FROM pk))" for a, b in SETTINGS))
def label_sensitivity(spark, d):
    """Peaks, and those that an end signal called, by what counts as a boom and a bust."""
    ends = P.signals(spark, d).where("NOT buy").select("entity", "day")
    out = None
    for boom, bust in SETTINGS:
        p = P.peaks(spark, d, boom / 100, bust / 100).select("entity", "peak")
        near = p.select("entity", "peak", F.explode(F.sequence(F.date_sub("peak", 30), F.date_add("peak", 1))).alias("day"))
        hit = near.join(ends, ["entity", "day"], "left_semi").select("entity", "peak").distinct().withColumn("hit", F.lit(True))
        row = p.join(hit, ["entity", "peak"], "left").agg(F.count(F.lit(1)).alias("peaks"), F.count_if("hit").alias("called"))
        row = row.select(F.lit(boom).alias("boom"), F.lit(bust).alias("bust"), "peaks", "called")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{SBASE}, {P.SIG}, {P.PEAK}, al AS (SELECT entity, day FROM sig) SELECT a.entity, a.day, CASE WHEN EXISTS (FROM pk p WHERE p.entity = a.entity AND a.day BETWEEN p.peak - 30 AND p.peak + 1) THEN 'HIT' WHEN a.day + 45 > (SELECT max(day) FROM px) THEN 'PENDING' WHEN NOT EXISTS (FROM pk p WHERE p.entity = a.entity AND p.peak BETWEEN a.day AND a.day + 45) THEN 'FA' ELSE 'NEITHER' END AS verdict FROM al a")
def pending_labels(spark, d):
    """An alert that is no hit yet has no verdict until 45 days of prices have passed."""
    last = filled_prices(spark, d).agg(F.date_sub(F.max("day"), 45).alias("ripe"))
    v = P.top_judge(spark, d).join(F.broadcast(last))
    return v.select("entity", "day", F.when((F.col("verdict") != "HIT") & (F.col("day") > F.col("ripe")), "PENDING").otherwise(F.col("verdict")).alias("verdict"))


@query("WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS \"user\", strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM r GROUP BY user_id, k")
def stream_sessions(spark, d):
    """The sessions of session_runs from a stream."""
    e = S.replay(spark, d, "events.parquet").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"))
    sink = S.folder(spark, "sessions")
    S.drain(S.sessions(e), lambda b, k: b.write.mode("overwrite").parquet(f"{sink}/batch={k}"), "complete", S.folder(spark, "sessions-at"))
    rows = spark.read.parquet(sink)
    rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # the last complete answer
    return rows.select("user", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("first", "last")), "n")
