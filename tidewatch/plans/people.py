"""Queries over texts, authors and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text as T
from tidewatch.sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{4,5})\b', 1)) AS tok FROM documents) GROUP BY ALL")
def caps_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(T.caps_tokens(F.col("text"))).alias("tok")).groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT lower(w) AS word, count(*) FILTER (w = upper(w)) AS caps, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b([A-Za-z]{4,5})\b', 1)) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 30")
def caps_ratio_screen(spark, d):
    w = read(spark, d, "documents").select(F.explode(T.runs(F.col("text"), "[A-Za-z]{4,5}")).alias("w"))
    return w.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") == F.upper("w")).alias("caps"), F.count(F.lit(1)).alias("n")).where("n >= 30")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"


@query(rf"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\b([a-z][a-z0-9]{{2,}})\b', 1) AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS t, 1 AS k FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: CASE WHEN NOT list_contains({_STOP}, w[i]) AND NOT list_contains({_STOP}, w[i + 1]) THEN w[i] || ' ' || w[i + 1] END)), 2 FROM w) SELECT t AS term, count(DISTINCT doc_id) AS n FROM p WHERE t IS NOT NULL AND NOT list_contains({_STOP}, t) GROUP BY t HAVING count(DISTINCT doc_id) >= CASE WHEN contains(t, ' ') THEN 5 ELSE 3 END")
def term_bigrams(spark, d):
    return T.term_counts(read(spark, d, "documents"), []).where(F.col("n") >= F.when(F.col("term").contains(" "), 5).otherwise(3))


CALLS = "c AS (SELECT user_id AS author, event_id, ts, (event_type IN ('click', 'purchase'))::INT AS ok, value FROM events), a AS (SELECT author, count(*) AS n, sum(ok) AS hits, avg(ok::DOUBLE) AS m FROM c GROUP BY author), g AS (SELECT avg(ok::DOUBLE) AS g FROM c), s AS (SELECT author, n, hits, (n * m + 10 * g) / (n + 10) AS shrunk FROM a, g)"


@query(f"WITH {CALLS} SELECT author, n, hits::BIGINT AS hits, round(shrunk, 6) AS shrunk, round((shrunk - min(shrunk) OVER ()) / nullif(max(shrunk) OVER () - min(shrunk) OVER (), 0), 6) AS scaled FROM s")
def author_scores(spark, d):
    """Empirical-Bayes hit rates, scaled to 0..1 over all authors."""
    c = read(spark, d, "events").select(F.col("user_id").alias("author"), F.col("event_type").isin("click", "purchase").cast("int").alias("ok"))
    a = c.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("hits"))
    g = a.agg((F.sum("hits") / F.sum("n")).alias("g"))
    s = a.join(F.broadcast(g)).withColumn("shrunk", (F.col("hits") + 10 * F.col("g")) / (F.col("n") + 10))
    lim = s.agg(F.min("shrunk").alias("lo"), F.max("shrunk").alias("hi"))
    return s.join(F.broadcast(lim)).select("author", "n", "hits", F.round("shrunk", 6).alias("shrunk"), F.round((F.col("shrunk") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), 6).alias("scaled"))


@query("SELECT user_id AS author, string_agg(event_type, ', ' ORDER BY ts DESC, event_id) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 3 GROUP BY user_id")
def latest_calls(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    e = read(spark, d, "events").withColumn("k", k).where("k <= 3")
    return e.groupBy(F.col("user_id").alias("author")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]), ", ").alias("latest"))


#: events of one day and props are a thread; its first is a post, the others are comments on the one before (every fifth one's parent is lost)
THREADS = """th AS (SELECT event_id, user_id AS author, row_number() OVER w AS i, lag(event_id) OVER w AS prev, first_value(event_id) OVER w AS head FROM events WINDOW w AS (PARTITION BY ts::DATE, props ORDER BY ts, event_id)),
po AS (SELECT 't3_' || event_id AS id, author FROM th WHERE i = 1),
co AS (SELECT 't1_' || event_id AS id, author, CASE WHEN event_id % 5 = 0 THEN 't1_lost' WHEN i = 2 THEN 't3_' || head ELSE 't1_' || prev END AS parent_id, 't3_' || head AS link_id FROM th WHERE i > 1)"""
EDGES = f"""{THREADS}, rr0 AS (SELECT c.id, c.author AS replier, coalesce(p.author, q.author, l.author) AS author FROM co c LEFT JOIN co p ON p.id = c.parent_id LEFT JOIN po q ON q.id = c.parent_id LEFT JOIN po l ON l.id = c.link_id),
rr AS (SELECT * FROM rr0 WHERE author != replier),
ed AS (SELECT least(replier, author) AS u, greatest(replier, author) AS v, least(count(*), 100)::DOUBLE AS w FROM rr GROUP BY 1, 2), both_ AS (SELECT u, v, w FROM ed UNION ALL SELECT v, u, w FROM ed)"""
DEG = "deg AS (SELECT u, sum(w) AS d FROM both_ GROUP BY u)"


def threads(spark, d):
    """Comments (id, author, parent_id, link_id) and posts (id, author)."""
    w = Window.partitionBy(F.to_date("ts"), "props").orderBy("ts", "event_id")
    t = read(spark, d, "events").select("event_id", F.col("user_id").alias("author"), F.row_number().over(w).alias("i"), F.lag("event_id").over(w).alias("prev"), F.first("event_id").over(w).alias("head"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parent = F.when(F.col("event_id") % 5 == 0, "t1_lost").when(F.col("i") == 2, name("t3_", "head")).otherwise(name("t1_", "prev"))
    comments = t.where("i > 1").select(name("t1_", "event_id").alias("id"), "author", parent.alias("parent_id"), name("t3_", "head").alias("link_id"))
    return comments, t.where("i = 1").select(name("t3_", "event_id").alias("id"), "author")


def edges(spark, d):
    """Replies as weighted undirected pairs."""
    from tidewatch.operators.graph import resolve_replies

    r = resolve_replies(*threads(spark, d))
    return r.groupBy(F.least("replier", "author").alias("u"), F.greatest("replier", "author").alias("v")).agg(F.least(F.count(F.lit(1)), F.lit(100)).cast("double").alias("w"))


@query(f"WITH {EDGES} SELECT id, replier, author FROM rr")
def resolved_replies(spark, d):
    """Whom each comment answers: the author of its parent comment, else of its parent post, else of the post it hangs under; not oneself."""
    from tidewatch.operators.graph import resolve_replies

    return resolve_replies(*threads(spark, d))


@query(f"WITH {EDGES} SELECT u, v, w FROM ed")
def reply_edges(spark, d):
    return edges(spark, d)


@query(f"WITH {EDGES} SELECT u AS author, count(*) AS repliers, sum(w)::BIGINT AS replies FROM both_ GROUP BY u")
def audience(spark, d):
    e = edges(spark, d)
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return both.groupBy(F.col("u").alias("author")).agg(F.count(F.lit(1)).alias("repliers"), F.sum("w").cast("long").alias("replies"))


#: the graph without bots (over 1000 comments or 100 posts; clicks stand for comments, views for posts) and, from 50 nodes on, without stars
CLEAN = f"""{EDGES}, act AS (SELECT user_id AS node FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') > 1000 OR count(*) FILTER (event_type = 'view') > 100),
e1 AS (SELECT * FROM ed WHERE u NOT IN (SELECT node FROM act) AND v NOT IN (SELECT node FROM act)), dg AS (SELECT node, count(*) AS k FROM (SELECT u AS node FROM e1 UNION ALL SELECT v FROM e1) GROUP BY node),
star AS (SELECT node FROM dg, (SELECT count(*) AS n FROM dg) WHERE n >= 50 AND k > 0.5 * (n - 1)), e2 AS (SELECT * FROM e1 WHERE u NOT IN (SELECT node FROM star) AND v NOT IN (SELECT node FROM star)),
bw AS (SELECT u, v, w FROM e2 UNION ALL SELECT v, u, w FROM e2), dw AS (SELECT u, sum(w) AS d, count(*) OVER () AS n FROM bw GROUP BY u),
st AS MATERIALIZED (SELECT bw.u, bw.v, w / d AS p, n FROM bw JOIN dw USING (u)),
rk AS (SELECT 0 AS k, u, 1.0::DOUBLE / n AS x FROM dw UNION ALL SELECT k + 1, st.v, 0.15 / any_value(n) + 0.85 * sum(x * p) FROM rk JOIN st ON st.u = rk.u WHERE k < 50 GROUP BY k, st.v)"""


def activity(spark, d):
    """Clicks stand for comments and views for posts, as in participation."""
    kind = F.col("event_type")
    return read(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.count_if(kind == "click").alias("n_comments"), F.count_if(kind == "view").alias("n_posts"))


@query(f"WITH RECURSIVE {CLEAN} SELECT u AS author, round(x, 7) AS rank FROM rk WHERE k = 50")
def pagerank_50(spark, d):
    """The whole number of rounds, on the graph without bots and stars."""
    from tidewatch.operators.graph import pagerank, without_bots

    return pagerank(without_bots(edges(spark, d), activity(spark, d))).select(F.col("node").alias("author"), F.round("rank", 7).alias("rank"))
