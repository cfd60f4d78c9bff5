"""Queries from the text of dated posts: symbols, themes, terms, sentiment, and communities that posts refer to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.functions import text as T
from tidewatch.operators import aggregates as A
from tidewatch.sources.posts import LISTED, POSTS, full_text, order_posts, universe

QUERIES, ORACLES = {}, {}
STOP_TICKERS, PROSE = ["THIS", "THAT", "NOT", "NACX"], ["EDGE"]
#: (theme, keyword); a keyword with a blank, hyphen or dot is a phrase
THEMES = [(f"group{k % 5}", "n" + "".join("abcdefghij"[int(c)] for c in f"{k:02d}") + "x") for k in range(25)]
THEMES += [("loss", "terrible loss"), ("loss", "not bad"), ("calls", "edge calls"), ("calls", "dge call"), ("place", "(r/naax")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _found(column: str, place: str) -> str:
    t = f"coalesce({column}, '')"
    tag = f"SELECT id, unnest(regexp_extract_all(upper({t}), '\\$([A-Z]{{1,5}})\\b', 1)) AS ticker, '{place}' AS place FROM posts"
    bare = f"SELECT id, unnest(regexp_extract_all(regexp_replace({t}, '\\$[A-Z]{{1,5}}\\b', ' ', 'g'), '\\b([A-Z]{{4,5}})\\b', 1)) AS ticker, '{place}' AS place FROM posts"
    return f"SELECT * FROM ({tag}) WHERE ticker NOT IN {_in(STOP_TICKERS)} UNION ALL SELECT * FROM ({bare}) WHERE ticker NOT IN {_in(STOP_TICKERS + PROSE)}"


MENTIONS = f"{POSTS}, {LISTED}, fnd AS ({_found('title', 'title')} UNION ALL {_found('body', 'body')}), mn AS (SELECT id, place, ticker, count(*) AS n FROM fnd WHERE ticker IN (FROM uni) GROUP BY ALL)"


def found(spark, d):
    return T.mentions(order_posts(spark, d), universe(spark, d), STOP_TICKERS, PROSE)


@query(f"WITH {LISTED} SELECT symbol FROM uni")
def symbol_universe(spark, d):
    """Symbols of a pipe-separated listing and of the delisted supplement."""
    return universe(spark, d)


@query(f"WITH {MENTIONS} SELECT id, place, ticker, n FROM mn")
def cashtag_extract(spark, d):
    """Symbols by place in the post. Stop words never count; words that are symbols as well count as cashtags only."""
    return found(spark, d)


@query(f"WITH {MENTIONS} SELECT day, ticker, count(DISTINCT id) AS n FROM mn JOIN posts USING (id) GROUP BY ALL")
def ticker_daily_mentions(spark, d):
    """A post counts once a symbol, wherever and however often it names it."""
    ids = found(spark, d).select("id", "ticker").distinct()
    return ids.join(order_posts(spark, d).select("id", "day"), "id").groupBy("day", "ticker").agg(F.count(F.lit(1)).alias("n"))


_KEYS = "ky AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in THEMES) + ") v(theme, keyword))"
TAGGED = f"{POSTS}, {_KEYS}, tg AS (SELECT DISTINCT id, day, theme FROM txt JOIN ky ON CASE WHEN regexp_matches(keyword, '[ .\\-]') THEN contains(lower(t), keyword) ELSE list_contains(regexp_extract_all(lower(t), '[a-z0-9]+'), keyword) END)"


def tagged(spark, d):
    return T.themes(full_text(order_posts(spark, d)), spark.createDataFrame(THEMES, "theme string, keyword string"))


@query(f"WITH {TAGGED} SELECT day, theme, count(*) AS n, 0 AS n_weighted FROM tg GROUP BY ALL")
def theme_daily(spark, d):
    posts = order_posts(spark, d).select("id", "day")
    return tagged(spark, d).join(posts, "id").groupBy("day", "theme").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("n_weighted"))


_STOP = _in(T.STOP)
TERMS = rf"""{POSTS}, tw AS (SELECT id, day, regexp_extract_all(lower(t), '\b([a-z][a-z0-9]{{2,}})\b', 1) AS w FROM txt),
tm AS (SELECT DISTINCT id, day, term FROM (SELECT id, day, unnest(w) AS term FROM tw UNION ALL SELECT id, day, unnest(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] NOT IN {_STOP} AND w[i + 1] NOT IN {_STOP} THEN w[i] || ' ' || w[i + 1] END)) FROM tw) WHERE term IS NOT NULL AND term NOT IN {_STOP}),
td0 AS (SELECT day, term, count(*) AS n FROM tm GROUP BY ALL), td AS (SELECT * FROM td0 WHERE n >= CASE WHEN contains(term, ' ') THEN 5 ELSE 3 END UNION ALL SELECT day, '__TOTAL__', count(*) FROM posts GROUP BY day),
tr AS (SELECT * FROM td WHERE day >= (SELECT max(day) FROM td) - 365)"""


def daily_terms(spark, d, words: int = 3, pairs: int = 5):
    """Terms a day from a floor on, and the day's number of posts as a row of its own."""
    posts = full_text(order_posts(spark, d)).select("day", F.col("t").alias("text"))
    counts = T.term_counts(posts, ["day"]).where(F.col("n") >= F.when(F.col("term").contains(" "), pairs).otherwise(words))
    total = posts.groupBy("day").agg(F.lit("__TOTAL__").alias("term"), F.count(F.lit(1)).alias("n"))
    return counts.unionByName(total)


def retained(counts, days: int = 365):
    """What lies within that many days of the newest day."""
    return counts.join(F.broadcast(counts.agg(F.max("day").alias("_top")))).where(F.col("day") >= F.date_sub("_top", days)).drop("_top")


@query(f"WITH {TERMS} SELECT day, term, n FROM td")
def term_daily(spark, d):
    return daily_terms(spark, d)


@query(f"WITH {TERMS} SELECT day, term, n FROM tr")
def term_retention(spark, d):
    return retained(daily_terms(spark, d))


@query(f"WITH {TERMS}, {LISTED}, {_KEYS}, mx AS (SELECT max(day) AS m FROM td), cn AS (SELECT term, coalesce(sum(n) FILTER (day > m - 14), 0)::BIGINT AS n, coalesce(sum(n) FILTER (day <= m - 14), 0)::BIGINT AS b FROM td, mx WHERE day > m - 194 GROUP BY term), tt AS (SELECT n AS nn, b AS bb FROM cn WHERE term = '__TOTAL__') SELECT term, n, b, round((n::DOUBLE / nn) / ((b + 1)::DOUBLE / bb), 5) AS spike FROM cn, tt WHERE term != '__TOTAL__' AND n >= 25 AND term NOT IN (SELECT lower(symbol) FROM uni) AND term NOT IN (SELECT keyword FROM ky)")
def spike_terms(spark, d):
    """Emerging terms: the share of the last 14 days' posts against that of the 180 days before, from 25 posts on, without known symbols and keywords."""
    t = daily_terms(spark, d)
    t = t.join(F.broadcast(t.agg(F.max("day").alias("m")))).where("day > date_sub(m, 194)")
    late = F.col("day") > F.date_sub("m", 14)
    c = t.groupBy("term").agg(*(F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(a) for a, x in (("n", late), ("b", ~late))))
    total = c.where("term = '__TOTAL__'").select(F.col("n").alias("nn"), F.col("b").alias("bb"))
    known = universe(spark, d).select(F.lower("symbol").alias("term")).unionByName(spark.createDataFrame([(k,) for _, k in THEMES], "term string"))
    new = c.where("term != '__TOTAL__' AND n >= 25").join(known, "term", "left_anti")
    return new.join(F.broadcast(total)).select("term", "n", "b", F.round(F.col("n") / F.col("nn") / ((F.col("b") + 1) / F.col("bb")), 5).alias("spike"))


_LEX = "MAP {" + ", ".join(f"'{w}': {v}::DOUBLE" for w, v in S.LEXICON.items()) + "}"
SCORES = f"""{POSTS}, sw AS (SELECT *, regexp_extract_all(lower(left(t, {S.READ})), '[a-z]+') AS w FROM txt),
ss AS (SELECT *, coalesce(list_sum(list_transform(range(1, len(w) + 1), lambda i: coalesce({_LEX}[w[i]], 0) * CASE WHEN i > 1 AND w[i - 1] IN {_in(S.NEGATORS)} THEN {S.TURN} ELSE 1 END)), 0) AS s0 FROM sw),
s1 AS (SELECT *, s0 + {S.MARK} * least(4, length(left(t, {S.READ})) - length(replace(left(t, {S.READ}), '!', ''))) * sign(s0) AS s FROM ss), sx AS (SELECT id, day, s / sqrt(s * s + {S.SCALE}) AS sentiment FROM s1)"""


def scored_posts(spark, d):
    return S.with_sentiment(full_text(order_posts(spark, d)).select("id", "day", "t"), "t").select("id", "day", "sentiment")


@query(f"WITH {SCORES} SELECT id, round(sentiment, 6) + 0.0 AS sentiment FROM sx")
def sentiment_scores(spark, d):
    return scored_posts(spark, d).select("id", (F.round("sentiment", 6) + 0.0).alias("sentiment"))


@query(f"WITH {SCORES} SELECT id, round(sentiment, 6) + 0.0 AS sentiment FROM sx")
def sentiment_cached(spark, d):
    """Half of the posts are scored into a store first; then all, of which only the rest is new."""
    from tidewatch.streaming.folds import folder

    store = folder(spark, "scores")
    posts = full_text(order_posts(spark, d)).select("id", "t")
    S.with_cached_sentiment(posts.where("id < 'o5'"), "t", store).write.format("noop").mode("overwrite").save()
    return S.with_cached_sentiment(posts, "t", store).select("id", (F.round("sentiment", 6) + 0.0).alias("sentiment"))


@query(f"WITH {MENTIONS}, {SCORES.split(', ', 1)[0] and SCORES[len(POSTS) + 2:]} SELECT day, ticker AS entity, count(*) AS n_posts, round(avg(sentiment), 6) + 0.0 AS avg_sentiment, round((count(*) FILTER (sentiment > 0.02) - count(*) FILTER (sentiment < -0.02))::DOUBLE / count(*), 6) + 0.0 AS net_bullish FROM (SELECT DISTINCT id, ticker FROM mn) JOIN sx USING (id) GROUP BY ALL")
def ticker_daily_sentiment(spark, d):
    rows = found(spark, d).select("id", F.col("ticker").alias("entity")).distinct().join(scored_posts(spark, d), "id").withColumnRenamed("sentiment", "score")
    s = A.daily_sentiment(rows)
    return s.select("day", "entity", "n_posts", *((F.round(c, 6) + 0.0).alias(c) for c in ("avg_sentiment", "net_bullish")))


@query(f"WITH {MENTIONS}, {TAGGED[len(POSTS) + 2:]}, {SCORES[len(POSTS) + 2:]} SELECT 'ticker' AS kind, day, ticker AS entity, count(DISTINCT id) AS n FROM mn JOIN posts USING (id) GROUP BY ALL UNION ALL SELECT 'theme', day, theme, count(*) FROM tg GROUP BY ALL UNION ALL SELECT 'source', day, source, count(*) FROM posts GROUP BY ALL UNION ALL SELECT 'bullish', day, source, count(*) FROM posts JOIN sx USING (id, day) WHERE sentiment > 0.02 GROUP BY ALL")
def one_pass_aggregates(spark, d):
    """Several aggregates of posts that are enriched once: symbols, themes and sentiment become columns of one table, cut before it is grouped."""
    posts = full_text(order_posts(spark, d))
    lists = found(spark, d).groupBy("id").agg(F.collect_set("ticker").alias("tickers"))
    themes = tagged(spark, d).groupBy("id").agg(F.collect_set("theme").alias("themes"))
    full = S.with_sentiment(posts, "t").join(lists, "id", "left").join(themes, "id", "left").select("day", "source", "tickers", "themes", "sentiment")
    bullish = F.when(F.col("sentiment") > 0.02, F.array("source"))
    keys = (("ticker", F.col("tickers")), ("theme", F.col("themes")), ("source", F.array("source")), ("bullish", bullish))
    marked = lambda k, v: F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("entity")))
    each = F.flatten(F.array(*(marked(k, v) for k, v in keys)))
    return full.select("day", F.explode(each).alias("e")).groupBy("e.kind", "day", "e.entity").agg(F.count(F.lit(1)).alias("n"))


REFERRED = rf"{POSTS}, rf AS (SELECT DISTINCT source, author, day, unnest(regexp_extract_all(body, '(?:^|[\s(\[])/?r/([A-Za-z0-9_]{{3,21}})\b', 1)) AS candidate FROM posts)"


def referred(spark, d):
    p = order_posts(spark, d)
    return p.select("id", "day", "source", "author", F.explode(T.referrals(F.col("body"))).alias("candidate"))


@query(f"WITH {REFERRED} SELECT candidate, count(DISTINCT author) AS referrers FROM rf WHERE candidate != source GROUP BY 1")
def referrals(spark, d):
    """Authors who refer to a community from another one."""
    return referred(spark, d).where("candidate != source").groupBy("candidate").agg(F.count_distinct("author").alias("referrers"))


@query(f"WITH {MENTIONS} SELECT source, round(avg((id IN (SELECT id FROM mn WHERE place = 'body'))::INT::DOUBLE), 6) AS rate FROM posts GROUP BY source")
def ticker_rate(spark, d):
    """The share of a community's posts that name a symbol in their body."""
    return rates(spark, d).select("source", F.round("rate", 6).alias("rate"))


def rates(spark, d):
    named = found(spark, d).where("place = 'body'").select("id").distinct().withColumn("named", F.lit(1.0))
    return order_posts(spark, d).select("id", "source").join(named, "id", "left").groupBy("source").agg(F.avg(F.coalesce("named", F.lit(0.0))).alias("rate"))


PANEL = ["automobile", "building"]


@query(f"WITH {REFERRED}, {MENTIONS[len(POSTS) + 2:]}, rt AS (SELECT source, avg((id IN (SELECT id FROM mn WHERE place = 'body'))::INT::DOUBLE) AS rate FROM posts GROUP BY source), q AS (SELECT candidate, count(DISTINCT author) AS referrers FROM rf GROUP BY 1 HAVING count(DISTINCT author) >= 100) SELECT candidate, referrers, round(rate, 6) AS rate FROM q JOIN rt ON source = candidate WHERE candidate NOT IN {_in(PANEL)} AND rate >= 0.5 * (SELECT avg(rate) FROM rt WHERE source IN {_in(PANEL)}) ORDER BY referrers DESC, candidate LIMIT 1")
def panel_addition(spark, d):
    """The community to add to the panel: 100 referrers, a measurable rate of symbols of half the panel's average, not in it; one at most."""
    from tidewatch.operators.panel import screen

    q = referred(spark, d).groupBy("candidate").agg(F.count_distinct("author").alias("referrers"))
    out = screen(q, rates(spark, d).withColumnRenamed("source", "community"), PANEL)
    return out.select("candidate", "referrers", F.round("rate", 6).alias("rate"))


@query(rf"WITH {POSTS}, w AS (SELECT unnest(regexp_extract_all(t, '\b([A-Za-z]{{4,5}})\b', 1)) AS w FROM txt), c AS (SELECT lower(w) AS word, count(*) FILTER (w = upper(w)) AS caps, count(*) AS n FROM w GROUP BY 1) SELECT word, caps, n, CASE WHEN n < 30 THEN 'unseen' WHEN caps / n::DOUBLE < 0.5 THEN 'word' ELSE 'ticker' END AS verdict FROM c")
def word_tickers(spark, d):
    """Words of four or five letters by how often they stand in capitals: seldom is prose, else a symbol; under 30 sightings tell nothing."""
    w = full_text(order_posts(spark, d)).select(F.explode(T.runs(F.col("t"), "[A-Za-z]{4,5}")).alias("w"))
    c = w.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") == F.upper("w")).alias("caps"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("verdict", F.when(F.col("n") < 30, "unseen").when(F.col("caps") / F.col("n") < 0.5, "word").otherwise("ticker"))
