"""Queries that write stores and read them back, and queries over raw files in the shapes of their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import aggregates as A
from tidewatch.operators import stores as K
from tidewatch.plans.people import THREADS, threads
from tidewatch.sources import readers as R
from tidewatch.sources.posts import POSTS, order_posts
from tidewatch.sources.tables import BASE, SBASE, mentions, read, scored
from tidewatch.streaming.folds import folder

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{BASE} SELECT day, entity, n FROM cnt")
def store_upsert(spark, d):
    """Counts of the odd orders in a store, those of the even ones merged into it."""
    store, m = folder(spark, "counts"), mentions(spark, d)
    merge = lambda old, new: A.merge_counts(old, new, ["day", "entity"])
    for part in (1, 0):
        K.upsert(A.daily_counts(m.where(F.col("id") % 2 == part)), store, merge)
    return K.load(spark, store).select("day", "entity", "n")


@query(f"{SBASE} SELECT day, entity, n_posts, round(avg_sentiment, 8) + 0.0 AS avg_sentiment, round(net_bullish, 8) + 0.0 AS net_bullish FROM sent")
def store_sentiment_upsert(spark, d):
    """The same with means, weighted by their posts."""
    store, s = folder(spark, "sentiment"), scored(spark, d)
    early = F.col("source") == "N"
    for part in (s.where(early), s.where(~early)):
        K.upsert(A.daily_sentiment(part), store, lambda old, new: A.merge_sentiment(old, new, ["day", "entity"]))
    return K.load(spark, store).select("day", "entity", "n_posts", *((F.round(c, 8) + 0.0).alias(c) for c in ("avg_sentiment", "net_bullish")))


@query("SELECT event_id, user_id, event_type FROM events")
def store_append(spark, d):
    """Two overlapping deliveries; rows whose id the store has do not come again."""
    store, e = folder(spark, "events"), read(spark, d, "events").select("event_id", "user_id", "event_type")
    K.append_new(e.where("event_id % 3 != 1"), store, "event_id")
    K.append_new(e.where("event_id % 3 != 2").unionByName(e.where("event_id % 3 = 1")), store, "event_id")
    return K.load(spark, store)


@query(f"{BASE} SELECT day, entity, CASE WHEN day >= DATE '1998-01-01' AND entity IN ('BUILDING', 'MACHINERY') THEN 2 * n ELSE n END AS n FROM cnt")
def store_group_replace(spark, d):
    """Groups (day, entity) that come again take the place of the old ones."""
    store, c = folder(spark, "groups"), A.daily_counts(mentions(spark, d))
    K.replace(c, store)
    again = c.where("day >= DATE '1998-01-01' AND entity IN ('BUILDING', 'MACHINERY')").withColumn("n", 2 * F.col("n"))
    K.replace_groups(again, store, ["day", "entity"])
    return K.load(spark, store).select("day", "entity", "n")


@query(f"{BASE} SELECT day, entity, CASE WHEN day > (SELECT max(day) FROM cnt) - 45 THEN n + 1 ELSE n END AS n FROM cnt")
def store_tail_splice(spark, d):
    """The last 45 days computed anew and spliced in."""
    store, c = folder(spark, "tail"), A.daily_counts(mentions(spark, d))
    K.replace(c, store)
    K.splice_tail(c.withColumn("n", F.col("n") + 1), store, 45)
    return K.load(spark, store).select("day", "entity", "n")


@query(f"{BASE} SELECT DATE '2024-05-01' AS day, entity, count(*) AS n FROM ev GROUP BY entity")
def store_snapshot(spark, d):
    """A day's snapshot is written once; what comes later for that day changes nothing."""
    at, c = folder(spark, "snapshots"), mentions(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    for k in (1, 5):
        K.snapshot(c.withColumn("n", k * F.col("n")), at, "2024-05-01")
    return spark.read.parquet(at).select(F.to_date("day").alias("day"), "entity", "n")


@query(f"{BASE} SELECT 'export' AS part, day, entity, n FROM cnt UNION ALL SELECT 'hydrate', day, entity, n FROM cnt")
def store_copy(spark, d):
    """Stores exported to another folder and back."""
    here, there, back = (folder(spark, x) for x in ("here", "there", "back"))
    K.replace(A.daily_counts(mentions(spark, d)), f"{here}/daily_counts")
    K.copy_store(spark, here, there)
    K.copy_store(spark, there, back)
    return K.load(spark, f"{there}/daily_counts").withColumn("part", F.lit("export")).unionByName(K.load(spark, f"{back}/daily_counts").withColumn("part", F.lit("hydrate"))).select("part", "day", "entity", "n")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 500")
def ledger_newest(spark, d):
    """A ledger of what was seen keeps its newest 500."""
    e = read(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    return K.newest(e, "ts", 500, "event_id")


@query(f"{SBASE} SELECT source, max(day) AS newest, (DATE '1999-01-02' - max(day))::INT AS age, CASE WHEN DATE '1999-01-02' - max(day) <= 2 THEN 'LIVE' ELSE 'STALE' END AS verdict FROM sc GROUP BY source")
def source_staleness(spark, d):
    return K.staleness(scored(spark, d).select("source", "day"), "1999-01-02")


@query(f"{BASE} SELECT day, entity, n FROM cnt WHERE day >= DATE '1999-06-01'")
def recent_scan(spark, d):
    """A day range and three columns, which both reach the Parquet scan, in the form of a given schema."""
    store = folder(spark, "recent")
    A.daily_counts(mentions(spark, d)).withColumn("unused", F.lit("x")).write.parquet(store)
    assert R.schema_of(spark, store)["n"] == "bigint"
    return R.conform(R.recent(spark, store, "1999-06-01", ["entity", "n", "day"]), "day date, entity string, n long")


@query("SELECT 'e' || event_id AS id, ts::DATE AS day, 'u' || user_id AS author, event_type AS title, (props::JSON ->> 'k')::INT AS score FROM events")
def json_lines_scan(spark, d):
    """Records as compressed JSON lines in several files, with broken lines and lines that are no object between them."""
    from tidewatch.sources.records import normalise

    at, e = folder(spark, "jsonl"), read(spark, d, "events")
    when = F.unix_timestamp(F.col("ts").cast("timestamp"))
    line = F.to_json(F.struct(F.concat(F.lit("e"), "event_id").alias("id"), when.alias("created_utc"), F.concat(F.lit("u"), "user_id").alias("author"), F.col("event_type").alias("title"), F.get_json_object("props", "$.k").alias("score")))
    lines = e.select(F.explode(F.array(line, F.concat(F.lit('{"id": "cut'), "event_id"), F.lit("[1, 2]"), F.lit(""))).alias("value"))
    lines.repartition(3).write.option("compression", "gzip").text(f"{at}/in")
    files = K.Files(spark, at)
    for k, (name, *_) in enumerate(x for x in files.listed(f"{at}/in") if x[0].endswith(".gz")):
        files.fs.rename(files.path(f"{at}/in/{name}"), files.path(f"{at}/in/part{k}.jsonl.gz"))
    paths = [f"{at}/in/{n}" for n, *_ in files.listed(f"{at}/in") if n.endswith(".jsonl.gz")]
    return normalise(R.read_lines(spark, paths)).select("id", "day", "author", "title", "score")


@query(f"WITH {POSTS} SELECT id, day, author, title, coalesce(body, '') AS body FROM posts")
def csv_scan(spark, d):
    """Posts as CSV with a header, quotes and line breaks within fields."""
    at = folder(spark, "csv")
    p = order_posts(spark, d).select("id", "day", "author", F.concat(F.lit('say "'), "title", F.lit('",\nthen')).alias("title"), "body")
    p.write.option("header", True).option("escape", '"').csv(f"{at}/posts.csv")
    back = R.read_csv(spark, [f"{at}/posts.csv"], "id string, day date, author string, title string, body string")
    return back.select("id", "day", "author", F.regexp_extract("title", '^say "(.*)",\nthen$', 1).alias("title"), F.coalesce("body", F.lit("")).alias("body"))


@query(f"WITH {THREADS} SELECT id, kind, 'u' || author AS author FROM (SELECT id, 'post' AS kind, author FROM po UNION ALL SELECT id, 'comment', author FROM co) WHERE author % 10 != 3")
def author_records(spark, d):
    """Posts and comments with their authors; deleted and automatic ones, and records without a time, go."""
    comments, posts = threads(spark, d)
    name = F.when(F.col("author") % 20 == 3, "[deleted]").when(F.col("author") % 20 == 13, "AutoModerator").otherwise(F.concat(F.lit("u"), "author"))
    raw = lambda rows, *more: rows.select(F.explode(F.array(F.to_json(F.struct(F.substring("id", 4, 30).alias("id"), name.alias("author"), F.lit("1700000000").alias("created_utc"), *more)), F.to_json(F.struct(F.lit("x").alias("id"), F.lit("no time").alias("author"))))).alias("raw"))
    return R.author_records(raw(posts), raw(comments, "parent_id", "link_id")).select("id", "kind", "author")


@query("SELECT 'e' || event_id AS id, ts::DATE AS day, 'u' || user_id AS author, event_type AS title FROM events WHERE event_id % 7 != 6")
def third_party_posts(spark, d):
    """Records of two backends in one batch: each with its own names of fields; one in seven has no title."""
    e = read(spark, d, "events").withColumn("title", F.when(F.col("event_id") % 7 != 6, F.col("event_type")))
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt")
    id_, name = F.concat(F.lit("e"), "event_id"), F.concat(F.lit("u"), "user_id")
    official = F.to_json(F.struct(F.lit("official").alias("_backend"), id_.alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_utc"), name.alias("author"), "title"))
    other = F.to_json(F.struct(F.lit("other").alias("_backend"), id_.alias("postId"), iso, F.struct(name.alias("handle")).alias("author"), "title", F.lit("text").alias("body")))
    return R.third_party(e.select(F.when(F.col("event_id") % 2 == 0, official).otherwise(other).alias("raw"))).select("id", "day", "author", "title")


@query("SELECT 'st_' || event_id AS id, ts::DATE AS day, 'u' || user_id AS author, event_type AS selftext, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 END::DOUBLE AS own_score FROM events")
def stream_messages(spark, d):
    """Messages of a symbol stream, with the author's own label as a score."""
    from tidewatch.functions.scoring import author_label

    e = read(spark, d, "events")
    label = F.when(F.col("event_id") % 3 == 0, "Bullish").when(F.col("event_id") % 3 == 1, "bearish")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("body"), iso.alias("created_at"), F.struct(F.concat(F.lit("u"), "user_id").alias("username")).alias("user"), F.struct(F.struct(label.alias("basic")).alias("sentiment")).alias("entities")))
    m = R.messages(e.select(raw.alias("raw")))
    return m.select("id", "day", "author", "selftext", author_label(F.col("label")).alias("own_score"))


@query("SELECT 'e' || event_id AS id, ts::DATE AS day, 'reddit' AS source FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'st_' || event_id, ts::DATE, 'stream' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT 'x_' || event_id, ts::DATE, 'tweets' FROM events WHERE event_id % 3 = 2")
def collected_posts(spark, d):
    """Three collectors, one frame of posts: each source's own reader, the same columns, one row an id (deliveries overlap)."""
    e = read(spark, d, "events")
    id_, iso = F.col("event_id").cast("string"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")
    body = F.col("event_type").alias("body")
    parts = [
        ("reddit", R.third_party(e.where("event_id % 3 = 0").select(F.to_json(F.struct(F.concat(F.lit("e"), id_).alias("id"), iso, F.col("event_type").alias("title"))).alias("raw")))),
        ("stream", R.messages(e.where("event_id % 3 = 1").select(F.to_json(F.struct(id_.alias("id"), iso, body)).alias("raw")))),
        ("tweets", R.tweets(e.where("event_id % 3 = 2").select(id_.alias("id"), iso, F.col("event_type").alias("text")), "rows")),
    ]
    out = None
    for name, posts in parts:
        rows = R.conform(posts.withColumn("source", F.lit(name)), "id string, day date, source string")
        again = rows.where(F.xxhash64("id") % 4 == 0)
        out = rows.unionByName(again) if out is None else out.unionByName(rows).unionByName(again)
    return A.first_seen(out, ["id"], ["day", "source"]).select("id", "day", "source")


@query("SELECT ['embeds', 'rows', 'api', 'engagement'][event_id % 4 + 1] AS dataset, 'x_' || event_id AS id, ts::DATE AS day, CASE WHEN event_id % 4 != 1 THEN 'u' || user_id END AS author, event_type AS title, CASE event_id % 4 WHEN 2 THEN 3 WHEN 3 THEN 7 ELSE 0 END::INT AS score FROM events")
def tweet_posts(spark, d):
    """Four tweet datasets, each by its own columns, as posts."""
    e = read(spark, d, "events")
    id_, name, iso = F.col("event_id").cast("string"), F.concat(F.lit("u"), "user_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    api = e.select(F.to_json(F.struct(F.struct(id_.alias("id"), F.col("event_type").alias("text"), iso.alias("created_at")).alias("tweet"), F.struct(name.alias("userName")).alias("author"), F.lit(3).alias("likeCount"))).alias("raw"), "event_id")
    frames = {
        "embeds": e.select("event_id", F.concat(F.lit("https://x.example/a/status/"), id_).alias("url"), iso.alias("timestamp"), F.concat(name, F.lit(" on X: hello")).alias("embed_title"), F.col("event_type").alias("description")),
        "rows": e.select("event_id", id_.alias("id"), day.alias("created_at"), F.col("event_type").alias("text")),
        "api": None,
        "engagement": e.select("event_id", id_.alias("tweet_id"), name.alias("writer"), epoch.alias("post_date"), F.col("event_type").alias("body"), F.lit("4").alias("comment_num"), F.lit("3").alias("like_num"), F.explode(F.array(F.lit("AA"), F.lit("BB"))).alias("symbol")),
    }
    out = None
    for k, (name_, frame) in enumerate(frames.items()):
        rows = R.flat_tweet(api.where(F.col("event_id") % 4 == k)) if frame is None else frame.where(F.col("event_id") % 4 == k)
        part = R.tweets(rows, name_).select(F.lit(name_).alias("dataset"), "id", "day", "author", "title", "score")
        out = part if out is None else out.unionByName(part)
    return out
