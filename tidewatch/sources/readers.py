"""Readers of raw folders: JSON lines and CSV (plain or compressed), and the shapes of the sources that fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.stores import Files
from tidewatch.sources.records import day_of, first_of, normalise

# Endings of input files, and words by which a deleted or automatic author is known.
ENDINGS = (".ndjson.zst", ".jsonl.zst", ".json.zst", ".csv.zst", ".zst", ".ndjson", ".jsonl", ".json", ".csv", ".parquet")
NOBODY = ("[deleted]", "[removed]", "automoderator", "")
MARKERS = (" on X:", " on Twitter:", " (@")


def find_inputs(spark: SparkSession, path: str) -> list[str]:
    """Input files of a folder, or the file itself; by name."""
    files = Files(spark, path)
    if files.exists(path) and files.fs.getFileStatus(files.path(path)).isFile():
        return [path] if path.lower().endswith(ENDINGS) else []
    return [f"{path}/{n}" for n, *_ in files.listed(path) if n.lower().endswith(ENDINGS)]


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON lines (raw: one text a record), plain or compressed as the file's ending says. Lines that are no object are dropped; broken bytes
    become replacement characters."""
    raw = spark.read.text(paths).select(F.trim("value").alias("raw")) if paths else spark.createDataFrame([], "raw string")
    return raw.where("raw LIKE '{%' AND try_parse_json(raw) IS NOT NULL")


def read_csv(spark: SparkSession, paths: list[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header and quoted line breaks; every column a string unless a schema says otherwise."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(paths)


def recent(spark: SparkSession, path: str, cutoff: str, columns: list[str]) -> DataFrame:
    """A store's rows from a day on, only the columns asked for: both reach the Parquet scan."""
    return spark.read.parquet(path).select(*columns).where(F.col("day") >= F.to_date(F.lit(cutoff)))


def conform(frame: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its order and types; missing ones are null, others go."""
    want = frame.sparkSession.createDataFrame([], schema).schema
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want))


def schema_of(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and types from the files' footers; no rows are read."""
    return {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}


def author_records(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """raw JSON lines of posts and comments -> (id, kind, author, day, text, parent_id, link_id); without author, time or a human author: none."""

    def rows(raw: DataFrame, kind: str, prefix: str) -> DataFrame:
        j = lambda k: F.get_json_object("raw", f"$.{k}")
        text = F.concat_ws(" ", j("title"), j("selftext"), j("body"))
        return raw.select(F.concat(F.lit(prefix), j("id")).alias("id"), F.lit(kind).alias("kind"), j("author").alias("author"), day_of(j("created_utc")).alias("day"), text.alias("text"), j("parent_id").alias("parent_id"), j("link_id").alias("link_id"))

    both = rows(posts, "post", "t3_").unionByName(rows(comments, "comment", "t1_"))
    return both.where("id IS NOT NULL AND day IS NOT NULL AND author IS NOT NULL").where(~F.lower("author").isin(*NOBODY))


def third_party(records: DataFrame) -> DataFrame:
    """Records of several backends (raw, with _backend): those of the official one keep its fields, others the first place that holds something.
    A post needs id, day and a title; of one id the earliest stays."""
    official = records.where(F.coalesce(F.get_json_object("raw", "$._backend"), F.lit("")) == "official")
    other = records.where(F.coalesce(F.get_json_object("raw", "$._backend"), F.lit("")) != "official")
    posts = normalise(official, {"when": ["created_utc"], "author": ["author"], "id": ["id"]}).unionByName(normalise(other))
    return posts.where("title != ''").groupBy("id").agg(F.min(F.struct(*[c for c in posts.columns if c != "id"])).alias("r")).select("id", "r.*")


def messages(records: DataFrame) -> DataFrame:
    """Messages of a symbol stream (raw) -> posts with the author's own label."""
    j = lambda k: F.get_json_object("raw", f"$.{k}")
    posts = records.select(F.concat(F.lit("st_"), j("id")).alias("id"), F.to_date(F.substring(j("created_at"), 1, 10)).alias("day"), j("user.username").alias("author"), F.lit("").alias("title"), j("body").alias("selftext"), j("entities.sentiment.basic").alias("label"))
    return posts.where("id IS NOT NULL AND day IS NOT NULL AND trim(selftext) != ''").dropDuplicates(["id"])


def embed_author(title: Column) -> Column:
    """The name before the first of the markers in an embed's title."""
    found = [F.when(F.contains(title, F.lit(m)), F.trim(F.split_part(title, F.lit(m), F.lit(1)))) for m in MARKERS]
    return F.coalesce(*found)


def _tweet(id_: Column, when: Column, author: Column, text: Column, score: Column) -> list[Column]:
    return [F.concat(F.lit("x_"), id_).alias("id"), day_of(when).alias("day"), author.alias("author"), text.alias("title"), F.coalesce(score.try_cast("int"), F.lit(0)).alias("score")]


#: the tweet datasets: how each one's columns become a post
DATASETS = {
    "embeds": lambda c: _tweet(F.regexp_extract(c("url"), r"/status/(\d+)", 1), c("timestamp"), embed_author(c("embed_title")), c("description"), F.lit("0")),
    "rows": lambda c: _tweet(c("id"), c("created_at"), F.lit(None).cast("string"), c("text"), F.lit("0")),
    "api": lambda c: _tweet(c("id"), c("created_at"), c("author"), c("text"), c("likes")),
    "engagement": lambda c: _tweet(c("tweet_id"), c("post_date"), c("writer"), c("body"), c("comment_num").try_cast("int") + c("like_num").try_cast("int")),
}


def tweets(frame: DataFrame, dataset: str) -> DataFrame:
    """A tweet dataset as posts; without id, day or text: none; of one id the first by text."""
    if dataset not in DATASETS:
        raise ValueError(f"no dataset {dataset}; known: {', '.join(sorted(DATASETS))}")
    posts = frame.select(*DATASETS[dataset](F.col)).where("id != 'x_' AND day IS NOT NULL AND trim(title) != ''")
    return posts.groupBy("id").agg(F.min(F.struct("title", "day", "author", "score")).alias("r")).select("id", "r.day", "r.author", "r.title", "r.score")


def flat_tweet(records: DataFrame) -> DataFrame:
    """Records of a tweet API (raw, fields in several places) as rows of the "api" dataset."""
    at = {"id": ["id", "id_str", "tweet.id", "rest_id"], "created_at": ["created_at", "createdAt", "tweet.created_at"], "text": ["full_text", "text", "tweet.text"], "author": ["author.username", "author.userName", "user.screen_name", "author"], "likes": ["likes", "likeCount", "favorite_count", "public_metrics.like_count"]}
    return records.select(*(first_of(F.col("raw"), places).alias(k) for k, places in at.items()))


def cashtag_queries(symbols: list[str], since: str, size: int = 6) -> list[str]:
    """Search texts of up to six cashtags each."""
    tags = [f"${s}" for s in sorted(set(symbols))]
    return [f"({' OR '.join(tags[k : k + size])}) since:{since}" for k in range(0, len(tags), size)]


def price_chunks(symbols: list[str], size: int = 50) -> list[list[str]]:
    names = sorted(set(symbols))
    return [names[k : k + size] for k in range(0, len(names), size)]


def fetch_plan(environment: dict[str, str], needs: dict[str, list[str]]) -> dict[str, bool]:
    """Which sources have all the settings they need."""
    return {source: all(environment.get(k, "").strip() for k in keys) for source, keys in needs.items()}


def lookback_bucket(days: int) -> str:
    return "day" if days <= 1 else "week" if days <= 7 else "month" if days <= 31 else "year"


def epoch_of(when: Column) -> Column:
    """Digits or an ISO time as seconds since 1970; null for anything else."""
    iso = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.substring(when, 1, 19), "T", " ")))
    return F.when(when.rlike(r"^\d+$"), when.try_cast("long")).otherwise(iso)
