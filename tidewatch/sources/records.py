"""Raw JSON records as posts, symbol listings, and what a price store still lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: field of a post to the places it may stand in, first non-blank wins
FIELDS = {
    "id": ["id", "postId", "name"], "when": ["created_utc", "createdUtc", "created", "createdAt", "created_at", "date"], "author": ["author.handle", "author.username", "author.name", "user.username", "author"],
    "title": ["title"], "selftext": ["selftext", "body"], "score": ["score", "upvotes", "ups", "likes"], "source": ["subreddit", "source"],
}


def first_of(raw: Column, places: list[str]) -> Column:
    """The first place that holds more than blanks; an object counts only through its fields."""
    found = [F.get_json_object(raw, f"$.{p}") for p in places]
    return F.coalesce(*(F.when((F.trim(v) != "") & ~v.startswith("{"), F.trim(v)) for v in found))


def day_of(when: Column) -> Column:
    """Epoch seconds (above 1e9) or an ISO time, as a UTC day; anything else is null."""
    epoch = when.try_cast("double")
    return F.when(epoch > 1e9, F.to_date(F.timestamp_seconds(epoch))).when(epoch.isNull(), F.to_date(F.try_to_timestamp(F.regexp_replace(F.substring(when, 1, 19), "T", " "))))


def normalise(records: DataFrame, fields: dict[str, list[str]] | None = None, prefix: str = "") -> DataFrame:
    """records (raw: one JSON text) as posts; broken lines and those without id, day or text go; of one id the earliest day stays (ties: the lesser text)."""
    at = FIELDS | (fields or {})

    def post(raw):
        col = lambda k: first_of(raw, at[k])
        text = lambda k: F.coalesce(col(k), F.lit(""))
        return F.struct(F.concat(F.lit(prefix), col("id")).alias("id"), day_of(col("when")).alias("day"), col("author").alias("author"), text("title").alias("title"), text("selftext").alias("selftext"), F.coalesce(col("score").try_cast("double").cast("int"), F.lit(0)).alias("score"), F.lower(col("source")).alias("source"))

    # generated from an array of one, so that a later filter does not parse each line anew
    p = records.select(F.explode(F.transform(F.array("raw"), post)).alias("p")).select("p.*")
    p = p.where("id IS NOT NULL AND day IS NOT NULL AND (title != '' OR selftext != '')")
    rest = ["day", "title", "selftext", "author", "score", "source"]
    return p.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")


def symbols(lines: DataFrame, test_at: int = 3) -> DataFrame:
    """lines (value: pipe-separated): plain symbols of up to five capitals that are no test issues."""
    part = F.split("value", r"\|")
    flag = F.try_element_at(part, F.lit(test_at + 1))
    return lines.select(F.trim(part[0]).alias("symbol"), flag.alias("flag")).where("symbol RLIKE '^[A-Z]{1,5}$' AND coalesce(flag, 'N') != 'Y'").select("symbol").distinct()


def missing_spans(wanted: DataFrame, have: DataFrame, start: str, end: str, tolerance: int = 3) -> DataFrame:
    """(span_start, span_end, n, symbols): what of the window each symbol lacks before its first and after its last day."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    c = wanted.join(have.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi")), "symbol", "left")
    span = lambda x, y: F.struct(x.alias("span_start"), y.alias("span_end"))
    spans = F.array(F.when(F.col("lo").isNull(), span(a, b)).when(a < F.date_sub("lo", tolerance), span(a, F.date_sub("lo", 1))), F.when(b > F.date_add("hi", tolerance), span(F.date_add("hi", 1), b)))
    s = c.select("symbol", F.explode(F.array_compact(spans)).alias("s")).select("symbol", "s.*")
    return s.groupBy("span_start", "span_end").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("symbols"))


def require_text_free(frame: DataFrame, forbidden: tuple[str, ...] = ("title", "selftext", "body", "text", "author")) -> DataFrame:
    """Aggregates that go to a store hold no text and no names."""
    bad = sorted({c.lower() for c in frame.columns} & set(forbidden))
    if bad:
        raise ValueError(f"columns not allowed in a store: {', '.join(bad)}")
    return frame
