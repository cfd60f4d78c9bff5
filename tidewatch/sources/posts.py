"""Orders as dated posts with text, and the symbol universe that goes with them; the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.records import symbols
from tidewatch.sources.tables import read

#: names no listing has any more, and words that are symbols as well
DELISTED = ["SAUDI", "EDGE"]


#: nation 12 has the symbol NBCX
SYMBOL = "'N' || translate(lpad(n_nationkey::VARCHAR, 2, '0'), '0123456789', 'ABCDEFGHIJ') || 'X'"


def symbol_of(key: Column) -> Column:
    return F.concat(F.lit("N"), F.translate(F.lpad(key.cast("string"), 2, "0"), "0123456789", "ABCDEFGHIJ"), F.lit("X"))


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, day, author, source, title, body): an order is a post of its customer about its nation; one in four has no body."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # 25 nations
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    name, segment, k = symbol_of(F.col("n_nationkey")), F.col("c_mktsegment"), F.col("o_orderkey") % 4
    body = F.when(k == 0, F.concat(F.lit("bought $"), F.lower(name), F.lit(" and $edge calls, not bad")))
    body = body.when(k == 1, F.concat(F.lit("THIS is a great "), segment, F.lit(" win, NOT "), name))
    body = body.when(k == 2, F.concat(F.lit("see r/"), F.lower(segment), F.lit(" and (r/"), F.lower(name), F.lit(") terrible loss!")))
    return rows.select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("c"), "o_custkey").alias("author"),
        F.lower(segment).alias("source"), F.concat(F.lit("Talk of "), name, F.lit(" and EDGE")).alias("title"), body.alias("body"),
    )


POSTS = f"""posts AS (SELECT 'o' || o_orderkey AS id, o_orderdate::DATE AS day, 'c' || o_custkey AS author, lower(c_mktsegment) AS source, 'Talk of ' || sym || ' and EDGE' AS title,
CASE o_orderkey % 4 WHEN 0 THEN 'bought $' || lower(sym) || ' and $edge calls, not bad' WHEN 1 THEN 'THIS is a great ' || c_mktsegment || ' win, NOT ' || sym
WHEN 2 THEN 'see r/' || lower(c_mktsegment) || ' and (r/' || lower(sym) || ') terrible loss!' END AS body
FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT *, {SYMBOL} AS sym FROM nation) ON c_nationkey = n_nationkey), txt AS (SELECT *, concat_ws(' ', title, body) AS t FROM posts)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a pipe-separated symbol listing with header, footer and test issues (value: a line)."""
    n = read(spark, sf_dir, "nation")
    lines = n.select(F.concat_ws("|", symbol_of(F.col("n_nationkey")), F.lit("Common Stock"), F.lit("Q"), F.when(F.col("n_nationkey") % 7 == 3, "Y").otherwise("N")).alias("value"))
    ends = spark.createDataFrame([("Symbol|Security Name|Market|Test Issue",), ("File Creation Time: 0101|||",)], "value string")
    return lines.unionByName(ends)


LISTED = f"uni AS (SELECT {SYMBOL} AS symbol FROM nation WHERE n_nationkey % 7 != 3 UNION SELECT unnest(['SAUDI', 'EDGE']))"


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed symbols that are no test issues, and the delisted ones."""
    more = spark.createDataFrame([(s,) for s in DELISTED], "symbol string")
    return symbols(listing(spark, sf_dir)).unionByName(more).distinct()


def full_text(posts: DataFrame) -> DataFrame:
    """posts with t, title and body joined by a blank (a missing body adds none)."""
    return posts.withColumn("t", F.concat_ws(" ", "title", "body"))
