"""Entities and terms of texts, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common words that are no terms.
STOP = "the and for with that this from was are you not but have has had its his her they them what which who will would can could than then der die das und ein eine ist les des est une que qui dans pour pas los las del una por con para".split()


def runs(text: Column, full: str) -> Column:
    """ASCII word runs that match a pattern in full (word boundaries differ between regex engines, runs do not)."""
    return F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: w.rlike(f"^{full}$"))


def caps_tokens(text: Column) -> Column:
    """Bare upper-case words of four or five letters."""
    return runs(text, "[A-Z]{4,5}")


# Fixed patterns: a cashtag, and a bare symbol.
CASHTAG, BARE = r"\$([A-Z]{1,5})\b", "[A-Z]{4,5}"


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(CASHTAG), F.lit(1))


def _without(words: Column, blocked: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(*blocked)) if blocked else words


def tickers(text: Column, stop: list[str], prose: list[str] | None = None) -> Column:
    """Cashtags of the upper-cased text, then bare words of the text without them; duplicates stay. Stop words go everywhere, words that are
    symbols as well as prose count as cashtags only."""
    bare = caps_tokens(F.regexp_replace(text, r"\$[A-Z]{1,5}\b", " "))
    return F.concat(_without(cashtags(text), stop), _without(bare, [*stop, *(prose or [])]))


def mentions(posts: DataFrame, universe: DataFrame, stop: list[str], prose: list[str] | None = None) -> DataFrame:
    """posts (id, title, body, ...) -> (id, ticker, place: title or body, n), of symbols in the universe (symbol)."""
    at = [F.struct(F.lit(p).alias("place"), tickers(F.coalesce(p, F.lit("")), stop, prose).alias("found")) for p in ("title", "body")]
    rows = posts.select("id", F.explode(F.array(*at)).alias("p")).select("id", "p.place", F.explode("p.found").alias("ticker"))
    rows = rows.groupBy("id", "place", "ticker").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(universe.select(F.col("symbol").alias("ticker")), "ticker", "left_semi")


def themes(posts: DataFrame, keywords: DataFrame, text: str = "t") -> DataFrame:
    """posts (id, text) -> distinct (id, theme). keywords (theme, keyword): a keyword with blank, hyphen or dot is a phrase and matches anywhere in
    the lower-cased text, others match whole words. Phrases are looked up by their first word, so neither kind is compared with every text."""
    first = F.regexp_extract("keyword", "^[a-z0-9]+", 0)
    k = keywords.select("theme", "keyword", first.alias("w"), F.col("keyword").rlike(r"[ .\-]").alias("phrase"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    plain = posts.select("id", F.explode(tokens).alias("keyword")).join(k.where("NOT phrase"), "keyword").select("id", "theme")
    # a phrase may begin inside a word: it is looked up by the endings of words that are as long as some phrase's first word
    lengths = sorted(r[0] for r in k.where("phrase").select(F.length("w")).distinct().collect())  # at most the longest word's length
    if not lengths:
        return plain.distinct()
    endings = F.array_distinct(F.flatten(F.transform(tokens, lambda w: F.array_compact(F.array(*(F.when(F.length(w) >= n, F.right(w, F.lit(n))) for n in lengths))))))
    some = posts.select("id", F.lower(text).alias("_t"), F.explode(endings).alias("w"))
    inside = some.join(k.where("phrase"), "w").where(F.contains("_t", "keyword")).select("id", "theme")
    return plain.unionByName(inside).distinct()


_RUNS = re.compile("[A-Za-z0-9_]+").findall
_TERM = re.compile("[a-z][a-z0-9]{2,}").fullmatch


def terms_in_text(text: str, stop: frozenset[str] = frozenset(STOP)) -> set[str]:
    """Distinct words and adjacent pairs; a pair needs both its words to be terms."""
    w = [x if x not in stop else "" for x in _RUNS(text.lower()) if _TERM(x)]
    return {x for x in w if x} | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a and b}


def term_counts(texts: DataFrame, by: list[str]) -> DataFrame:
    """texts (by..., text) -> (by..., term, n texts). One Arrow pass splits each text once and adds up within a batch, so that only one row a
    term, key and batch is shuffled."""
    import pyarrow as pa

    kinds = [texts.schema[c].dataType.simpleString() for c in by]

    def run(batches):
        for batch in batches:
            counts: dict = {}
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            for key, text in zip(keys, batch.column(len(by)), strict=True):
                for term in terms_in_text(text.as_py() or ""):
                    counts[key, term] = counts.get((key, term), 0) + 1
            columns = [[k[c] for k, _ in counts] for c in range(len(by))]
            arrays = [pa.array(c, batch.schema.field(k).type) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=[*by, "term", "n"])

    schema = "".join(f"`{c}` {k}, " for c, k in zip(by, kinds, strict=True)) + "term string, n long"
    return texts.select(*by, "text").mapInArrow(run, schema).groupBy(*by, "term").agg(F.sum("n").alias("n"))


def referrals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?:^|[\s(\[])/?r/([A-Za-z0-9_]{3,21})\b"), F.lit(1))
