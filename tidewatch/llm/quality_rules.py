"""Quality rules whose failures are judged for each document and for its host.

Words are runs of anything but ASCII white space. A document fails the base rules if it has fewer than 20 words or over 30 % of its
words lie in 8-word windows that occur twice or more in it. Failures are summed by host (``source``); a beta prior is fitted to
the hosts' rates by moments (without the binomial noise of small hosts), each host's rate is shrunk towards it, and a host whose shrunk rate exceeds ``HOST_LIMIT`` is
rejected with all its documents. Very long texts are measured whole, one at a time.

Defined cases: null text has no words; documents without a host form one host of their own; an empty table gives no rows; equal rows
count each; columns other than id, text and host are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import durable

HOST_LIMIT, MIN_HOSTS = 0.5, 2
SALTS = 64
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
WINDOW = 8
MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 8-word windows that occur at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, np.flatnonzero(twice), 1)
    np.add.at(steps, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # of bytes: splits at ASCII white space only
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def measures(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """MEASURES of each row, and its columns to carry under the names carry0, carry1, ..."""
    import pyarrow as pa

    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            found = np.array([measure(t.as_py() or "") for t in batch.column(1)], np.int64).reshape(-1, 5)
            columns = [batch.column(0), batch.column(2), *(pa.array(found[:, k]) for k in range(5)), *(batch.column(k) for k in at)]
            yield pa.RecordBatch.from_arrays(columns, names=names + [f"carry{k}" for k in range(len(at))])

    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host")]
    # the text goes over once, also where it is carried
    again = [c == "text" and docs.schema[c].dataType.simpleString() == "string" for c in carry or []]
    carried = [F.col(c).alias(f"carry{k}") for k, c in enumerate(carry or []) if not again[k]]
    at = [1 if same else 3 + k - sum(again[:k]) for k, same in enumerate(again)]
    kinds = "".join(f", carry{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry or []))
    return docs.select(*own, *carried).mapInArrow(run, MEASURES + kinds)


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected. The prior's mean m is the rate over all documents; its strength s is m(1-m)/var - 1, held to
    1..1000, with var the spread of the hosts' rates around m, weighted by their documents, less what chance alone gives hosts of their size:
    sum n (rate - m)^2 has the expectation (N - sum n^2 / N) var + (k - 1) m (1 - m) for k hosts with N documents, but for a factor near 1."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    prior = hosts.agg(F.sum(n).alias("docs"), F.sum(failed).alias("f"), F.sum(n * n).alias("nn"), F.sum(failed * failed / n).alias("ff"), F.count(F.lit(1)).alias("hosts"))
    prior = prior.withColumn("m", F.try_divide("f", "docs")).withColumn("chance", F.col("m") * (1 - F.col("m")))
    between = F.col("ff") - F.col("f") * F.col("m") - (F.col("hosts") - 1) * F.col("chance")
    spread = F.try_divide(between, F.col("docs") - F.col("nn") / F.col("docs"))
    strength = F.when((F.col("hosts") < MIN_HOSTS) | spread.isNull() | (spread <= 1e-12) | (F.col("chance") <= 0), F.lit(1000.0))
    strength = strength.otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.try_divide(F.col("chance"), spread) - 1)))
    shrunk = (F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    # one row of prior: its size is fixed
    return hosts.join(F.broadcast(prior.withColumn("s", strength).select("m", "s"))).select("host", "n", "failed", shrunk.alias("rate"), (shrunk > limit).alias("rejected"))


def judge(docs: DataFrame, limit: float = HOST_LIMIT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, host_rejected, kept, and the columns to carry (as carry0, carry1, ...). The rejected hosts are a durable table of known size:
    Spark broadcasts it if it is small, else the join deals each host under SALTS keys, so that a host of any share spreads over tasks."""
    table = durable(measures(docs, carry), "rules")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = table.withColumn("base_failed", failed)
    bad = host_verdicts(judged, limit).where("rejected").select(F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_none"))
    bad = durable(bad, "hosts").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("host_rejected"))
    keyed = judged.withColumns({"_host": F.coalesce("host", F.lit("")), "_none": F.col("host").isNull(), "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    out = keyed.join(bad, ["_host", "_none", "_salt"], "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("_host", "_none", "_salt")


def keep(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that are kept, each judged by itself (rows may share an id), with all columns."""
    out = judge(docs, limit, docs.columns)
    return out.where("kept").select(*(F.col(f"carry{k}").alias(c) for k, c in enumerate(docs.columns)))
