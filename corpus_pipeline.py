"""Training-corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents. Every stage
judges rows, not ids: of two rows that share an id but not the text, one may go and the other stay.

Defined cases: a null or blank text fails the quality rules and goes; a null doc_id is an id like any other; equal rows are judged alike,
and one of them stays past the near-duplicate stage; very long texts pass whole through every stage; an empty table gives no rows; columns
other than those of documents are left out after the first stage. A stage's tables are deleted once the next stage's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, line_dedup, minhash, packing, quality_rules
from tidewatch.llm.common import Scratch, durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules or their host's verdict reject go."""
    return quality_rules.keep(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later repeated runs go, and with them documents of which no word is left."""
    out = line_dedup.dedup_lines(docs, carry=["lang", "source"])
    return out.where(F.col("text").rlike(r"[^\s]")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class stays, by id and then by the hash of its text; of equal rows one."""
    judged = durable(minhash.near_duplicates(docs).select("doc_id", "mark", "leads"), "near")
    later = judged.where("NOT leads").select(F.col("doc_id").alias("later_id"), F.col("mark").alias("later_mark")).distinct()
    same = docs["doc_id"].eqNullSafe(later["later_id"]) & (F.xxhash64(docs["text"]) == later["later_mark"])
    kept = docs.join(later, same, "left_anti")
    twice = not judged.where("leads").groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    return kept.dropDuplicates(["doc_id", "text"]) if twice else kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark):
        for name, stage in STAGES[:-1]:
            with Scratch(spark):
                docs = durable(stage(spark, docs, sf_dir), name, outer=True)
        # packing reads the last stage's table while it runs, so its own tables outlive this block
        return durable(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0], outer=True)


# MinHash classes and token ids are beyond SQL: tests/llm/test_pipeline.py runs a brute-force version instead.
ORACLE_SQL = None
