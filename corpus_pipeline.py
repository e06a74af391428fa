"""A corpus pipeline over the table documents: quality rules, near-duplicates, substring duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and rereads it as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm import bpe, cascade, decontaminate, order_minhash, substring
from quirefold.llm.common import Stages, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return cascade.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each class of near-duplicates, the document with the smallest doc_id; rows without a doc_id stay.

    Texts that differ are documents of their own, also under one doc_id; of those in one class the smallest digest stays.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return order_minhash.near_duplicates(docs).where("class_id IS NULL OR class_id = doc_id").select(*docs.columns)
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    named = docs.where("doc_id IS NOT NULL").withColumn("_near_digest", digest).withColumn("_near_id", F.xxhash64("doc_id", "_near_digest"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("_near_id").orderBy("text", *others)
    named = named.withColumn("_near_row", F.row_number().over(first)).where("_near_row = 1")
    classes = order_minhash.near_duplicates(named.select(F.col("_near_id").alias("doc_id"), "text", F.col("doc_id").alias("_near_doc"), "_near_digest"))
    least = classes.groupBy("class_id").agg(F.min_by("doc_id", F.struct("_near_doc", "_near_digest")).alias("_near_id"))
    kept = named.join(least.select("_near_id"), "_near_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the later documents; other texts stay as they are."""
    cut = substring.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    out = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(out).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), bpe.vocabulary_path()).drop("text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", byte_pairs),
]

#: Candidates of Order MinHash and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, docs = Stages(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stages.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
