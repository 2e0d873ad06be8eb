"""The training-corpus pipeline: its stages call the operators of presswork.llm.

documents -> language ID -> near-duplicates -> benchmark decontamination -> mixing -> sharding
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import staged, table
from presswork.llm.decontaminate import find_leaks
from presswork.llm.language_id import held_out, identify, learn_prototypes
from presswork.llm.mixing import corpus_rows, mix
from presswork.llm.near_dedup import near_duplicates
from presswork.llm.sharding import shard_names, with_shards


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id is in kept, all their columns and rows unchanged."""
    kept = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents in which no language can be told: null texts and texts without a letter."""
    found = identify(docs, learn_prototypes(docs.where(~held_out())))
    return _only(docs, found.where("lang_pred <> 'und'"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    found = near_duplicates(docs, size=5, share=80).where("kept").select("doc_id")
    kept = _only(docs, found)
    # rows that repeat an id, or a text without one, are one document; mostly there are none, and no text moves
    same = ["doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("_text")]
    repeated = docs.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.withColumn("_text", same[1]).dropDuplicates(["doc_id", "_text"]).drop("_text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak_id")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics approach their target weights."""
    rows = corpus_rows(spark, docs, sf_dir)
    return _only(docs, mix(rows, ["source", "lang", "topic"]).where("kept"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard to each document, where it stands."""
    return with_shards(docs, shard_names(64))


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: Minwise trees, edit matching and hyperdimensional vectors have no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
