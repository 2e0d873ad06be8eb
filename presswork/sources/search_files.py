"""Documents, queries and relevance judgements as JSON lines, with their contracts checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "news_id string, headline string, abstract string, topic_ids array<int>, category string, subcategory string"
QUERY = "query_id string, text string, slice string, split string, intended_meaning string, expected_relevant boolean, anchor_article_ids array<long>"
QREL = "query_id string, article_id long, relevance int, confidence string, label_source string, human_reviewed boolean"


def _checked(rows: DataFrame, bad: Column, key: list[str], what: str) -> DataFrame:
    """The rows, or an error that names some of those that break the contract or repeat a key."""
    broken = rows.where(bad).select(F.concat_ws("/", *key).alias("k")).limit(5).collect()
    if broken:
        raise ValueError(f"invalid {what}: " + ", ".join(r.k for r in broken))
    repeated = rows.groupBy(*key).count().where("count > 1").select(F.concat_ws("/", *key).alias("k")).limit(5).collect()
    if repeated:
        raise ValueError(f"repeated {what}: " + ", ".join(r.k for r in repeated))
    return rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(DOCUMENT).json(path)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("headline", "abstract", "category", "subcategory")]
    rows = rows.select("news_id", *blank, F.coalesce("topic_ids", F.array().cast("array<int>")).alias("topic_ids"))
    return _checked(rows, F.col("news_id").isNull() | ~F.col("news_id").rlike(r"^N\d+$"), ["news_id"], "documents")


def write_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Ids are unique, texts are not blank, the split is calibration or test."""
    rows = spark.read.schema(QUERY).json(path)
    bad = F.col("query_id").isNull() | (F.trim(F.coalesce("text", F.lit(""))) == "") | ~F.coalesce(F.col("split").isin("calibration", "test"), F.lit(False))
    return _checked(rows, bad, ["query_id"], "queries")


def read_qrels(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """One judgement per query and article, graded 0, 1 or 2, of known queries."""
    rows = spark.read.schema(QREL).json(path)
    rows = _checked(rows, ~F.coalesce(F.col("relevance").isin(0, 1, 2), F.lit(False)), ["query_id", "article_id"], "judgements")
    unknown = rows.join(queries, "query_id", "left_anti").select("query_id").distinct().limit(5).collect()
    if unknown:
        raise ValueError("judgements of unknown queries: " + ", ".join(r.query_id for r in unknown))
    return rows


def merge_labels(parts: list[DataFrame], pool: DataFrame) -> DataFrame:
    """Labels from several files; together they must cover the pool of (query_id, article_id), each pair once."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    key = ["query_id", "article_id"]
    _checked(rows, F.lit(False), key, "labels")
    labelled, wanted = rows.select(*key), pool.select(*key).distinct()
    if not labelled.exceptAll(wanted).isEmpty() or not wanted.exceptAll(labelled).isEmpty():
        raise ValueError("labels and pool do not hold the same pairs")
    return rows


def apply_review(rows: DataFrame, review: DataFrame) -> DataFrame:
    """Judgements with those a person has reviewed (query_id, article_id, relevance) put in and marked."""
    changed = review.select("query_id", "article_id", F.col("relevance").alias("_reviewed"))
    stray = changed.join(rows, ["query_id", "article_id"], "left_anti")
    if not stray.isEmpty():
        raise ValueError("a review of a pair that is not judged")
    out = rows.join(changed, ["query_id", "article_id"], "left")
    out = out.withColumn("relevance", F.coalesce("_reviewed", "relevance")).withColumn("human_reviewed", F.col("_reviewed").isNotNull() | F.coalesce("human_reviewed", F.lit(False)))
    return out.drop("_reviewed").select(*rows.columns)
