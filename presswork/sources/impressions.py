"""Raw impression logs: tab-separated news and behaviour files to validated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.sources.logs import shared_path

NEWS = ("news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")
BEHAVIOURS = ("impression_id", "user_id", "time", "history", "impressions")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Lines cut at tabs and nothing else (quotes are data), and problem: why a line can't be used, or null."""
    cut = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(cut.alias("f"))
    return rows.select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)), F.when(F.size("f") != len(columns), "wrong_column_count").alias("problem"))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """news_id must be N and digits; entity lists must be JSON arrays. Adds article_id, the number of the id."""
    rows = read_tsv(spark, path, NEWS)
    array = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"^\s*\[.*\]\s*$")
    problem = F.coalesce(F.col("problem"), F.when(~F.col("news_id").rlike(r"^N\d+$"), "bad_news_id").when(F.trim("category") == "", "blank_category").when(~array("title_entities") | ~array("abstract_entities"), "bad_entities"))
    return rows.withColumn("problem", problem).withColumn("article_id", F.regexp_extract("news_id", r"^N(\d+)$", 1).try_cast("long"))


def read_behaviours(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One row a request: request_id ({source}:{split}:{id}), user_id, event_ts (UTC), history and candidates
    (article_id, clicked), with problem where an id, a time or a candidate can't be read or there is no candidate."""
    rows = read_tsv(spark, path, BEHAVIOURS)
    tokens = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")
    rows = rows.withColumn("_c", tokens("impressions")).withColumn("_h", tokens("history"))
    time = F.try_to_timestamp("time", F.lit("M/d/yyyy h:mm:ss a"))
    problem = F.coalesce(
        F.col("problem"), F.when(F.trim("impression_id") == "", "blank_id"), F.when(~F.col("user_id").rlike(r"^U\d+$"), "bad_user_id"), F.when(time.isNull(), "bad_time"),
        F.when(F.size("_c") == 0, "no_candidates"), F.when(F.exists("_c", lambda x: ~x.rlike(r"^N\d+-[01]$")), "bad_candidate"), F.when(F.exists("_h", lambda x: ~x.rlike(r"^N\d+$")), "bad_history"),
    )
    number = lambda x, p: F.regexp_extract(x, p, 1).try_cast("long")
    candidates = F.transform("_c", lambda x: F.struct(number(x, r"^N(\d+)-").alias("article_id"), x.endswith("-1").alias("clicked")))
    return rows.select(
        F.concat_ws(":", F.lit("mind"), F.lit(split), "impression_id").alias("request_id"), F.lit(split).alias("split"), number(F.col("user_id"), r"^U(\d+)$").alias("user_id"),
        F.unix_timestamp(time).alias("event_ts"), F.transform("_h", lambda x: number(x, r"^N(\d+)$")).alias("history"), candidates.alias("candidates"), problem.alias("problem"),
    )


def load_articles(parts: list[DataFrame]) -> DataFrame:
    """The articles of several splits, each once. Fails if an id has different metadata in two places."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.where("problem is null").drop("problem").dropDuplicates()
    clash = rows.groupBy("news_id").count().where("count > 1").orderBy("news_id").limit(5).collect()
    if clash:
        raise ValueError("conflicting metadata for " + ", ".join(r.news_id for r in clash))
    return rows


def requests_table(behaviours: DataFrame) -> DataFrame:
    good = behaviours.where("problem is null")
    return good.select("request_id", "split", "user_id", "event_ts", "history", F.size("candidates").alias("candidate_count"), F.size(F.filter("candidates", lambda c: c["clicked"])).alias("positive_count"))


def impressions_table(behaviours: DataFrame) -> DataFrame:
    good = behaviours.where("problem is null")
    return good.select("request_id", "split", "user_id", "event_ts", F.posexplode("candidates").alias("candidate_position", "c")).select("request_id", "split", "user_id", "event_ts", "candidate_position", "c.article_id", "c.clicked")


def fingerprint(rows: DataFrame) -> str:
    """A digest of the rows that depends neither on their order nor on files or partitions."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    n, a, b = rows.agg(F.count("*"), part(1), part(13)).first()
    return f"{n}-{a or 0}-{b or 0}"


def write_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def repeated_requests(behaviours: DataFrame) -> DataFrame:
    """(request_id, n) of the requests that occur more than once."""
    return behaviours.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1")


def read_selected(spark: SparkSession, path: str, key: str, values: list, columns: list[str]) -> DataFrame:
    """The named columns of the rows whose key is among the values; both go down to the Parquet scan."""
    return spark.read.parquet(path).where(F.col(key).isin(values)).select(*columns)


def problem_counts(rows: DataFrame) -> DataFrame:
    """(problem, n): how many rows can't be used, and why; the others under ok."""
    return rows.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


def id_map(rows: DataFrame, key: str) -> DataFrame:
    """(key, number): each distinct key with a number of its own, from 1 in order of key.

    Numbers are places within ranges of keys plus the sizes of the ranges before, so no task sees all keys. The ranges
    are written first, as Spark may cut them differently if it computes them again.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    path = shared_path(rows.sparkSession, "ids")
    keys.withColumn("_part", F.spark_partition_id()).withColumn("_at", place).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(key, (F.col("_before") + F.col("_at") + 1).alias("number"))
