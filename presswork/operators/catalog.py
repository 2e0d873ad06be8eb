"""Catalog snapshots: several tables merged as one, with a commit that comes last, and what must start anew when topics change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, topics_changed boolean, tables array<string>"


def current_version(spark: SparkSession, path: str) -> int:
    """The number of the last snapshot that was committed; 0 if there is none. What an aborted merge wrote has no commit."""
    try:
        return spark.read.schema(COMMIT).json(f"{path}/commits/*").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    except AnalysisException:
        return 0


def read_table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    version = current_version(spark, path) if version is None else version
    if version == 0:
        raise ValueError("the catalog is empty")
    return spark.read.parquet(f"{path}/v{version}/{name}")


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, action) of each row: insert, delete, update or keep; values are compared null-safe."""
    values = [c for c in after.columns if c not in key]
    side = lambda df, name: df.select(*key, F.struct(*values).alias(name) if values else F.struct(F.lit(1).alias("x")).alias(name))
    both = side(before, "_old").join(side(after, "_new"), key, "full")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("keep")
    return both.select(*key, action.alias("action"))


@dataclass
class Merge:
    version: int
    topics_changed: bool
    actions: DataFrame


def merge_catalog(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, list[str]]], topics: list[str], dependent: dict[str, Column | str]) -> Merge:
    """Makes the staged tables (name -> rows, key) the catalog's next snapshot.

    topics: the tables whose change means that topics changed: an article's move to another topic, a topic that came,
    went or got another name. Then the dependent tables (name -> which of their rows survive a reset) lose the rows that
    do not survive; else they are carried over whole. Rows that repeat a key are an error, before anything is written. All
    tables are written under a new number, and the commit that makes them current is written last, so readers see the
    old snapshot whole until they see the new one whole. Returns the actions (table, action, n).
    """
    for name, (rows, key) in tables.items():
        twice = rows.groupBy(*key).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name} repeats a key: {twice[0][0]}")
    old = current_version(spark, path)
    new, actions = old + 1, None
    for name, (rows, key) in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/v{new}/{name}")
        after = read_table(spark, path, name, new)
        before = read_table(spark, path, name, old) if old else after.where("false")
        made = changes(before, after, key).groupBy("action").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "action", "n")
        actions = made if actions is None else actions.unionByName(made)
    actions = spark.createDataFrame(actions.collect(), "table string, action string, n long")  # four rows a table
    changed = old > 0 and not actions.where(F.col("table").isin(topics) & (F.col("action") != "keep")).isEmpty()
    kept = [*tables]
    for name, survives in dependent.items():
        try:
            rows = read_table(spark, path, name, old) if old else None
        except AnalysisException:  # nothing has been written under this name yet
            rows = None
        if rows is not None:
            (rows.where(survives) if changed else rows).write.mode("overwrite").parquet(f"{path}/v{new}/{name}")
            kept.append(name)
    spark.createDataFrame([(new, changed, kept)], COMMIT).coalesce(1).write.json(f"{path}/commits/{new:012d}")
    return Merge(new, changed, actions)


def add_dependent(spark: SparkSession, path: str, name: str, rows: DataFrame) -> None:
    """Writes a dependent table into the current snapshot, where later merges find it."""
    rows.write.mode("overwrite").parquet(f"{path}/v{current_version(spark, path)}/{name}")
