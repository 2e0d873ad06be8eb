"""Event logs as partitioned Parquet, and where files of a session may stand."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; on one machine without that setting, under a folder of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="presswork-"))
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def append_events(events: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """Appends events to the log at the path (a new one by default), in a folder for each kind; the log as it is then."""
    spark = events.sparkSession
    path = path or shared_path(spark, "events")
    events.write.mode("append").partitionBy(kind).parquet(path)
    return spark.read.parquet(path)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back, so that what builds on the rows does not compute them again."""
    path = shared_path(rows.sparkSession, name)
    write_once(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Writes the rows; the shuffle files behind them are removed once that is done."""
    conf = rows.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
