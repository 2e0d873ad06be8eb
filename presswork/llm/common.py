"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine (tests) a fresh one where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="presswork-")
    return _own[context.applicationId]


def staged(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back, which cuts its lineage.

    Lost executors cost nothing but the running stage. The shuffle files behind it are removed once it is
    written, its own files by clear_staged or when Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/presswork-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Removes what was staged in the session so far; frames that were built on it can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for entry in [x for x in _written if x[0] is spark]:
        where = jvm.org.apache.hadoop.fs.Path(entry[1])
        where.getFileSystem(conf).delete(where, True)
        _written.remove(entry)


@atexit.register
def _remove() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            clear_staged(spark)
        except Exception:  # the session may have ended before
            return


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters_lowered(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def md5_number(value: Column, digits: int = 8) -> Column:
    """The first hex digits of the md5 of a string, as a long; the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")
