"""Tables written with what must hold before they are used again: version, rows, fingerprint and that of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.sources.impressions import fingerprint

CARD = "kind string, version int, n long, fingerprint string, source_fingerprint string"


def write_artifact(rows: DataFrame, path: str, kind: str, version: int, source_fingerprint: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
    spark = rows.sparkSession
    written = spark.read.schema(rows.schema).parquet(f"{path}/data")
    card = [(kind, version, written.count(), fingerprint(written), source_fingerprint)]
    spark.createDataFrame(card, CARD).coalesce(1).write.mode("overwrite").json(f"{path}/card")


def read_artifact(spark: SparkSession, path: str, kind: str, version: int, source_fingerprint: str | None = None, verify: bool = True) -> DataFrame:
    """The table, if its card says what is asked for; an error that says what differs if not."""
    card = spark.read.schema(CARD).json(f"{path}/card").first()
    if card is None:
        raise ValueError("no card")
    for name, want in (("kind", kind), ("version", version), ("source_fingerprint", source_fingerprint)):
        if want is not None and card[name] != want:
            raise ValueError(f"{name} is {card[name]!r}, not {want!r}")
    rows = spark.read.parquet(f"{path}/data")
    if verify and (rows.count() != card.n or fingerprint(rows) != card.fingerprint):
        raise ValueError("the data is not what was written")
    return rows
