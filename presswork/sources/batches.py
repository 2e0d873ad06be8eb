"""JSON-lines batches whose broken lines become rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "date string, url string, domain string, outletName string, title string, image string, `desc` string, lang string, author string"


def read_json_lines(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Plain or gzip files: the record's columns, line (as read) and malformed (whether it is no JSON object)."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")
    parsed = rows.withColumn("r", F.from_json("line", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.select("r.*", "line").withColumn("malformed", F.col("_broken").isNotNull() | ~F.trim("line").startswith("{")).drop("_broken")


def latest_batch_time(feed_xml: F.Column) -> F.Column:
    """Time of the newest item of an RSS feed (UTC), wherever it stands; null if none can be read."""
    dates = F.xpath(feed_xml, F.lit("/rss/channel/item/pubDate/text()"))
    zoned = lambda d: F.regexp_replace(F.trim(d), r"(GMT|UTC|UT|Z)$", "+0000")
    return F.array_max(F.transform(dates, lambda d: F.try_to_timestamp(F.regexp_replace(zoned(d), r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))))
