"""The list of publishers whose articles may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY = "domain: string, languages: array<string>, quality_weight: double"


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """domain, languages, quality_weight and ord (place in the file). Domains are unique and lower case, languages
    are zh or en, weights from 0 to 1; anything else is an error."""
    parsed = F.from_json("value", f"array<struct<{POLICY}>>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(parsed).alias("ord", "p")).select("p.*", "ord")
    bad = F.col("domain").isNull() | (F.lower("domain") != F.col("domain")) | (F.size("languages") < 1) | (F.size(F.array_except("languages", F.array(F.lit("zh"), F.lit("en")))) > 0) | ~F.coalesce(F.col("quality_weight").between(0, 1), F.lit(False))
    wrong = [r.domain or "(no domain)" for r in rows.where(bad).limit(5).collect()]
    wrong += [r.domain for r in rows.groupBy("domain").count().where("count > 1").limit(5).collect()]
    if wrong:
        raise ValueError("invalid policies: " + ", ".join(wrong))
    return rows


def match_policy(hosts: DataFrame, policies: DataFrame, host: str = "host") -> DataFrame:
    """Adds domain, languages and quality_weight of the first policy whose domain is the host or above it, or nulls.

    Each host meets only the policies of its own suffixes, by equality.
    """
    parts = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    distinct = hosts.select(host).where(F.col(host).isNotNull()).distinct().withColumn("domain", F.explode(suffixes))
    best = distinct.join(policies, "domain").groupBy(host).agg(F.min(F.struct("ord", "domain", "languages", "quality_weight")).alias("p"))
    return hosts.join(best, host, "left").select(*hosts.columns, "p.domain", "p.languages", "p.quality_weight")
