"""Mixing a corpus to target weights by iterative proportional fitting (raking)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.llm.common import checkpointed, md5_number, staged, table

ROUNDS = 12
NONE = "(none)"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered_targets(cells: DataFrame, dim: str, temperature: float = 0.5) -> DataFrame:
    """(dim, target): the share of each value, raised to a power below 1, which lifts small ones; shares sum to 1."""
    lifted = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("x")).where("x > 0")
    return lifted.select(dim, (F.col("x") / F.sum("x").over(Window.partitionBy(F.lit(1)))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Weights of the cells whose sums over each dimension approach its targets.

    cells: the dimensions and tokens (> 0), one row a cell. Starts from the tokens' shares and scales them to the
    targets of each dimension in turn, `rounds` times. Values without a target keep weight 0; targets of values
    that no cell has are left out and the rest scaled up. The table has a row for each combination of values, not
    for each document, and stays distributed.
    """
    weighted = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim, target in targets.items():
        present = target.join(cells.select(dim).distinct(), dim)
        scaled = present.select(dim, (F.col("target") / F.sum("target").over(Window.partitionBy(F.lit(1)))).alias(f"to_{dim}"))
        weighted = weighted.join(scaled, dim, "left")
    weighted = checkpointed(weighted)
    for _ in range(rounds):
        for dim in targets:
            total = F.sum("w").over(Window.partitionBy(dim))
            weighted = weighted.withColumn("w", F.when(total > 0, F.col("w") * F.coalesce(F.col(f"to_{dim}"), F.lit(0.0)) / total).otherwise(0.0))
        weighted = checkpointed(weighted)
    return weighted.drop(*(f"to_{dim}" for dim in targets))


def keep_rates(cells: DataFrame, share: float) -> DataFrame:
    """Adds rate, at most 1 and as w / tokens up to a common factor, so that the expected tokens kept are `share` of all.

    Where a cell would have to be kept more than once it is kept whole, and the others make up for it.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("r").desc(), *[c for c in cells.columns if c not in ("tokens", "w")])
    rated = cells.withColumn("r", F.col("w") / F.col("tokens"))
    rated = rated.withColumn("whole", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rated = rated.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    budget = F.lit(share) * F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    rated = rated.withColumn("c", F.when(F.col("open") > 0, (budget - F.col("whole")) / F.col("open")))
    # the first place in the order where nothing is left over 1
    factor = F.max(F.when(F.col("c") * F.col("r") <= 1, F.struct(-F.col("whole").cast("double"), "c"))).over(Window.partitionBy(F.lit(1)))["c"]
    return rated.withColumn("rate", F.when(F.col("r") > 0, F.least(F.lit(1.0), F.coalesce(factor, F.lit(1.0)) * F.col("r"))).otherwise(0.0)).drop("r", "whole", "open", "c")


def uniform(key: Column) -> Column:
    """A number in [0, 1) fixed by the key."""
    return md5_number(F.concat(F.lit("mix/"), F.coalesce(key.cast("string"), F.lit(""))), 12) / F.lit(float(16**12))


def mix(docs: DataFrame, dims: list[str], targets: dict[str, DataFrame] | None = None, tokens_col: str = "tokens", id_col: str = "doc_id", share: float = 0.7, rounds: int = ROUNDS) -> DataFrame:
    """The id, dims and tokens of each row with rate (its probability) and kept (whether it is drawn).

    targets: for each dimension (value, target) rows; without them, shares at temperature 0.5. Null values of a
    dimension are a value of their own, `(none)`. Rows without tokens have no weight and come back with rate 1,
    kept. Rows of equal id are drawn or left together. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), *(F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in dims), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("tokens"))
    cells = staged(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    targets = targets or {d: tempered_targets(cells, d) for d in dims}
    rates = checkpointed(keep_rates(rake(cells, targets, rounds), share)).select(*dims, "rate")
    rated = rows.join(rates, dims, "left").withColumn("rate", F.when(F.col("tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(1.0))
    return rated.withColumn("kept", uniform(F.col("_id")) < F.col("rate")).withColumnRenamed("_id", id_col)


def corpus_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, tokens and topic: the label of the embedding of the same number, if there is one."""
    topic = table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").alias("topic"))
    words = docs.select("doc_id", "source", "lang", count_words(F.col("text")).alias("tokens"))
    return words.join(topic, "doc_id", "left")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keep rate of each document towards tempered shares of source, language and topic, and whether it is drawn."""
    out = mix(corpus_rows(spark, table(spark, sf_dir, "documents"), sf_dir), ["source", "lang", "topic"])
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("rate", 6).alias("rate"), "kept")


def mixing_sql(dims: list[str], rounds: int = ROUNDS, share: float = 0.7) -> str:
    ctes = [
        "t AS (SELECT vec_id, min(label) AS label FROM embeddings GROUP BY vec_id)",
        f"d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(label::VARCHAR, '{NONE}') AS topic, "
        r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents LEFT JOIN t ON t.vec_id = documents.doc_id)",
        f"cells AS MATERIALIZED (SELECT {', '.join(dims)}, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
        *(f"to_{x} AS (SELECT {x}, pow(sum(tokens)::DOUBLE, 0.5) / sum(pow(sum(tokens)::DOUBLE, 0.5)) OVER () AS g FROM cells GROUP BY {x})" for x in dims),
        f"w0 AS (SELECT {', '.join(dims)}, tokens, tokens::DOUBLE AS w FROM cells)",
    ]
    step = 0
    for _ in range(rounds):
        for x in dims:
            ctes.append(f"w{step + 1} AS MATERIALIZED (SELECT {', '.join(dims)}, tokens, w * g / sum(w) OVER (PARTITION BY {x}) AS w FROM w{step} JOIN to_{x} USING ({x}))")
            step += 1
    ctes += [
        f"r1 AS (SELECT *, w / tokens AS r FROM w{step})",
        f"r2 AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY r DESC, {', '.join(dims)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole, "
        f"sum(w) OVER (ORDER BY r DESC, {', '.join(dims)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS everything FROM r1)",
        f"r3 AS (SELECT *, ({share} * everything - whole) / rest AS c FROM r2)",
        f"rates AS MATERIALIZED (SELECT {', '.join(dims)}, least(1.0, r * (SELECT c FROM r3 WHERE c * r <= 1 ORDER BY whole LIMIT 1)) AS rate FROM r3)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, source, lang, topic, tokens, round(p, 6) AS rate, u < p AS kept FROM (SELECT d.*, CASE WHEN tokens > 0 THEN coalesce(rate, 0.0) ELSE 1.0 END::DOUBLE AS p, "
        "('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS u "
        f"FROM d LEFT JOIN rates USING ({', '.join(dims)}))"
    )
