"""Content jobs as a table of generations: asked for again without effect, answered late without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB = "article_id long, generation long, content_hash string, state string, attempts int"
#: Fixed value: attempts after which a job is given up.
ATTEMPTS = 5


def latest(jobs: DataFrame) -> DataFrame:
    """The newest generation of each article's job."""
    return jobs.groupBy("article_id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "article_id"]), "generation").alias("j")).select("article_id", "j.*")


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The jobs that are new: a pending one of the next generation for each wanted article (article_id, content_hash) whose
    newest job, if it has one, was for other content. Wanted rows that repeat count once; null hashes are content of their
    own. To add what comes back and to ask again adds nothing."""
    asked = wanted.groupBy("article_id").agg(F.max("content_hash").alias("_asked"))
    now = latest(jobs).select("article_id", "generation", "content_hash")
    open_ = asked.join(now, "article_id", "left").where(F.col("generation").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_asked")))
    return open_.select("article_id", (F.coalesce("generation", F.lit(0)) + 1).alias("generation"), F.col("_asked").alias("content_hash"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def answer(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after results (article_id, generation, ok, attempt): one that succeeded is complete, one that failed is tried
    again until its attempts are used up. Results of an older generation, of an attempt that was answered already, or for a
    complete or failed job change nothing."""
    got = results.groupBy("article_id", "generation", "attempt").agg(F.bool_or("ok").alias("ok"))
    newest = latest(jobs).select("article_id", F.col("generation").alias("_newest"))
    rows = jobs.join(newest, "article_id").join(got.withColumn("_next", F.col("attempt")).drop("attempt"), ["article_id", "generation"], "left")
    counts = (F.col("generation") == F.col("_newest")) & F.col("state").isin("pending", "retry") & (F.col("_next") == F.col("attempts") + 1)
    state = F.when(counts & F.col("ok"), "complete").when(counts & (F.col("_next") >= ATTEMPTS), "failed").when(counts, "retry").otherwise(F.col("state"))
    attempts = F.when(counts, F.col("_next")).otherwise(F.col("attempts")).cast("int")
    moved = rows.select("article_id", "generation", "content_hash", state.alias("state"), attempts.alias("attempts"), F.coalesce(counts, F.lit(False)).alias("_moved"))
    # several results of one job: the one that counts, if any does
    best = F.max_by(F.struct("content_hash", "state", "attempts"), F.col("_moved").cast("int"))
    return moved.groupBy("article_id", "generation").agg(best.alias("j")).select("article_id", "generation", "j.*")


def on_demand(asks: DataFrame, documents: DataFrame, jobs: DataFrame, version: int) -> DataFrame:
    """(article_id, outcome) of each ask (article_id, allowed): blocked by policy; available, the document being there in
    this version; queued, a job being open; given_up, the newest job having failed; else enqueued."""
    have = documents.where(F.col("version") == version).select("article_id").distinct().withColumn("_have", F.lit(True))
    state = latest(jobs).select("article_id", "state")
    rows = asks.join(have, "article_id", "left").join(state, "article_id", "left")
    outcome = (
        F.when(~F.coalesce("allowed", F.lit(False)), "blocked").when(F.col("_have"), "available").when(F.col("state").isin("pending", "retry"), "queued")
        .when(F.col("state") == "failed", "given_up").otherwise("enqueued")
    )
    return rows.select("article_id", outcome.alias("outcome"))
