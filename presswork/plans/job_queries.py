"""Catalog snapshots and content jobs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.operators import catalog, jobs
from presswork.plans.registry import query
from presswork.sources.logs import shared_path


@query("c13_catalog_snapshots", "WITH old AS (SELECT DISTINCT l_partkey AS article_id FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), t0 AS (SELECT DISTINCT p_brand AS topic FROM part JOIN old ON article_id = p_partkey WHERE p_size < 25), t1 AS (SELECT DISTINCT p_brand AS topic FROM part), "
    "ch AS (SELECT (SELECT count(*) FROM t1 WHERE topic NOT IN (SELECT topic FROM t0)) > 0 AS yes), ac AS (SELECT 'articles' AS \"table\", CASE WHEN article_id IS NULL THEN 'insert' WHEN p_partkey % 10 = 0 THEN 'update' ELSE 'keep' END AS action FROM part LEFT JOIN (SELECT article_id FROM old JOIN part ON article_id = p_partkey WHERE p_size < 25) ON article_id = p_partkey "
    "UNION ALL SELECT 'topics', CASE WHEN t0.topic IS NULL THEN 'insert' WHEN t1.topic IS NULL THEN 'delete' ELSE 'keep' END FROM t0 FULL JOIN t1 ON t0.topic = t1.topic "
    "UNION ALL SELECT 'profiles', CASE WHEN (SELECT yes FROM ch) AND c_custkey IN (SELECT o_custkey FROM orders) THEN 'reset' ELSE 'carried' END FROM customer) SELECT \"table\", action, count(*)::BIGINT AS n FROM ac GROUP BY ALL")
def c13(t):
    """A first snapshot of the smaller early articles, then the whole catalog with a tenth of it renamed: what changed, and
    what became of the profiles, of which those that were learnt do not survive a change of topics."""
    path = shared_path(t.spark, "catalog")
    early = t.lineitem.where("l_shipdate < TIMESTAMP '1995-06-01'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    first = t.part.join(early, "p_partkey", "left_semi").where("p_size < 25").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("topic"))
    renamed = F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit(" (new)"))).otherwise(F.col("p_name"))
    second = t.part.select(F.col("p_partkey").alias("article_id"), renamed.alias("title"), F.col("p_brand").alias("topic"))
    tables = lambda a: {"articles": (a, ["article_id"]), "topics": (a.select("topic").distinct(), ["topic"])}
    survives = {"profiles": F.col("origin") == "seed"}
    catalog.merge_catalog(t.spark, path, tables(first), ["topics"], survives)
    learnt = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("origin", F.lit("learnt"))
    profiles = t.customer.select("c_custkey").join(learnt, "c_custkey", "left").select(F.col("c_custkey").alias("user_id"), F.coalesce("origin", F.lit("seed")).alias("origin"))
    catalog.add_dependent(t.spark, path, "profiles", profiles)
    merged = catalog.merge_catalog(t.spark, path, tables(second), ["topics"], survives)
    left = catalog.read_table(t.spark, path, "profiles", merged.version).select("user_id", F.lit("carried").alias("action"))
    fate = profiles.join(left, "user_id", "left").groupBy(F.coalesce("action", F.lit("reset")).alias("action")).agg(F.count("*").alias("n"))
    return merged.actions.unionByName(fate.select(F.lit("profiles").alias("table"), "action", "n"))


def _jobs(t):
    """Jobs of the labelled documents, answered by their quality, then of all documents, asked for twice."""
    content = t.documents.select(F.col("doc_id").alias("article_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    none = t.spark.createDataFrame([], jobs.JOB)
    labelled = t.labels.groupBy(F.col("doc_id").alias("article_id")).agg((F.max("quality") == 1).alias("ok"))
    table = jobs.enqueue(none, content.join(labelled, "article_id", "left_semi"))
    table = jobs.answer(table, labelled.select("article_id", F.lit(1).cast("long").alias("generation"), "ok", F.lit(1).alias("attempt")))
    for _ in range(2):
        table = table.unionByName(jobs.enqueue(table, content))
    return table


@query("k15_backfill_jobs", "SELECT doc_id AS article_id, 1::BIGINT AS generation, CASE WHEN q IS NULL THEN 'pending' WHEN q = 1 THEN 'complete' ELSE 'retry' END AS state, (q IS NOT NULL)::INT AS attempts FROM (SELECT doc_id, max(quality) AS q FROM (SELECT doc_id FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY doc_id)")
def k15(t):
    """The job table after a backfill: nothing is queued twice, and what was answered stays so."""
    return jobs.latest(_jobs(t)).select("article_id", "generation", "state", "attempts")


@query("k14_on_demand", "SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN lang IS DISTINCT FROM 'en' THEN 'blocked' WHEN doc_id IN (SELECT vec_id FROM embeddings WHERE label < 5) THEN 'available' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'enqueued' ELSE 'queued' END AS outcome FROM documents) GROUP BY 1")
def k14_on_demand(t):
    """What asking for each document's content leads to: only English may be shown, and embeddings of the lower labels stand
    for content that is there in the version that is read."""
    asks = t.documents.select(F.col("doc_id").alias("article_id"), F.col("lang").eqNullSafe("en").alias("allowed"))
    documents = t.embeddings.select(F.col("vec_id").alias("article_id"), F.when(F.col("label") < 5, 2).otherwise(1).alias("version"))
    return jobs.on_demand(asks, documents, _jobs(t), 2).groupBy("outcome").agg(F.count("*").alias("n"))
