"""Catalog snapshots and content jobs."""

import pytest
from pyspark.sql import functions as F

from presswork.operators import catalog, jobs


def tables(spark, articles, topics):
    return {"articles": (spark.createDataFrame(articles, "id int, title string, topic int"), ["id"]), "topics": (spark.createDataFrame(topics, "topic int, name string"), ["topic"])}


SURVIVES = {"profiles": "origin = 'seed'"}


def test_snapshots_reset_profiles_only_when_topics_change(spark, tmp_path):
    path = str(tmp_path / "catalog")
    merge = lambda a, t: catalog.merge_catalog(spark, path, tables(spark, a, t), ["topics"], SURVIVES)
    with pytest.raises(ValueError, match="empty"):
        catalog.read_table(spark, path, "articles")
    first = merge([(1, "a", 5), (2, "b", 5)], [(5, "five")])
    assert first.version == 1 and not first.topics_changed
    catalog.add_dependent(spark, path, "profiles", spark.createDataFrame([(1, "seed"), (2, "learnt")], "user int, origin string"))
    second = merge([(2, "B", 5), (3, "c", None)], [(5, "five")])
    assert {(r.table, r.action): r.n for r in second.actions.collect()} == {("articles", "delete"): 1, ("articles", "update"): 1, ("articles", "insert"): 1, ("topics", "keep"): 1}
    assert not second.topics_changed and catalog.read_table(spark, path, "profiles").count() == 2
    third = merge([(2, "B", 5)], [(5, "FIVE")])
    assert third.topics_changed and [r.user for r in catalog.read_table(spark, path, "profiles").collect()] == [1]
    assert catalog.read_table(spark, path, "profiles", 2).count() == 2 and catalog.read_table(spark, path, "articles").count() == 1


def test_an_aborted_merge_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "catalog")
    catalog.merge_catalog(spark, path, tables(spark, [(1, "a", 5)], [(5, "five")]), ["topics"], SURVIVES)
    with pytest.raises(ValueError, match="repeats"):
        catalog.merge_catalog(spark, path, tables(spark, [(1, "x", 5), (1, "y", 5)], [(5, "five")]), ["topics"], SURVIVES)
    broken = tables(spark, [(9, "z", 5)], [(5, "other")])
    broken["topics"] = (broken["topics"][0].withColumn("name", F.raise_error(F.lit("lost")).cast("string")), ["topic"])
    with pytest.raises(Exception, match="lost"):  # half of the new tables are written by then
        catalog.merge_catalog(spark, path, broken, ["topics"], SURVIVES)
    assert catalog.current_version(spark, path) == 1 and [r.title for r in catalog.read_table(spark, path, "articles").collect()] == ["a"]
    again = catalog.merge_catalog(spark, path, tables(spark, [(1, "b", 5)], [(5, "five")]), ["topics"], SURVIVES)
    assert again.version == 2 and [r.title for r in catalog.read_table(spark, path, "articles").collect()] == ["b"]


def test_jobs_are_queued_once_for_each_content(spark):
    none = spark.createDataFrame([], jobs.JOB)
    wanted = lambda *rows: spark.createDataFrame(list(rows), "article_id long, content_hash string")
    table = jobs.enqueue(none, wanted((1, "a"), (1, "a"), (2, None)))
    assert sorted((r.article_id, r.generation, r.state) for r in table.collect()) == [(1, 1, "pending"), (2, 1, "pending")]
    assert jobs.enqueue(table, wanted((1, "a"), (2, None))).count() == 0
    table = table.unionByName(jobs.enqueue(table, wanted((1, "b"), (2, None), (3, "c"))))
    assert sorted((r.article_id, r.generation, r.content_hash) for r in jobs.latest(table).collect()) == [(1, 2, "b"), (2, 1, None), (3, 1, "c")]


def test_only_the_newest_generation_and_the_next_attempt_are_answered(spark):
    rows = [(1, 1, "a", "pending", 0), (1, 2, "b", "pending", 0), (2, 1, "c", "retry", 4), (3, 1, "d", "complete", 1), (4, 1, "e", "retry", 2), (5, 1, "f", "pending", 0)]
    table = spark.createDataFrame(rows, jobs.JOB)
    results = spark.createDataFrame([(1, 1, True, 1), (1, 2, False, 1), (2, 1, False, 5), (3, 1, False, 2), (4, 1, True, 2), (4, 1, True, 3), (9, 1, True, 1)], "article_id long, generation long, ok boolean, attempt int")
    got = {(r.article_id, r.generation): (r.state, r.attempts) for r in jobs.answer(table, results).collect()}
    assert got == {(1, 1): ("pending", 0), (1, 2): ("retry", 1), (2, 1): ("failed", 5), (3, 1): ("complete", 1), (4, 1): ("complete", 3), (5, 1): ("pending", 0)}
    once = jobs.answer(table, results)
    assert sorted(map(tuple, jobs.answer(once, results).collect())) == sorted(map(tuple, once.collect()))


def test_on_demand_outcomes(spark):
    table = spark.createDataFrame([(3, 1, "a", "retry", 1), (4, 1, "a", "failed", 5)], jobs.JOB)
    asks = spark.createDataFrame([(1, False), (2, True), (3, True), (4, True), (5, True), (6, None)], "article_id long, allowed boolean")
    documents = spark.createDataFrame([(1, 2), (2, 2), (5, 1)], "article_id long, version int")
    assert {r.article_id: r.outcome for r in jobs.on_demand(asks, documents, table, 2).collect()} == {1: "blocked", 2: "available", 3: "queued", 4: "given_up", 5: "enqueued", 6: "blocked"}
