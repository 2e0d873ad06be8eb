"""Files with contracts: read back what was written, and refuse what breaks them."""

import json

import pytest
from pyspark.sql import functions as F

from presswork.sources import artifacts, policies, search_files


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_documents_round_trip(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", [{"news_id": "N1", "headline": "A", "topic_ids": [1]}, {"news_id": "N2"}])
    rows = search_files.read_documents(spark, path)
    search_files.write_documents(rows, str(tmp_path / "out"))
    again = search_files.read_documents(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect())) and rows.where("headline = ''").count() == 1
    with pytest.raises(ValueError, match="invalid documents"):
        search_files.read_documents(spark, write(tmp_path / "bad.jsonl", [{"news_id": "7"}]))
    with pytest.raises(ValueError, match="repeated documents: N1"):
        search_files.read_documents(spark, write(tmp_path / "two.jsonl", [{"news_id": "N1"}, {"news_id": "N1"}]))


def test_queries_and_judgements(spark, tmp_path):
    queries = search_files.read_queries(spark, write(tmp_path / "q.jsonl", [{"query_id": "a", "text": "x", "split": "test"}, {"query_id": "b", "text": "y", "split": "calibration"}]))
    with pytest.raises(ValueError, match="invalid queries: c"):
        search_files.read_queries(spark, write(tmp_path / "q2.jsonl", [{"query_id": "c", "text": "x", "split": "train"}]))
    judged = search_files.read_qrels(spark, write(tmp_path / "r.jsonl", [{"query_id": "a", "article_id": 1, "relevance": 2}, {"query_id": "a", "article_id": 2, "relevance": 0}]), queries)
    for row in ({"query_id": "a", "article_id": 1, "relevance": 3}, {"query_id": "zz", "article_id": 1, "relevance": 1}):
        with pytest.raises(ValueError):
            search_files.read_qrels(spark, write(tmp_path / "bad.jsonl", [row]), queries)
    review = spark.createDataFrame([("a", 2, 1)], "query_id string, article_id long, relevance int")
    got = {r.article_id: (r.relevance, r.human_reviewed) for r in search_files.apply_review(judged, review).collect()}
    assert got == {1: (2, False), 2: (1, True)}
    with pytest.raises(ValueError):
        search_files.apply_review(judged, review.withColumn("article_id", F.lit(9).cast("long")))
    assert search_files.merge_labels([judged.where("article_id = 1"), judged.where("article_id = 2")], judged).count() == 2
    with pytest.raises(ValueError):
        search_files.merge_labels([judged.where("article_id = 1")], judged)


def test_artifacts_are_checked(spark, tmp_path):
    path = str(tmp_path / "a")
    artifacts.write_artifact(spark.range(10), path, "factors", 2, "src")
    assert artifacts.read_artifact(spark, path, "factors", 2, "src").count() == 10
    for kind, version, source in (("index", 2, "src"), ("factors", 3, "src"), ("factors", 2, "other")):
        with pytest.raises(ValueError):
            artifacts.read_artifact(spark, path, kind, version, source)
    spark.range(11).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="not what was written"):
        artifacts.read_artifact(spark, path, "factors", 2)


def test_allow_list(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"domain": "a.com", "languages": ["en"], "quality_weight": 0.5}, {"domain": "x.a.com", "languages": ["zh", "en"], "quality_weight": 1}]))
    rows = policies.read_allow_list(spark, str(tmp_path / "p.json"))
    hosts = spark.createDataFrame([("a.com",), ("y.x.a.com",), ("ba.com",), (None,)], "host string")
    got = {r.host: r.domain for r in policies.match_policy(hosts, rows).collect()}
    assert got == {"a.com": "a.com", "y.x.a.com": "a.com", "ba.com": None, None: None}
    (tmp_path / "bad.json").write_text(json.dumps([{"domain": "a.com", "languages": ["fr"], "quality_weight": 0.5}]))
    with pytest.raises(ValueError, match=r"a\.com"):
        policies.read_allow_list(spark, str(tmp_path / "bad.json"))
