"""Queries do the whole job: every row that is asked for, against SQL without cuts or against brute force."""

import hashlib
import importlib
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators import feed, live, search
from test_oracle import FOLDER, TABLES, rows

registry = importlib.import_module("presswork.plans.registry")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def check_against(spark, duck, name):
    sql = registry.ORACLE_SQL[name]
    assert "% 10 = 0" not in sql and "_id < 10" not in sql and "custkey <" not in sql
    got, want = registry.QUERIES[name](spark, FOLDER), duck.execute(sql)
    names = [d[0] for d in want.description]
    expected = rows(names, want.fetchall())
    assert expected and rows(got.columns, [tuple(r) for r in got.collect()]) == expected


@pytest.mark.parametrize("name", ["c1_recall_union", "f45_selected_reason", "c2_feed_manual", "j21_pairwise_similarity", "j22_candidate_recall"])
def test_feed_of_every_request(spark, duck, name):
    check_against(spark, duck, name)


def test_every_request_gets_a_page(spark):
    pages = registry.QUERIES["l8_mmr_page"](spark, FOLDER)
    asked = {r.o_orderkey for r in spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey").collect()}
    assert {r.request_id for r in pages.select("request_id").distinct().collect()} == asked


@pytest.mark.parametrize("name", ["f5_bm25_top10", "l5_dense_topk", "f6_rrf", "f7_gate", "l17_pool"])
def test_searches_of_every_fiftieth_row(spark, duck, name):
    check_against(spark, duck, name)


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (300, 5)).astype(float)  # whole numbers: many ties
    x[100:160] = x[7]
    rows_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (None, [1.0] * 5)], "id long, v array<double>")
    got = search.dense_top_k(rows_, rows_, "id", "v", 4, block=70, query_block=40).collect()
    want = {(q, d, r) for q in range(300) for r, d in enumerate(sorted((d for d in range(300) if d != q), key=lambda d: (-(x[d] @ x[q]), d))[:4], 1)}
    assert {(r.query, r.doc, r["rank"]) for r in got} == want and len(got) == 1200


def test_dense_search_of_many_queries(spark):
    rows_ = spark.range(10_050).select("id", F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0)).alias("v"))
    assert search.dense_top_k(rows_.where("id < 50"), rows_, "id", "v", 1).count() == 10_050


def test_search_text_of_every_document(spark):
    got = {r.doc_id: r.digest for r in registry.QUERIES["f1_search_text"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: d.text and hashlib.md5(" ".join(d.text.lower().split()).encode()).hexdigest() for d in docs}
    assert any(d.text and not d.text.isascii() for d in docs) and got == want


def test_search_text_of_other_scripts(spark):
    texts = ["\u00c4RGER\u00a0 \u201cNa\u00efve\u201d\u2003\u00c9t\u00e9\n", "\u3000Stra\u00dfe\u2028\u00d1\x1fx\x85", " "]
    rows_ = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in rows_.select(text.search_text(F.col("t")).alias("x")).collect()] == [" ".join(t.lower().split()) for t in texts]


def test_profile_of_every_customer(spark, duck):
    check_against(spark, duck, "c14_ensure_profiles")
    folder = FOLDER.replace("sf0.001", "sf0.01")
    assert registry.QUERIES["c14_ensure_profiles"](spark, folder).count() == spark.read.parquet(f"{folder}/customer.parquet").count()


def test_reservation_of_every_event_and_campaign(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    got = registry.QUERIES["c10_ad_reservation"](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/events.parquet").count()
    assert got.select("campaign_id").distinct().count() > 20


def test_reservation_carries_state_over_batches(spark):
    rng = random.Random(3)
    asked = [(rng.randrange(3), rng.choice("de"), i, rng.randrange(40), rng.randrange(86400)) for i in range(900)]
    limits = {c: (1 + c, 120, 2) for c in range(3)}
    want, spent, seen = {}, {}, {}
    for c, day, i, user, second in sorted(asked, key=lambda r: (r[4], r[2])):
        spend, budget, cap = limits[c]
        limit = max(spend, round(budget * min(1.0, (second + 3600.0) / 86400.0)))
        want[i] = spent.get((c, day), 0) + spend <= min(limit, budget) and seen.get((c, day, user), 0) < cap
        if want[i]:
            spent[c, day] = spent.get((c, day), 0) + spend
            seen[c, day, user] = seen.get((c, day, user), 0) + 1
    requests = spark.createDataFrame(asked, "campaign_id long, day string, request_id long, user_id long, second int")
    campaigns = spark.createDataFrame([(c, *v) for c, v in limits.items()], "campaign_id long, spend int, daily_budget int, frequency_cap int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.request_id: r.served for r in feed.reserve(requests, campaigns).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_trigrams_take_one_pass(spark):
    """Each character was looked for from the start of the text: 400,000 of them took minutes."""
    for t in ("", "a", "ab", "abc", "abcd", "a😀b😀c\nd", "ababab"):
        assert spark.range(1).select(text.trigrams(F.lit(t))).first()[0] == list(dict.fromkeys(t[i : i + 3] for i in range(max(1, len(t) - 2))))
    long = "".join(random.Random(3).choices("abcdeé", k=400_000))
    begun = time.monotonic()
    assert spark.range(1).select(F.size(text.trigrams(F.lit(long)))).first()[0] == len({long[i : i + 3] for i in range(len(long) - 2)})
    assert time.monotonic() - begun < 20


def test_no_pair_of_user_and_campaign_is_shuffled(spark, duck):
    plan = registry.QUERIES["c9_ad_eligibility"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and not re.search("Join .*campaign_id#[0-9]+L? = .*user_id", plan)
    check_against(spark, duck, "c9_ad_eligibility")


@pytest.mark.parametrize("name", ["f38_page_text", "f40_folded", "f37_body_text", "f30_content_hash_nfkc"])
def test_texts_go_to_python_a_hundred_at_a_time(spark, name):
    """An Arrow batch of 10,000 texts took some 500 MB of each worker."""
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 1


def test_pages_are_made_where_requests_are_dealt(spark, duck, monkeypatch):
    """More requests give more partitions, not larger ones, and no join by request shuffles them again."""
    monkeypatch.setattr("presswork.plans.bindings.REQUESTS_EACH", 100)
    plan = registry.QUERIES["l10_slot_blend"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(request_id#[0-9]+L, 15\), REPARTITION_BY_NUM", plan) and "ENSURE_REQUIREMENTS" not in plan
    check_against(spark, duck, "l10_slot_blend")


def test_near_titles_give_every_pair_of_a_day(spark):
    """Copies were linked to one of them only, and classes of copies by one pair for all."""
    title = "Council approves the new harbour bridge{} after a long debate over costs and night traffic{}"
    timed = [(1, title.format("", ""), 0), (2, title.format(",", "!"), 80_000), (3, title.format("", "?"), 86_400), (4, "Something else entirely", 0), (5, title.format("s", ""), 90_000), (6, title.format("s", "."), 166_400), (7, None, 5), (8, "?!", 5), (9, title.format("", ""), 100)]
    rows_ = spark.createDataFrame(timed, "id int, title string, discovered_at long")
    got = [(r.a, r.b) for r in live.all_near_title_pairs(rows_).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 9), (2, 3), (2, 5), (2, 6), (2, 9), (3, 5), (3, 6), (3, 9), (5, 6)]


def test_near_titles_of_documents_equal_brute_force(spark):
    grams = lambda x: {x[i : i + 3] for i in range(max(1, len(x) - 2))}
    docs = [(d.doc_id, "".join(re.findall(r"[^\W_]", (d.text or "").split("\n")[0].lower()))) for d in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    docs = sorted((i, grams(x)) for i, x in docs if x)
    want = {(i, j) for k, (i, a) in enumerate(docs) for j, b in docs[k + 1 :] if (j - i) * 60 <= 86_400 and len(a & b) >= 0.92 * len(a | b)}
    got = [(r.a, r.b) for r in registry.QUERIES["j14_near_title_pairs"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) == len(want) > 100 and set(got) == want


def test_users_of_a_topic_go_through_its_campaigns_together(spark, duck, monkeypatch):
    """Every user had its own run of campaigns, made by few tasks; now a campaign is a run, and tasks make a bounded number of rows."""
    monkeypatch.setattr("presswork.plans.feed_queries.PAIRS_EACH", 500)
    got = registry.QUERIES["c9_ad_eligibility"](spark, FOLDER.replace("sf0.001", "sf0.01"))
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 8

    def runs(batches):
        last, rows_, n = None, 0, 0
        for batch in batches:
            for c in batch.column("campaign_id").to_pylist():
                rows_, n, last = rows_ + 1, n + (c != last), c
        yield pa.RecordBatch.from_arrays([pa.array([rows_]), pa.array([n])], names=["rows", "runs"])

    total = got.mapInArrow(runs, "rows long, runs long").agg(F.sum("rows").alias("rows"), F.sum("runs").alias("runs")).first()
    assert total["rows"] > 4000 and total.runs * 8 < total["rows"]
    check_against(spark, duck, "c9_ad_eligibility")
