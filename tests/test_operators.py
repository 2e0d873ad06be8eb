"""Operators against values worked out by hand."""

import gzip
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.functions import scores, text
from presswork.operators import evaluation, feed, live, ordered, profile, resolve, search
from presswork.sources import batches, impressions, search_index
from presswork.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("dwell, strength", [(9_999, 0), (10_000, 0.25), (29_999, 0.25), (30_000, 0.5), (119_999, 0.5), (120_000, 0.75), (None, 0)])
def test_dwell_strength(spark, dwell, strength):
    assert one(spark, scores.dwell_strength(F.lit(dwell).cast("long"))) == strength


@pytest.mark.parametrize("kind, strength", [("recommendation_click", 1), ("search_result_click", 1.25), ("upvote", 2), ("downvote", -2), ("share", 0)])
def test_event_strength(spark, kind, strength):
    assert one(spark, scores.event_strength(F.lit(kind), F.lit(None).cast("long"))) == strength


def test_base_score_and_alpha(spark):
    assert one(spark, scores.base_score(F.lit(100))) == 0.5
    assert one(spark, scores.base_score(F.lit(0))) == 0
    assert one(spark, scores.personal_share(F.lit(-4))) == pytest.approx(0.1)
    assert one(spark, scores.personal_share(F.lit(30))) == pytest.approx(0.525)


def test_search_text(spark):
    assert one(spark, text.search_tokens(F.lit(" The Mayor's  3-2 vote; ADJOURNED "))) == ["the", "mayor's", "3", "2", "vote", "adjourned"]
    assert one(spark, text.search_terms(F.lit(" River   flood  of 99 "))) == ["river flood of 99", "river", "flood"]
    # phrase, first and second word: in the title 2 + 2 + 2, in the body 0 + 1 + 0, of 3 * 3
    score = text.lexical_score(text.search_terms(F.lit("river flood")), F.lit("River flood warning lifted"), F.lit("The river has gone back to its banks"))
    assert one(spark, score) == pytest.approx(7 / 9)
    assert one(spark, text.lexical_score(text.search_terms(F.lit("")), F.lit("x"), F.lit(None).cast("string"))) == 0


@pytest.mark.parametrize("url, canonical", [
    ("http://Paper.Example:8080/a/B?z=1&gclid=7&c=#part", "http://paper.example:8080/a/B?c=&z=1"),
    ("HtTp://x.example?utm_term=q&fbclid=1", "http://x.example"),
])
def test_canonical_url(spark, url, canonical):
    assert one(spark, text.canonical_url(F.lit(url))) == canonical


def test_text_edges(spark):
    assert one(spark, text.source_domain(F.lit("https://www.msn.com/one"))) == "msn.com"
    assert one(spark, text.source_domain(F.lit(None).cast("string"))) == "unknown-source"
    assert one(spark, text.trigrams(F.lit("ab"))) == ["ab"]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert one(spark, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, text.normal_form(F.lit("ﬁne  ①"))) == "fine 1"


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([("r", i, s, y) for i, s, y in ((1, 5.0, 1), (2, 4.0, 0), (3, 3.0, 1), (4, 2.0, 0), (5, 1.0, 0), (6, 0.5, 1))] + [("none", 1, 1.0, 0)], "r string, item int, s double, y int")
    got = evaluation.request_metrics(evaluation.ranked(rows, "r", "s", "item"), "r", "y", (5,)).collect()
    assert len(got) == 1 and got[0].recall_5 == pytest.approx(2 / 3) and got[0].mrr == 1
    second = spark.createDataFrame([("r", 1, 2.0, 0), ("r", 2, 1.0, 1)], "r string, item int, s double, y int")
    assert evaluation.request_metrics(evaluation.ranked(second, "r", "s", "item"), "r", "y", (5,)).first().ndcg_5 == pytest.approx(1 / math.log2(3))


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int")
    assert evaluation.roc_auc(rows, "s", "y").first().auc == pytest.approx(0.875)
    assert evaluation.average_precision(rows, "s", "y").first().ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_bootstrap_of_a_constant(spark):
    rows = spark.range(50).select(F.col("id").alias("request_id"), F.lit(1.0).alias("d"))
    got = evaluation.paired_bootstrap(rows, ["d"], iterations=50).first()
    assert got.low == pytest.approx(1) and got.high == pytest.approx(1)


def test_prior_counts_are_strictly_before(spark):
    rows = spark.createDataFrame([(10, 100, "a", 1, 1), (10, 200, "b", 1, 0), (10, 200, "b", 2, 1)], "article_id int, event_ts long, request_id string, position int, clicked int")
    got = ordered.prior_counts(rows, "article_id", ["event_ts", "request_id", "position"]).orderBy("event_ts", "position").collect()
    assert [(r.prior_impressions, r.prior_clicks) for r in got] == [(0, 0), (1, 1), (2, 1)]


def test_chronological_cutoff(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 20), ("c", 20), ("d", 30)], "request_id string, event_ts long")
    assert ordered.chronological_cutoff(rows, 0.5) == 20
    assert ordered.chronological_cutoff(rows.limit(1), 0.5) is None


def test_islands(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabcccba")], "p int, i int, v string")
    got = ordered.islands(rows, ["p"], ["i"], "v").groupBy("island").count().orderBy("island").collect()
    assert [r["count"] for r in got] == [2, 1, 3, 1, 1]


def test_blend_slots(spark):
    organic = spark.createDataFrame([("r", 10 + i, i) for i in range(1, 4)], "r string, item int, rank int")
    ads = spark.createDataFrame([("r", 99, 2)], "r string, item int, slot int")
    got = ordered.blend_slots(organic, ads, "r", 6).orderBy("position").collect()
    assert [r.item for r in got] == [11, 99, 12, 13]


def test_as_of(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 10, 2), ("u", 1, 3), ("v", 5, 4)], "user string, t int, k int")
    right = spark.createDataFrame([("u", 2, "x"), ("u", 10, "y")], "user string, s int, q string")
    got = {r.k: r.q for r in ordered.as_of(left, right, ["user"], "t", "s", ["q"]).collect()}
    assert got == {1: "x", 2: "y", 3: None, 4: None}


def test_mmr(spark):
    rows = spark.createDataFrame([("r", "N1", 0.90, [10]), ("r", "N2", 0.89, [10]), ("r", "N3", 0.80, [20])], "request_id string, article_id string, relevance double, topics array<int>")
    got = feed.rerank_mmr(rows, 3, 0.2).orderBy("rank").collect()
    assert [(r.article_id, r.max_similarity) for r in got] == [("N1", 0), ("N3", 0), ("N2", 1)]


def test_index_ties_go_by_id_and_a_changed_source_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([("N20", "alpha beta"), ("N10", "alpha beta"), ("N30", "alpha beta gamma delta epsilon"), ("N40", None)], "id string, body string")
    asked = spark.createDataFrame([(1, "alpha alpha beta"), (2, "unknown"), (3, None)], "q int, t string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    state = search_index.source_state(spark.read.parquet(str(tmp_path / "docs")))
    search_index.build_index(docs, str(tmp_path / "index"), "id", F.col("body"), state, buckets=4)
    index = search_index.open_index(spark, str(tmp_path / "index"), state)
    hits = index.bm25(asked, "q", "t", 3).orderBy("rank").collect()
    assert [(r.query, r.doc) for r in hits] == [(1, "N10"), (1, "N20"), (1, "N30")] and index.n == 4 and index.total == 9
    plain = lambda n, length: sum(math.log(1 + (4 - 3 + 0.5) / 3.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / (9 / 4))) for _ in range(n))
    assert hits[0].score == pytest.approx(plain(2, 2)) and hits[2].score == pytest.approx(plain(2, 5))
    docs.write.mode("append").parquet(str(tmp_path / "docs"))
    with pytest.raises(ValueError, match="changed"):
        search_index.open_index(spark, str(tmp_path / "index"), search_index.source_state(spark.read.parquet(str(tmp_path / "docs"))))
    with pytest.raises(ValueError, match="no search index"):
        search_index.open_index(spark, str(tmp_path / "none"), state)


def test_index_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(200)], "id long, body string")
    search_index.build_index(docs, str(tmp_path / "index"), "id", F.col("body"), "s", buckets=16)
    index = search_index.open_index(spark, str(tmp_path / "index"), "s")
    asked = spark.createDataFrame([(1, "w7")], "q int, t string")
    plan = index._of(index.postings, asked.select(F.col("t").alias("term")))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w7)]" in plan
    assert [r.doc for r in index.bm25(asked, "q", "t", 5).collect()] == [7]


def test_dense_search_goes_by_the_most_common_length(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)] + [(100, [1.0] * 9), (101, None), (102, [float("inf"), 1.0, 1.0]), (103, []), (None, [1.0] * 3)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = search.dense_top_k(v, v.where("id < 4"), "id", "v", 5, block=16, query_block=2).collect()
    for q in range(4):
        dot = lambda i, q=q: sum(a * b for a, b in zip(rows[q][1], rows[i][1], strict=True))
        best = sorted((i for i in range(40) if i != q), key=lambda i: (-dot(i), i))[:5]
        assert [r.doc for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == best


def test_profiles_hold_only_what_came_before(spark):
    clicks = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (1, "b", 20), (2, "a", 5)], "user_id int, category string, event_ts long")
    moments = spark.createDataFrame([(1, 10), (1, 20), (1, 21), (2, 5), (3, 9)], "user_id int, event_ts long")
    got = {(r.user_id, r.event_ts, r.category): (r.weight, r.history_length) for r in feed.profile_as_of(clicks, moments).collect()}
    # the first request of a user has no profile, and a click at the time of a request does not count
    assert got == {(1, 20, "a"): (1, 1), (1, 21, "a"): (pytest.approx(1 / 3), 3), (1, 21, "b"): (pytest.approx(2 / 3), 3)}


def test_hybrid_resolution_stops_at_the_first_stage_that_answers(spark):
    asks = spark.createDataFrame([(1, " 7   8 "), (2, "Storm Watch"), (3, "weather"), (4, "heavy rain"), (5, "gibberish"), (6, " "), (7, "lost"), (8, None)], "ask int, asked string")
    query_map = spark.createDataFrame([("q1", 10, 0.5, 1, "storm watch"), ("q2", 10, 0.9, 2, "other"), ("q0", 11, 0.9, 3, "third"), ("q3", 11, 0.9, 1, "third")], "query_key string, topic_id int, score double, match_rank int, display_query string")
    topics = spark.createDataFrame([(10, "Weather", 5), (11, "Sport", 9), (12, "Unmapped", 1)], "topic_id int, display_name string, news_count int")
    mapping = spark.createDataFrame([(100, 10, 0), (100, 11, 1), (200, 12, 0)], "article_id int, topic_id int, source_rank int")
    seen = []

    def find(open_):
        seen.extend(sorted(r.ask for r in open_.collect()))
        hits = spark.createDataFrame([(4, 100, 0.02, 1), (5, 100, 0.02, 1), (7, 200, 0.02, 1)], "query int, doc int, fusion double, rank int")
        return hits, spark.createDataFrame([(4, 0.7, True), (5, 0.1, False), (7, 0.8, True)], "query int, dense double, accepted boolean")

    got = {r.ask: (r.query_key, r.source, r.confidence) for r in resolve.resolve_hybrid(asks, query_map, topics, mapping, find).collect()}
    assert seen == [4, 5, 7]
    # topic 11 has a quarter more votes than topic 10, and of its two keys with one score the smaller match_rank wins
    assert got == {1: ("7 8", "numeric_query_key", 1), 2: ("q1", "exact_alias", 1), 3: ("q2", "exact_alias", 1), 4: ("q3", "hybrid_v1", 0.7), 5: (None, "rejected", None), 6: (None, "blank", None), 7: ("12", "hybrid_v1", 0.8), 8: (None, "blank", None)}


def test_fusion_needs_a_weight(spark):
    with pytest.raises(ValueError):
        search.fuse(None, None, 1, weights=(0, 0))


def events(spark, rows):
    return spark.createDataFrame([(u, t, i, ts, k, None) for u, t, i, ts, k in rows], "user_id long, topic_id int, event_id long, event_ts long, event_type string, dwell_ms long")


def test_profile_of_one_upvote(spark):
    got = profile.in_order_profile(events(spark, [(1, 5, 1, 100, "upvote")]), ["user_id", "topic_id"]).first()
    assert (got.short_positive, got.short_negative, got.long_positive, got.positive_evidence) == (2, 0, 0.5, 1)


def test_late_events_are_per_key_and_equal_times_count(spark):
    rows = events(spark, [(1, 5, 1, 100, "upvote"), (1, 5, 2, 90, "upvote"), (1, 6, 3, 90, "upvote"), (1, 5, 4, 100, "share"), (1, 5, 5, 100, "downvote")])
    got = {r.event_id: r.outcome for r in profile.late_events(rows, ["user_id", "topic_id"], "event_ts", "event_id").collect()}
    assert got == {1: "applied", 2: "out_of_order", 3: "applied", 4: "no_signal", 5: "applied"}


def test_fold_truncates_at_every_event(spark):
    rows = spark.createDataFrame([(1, t, 0.1, t) for t in range(12)], "u int, t int, d double, ts int")
    got = {r.t: r.weight for r in profile.truncated_fold(rows, "u", "t", "d", ["ts"]).collect()}
    assert sorted(got) == list(range(2, 12)) and got[11] == 0.1 and got[10] == 0.092


def test_stream_equals_closed_form_over_two_files(spark, tmp_path):
    rows = events(spark, [(u % 3, u % 2, u, 1000 + 7 * u, ("upvote", "downvote", "recommendation_click")[u % 3]) for u in range(60)])
    for k, part in enumerate((rows.where("event_id < 30"), rows.where("event_id >= 30"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    state = ev.latest(ev.run_to_end(ev.profile_state(stream), str(tmp_path / "out"), "update"), ["user_id", "topic_id"])
    want = {(r.user_id, r.topic_id): r for r in profile.in_order_profile(rows, ["user_id", "topic_id"]).collect()}
    got = state.collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.user_id, r.topic_id]
        assert r.short_positive == pytest.approx(w.short_positive) and r.long_negative == pytest.approx(w.long_negative) and r.last_event_ts == w.last_event_ts


def test_rejection_order(spark):
    good = dict(url="https://a.com/x", allowed=["en"], language="EN", title="A title", age=0)
    cases = [({}, None), ({"url": "ftp://a"}, "invalid_metadata"), ({"allowed": None}, "domain_not_allowed"), ({"language": "de"}, "unsupported_language"), ({"title": "  "}, "missing_title"), ({"title": "404 gone"}, "invalid_page"), ({"url": "https://a.com/tags/x"}, "invalid_page"), ({"age": 300_000}, "stale_article"), ({"age": -3600}, "stale_article")]
    rows = spark.createDataFrame([(i, *{**good, **c}.values()) for i, (c, _) in enumerate(cases)], "i int, url string, allowed array<string>, language string, title string, age long")
    got = rows.select("i", live.rejection_reason(F.col("url"), F.lit("a.com"), F.col("allowed"), F.col("language"), F.col("title"), F.col("age")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [w for _, w in cases]


def test_near_titles_within_a_day(spark):
    title = "Council approves the new harbour bridge{} after a long debate over costs and night traffic{}"
    timed = [(1, title.format("", ""), 0), (2, title.format(",", "!"), 80_000), (3, title.format("", "?"), 170_000), (4, "Something else entirely", 0), (5, title.format("s", ""), 90_000), (6, title.format("s", ""), 300_000), (7, None, 5), (8, "?!", 5)]
    rows = spark.createDataFrame(timed, "id int, title string, discovered_at long")
    # 1 and 2 are one class of a day; 3 has their title, but more than a day after 2; 5 is near in title to all of them, in time to 2 and 3
    assert sorted((r.a, r.b, r.same) for r in live.near_title_pairs(rows).collect()) == [(1, 2, True), (1, 5, False), (3, 5, False)]


def test_diversify_breaks_runs_of_a_publisher(spark):
    rows = spark.createDataFrame([("r", i, 1.0 - i / 10, 0, p, l, t) for i, p, l, t in ((1, "a", "en", "one alpha"), (2, "a", "en", "two beta"), (3, "a", "en", "three gamma"), (4, "b", "zh", "four delta"))], "request_id string, article_id int, score double, discovered_at long, publisher string, language string, title string")
    assert [r.article_id for r in live.diversify(rows, 3).orderBy("rank").collect()] == [1, 2, 4]


def test_html_blocks(spark):
    html = "<html><script>var x = '</p>'</script><h1>A  title</h1><p>One <b>two</b></p><img src='https://x/i.png' alt='pic'><img src='data:x'><nav><p>menu</p></nav><p> </p></html>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(live.html_blocks("h").alias("b")).collect()
    assert [(b.type, b.text) for b in got[0].b] == [("heading", "A title"), ("paragraph", "One two"), ("image", "pic")]
    assert got[1].b == []


def test_normalise_golden(spark, tmp_path):
    (tmp_path / "news.tsv").write_text("".join(f"N{i}\tNews\tLocal\tT{i}\t\thttps://www.msn.com/{i}\t[]\t[]\n" for i in (1, 2, 3)) + "X4\tNews\tLocal\tT\t\tu\t[]\t[]\nN5\tshort\n")
    (tmp_path / "train.tsv").write_text('1\tU1\t11/13/2019 8:36:57 AM\t\tN1-0 N2-1\n2\tU2\t11/13/2019 9:36:57 AM\tN1 N2\tN3-1 N2-1\n3\tU3\t11/13/2019 9:36:57 AM\t\tN3-2\n4\tU3\tnot a time\t\tN3-1\n')
    news = impressions.read_news(spark, str(tmp_path / "news.tsv"))
    assert {r.problem: r["count"] for r in news.groupBy("problem").count().collect()} == {None: 3, "bad_news_id": 1, "wrong_column_count": 1}
    behaviours = impressions.read_behaviours(spark, str(tmp_path / "train.tsv"), "train")
    assert sorted(r.problem for r in behaviours.where("problem is not null").collect()) == ["bad_candidate", "bad_time"]
    requests = impressions.requests_table(behaviours).orderBy("request_id").collect()
    assert [(r.request_id, r.event_ts, r.history, r.candidate_count, r.positive_count) for r in requests] == [("mind:train:1", 1573634217, [], 2, 1), ("mind:train:2", 1573637817, [1, 2], 2, 2)]
    table = impressions.impressions_table(behaviours)
    assert table.count() == 4 and table.where("clicked").count() == 3
    assert impressions.fingerprint(table) == impressions.fingerprint(table.repartition(3))
    articles = impressions.load_articles([news, news])
    assert articles.count() == 3
    with pytest.raises(ValueError, match="N1"):
        impressions.load_articles([news, news.withColumn("title", F.lit("other"))])


def test_json_lines(spark, tmp_path):
    path = tmp_path / "b.json.gz"
    with gzip.open(path, "wt") as out:
        out.write(json.dumps({"url": "https://a.com", "title": "x"}) + "\n{broken\n\n[1]\n")
    got = batches.read_json_lines(spark, str(path)).collect()
    assert sorted((r.malformed, r.url) for r in got if not r.malformed) == [(False, "https://a.com")] and len(got) == 3


def test_claim_events_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 4, "a")], "event_id long, arrival long, event_type string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = ev.run_to_end(ev.claim_events(stream, ["event_type"]), str(tmp_path / "out"), "append").orderBy("arrival").collect()
    assert [r.outcome for r in got] == ["first", "duplicate", "conflict", "first"]


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_claims_of_a_busy_id_follow_arrival_over_all_parts(spark, tmp_path, small_parts):
    rows = spark.createDataFrame([(1, 9 - k, "a" if k == 8 else "b") for k in range(9)], "event_id long, arrival long, event_type string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = ev.run_to_end(ev.claim_events(stream, ["event_type"]), str(tmp_path / "out"), "append").orderBy("arrival").collect()
    assert [r.outcome for r in got] == ["first"] + ["conflict"] * 8


def test_profile_of_a_busy_key_takes_parts_in_any_order(spark, tmp_path, small_parts):
    rows = events(spark, [(1, 1, u, 1000 - 7 * u, ("upvote", "downvote", "recommendation_click")[u % 3]) for u in range(9)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = ev.run_to_end(ev.profile_state(stream), str(tmp_path / "out"), "update").first()
    want = profile.in_order_profile(rows, ["user_id", "topic_id"]).first()
    assert (got.positive_evidence, got.negative_evidence, got.last_event_ts) == (6, 3, 1000)
    assert got.short_positive == pytest.approx(want.short_positive) and got.long_negative == pytest.approx(want.long_negative)


def test_equal_arrivals_come_in_order_of_their_ids(spark):
    rows = events(spark, [(1, 5, k, 100 - k, "upvote") for k in (4, 2, 3, 1, 5)]).withColumn("arrival", F.lit(1))
    got = {r.event_id: r.outcome for r in profile.late_events(rows, ["user_id", "topic_id"], "event_ts", "arrival").collect()}
    assert got == {1: "applied", **{k: "out_of_order" for k in (2, 3, 4, 5)}}


def test_six_digits_of_the_double_as_in_the_sql(spark):
    import duckdb

    values = [0.525 * 0.1 + 0.475 * 0.1555, 0.1 + 21 / 51.0 * 0.85, *(k / 2e6 for k in range(1, 4001, 2))]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(scores.to_millionths(F.col("v")).alias("x")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_rows_are_kept_if_either_half_of_the_stage_holds_them(spark, tmp_path):
    from presswork.plans.registry import QUERIES

    spark.createDataFrame([(50,), (550,), (11,), (12,), (1_000_450,)], "p_partkey long").unionByName(spark.createDataFrame([(450,)], "p_partkey long")).write.parquet(str(tmp_path / "part.parquet"))
    assert sorted(r.p_partkey for r in QUERIES["j10_anti_delete"](spark, str(tmp_path)).collect()) == [12, 50, 450, 1_000_450]


def test_claimed_ids_are_forgotten_after_a_while(spark, tmp_path):
    """Over ten batches an hour apart, state holds the ids of the last hours only; conflicts within them are still found."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    for b in range(10):
        rows = [(b * 100 + i, b * 1000 + i, "a", start + dt.timedelta(hours=b, seconds=i)) for i in range(20)]
        rows += [(max(0, b - 1) * 100 + 1, b * 1000 + 500, "b", start + dt.timedelta(hours=b, seconds=30))]  # an id of the batch before, with other content
        rows += [(0, b * 1000 + 600, "c", start + dt.timedelta(hours=b, seconds=40))] if b == 9 else []  # the first id of all, long forgotten
        spark.createDataFrame(rows, "event_id long, arrival long, event_type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{b}"))
    stream = spark.readStream.schema("event_id long, arrival long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    claimed = ev.claim_events(stream, ["event_type"], "ts", 2 * 3600)
    held = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={number}"))

    run = claimed.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    got = {r.arrival: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert max(held) <= 20 * 6 and len(held) >= 10
    assert all(got[b * 1000 + 500] == "conflict" for b in range(1, 10)) and got[9600] == "first"


def test_reservation_stops_at_pace_and_cap(spark):
    asked = spark.createDataFrame([(1, "d", i, 7 if i < 3 else i, 0) for i in range(10)], "campaign_id long, day string, request_id long, user_id long, second int")
    limits = spark.createDataFrame([(1, 1, 96, 2)], "campaign_id long, spend int, daily_budget int, frequency_cap int")
    got = [r.served for r in feed.reserve(asked, limits).orderBy("request_id").collect()]
    assert got == [True, True, False, True, True, False, False, False, False, False]


def test_candidates_of_the_feed_are_not_shuffled(spark):
    """Everything above the step that makes a request's candidates stays in its partition."""
    from presswork.plans import registry  # noqa: F401
    from presswork.plans.bindings import Tables
    from presswork.plans.feed_queries import scored

    rows = scored(Tables(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(items")]
    assert "Window" in above and "Exchange hashpartitioning" not in above


def test_recall_drops_what_was_clicked_before_only(spark):
    requests = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 8, 20)], "request_id long, user_id long, event_ts long")
    articles = spark.createDataFrame([(1, "a", 9), (2, "a", 8), (3, "b", 7), (4, None, 6)], "article_id long, category string, hot long")
    clicks = spark.createDataFrame([(7, 1, "a", 10), (7, 3, "b", 15), (7, 4, None, 5)], "user_id long, article_id long, category string, event_ts long")
    profiles = feed.request_profiles(clicks, requests, 3)
    assert {r.request_id: (r.history_length, r.topics) for r in profiles.collect()} == {1: (1, {}), 2: (3, {"a": 1 / 3, "b": 1 / 3}), 3: (0, {})}
    found = feed.recall_from(profiles, feed.shelves(articles, 2, 1), clicks.select("user_id", "article_id", "event_ts"), 3, ["category"])
    got = sorted((r.request_id, r.article_id, "+".join(r.sources), r.is_fallback) for r in found.collect())
    assert got == [(1, 1, "hot", True), (2, 2, "profile", False), (3, 1, "hot", True)]


def shuffled_rows(spark, frame):
    """How many rows the frame's stages write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    last = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    rows = frame.collect()
    done = stages()
    return rows, sum(done.apply(i).shuffleWriteRecords() for i in range(done.size()) if done.apply(i).stageId() > last)


def test_texts_that_many_ask_for_are_looked_up_once(spark):
    asks = spark.createDataFrame([(k, f"red {('ring', 'gear')[k % 2]}") for k in range(400)], "ask long, asked string")
    articles = spark.createDataFrame([(k, ("Red ring", "Blue gear")[k % 2], "Brand") for k in range(400)], "article_id long, title string, abstract string")
    topics = articles.select("article_id", (F.col("article_id") % 2).cast("int").alias("topic_id"), F.lit(0).alias("source_rank"))
    keys = spark.createDataFrame([(1, "k0", 0, 0.5, 1, "x"), (2, "k1", 1, 0.9, 1, "y")], "row long, query_key string, topic_id int, score double, match_rank int, display_query string")
    rows, shuffled = shuffled_rows(spark, resolve.by_article_text(asks, articles, topics, keys))
    assert {(r.ask % 2, r.query_key) for r in rows} == {(0, "k0"), (1, "k1")} and len(rows) == 400 and shuffled < 20_000
    aliases = spark.createDataFrame([("nothing", 0)], "alias string, topic_id int")
    rows, shuffled = shuffled_rows(spark, resolve.lexical_baseline(asks, aliases, articles, topics, 5))
    got = {r.ask: [] for r in rows}
    for r in sorted(rows, key=lambda r: (r.ask, r.rank)):
        got[r.ask].append(r.article_id)
    assert got[0] == [0, 2, 4, 6, 8] and len(got) == 400 and shuffled < 20_000


def test_rows_of_a_query_bring_a_topic_s_articles_once(spark, tmp_path):
    """Two hundred rows of one key and topic, two hundred articles: pairs of key and article are joined, not of rows."""
    from presswork.plans.registry import QUERIES

    spark.range(200).select((F.col("id") * 25).alias("p_partkey"), F.lit(0).alias("p_size"), F.lit("a").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(200).select((F.col("id") * 1000).alias("s_suppkey"), F.lit(0).alias("s_nationkey"), (F.col("id") * 10.0).alias("s_acctbal")).where("s_suppkey % 25 = 0 AND s_suppkey < 5000").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(25, 40, 0.5)], "l_partkey long, l_suppkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    page = QUERIES["c7_search_scores"](spark, str(tmp_path))
    assert [(r.query_key, r.article_id, r.score) for r in page.where("rank <= 2").orderBy("rank").collect()] == [("0", 25, 0.5), ("0", 0, 0.004)]
    joined = page._jdf.queryExecution().optimizedPlan().toString()
    side = joined[joined.index("topic_score") :]
    assert side.count("max(score") == 2


def test_factor_top_k_equals_brute_force(spark):
    """Over several blocks, with equal and zero vectors, a user's list is that of all pairs; and no task holds more than a block."""
    rng = np.random.default_rng(3)
    users, items = rng.normal(size=(60, 8)).astype(np.float32), rng.normal(size=(900, 8)).astype(np.float32) * rng.lognormal(size=(900, 1)).astype(np.float32)
    items[100:130], users[0] = items[5], 0
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, features array<float>")
    got = search.factor_top_k(frame(users), frame(items), 7, block=200).collect()
    by_user = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        by_user.setdefault(r.id, []).append((r.doc, r.score))
    assert len(by_user) == 60
    exact = users.astype(float) @ items.T.astype(float)
    for u, hits in by_user.items():
        rows = np.lexsort((np.arange(900), -np.round(exact[u], 10)))[:7]
        assert [d for d, _ in hits] == rows.tolist()
        assert np.allclose([s for _, s in hits], exact[u][rows], rtol=1e-12)
    assert search.factor_top_k(frame(users), frame(items).where("id < 3"), 7).count() == 180
    assert search.factor_top_k(frame(users), frame(items).where("false"), 7).count() == 0


def test_index_adds_up_rows_of_one_document_and_search_blocks_lose_nothing(spark, tmp_path, monkeypatch):
    words = lambda i: " ".join(f"w{(i * k) % 7}" for k in range(1, 5))
    rows = [(i, words(i).upper() if i % 3 else words(i)) for i in range(60)] + [(5, "extra w1"), (5, "extra"), (None, "lost words"), (70, "")]
    docs = spark.createDataFrame(rows, "id long, body string").repartition(3)
    asked = spark.createDataFrame([(q, f"w{q % 7} W{(q + 2) % 7} extra none") for q in range(9)], "q int, t string")
    search_index.build_index(docs, str(tmp_path / "index"), "id", F.col("body"), "s", buckets=4)
    index = search_index.open_index(spark, str(tmp_path / "index"), "s")
    assert index.n == 64 and index.total == 60 * 4 + 3 + 2
    held = {(r.doc, r.term): (r.tf, r.length) for r in index.postings.collect()}
    assert held[5, "extra"] == (2, 7) and held[5, "w1"][1] == 7 and len(held) == index.postings.count()
    monkeypatch.setattr(search_index, "POSTINGS", 16)
    monkeypatch.setattr(search_index, "ASKED", 8)
    got = {(r.query, r["rank"]): (r.doc, r.score) for r in index.bm25(asked, "q", "t", 4).collect()}
    idf = {r.term: r.idf for r in index.terms.collect()}
    for q in range(9):
        score = {}
        for (doc, term), (tf, length) in held.items():
            if term in {f"w{q % 7}", f"w{(q + 2) % 7}", "extra"}:
                score[doc] = score.get(doc, 0) + idf[term] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (245 / 64)))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]
        assert [got[q, r][0] for r in range(1, 5)] == [d for d, _ in best] and [got[q, r][1] for r in range(1, 5)] == pytest.approx([s for _, s in best], abs=1e-8)


def test_search_shuffles_no_pair_of_a_query_and_a_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common words") for i in range(50)], "id long, body string")
    search_index.build_index(docs, str(tmp_path / "index"), "id", F.col("body"), "s", buckets=4)
    asked = spark.createDataFrame([(q, "common words") for q in range(5)], "q int, t string")
    hits = search_index.open_index(spark, str(tmp_path / "index"), "s").bm25(asked, "q", "t", 2)
    assert "FlatMapCoGroupsInArrow" in hits._jdf.queryExecution().toString() and "sum(w" not in hits._jdf.queryExecution().toString()
    assert sorted((r.query, r.doc) for r in hits.collect()) == [(q, d) for q in range(5) for d in range(2)]


def test_past_shares_count_earlier_clicks_of_the_user_only(spark):
    rows = [(k, (k * 5) % 3 or None, (k * 7) % 5 if k % 11 else None, ("a", "b", None)[(k * 3) % 7 % 3], int(k % 4 < 2)) for k in range(90)]
    shown = spark.createDataFrame(rows, "k long, user_id long, event_ts long, category string, clicked int")
    got = {r.k: r for r in feed.with_past_shares(shown).collect()}
    for k, user, time, category, _ in rows:
        past = [c for _, u, s, c, clicked in rows if clicked and None not in (u, s, user, time) and u == user and s < time]
        assert (got[k].history_length, got[k].topics) == (len(past), len(set(past)))
        assert got[k].weight == pytest.approx(past.count(category) / len(past) if past and category else 0)


def test_category_arm_deals_a_bounded_number_of_impressions(spark, monkeypatch):
    from presswork.plans import bindings, registry

    monkeypatch.setattr(bindings, "IMPRESSIONS_EACH", 100, raising=False)
    t = bindings.Tables(spark, "/root/testdata/sf0.001")
    plan = registry.QUERIES["a24_category_arm"](spark, t.folder)._jdf.queryExecution().toString()
    n = -(-t.lineitem.count() // 100)
    assert re.search(rf"hashpartitioning\(user_id#\d+L?, {n}\)", plan) and "LeftOuter" not in plan


def test_profiles_of_many_keys_take_few_calls(spark, tmp_path, monkeypatch):
    """Python was called for each key of each batch; keys, late events, nulls and events without a time fold as one by one."""
    monkeypatch.setattr(ev, "BUCKETS", 3)
    kinds = ("upvote", "downvote", "recommendation_click", "share")
    data = [(u % 50 if u % 41 else None, u % 4 if u % 37 else None, u, 10_000 + 97 * (u * 7919 % 2000) if u % 43 else None, kinds[u % 3 if u % 5 else 3]) for u in range(2_000)]
    rows = spark.createDataFrame([(*r, None) for r in data], "user_id long, topic_id int, event_id long, event_ts long, event_type string, dwell_ms long")
    for k, part in enumerate((rows.where("event_id < 1000"), rows.where("event_id >= 1000"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    made = ev.profile_state(stream)
    assert "bucket" in made._jdf.queryExecution().analyzed().toString()
    got = ev.latest(ev.run_to_end(made, str(tmp_path / "out"), "update"), ["user_id", "topic_id"]).collect()
    state, since = {}, {}
    order = [[r for r in data if r[2] < 1000], [r for r in data if r[2] >= 1000]]
    if spark.read.parquet(str(tmp_path / "out" / "rows" / "batch_id=0")).agg(F.sum(F.col("positive_evidence") + F.col("negative_evidence"))).first()[0] != sum(r[4] != "share" for r in order[0]):
        order.reverse()  # the files were taken in the other order
    for batch in order:
        since = {k: max((t for _, t in s if t is not None), default=None) for k, s in state.items()}
        for user, topic, _, ts, kind in batch:
            strength = {"upvote": 2.0, "downvote": -2.0, "recommendation_click": 1.0, "share": 0.0}[kind]
            last = since.get((user, topic))
            if strength and (ts is None or last is None or ts >= last):
                state.setdefault((user, topic), []).append((strength, ts))
    assert len(got) == len(state) > 100 and any(None in k for k in state)
    for r in got:
        signals = state[r.user_id, r.topic_id]
        newest = max((t for _, t in signals if t is not None), default=None)
        assert (r.positive_evidence, r.negative_evidence, r.last_event_ts) == (sum(d > 0 for d, _ in signals), sum(d < 0 for d, _ in signals), newest)
        if newest is None:
            assert r.short_positive is None
            continue
        part = lambda sign, h: sum(max(sign * d, 0) * 2.0 ** ((t - newest) / h) for d, t in signals if t is not None)  # noqa: B023, E731
        assert (r.short_positive, r.short_negative) == (pytest.approx(part(1, 21_600)), pytest.approx(part(-1, 21_600)))
        assert (r.long_positive, r.long_negative) == (pytest.approx(0.25 * part(1, 2_592_000)), pytest.approx(0.25 * part(-1, 2_592_000)))


def test_factor_top_k_shuffles_no_copy_of_a_block(spark):
    """Blocks were copied for each block they met, and each meeting's candidates were shuffled; both grew with users times items."""
    rng = np.random.default_rng(5)
    users, items = rng.integers(-2, 3, (130, 4)).astype(float), rng.integers(-2, 3, (170, 4)).astype(float)  # many ties, over blocks too
    frame = lambda x, kind: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"id {kind}, features array<float>")
    got = search.factor_top_k(frame(users, "int"), frame(items, "long"), 6, block=40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert [t for _, t in got.dtypes] == ["int", "int", "bigint", "double"]
    want = {(u, n, d, float(users[u] @ items[d])) for u in range(130) for n, d in enumerate(np.lexsort((np.arange(170), -(items @ users[u])))[:6].tolist(), 1)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 780
