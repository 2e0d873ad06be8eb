"""Operators and functions of the inventory against plain Python and on awkward values."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from presswork.functions import media, scores, text
from presswork.operators import feed, ordered, profile, resolve
from presswork.sources import batches, impressions

AWKWARD = [None, "", "  ", "Ｆｕｌｌ  width\tA", "a\r\nb\r\n\r\n \r\nc\x00d\x7f", "Straße ﬁ", "x\n\n\n\ny", " z", "é" * 5000]


def values(spark, kind, rows, column):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}").select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_folded_and_body_text_equal_python(spark):
    assert values(spark, "string", AWKWARD, text.folded) == [v and unicodedata.normalize("NFKC", v).casefold().strip() for v in AWKWARD]
    got = values(spark, "string", AWKWARD, text.body_text)
    assert got[:4] == [None, "", "", "Full width A"] and got[4] == "a b\n\ncd" and got[6] == "x\n\ny" and got[8] == "é" * 5000


def test_entities_of_awkward_json(spark):
    raw = [None, "", "[]", "{}", "[1, null]", '[{"Label": " a ", "Type": "o", "Confidence": "0.25"}, {"Label": "A"}, {"Label": "b", "WikidataId": "Q1", "Confidence": -1}, {"Label": "c", "WikidataId": "q1"}]']
    got = [[tuple(e) for e in v] for v in values(spark, "string", raw, text.entities)]
    assert got[:5] == [[]] * 5 and got[5] == [("a", "organization", None, 0.25), ("b", "other", "Q1", None)]


def test_moment_and_whole_numbers(spark):
    assert values(spark, "string", ["1970-01-01T00:01:00Z", "1970-01-01T00:01:00", "1970-01-01T02:00:00+02:00", "soon", None], text.moment) == [60, 60, 0, None, None]
    assert values(spark, "string", [" 1  22 ", "1 x", ""], text.whole_numbers) == [[1, 22], [], []]


def test_hybrid_similarity_and_scores(spark):
    rows = spark.createDataFrame([(0, 2.0), (1, -0.5), (2, float("nan")), (3, float("inf")), (4, None)], "i int, c double").withColumn("a", F.array(F.lit(1), F.lit(2))).withColumn("b", F.array(F.lit(2), F.lit(3)))
    assert [round(r.x, 6) for r in rows.select("i", text.hybrid_similarity(F.col("c"), F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [1.0, 0.0, 0.333333, 0.333333, 0.333333]
    waits = spark.createDataFrame([(1, 0.0, None), (9, 1.0, None), (3, 0.5, 99999)], "n int, j double, r int").select(scores.content_retry(F.col("n"), F.col("j"), F.col("r")).alias("x")).collect()
    assert [r.x for r in waits] == [30.0, 2160.0, 3600.0]


def test_newest_item_wherever_it_stands(spark):
    item = "<item><pubDate>{}</pubDate></item>"
    feed_ = "<rss><channel>" + item.format("Mon, 01 Jan 2024 10:00:00 GMT") + item.format("Tue, 02 Jan 2024 10:00:00 +0100") + item.format("never") + "</channel></rss>"
    got = values(spark, "string", [feed_, "<rss><channel></channel></rss>"], lambda v: F.unix_timestamp(batches.latest_batch_time(v)))
    assert got == [1704186000, None]


def test_effects_of_events(spark):
    rows = [(1, "recommendation_click", [3, 4], [9]), (2, "search_result_click", [3, 4], [4, 5]), (3, "search_query", None, None), (4, "dwell", [3], None), (5, "upvote", None, None)]
    events = spark.createDataFrame([(7, *r) for r in rows], "user_id int, event_id int, event_type string, article_topics array<int>, query_topics array<int>")
    effects = profile.event_effects(events)
    assert sorted((r.event_id, r.topic_id, r.delta) for r in effects.where("topic_id is not null").collect()) == [(1, 3, 0.08), (1, 4, 0.08), (2, 3, 0.12), (2, 4, 0.2), (2, 5, 0.12)]
    weights, points = profile.apply_effects(effects)
    assert points.collect()[0].behaviour == 3 + 5 + 1 + 3 and {r.topic_id: round(r.weight, 6) for r in weights.collect()} == {3: 0.2, 4: 0.28, 5: 0.12}


def test_reset_gives_the_seed(spark):
    state = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "user_id int, topic_id int, weight double")
    resets = spark.createDataFrame([(2, "s"), (3, "s")], "user_id int, seed_key string")
    seeds = spark.createDataFrame([("s", 8, 0.1)], "seed_key string, topic_id int, weight double")
    assert sorted(map(tuple, profile.reset(state, resets, seeds).collect())) == [(1, 1, 0.5), (2, 8, 0.1), (3, 8, 0.1)]


def test_each_stage_of_the_search_cascade(spark):
    asks = spark.createDataFrame(list(enumerate([" 4  5 ", "World CUP", "world", "sport", "spor", "the goal keeper", "zz", None, ""])), "ask int, asked string")
    query_map = spark.createDataFrame([(1, "10", 1, 0.5, "world cup"), (2, "11", 1, 0.9, "world cup final"), (3, "12", 2, 0.4, "cooking")], "row int, query_key string, topic_id int, score double, display_query string")
    topics = spark.createDataFrame([(1, "Sport", 5), (2, "Sports drinks", 9), (3, "Empty", 1)], "topic_id int, display_name string, news_count int")
    articles = spark.createDataFrame([(1, "A goal", None), (2, None, "soup")], "article_id int, title string, abstract string")
    bridge = spark.createDataFrame([(1, 1), (2, 2)], "article_id int, topic_id int")
    got = {r.ask: (r.query_key, r.source) for r in resolve.resolve(asks, query_map, topics, articles, bridge).collect()}
    assert got == {
        0: ("4 5", "numeric_query_key"), 1: ("10", "lexical_v1"), 2: ("10", "lexical_v1"), 3: ("11", "lexical_v1"), 4: ("11", "lexical_v1"), 5: ("11", "lexical_v1"),
        6: (None, "unresolved"), 7: (None, "unresolved"), 8: (None, "unresolved"),
    }


def test_running_sums_over_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.random() if i else 0.5, rng.randrange(5)) for i in range(700)]
    table = spark.createDataFrame(rows, "x double, n int")
    for down in (False, True):
        got = {r.x: r.before_n for r in ordered.running_before(table, "x", ["n"], descending=down, buckets=16).collect()}
        assert got == {x: sum(n for y, n in rows if (y > x if down else y < x)) for x, _ in rows}
    assert ordered.running_before(table.where("false"), "x", ["n"]).count() == 0


def by_hand(items, limit, penalty):
    chosen = []
    while items and len(chosen) < limit:
        near = lambda i: max((len(i[2] & c[2]) / len(i[2] | c[2]) if i[2] | c[2] else 0.0 for c in chosen), default=0.0)
        best = min(items, key=lambda i: (-(i[1] - penalty * near(i)), -i[1], i[0]))
        items = [i for i in items if i is not best]
        chosen.append(best)
    return [c[0] for c in chosen]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_reranking_equals_plain_python(spark, batch):
    rng = random.Random(5)
    rows = [(q, i, rng.randrange(8) / 8, [rng.randrange(4) for _ in range(rng.randrange(4))]) for q in range(40) for i in range(rng.randrange(1, 14))]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = feed.rerank_mmr(spark.createDataFrame(rows, "request_id int, article_id int, relevance double, topics array<int>"), 5, 0.3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for q in range(40):
        want = by_hand([(i, r, set(t)) for k, i, r, t in rows if k == q], 5, 0.3)
        assert [r.article_id for r in sorted((r for r in got if r.request_id == q), key=lambda r: r["rank"])] == want


def test_id_map_numbers_each_key_once(spark):
    rows = spark.createDataFrame([(f"k{i % 300:03d}" if i % 7 else None,) for i in range(2000)], "k string").repartition(9)
    got = sorted((r.k, r.number) for r in impressions.id_map(rows, "k").collect())
    assert [n for _, n in got] == list(range(1, len(got) + 1)) and len(got) == len({k for k, _ in got}) == 300


def test_media_addresses_and_charsets(spark):
    base = F.lit("https://a.pub.com/x/page.html")
    urls = [None, "", " ", "p.png", "/q.png", "//cdn.pub.com/r", "http://pub.com:81/s", "https://u@pub.com/", "ftp://pub.com/", "https://notpub.com/", "https://pub.com./t"]
    assert values(spark, "string", urls, lambda v: media.media_url(v, base, ("pub.com",))) == [None, None, None, "https://a.pub.com/x/p.png", "https://a.pub.com/q.png", "https://cdn.pub.com/r", "https://pub.com/s", None, None, None, "https://pub.com./t"]
    bodies = ["中文".encode("gb18030"), '<meta charset="gbk">中'.encode("gbk"), "é".encode(), b"\xff\xff\xff", None]
    assert values(spark, "binary", bodies, lambda v: media.page_text(v, F.lit("text/html; charset=UTF-8"))) == ["中文", '<meta charset="gbk">中', "é", None, None]
