"""Scalar functions of ranking, texts and times over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import scores, text
from presswork.plans.bindings import with_views
from presswork.plans.registry import query

NOW = 1_706_659_200


@query("f8_embedding_text", "SELECT p_partkey, md5(concat_ws(chr(10), 'title: ' || p_name, CASE WHEN p_partkey % 3 <> 0 THEN 'abstract: ' || p_brand END, 'category: ' || p_type)) AS digest FROM part")
def f8(t):
    """Labelled lines; a blank abstract leaves none."""
    out = text.embedding_text(title=F.col("p_name"), abstract=F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("  "), "p_brand")), category=F.col("p_type"))
    return t.part.select("p_partkey", F.md5(out).alias("digest"))


@query("f9_topic_jaccard", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM (SELECT p_partkey, [p_size % 5, p_partkey % 5] AS a, [p_size % 3, p_partkey % 4] AS b FROM part)")
def f9(t):
    """An empty union gives 0."""
    some = F.col("p_partkey") % 7 != 0
    a, b = (F.when(some, F.array((F.col("p_size") % x).cast("long"), (F.col("p_partkey") % y).cast("long"))).otherwise(F.array().cast("array<long>")) for x, y in ((5, 5), (3, 4)))
    return t.part.select("p_partkey", F.round(text.jaccard(a, b), 6).alias("similarity"))


@query("f10_hybrid_similarity", "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN greatest(0.0, least(1.0, (p_partkey % 40 - 10) / 20.0)) ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS similarity FROM (SELECT p_partkey, [p_size % 5, p_partkey % 5] AS a, [p_size % 3, p_partkey % 4] AS b FROM part)")
def f10(t):
    """Factor cosine where there is a finite one, else the topics."""
    key = F.col("p_partkey")
    cosine = F.when(key % 3 == 0, (key % 40 - 10) / 20.0).when(key % 3 == 1, F.lit(float("nan")))
    a, b = (F.array((F.col("p_size") % x).cast("long"), (key % y).cast("long")) for x, y in ((5, 5), (3, 4)))
    return t.part.select("p_partkey", F.round(text.hybrid_similarity(cosine, a, b), 6).alias("similarity"))


@query("f12_decayed_score", with_views("user_events") + f"SELECT event_id, round(pow(2.0, -greatest({NOW} - 86400 - event_ts, 0) / 21600.0), 9) AS score FROM user_events")
def f12(t):
    """Nothing grows for an event that lies ahead."""
    return t.user_events.select("event_id", F.round(scores.decayed(F.lit(1.0), F.lit(NOW - 86_400) - F.col("event_ts"), 21_600), 9).alias("score"))


@query("f13_dwell_strength", "SELECT event_id, CASE WHEN value * 1000 >= 120000 THEN 0.75 WHEN value * 1000 >= 30000 THEN 0.5 WHEN value * 1000 >= 10000 THEN 0.25 ELSE 0.0 END::DOUBLE AS strength FROM events")
def f13(t):
    return t.events.select("event_id", scores.dwell_strength(F.col("value") * 1000).alias("strength"))


@query("f17_combined_interest", "SELECT l_orderkey, l_linenumber, round(0.7 * tanh(l_discount * 10 - 0.5) + 0.3 * tanh(l_tax * 20 - 1), 6) AS interest FROM lineitem")
def f17(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(scores.combined_interest(F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 20 - 1), 6).alias("interest"))


@query("f24_freshness", "SELECT o_orderkey, round(exp(-ln(2.0) * greatest(883612800 - epoch_us(o_orderdate) // 1000000, 0) / 86400.0 / 500), 9) AS fresh FROM orders")
def f24(t):
    age = F.lit(883_612_800) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", F.round(scores.freshness(F.greatest(age, F.lit(0)) / 500), 9).alias("fresh"))


@query("f25_completeness", "SELECT p_partkey, round(0.5 * (p_partkey % 2 = 0)::INT + 0.3 * (p_partkey % 3 = 0)::INT + 0.2 * (p_partkey % 5 <> 0)::INT, 6)::DOUBLE AS complete FROM part")
def f25(t):
    key = F.col("p_partkey")
    publisher = F.when(key % 5 == 0, "a.org").otherwise("A")
    complete = scores.completeness(F.when(key % 2 == 0, F.col("p_name")).otherwise(" "), F.when(key % 3 == 0, F.lit("i.png")), publisher, F.lit("a.org"))
    return t.part.select("p_partkey", F.round(complete, 6).alias("complete"))


@query("f27_live_search_score", "SELECT p_partkey, round(0.8 * CASE WHEN lower(p_name) = 'small ring' THEN 1.0 WHEN contains(lower(p_name), 'small ring') THEN 0.7 WHEN contains(lower(p_brand), 'small ring') THEN 0.5 WHEN contains(lower(p_type || ' small ring'), 'small ring') AND p_partkey % 2 = 0 THEN 0.4 END + 0.2 * (p_partkey % 10) / 10.0, 8)::DOUBLE AS score FROM part")
def f27(t):
    key = F.col("p_partkey")
    publisher = F.when(key % 2 == 0, F.concat("p_type", F.lit(" Small ring")))
    return t.part.select("p_partkey", scores.live_search_score(F.col("p_name"), F.col("p_brand"), publisher, F.lit("Small Ring"), (key % 10) / 10.0).alias("score"))


@query("f31_plain_title", "SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def f31(t):
    """Letters and digits of each text, in lower case."""
    return t.documents.where("text is not null").select("doc_id", F.md5(text.plain_title(F.col("text"))).alias("digest"))


@query("f33_parse_time", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (epoch_us(o_orderdate) // 1000000) - CASE WHEN o_orderkey % 5 = 1 THEN 7200 ELSE 0 END END::BIGINT AS ts FROM orders")
def f33(t):
    """With Z, with an offset, without a zone, and no time at all."""
    plain = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("o_orderkey") % 5
    value = F.when(kind == 0, F.lit("not a time")).when(kind == 1, F.concat(plain, F.lit("+02:00"))).when(kind == 2, F.concat(plain, F.lit("Z"))).otherwise(plain)
    return t.orders.select("o_orderkey", text.moment(value).alias("ts"))


@query("f35_entities", "SELECT p_partkey, (CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 2 + (p_partkey % 3 = 0)::INT END)::INT AS n, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || '|person|0.5;' || p_brand || '|other|' || CASE WHEN p_partkey % 3 = 0 THEN ';Else|location|' ELSE '' END END AS entities FROM part")
def f35(t):
    """Typed entities of a JSON array: repeated ids, bad confidences and missing labels; a text that is no JSON has none."""
    key = F.col("p_partkey")
    raw = F.concat(
        F.lit('[{"Label":"'), "p_name", F.lit('","Type":"p","WikidataId":"Q1","Confidence":0.5},{"Label":"again","WikidataId":"q1"},{"Label":"'), "p_brand", F.lit('","Type":"X","Confidence":7},{"Type":"P"}'),
        F.when(key % 3 == 0, F.lit(',{"Label":"Else","Type":"G","Confidence":"no"},{"Label":"ELSE"}')).otherwise(""), F.lit("]"),
    )
    got = text.entities(F.when(key % 4 == 0, F.lit("{broken")).otherwise(raw))
    each = F.transform(got, lambda e: F.concat_ws("|", e["label"], e["kind"], F.coalesce(e["confidence"].cast("string"), F.lit(""))))
    return t.part.select("p_partkey", F.size(got).alias("n"), F.array_join(each, ";").alias("entities"))


@query("f36_key_numbers", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey + p_size END::BIGINT AS total FROM part")
def f36(t):
    """Whole numbers of a query key, none if a word is no number."""
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_partkey", F.lit(" x"))).otherwise(F.concat(F.lit(" "), "p_partkey", F.lit(" \t "), "p_size"))
    return t.part.select("p_partkey", F.aggregate(text.whole_numbers(raw), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("f37_body_text")
def f37(t):
    """Length and digest of each text as a body: one line a paragraph."""
    body = text.body_text(F.col("text"))
    return t.documents.select("doc_id", F.length(body).alias("n_chars"), F.md5(body).alias("digest"))


@query("f40_folded", "SELECT doc_id, md5(trim(replace(lower(text), 'ß', 'ss'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))) AS digest FROM documents WHERE text IS NOT NULL")
def f40(t):
    """All texts, folded; those beyond ASCII agree with lower case as far as these tables go, and with Python in the tests."""
    return t.documents.where("text is not null").select("doc_id", F.md5(text.folded(F.col("text"))).alias("digest"))


@query("f41_sponsored_score", "SELECT s_suppkey, round((40 + s_suppkey % 60) * (0.01 + (s_suppkey % 7) / 100.0) * (0.5 + (s_suppkey % 3) / 4.0), 6)::DOUBLE AS score, greatest(1, round_even((40 + s_suppkey % 60) * (0.01 + (s_suppkey % 7) / 100.0), 0))::BIGINT AS spend FROM supplier")
def f41(t):
    key = F.col("s_suppkey")
    bid, ctr = 40 + key % 60, 0.01 + key % 7 / 100.0
    return t.supplier.select("s_suppkey", F.round(scores.sponsored_score(bid, ctr, 0.5 + key % 3 / 4.0), 6).alias("score"), scores.expected_spend(bid, ctr).alias("spend"))


@query("f44_content_retry", "SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN least((o_orderkey % 9000)::DOUBLE, 3600.0) END, least(1800.0, 30.0 * pow(2.0, o_orderkey % 9)) * (1 + 0.2 * (o_orderkey % 11) / 10.0)), 6)::DOUBLE AS wait FROM orders")
def f44(t):
    key = F.col("o_orderkey")
    wait = scores.content_retry(key % 9 + 1, key % 11 / 10.0, F.when(key % 4 == 0, key % 9000))
    return t.orders.select("o_orderkey", F.round(wait, 6).alias("wait"))


@query("p21_page_gates", "SELECT page_id, regexp_matches(lower(html), 'subscribe|paywall|track') AS gated, regexp_extract(html, '<title>([^<]*)</title>', 1) = regexp_extract(html, '<h1>([^<]*)</h1>', 1) AND regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS same_title FROM pages")
def p21(t):
    """Whether a page shows a paywall's marks, and whether its title is its heading."""
    title, heading = (F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1) for tag in ("title", "h1"))
    return t.pages.select("page_id", F.lower("html").rlike("subscribe|paywall|track").alias("gated"), ((title == heading) & (title != "")).alias("same_title"))
