"""Live-news queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import scores, text
from presswork.operators import live, pages
from presswork.plans.registry import query

#: Documents as live articles: found a minute apart, published before; the first line is the title.
LIVE = "lv AS (SELECT doc_id AS article_id, string_split(coalesce(text, ''), chr(10))[1] AS title, source AS publisher, lang AS language, doc_id * 60 AS discovered_at, doc_id * 60 - doc_id % 97 * 3000 AS published_at, text FROM documents)"


def live_articles(t):
    return t.documents.select(
        F.col("doc_id").alias("article_id"), F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"), F.col("source").alias("publisher"), F.col("lang").alias("language"),
        (F.col("doc_id") * 60).alias("discovered_at"), (F.col("doc_id") * 60 - F.col("doc_id") % 97 * 3000).alias("published_at"), "text",
    )


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"


@query("p13_record_classify", f"""WITH r AS (SELECT page_id, url, {HOST} AS host, CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 17 = 0 THEN 'Page expired' ELSE 'Title ' || page_id END AS title,
 CASE WHEN page_id % 5 = 0 THEN 'de' ELSE 'en' END AS lang, (page_id % 40) * 7200 - 3600 AS age FROM pages)
SELECT page_id, CASE WHEN NOT regexp_matches(url, '(?i)^https?://[^/?#]+') THEN 'invalid_metadata' WHEN ('.' || host) NOT LIKE '%.example.com' AND ('.' || host) NOT LIKE '%.example.org' THEN 'domain_not_allowed'
 WHEN lang <> 'en' THEN 'unsupported_language' WHEN title = '' THEN 'missing_title' WHEN title = 'Page expired' OR len(list_intersect(string_split(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/'), ['tag', 'tags', 'topic', 'topics', 'category', 'categories', 'series'])) > 0 THEN 'invalid_page'
 WHEN age > 259200 OR age < -1800 THEN 'stale_article' END AS reason FROM r""")
def p13(t):
    host = F.concat(F.lit("."), F.lower(F.try_parse_url("url", F.lit("HOST"))))
    allowed = F.when(F.endswith(host, F.lit(".example.com")) | F.endswith(host, F.lit(".example.org")), F.array(F.lit("en")))
    title = F.when(F.col("page_id") % 13 == 0, "").when(F.col("page_id") % 17 == 0, "Page expired").otherwise(F.concat(F.lit("Title "), "page_id"))
    language = F.when(F.col("page_id") % 5 == 0, "de").otherwise("en")
    age = F.col("page_id") % 40 * 7200 - 3600
    return t.pages.select("page_id", live.rejection_reason(F.col("url"), host, allowed, language, title, age).alias("reason"))


SCORE = "round(0.65 * exp(-ln(2.0) * greatest(60 * 1000 - published_at, 0) / 86400.0) + 0.20 * (length(publisher) % 3) / 2.0 + 0.15 * (0.5 * (trim(coalesce(text, '')) <> '')::INT + 0.2 * (publisher IS DISTINCT FROM 'src0')::INT), 8)"


def _score():
    fresh = scores.freshness(F.lit(60_000) - F.col("published_at"))
    complete = scores.completeness(F.col("text"), F.lit(None).cast("string"), F.col("publisher"), F.lit("src0"))
    return F.round(scores.live_score(fresh, F.length("publisher") % 3 / 2.0, complete), 8)


@query("f26_live_score", f"WITH {LIVE} SELECT article_id, round({SCORE}, 6) AS score FROM lv")
def f26(t):
    return live_articles(t).select("article_id", F.round(_score(), 6).alias("score"))


@query("c18_live_feed_scored", f"WITH {LIVE}, s AS (SELECT article_id, language, {SCORE} AS score, discovered_at FROM lv WHERE discovered_at >= 60 * 100) SELECT language, article_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY score DESC, discovered_at DESC, article_id) AS rank FROM s) WHERE rank <= 30")
def c18(t):
    from presswork.operators.ordered import top_per_group

    rows = live_articles(t).where("discovered_at >= 6000").select("article_id", "language", _score().alias("score"), "discovered_at")
    return top_per_group(rows, ["language"], [F.col("score").desc(), F.col("discovered_at").desc(), "article_id"], 30).select("language", "article_id", "rank")


@query("l12_diversify")
def l12(t):
    rows = live_articles(t).withColumn("request_id", F.floor(F.col("article_id") / 100)).withColumn("score", _score())
    return live.diversify(rows.select("request_id", "article_id", "score", "discovered_at", "publisher", "language", "title"), 20)


PLAIN = "regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g')"


@query("f32_trigrams", f"WITH {LIVE}, n AS (SELECT article_id, {PLAIN} AS x FROM lv) SELECT article_id, len(list_distinct(list_transform(range(1, greatest(length(x) - 2, 1) + 1), lambda i: substr(x, i, 3))))::INT AS n_grams FROM n")
def f32(t):
    return live_articles(t).select("article_id", F.size(text.trigrams(text.plain_title(F.col("title")))).alias("n_grams"))


@query("j14_near_title_pairs", f"WITH {LIVE}, n AS (SELECT article_id, discovered_at, {PLAIN} AS x FROM lv), g AS (SELECT article_id, discovered_at, list_distinct(list_transform(range(1, greatest(length(x) - 2, 1) + 1), lambda i: substr(x, i, 3))) AS g FROM n WHERE x <> ''), "
    "i AS (SELECT a.article_id AS a, b.article_id AS b, len(list_intersect(a.g, b.g))::DOUBLE AS k, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.article_id < b.article_id AND abs(a.discovered_at - b.discovered_at) <= 86400 AND len(a.g) >= 0.92 * len(b.g) AND len(b.g) >= 0.92 * len(a.g)) SELECT a, b, round(k / (s - k), 6) AS similarity FROM i WHERE k / (s - k) >= 0.92")
def j14(t):
    """Every pair of articles within a day whose titles are near duplicates, copies included."""
    rows = live_articles(t).select(F.col("article_id").alias("id"), "title", "discovered_at")
    return live.all_near_title_pairs(rows).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("f30_content_hash", r"SELECT doc_id, sha256(coalesce(source, '') || chr(10) || trim(regexp_replace(coalesce(text, ''), '[\s\v]+', ' ', 'g'))) AS hash FROM documents")
def f30(t):
    """Source as the title and the whole text, which are in normal form already."""
    return t.documents.select("doc_id", text.content_hash_ascii(F.col("source"), F.col("text")).alias("hash"))


@query("f30_content_hash_nfkc")
def f30b(t):
    return live_articles(t).select("article_id", text.content_hash(F.col("title"), F.col("text")).alias("hash"))


@query("ts9_minute_gaps", f"WITH {LIVE}, m AS (SELECT DISTINCT published_at // 3600 AS hour FROM lv WHERE published_at >= 0) SELECT h AS hour FROM range(0, 20) r(h) WHERE h NOT IN (SELECT hour FROM m)")
def ts9(t):
    """Hours of a range for which no batch has come."""
    have = live_articles(t).where("published_at >= 0").select(F.floor(F.col("published_at") / 3600).alias("hour")).distinct()
    return t.spark.range(20).select(F.col("id").alias("hour")).join(have, "hour", "left_anti")


@query("ts10_upsert_latest", f"WITH {LIVE} SELECT md5(title) AS title_key, max(article_id)::BIGINT AS article_id, max(discovered_at)::BIGINT AS checkpoint FROM lv GROUP BY 1")
def ts10(t):
    """The latest version of each key wins; the checkpoint only moves forward."""
    rows = live_articles(t).groupBy(F.md5("title").alias("title_key")).agg(F.max_by("article_id", "discovered_at").alias("article_id"), F.max("discovered_at").alias("checkpoint"))
    return rows


@query("c22_topic_classification", "WITH pr AS (SELECT label AS topic_id, list(x ORDER BY i) AS proto FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1), "
    "sc AS (SELECT vec_id AS id, topic_id, 0.9 * list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * proto[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(proto, lambda x: x * x))) AS score FROM embeddings, pr), "
    "rk AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS top FROM sc WINDOW w AS (PARTITION BY id ORDER BY round(score, 9) DESC, topic_id)), ok AS (SELECT id, topic_id, rank, score FROM rk WHERE rank <= 3 AND score >= 0.3 AND top - score <= 0.05) "
    "SELECT id, topic_id::INT AS topic_id, rank::INT AS rank, round(score, 6) AS score FROM ok UNION ALL SELECT vec_id, 1000014, 1, 0.0 FROM embeddings WHERE vec_id NOT IN (SELECT id FROM ok)")
def c22(t):
    """Vectors against the mean vector of each label."""
    n = F.lit(64)
    mean = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy(F.col("label").alias("topic_id")).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("proto")).where(F.size("proto") == n)
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.lit(None).cast("map<int,double>").alias("keyword"))
    return live.classify_topics(vectors, mean, threshold=0.3, margin=0.05).select("id", "topic_id", "rank", F.round("score", 6).alias("score"))


@query("c25_html_blocks")
def c25(t):
    blocks = t.pages.select("page_id", F.posexplode(live.html_blocks("html")).alias("position", "b"))
    return blocks.select("page_id", "position", "b.type", "b.text", "b.url", "b.block_id")


@query("c27_prose_length")
def c27(t):
    parts = F.filter(F.col("blocks"), lambda b: b["type"].isin("paragraph", "heading", "quote"))
    rows = t.pages.select("page_id", live.html_blocks("html").alias("blocks"))
    prose = F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n")
    return rows.select("page_id", F.size("blocks").alias("n_blocks"), F.length(prose).alias("n_chars"), F.sha2(prose, 256).alias("prose_sha256"))


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_DECODED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_PLAIN_PAGE = "{}"
for _name, _character in pages.ENTITIES:
    _PLAIN_PAGE = f"replace({_PLAIN_PAGE}, '{_name}', '{_character.replace(chr(39), chr(39) * 2)}')"
_EDGE = f"kind IN ('open', 'close') AND tag IN {_listed((*pages.TYPES, *pages.STRUCTURE))}"
_QUOTED = lambda pattern: pattern.replace("'", "''")
BLOCK_SQL = (
    f"tk AS (SELECT page_id, pos, raw, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM (SELECT page_id, unnest(ts) AS raw, unnest(range(0, len(ts))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{pages.TOKEN}') AS ts FROM pages WHERE html IS NOT NULL)))",
    f"nd AS (SELECT *, CASE WHEN NOT starts_with(raw, '<') THEN 'text' WHEN tag IN ('', 'script', 'style', 'noscript') THEN 'skip' WHEN starts_with(raw, '</') THEN 'close' WHEN tag IN {_listed(pages.VOID)} OR ends_with(raw, '/>') THEN 'void' ELSE 'open' END AS kind FROM tk)",
    f"lv AS (SELECT *, sum(CASE WHEN kind = 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) + (kind = 'close')::INT AS level FROM nd WHERE kind IN ('open', 'close') AND tag IN {_listed(pages.STRUCTURE)})",
    "el AS (SELECT page_id, tag, raw, kind, pos AS o, coalesce(lead(pos) OVER (PARTITION BY page_id, tag, level ORDER BY pos), 1073741824) AS c FROM lv)",
    f"co AS (SELECT page_id, o AS first, c AS last FROM el WHERE kind = 'open' AND (tag IN ('article', 'main') OR regexp_matches(raw, '{_QUOTED(pages.CONTAINER_CLASS)}')) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN regexp_matches(raw, '{_QUOTED(pages.CONTAINER_CLASS)}') THEN 0 WHEN tag = 'article' THEN 1 ELSE 2 END, o - c, o) = 1)",
    f"no AS (SELECT page_id, o, c FROM el WHERE kind = 'open' AND (tag IN {_listed(pages.NOISE)} OR regexp_matches(raw, '{_QUOTED(pages.NOISE_CLASS)}')))",
    f"sg AS (SELECT *, sum(({_EDGE})::INT) OVER w AS segment, last_value(CASE WHEN {_EDGE} THEN CASE WHEN kind = 'open' THEN tag ELSE '' END END IGNORE NULLS) OVER w AS inside FROM nd WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    f"wd AS (SELECT page_id, segment, min(pos) AS pos, any_value(inside) AS inside, {_DECODED.format(_PLAIN_PAGE.format('string_agg(CASE WHEN tag = $$br$$ THEN $$ $$ ELSE raw END, $$$$ ORDER BY pos)'))} AS text FROM sg s LEFT JOIN co USING (page_id) WHERE (kind = 'text' OR tag = 'br' AND kind <> 'close') AND inside IN {_listed(pages.TYPES)} AND (first IS NULL OR pos > first AND pos < last) AND NOT EXISTS (SELECT 1 FROM no WHERE no.page_id = s.page_id AND s.pos > no.o AND s.pos < no.c) GROUP BY page_id, segment)",
    "bl AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS position, CASE inside " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pages.TYPES.items()) + " END AS type, text FROM wd WHERE text <> '')",
)


@query("c26_site_blocks", "WITH " + ", ".join(BLOCK_SQL) + " SELECT page_id, position::INT AS position, type, md5(text) AS digest, sha256(page_id || chr(0) || position || chr(0) || type || chr(0) || text || chr(0))[1:16] AS block_id FROM bl")
def c26(t):
    """The blocks of each page's article, by the places of its elements."""
    return pages.blocks(t.pages).select("page_id", "position", "type", F.md5("text").alias("digest"), "block_id")


_BODY = "CASE WHEN {least} > length(body) THEN 'too_short' WHEN length(body) > 200000 THEN 'too_long' WHEN language = 'en' AND (length(regexp_replace(body, '[^A-Za-z]', '', 'g')) < 50 OR length(regexp_replace(body, '[^㐀-鿿]', '', 'g')) > greatest(20, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) // 2)) THEN 'language_mismatch' END"


@query("k50_page_gates", "WITH " + ", ".join((*BLOCK_SQL, "pr AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS body FROM bl WHERE type IN ('heading', 'paragraph', 'quote') GROUP BY page_id)",
    f"hd AS (SELECT page_id, html, regexp_extract(html, '(?i)<html lang=\"([a-z]+)\"', 1) AS language, {PLAIN.replace('title', _PLAIN_PAGE.format('regexp_extract(html, $$(?is)<title[^>]*>(.*?)</title>$$, 1)'))} AS own, regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS hs FROM pages)",
    f"hh AS (SELECT * EXCLUDE (hs), list_transform(hs, lambda h: {PLAIN.replace('title', _PLAIN_PAGE.format('regexp_replace(h, $$<[^>]*>$$, $$$$, $$g$$)'))}) AS heads FROM hd)",
    "gt AS (SELECT page_id, language, body, len(heads) = 1 AND heads[1] = own AND own <> '' AND len(regexp_extract_all(html, '(?i)<article\\b')) = 1 AS exact, CASE WHEN trim(coalesce(html, '')) = '' THEN 'empty_page' WHEN regexp_matches(html, '" + _QUOTED(pages.PAYWALL) + "') THEN 'paywalled' WHEN body IS NULL THEN 'no_content' END AS early FROM hh LEFT JOIN pr USING (page_id))")) +
    f" SELECT coalesce(early, CASE WHEN exact THEN {_BODY.format(least=200)} ELSE {_BODY.format(least=300)} END, 'accepted') AS code, language, count(*)::BIGINT AS n, coalesce(sum(length(body)) FILTER (WHERE early IS NULL), 0)::BIGINT AS n_chars FROM gt GROUP BY 1, 2")
def k50(t):
    """How many pages come through to a body, and which gate stops the others."""
    rows = t.pages.withColumn("language", F.regexp_extract("html", '(?i)<html lang="([a-z]+)"', 1))
    found = pages.accepted_bodies(rows).join(rows.select("page_id", "language"), "page_id")
    whole = pages.blocks(t.pages).where(F.col("type").isin("heading", "paragraph", "quote")).groupBy("page_id").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n_chars"))
    return found.join(whole, "page_id", "left").groupBy(F.coalesce("code", F.lit("accepted")).alias("code"), "language").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~F.coalesce("code", F.lit("")).isin("empty_page", "paywalled"), F.col("n_chars"))), F.lit(0)).alias("n_chars"))
