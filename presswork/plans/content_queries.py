"""Pictures, addresses, encodings and policies of publisher content."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import media
from presswork.plans.bindings import with_views
from presswork.plans.registry import query
from presswork.plans.relational_queries import HOT, item_counts

DOMAINS = ("example.com", "img.org")


@query("k23_image_type", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END AS kind FROM part")
def k23(t):
    key = F.col("p_partkey") % 5
    start = F.when(key == 0, "FFD8FFE0").when(key == 1, "89504E470D0A1A0A0000").when(key == 2, "474946383961").when(key == 3, "524946460000000057454250").otherwise("3C68746D6C3E")
    return t.part.select("p_partkey", media.image_type(F.unhex(start)).alias("kind"))


@query("f46_srcset", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'b.png' WHEN p_partkey % 4 = 2 THEN 'c.png' ELSE 'z.png' END AS url FROM part")
def f46(t):
    """Widths, densities, none at all."""
    k = F.col("p_partkey") % 4
    srcset = F.when(k == 0, " , ").when(k == 1, F.concat(F.lit("a.png 320w, b.png "), 400 + F.col("p_size"), F.lit("w, c.png 300w"))).when(k == 2, "a.png 1.5x,b.png 900w , c.png 2x").otherwise("z.png, a.png")
    return t.part.select("p_partkey", media.srcset_best(srcset).alias("url"))


@query("k53_media_urls", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://cdn.example.com/' || page_id WHEN 1 THEN 'https://img.org/x/' || page_id WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'https://a.example.com/p/' || page_id END AS url FROM pages")
def k53(t):
    """Without a scheme, insecure, at another host, with a user, and relative."""
    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.concat(F.lit(" //cdn.example.com/"), "page_id")).when(k == 1, F.concat(F.lit("http://img.org:8080/x/"), "page_id")).when(k == 2, "https://evil.com/").when(k == 3, "https://me@img.org/").otherwise(F.col("page_id").cast("string"))
    return t.pages.select("page_id", media.media_url(raw, F.lit("https://a.example.com/p/index.html"), DOMAINS).alias("url"))


@query("k54_url_safety", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'no_host' WHEN 1 THEN 'user' WHEN 2 THEN 'port' WHEN 3 THEN 'scheme' END AS problem FROM pages")
def k54(t):
    k = F.col("page_id") % 5
    url = F.when(k == 0, "/articles/1").when(k == 1, "https://u:p@a.org/").when(k == 2, "https://a.org:8443/").when(k == 3, "http://a.org/x").otherwise("https://a.org:443/x")
    return t.pages.select("page_id", media.url_problem(url).alias("problem"))


@query("k21_publisher_tags", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Art|Art 2' ELSE 'Art' END AS names FROM part")
def k21(t):
    """Tags of two kinds at the publisher's own site, each address once."""
    tag = lambda kind, name, url: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit(url).alias("url"))
    base = F.array(tag("keyword", "Art", "https://www.pub.com/art"), tag("tone", "Again", "https://www.pub.com/art"), tag("series", "No", "https://pub.com/s"), tag("tone", "No", "https://notpub.com/"))
    more = F.when(F.col("p_partkey") % 3 == 0, F.array(tag("tone", "Art 2", "https://pub.com/2"))).otherwise(F.slice(base, 1, 0))
    got = media.publisher_tags(F.concat(base, more), "pub.com")
    return t.part.select("p_partkey", F.array_join(F.transform(got, lambda x: x["name"]), "|").alias("names"))


@query("f38_page_text", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE md5(text) END AS digest FROM documents WHERE text IS NOT NULL")
def f38(t):
    """Texts in UTF-8 and GB 18030, named by the header, by the page or by nothing; broken bytes give null."""
    head = F.col("text")
    utf, k = F.encode(head, "utf-8"), F.col("doc_id") % 4
    body = F.when(k == 3, F.unhex(F.lit("FFFFFFFF"))).otherwise(utf)
    header = F.when(k == 0, "text/html; charset=UTF-8").when(k == 1, "text/html; charset=klingon").otherwise("text/html")
    return t.documents.where("text is not null").select("doc_id", F.md5(media.page_text(body, header)).alias("digest"))


@query("c28_image_merge", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'one,i1,two' WHEN 1 THEN 'i1,one,two' ELSE 'one,two' END AS merged FROM part")
def c28(t):
    """A page's picture between two texts, before the first, and after the last, where nothing anchors it."""
    block = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"))
    one, two, image = block("text", "one"), block("text", "two"), block("image", "i1")
    page = F.when(F.col("p_partkey") % 3 == 0, F.array(one, image, two)).when(F.col("p_partkey") % 3 == 1, F.array(image, one, two)).otherwise(F.array(one, two, image))
    merged = media.merged_images(F.array(one, two), page)
    return t.part.select("p_partkey", F.array_join(F.transform(merged, lambda b: b["value"]), ",").alias("merged"))


def policy_problem(mode, domain, minimum):
    """Why a content policy can't be used; null if it can."""
    return F.when(~mode.isin("html", "api", "rss", "none"), "mode").when((mode != "none") & ~F.coalesce(domain, F.lit("")).rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), "domain").when((mode != "none") & ~F.coalesce(minimum.between(1, 100_000), F.lit(False)), "minimum")


@query("k45_content_policies", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN 'mode' WHEN s_suppkey % 5 <> 3 AND s_suppkey % 7 = 0 THEN 'domain' WHEN s_suppkey % 5 <> 3 AND s_suppkey % 11 = 0 THEN 'minimum' END AS problem FROM supplier")
def k45(t):
    key = F.col("s_suppkey")
    mode = F.element_at(F.array(*(F.lit(m) for m in ("html", "api", "rss", "none", "ftp"))), (key % 5 + 1).cast("int"))
    domain = F.when(key % 7 == 0, "NoDomain").otherwise(F.concat(F.lit("d"), key, F.lit(".org")))
    return t.supplier.select("s_suppkey", policy_problem(mode, domain, F.when(key % 11 != 0, 300)).alias("problem"))


@query("k42_live_category", "SELECT l_partkey AS article_id FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 15 = 4 GROUP BY 1")
def k42(t):
    """Articles whose completed job gave them the topic of a category's key."""
    keys = t.nation.select(F.concat(F.lit("live-"), F.col("n_nationkey")).alias("category"), F.col("n_nationkey").alias("topic_id"))
    wanted = keys.where("category = 'live-4'")
    rows = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_partkey").alias("article_id"), (F.col("l_suppkey") % 15).cast("int").alias("topic_id"))
    return rows.join(F.broadcast(wanted), "topic_id", "left_semi").select("article_id").distinct()  # one category


@query("k66_ad_hydration", with_views("articles", "impressions", more=(HOT,)) + "SELECT s_suppkey AS creative_id, title, coalesce(clicks, 0)::BIGINT AS clicks, CASE WHEN title IS NULL THEN 'missing_article' END AS problem FROM supplier LEFT JOIN articles ON article_id = s_suppkey * 3 LEFT JOIN hot USING (article_id)")
def k66(t):
    """Creatives with their articles; one without is an error of its own."""
    rows = t.supplier.select(F.col("s_suppkey").alias("creative_id"), (F.col("s_suppkey") * 3).alias("article_id")).join(t.articles, "article_id", "left").join(item_counts(t).drop("hot", "impressions"), "article_id", "left")
    return rows.select("creative_id", "title", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.when(F.col("title").isNull(), "missing_article").alias("problem"))


@query("k68_live_query_log", with_views("user_events") + "SELECT user_id, topic_id, n, latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, topic_id) AS k FROM (SELECT user_id, topic_id, count(*)::BIGINT AS n, max(event_ts)::BIGINT AS latest FROM user_events WHERE event_type = 'signup' GROUP BY ALL)) WHERE k <= 5")
def k68(t):
    """Searches of each user: the five latest distinct ones and how often each was asked."""
    per = t.user_events.where("event_type = 'signup'").groupBy("user_id", "topic_id").agg(F.count("*").alias("n"), F.max("event_ts").alias("latest"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("latest").desc(), "topic_id"))
    return per.withColumn("k", place).where("k <= 5").drop("k")


WEIGHTS = {"l_quantity": 0.02, "l_discount": -1.5, "l_tax": 3.0, "absent": 9.0}


def linear_score(rows, weights: dict[str, float], bias: float):
    """A model's score over its columns in their fixed order; columns that are not there, or null, count as 0."""
    total = F.lit(bias)
    for name, weight in weights.items():
        if name in rows.columns:
            total = total + weight * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


@query("m4_batch_scores", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.4 + 0.02 * l_quantity - 1.5 * coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END, 0) + 3.0 * l_tax))), 6) AS score FROM lineitem")
def m4(t):
    rows = t.lineitem.withColumn("l_discount", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")))
    return rows.select("l_orderkey", "l_linenumber", F.round(linear_score(rows, WEIGHTS, -0.4), 6).alias("score"))


@query("k38_catalog_preparation", with_views("articles", "impressions", more=(HOT,)) + "SELECT article_id, title, ln(1 + coalesce(clicks, 0)) + coalesce(clicks::DOUBLE / impressions, 0) > 1 AS is_hot, row_number() OVER (ORDER BY article_id)::BIGINT AS place FROM articles LEFT JOIN hot USING (article_id)")
def k38(t):
    """The catalog with its counters, numbered in order of id."""
    from presswork.functions.scores import catalog_hot_score
    from presswork.sources.impressions import id_map

    rows = t.articles.select("article_id", "title").join(item_counts(t).drop("hot"), "article_id", "left")
    rows = rows.withColumn("is_hot", catalog_hot_score(F.coalesce("clicks", F.lit(0)), F.coalesce("impressions", F.lit(0))) > 1)
    return rows.join(id_map(rows, "article_id"), "article_id").select("article_id", "title", "is_hot", F.col("number").alias("place"))


@query("k62_config_metrics", "WITH h AS (SELECT l_orderkey, l_discount AS dense, l_tax AS lexical, l_returnflag = 'R' AS relevant FROM lineitem), c AS (SELECT n_nationkey AS config, n_nationkey / 250.0 AS a, n_nationkey % 5 / 50.0 AS b FROM nation) SELECT config, count(*) FILTER (WHERE relevant AND (dense >= a OR lexical >= b))::BIGINT AS hits, count(*) FILTER (WHERE dense >= a OR lexical >= b)::BIGINT AS accepted FROM h, c GROUP BY config")
def k62(t):
    """Every setting of a grid judged in one pass over the hits, which are computed once and summed up by value first."""
    hits = t.lineitem.groupBy("l_discount", "l_tax").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("relevant"))
    grid = [(k, k / 250.0, k % 5 / 50.0) for k in range(25)]
    sums = []
    for k, a, b in grid:
        accepted = (F.col("l_discount") >= a) | (F.col("l_tax") >= b)
        sums.append(F.struct(F.lit(k).alias("config"), F.coalesce(F.sum(F.when(accepted, F.col("relevant"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(accepted, F.col("n"))), F.lit(0)).alias("accepted")))
    return hits.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("x")).select("x.*")
