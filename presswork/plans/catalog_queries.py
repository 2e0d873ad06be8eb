"""Catalog, state, queue and validation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import scores, text
from presswork.operators import ordered, profile
from presswork.plans.bindings import with_views
from presswork.plans.profile_queries import SIGNALS
from presswork.plans.registry import query
from presswork.plans.relational_queries import HOT, item_counts


@query("p5_article_projection", with_views("articles", "impressions", more=("f AS (SELECT article_id, min(event_ts) FILTER (WHERE event_ts < 900000000) AS a, min(event_ts) FILTER (WHERE event_ts >= 900000000) AS b FROM impressions GROUP BY article_id)",)) +
    "SELECT article_id, a AS first_seen_train_ts, b AS first_seen_dev_ts, least(a, b) AS first_seen_any_ts FROM articles LEFT JOIN f USING (article_id)")
def p5(t):
    early = F.col("event_ts") < 900_000_000
    seen = t.impressions.groupBy("article_id").agg(F.min(F.when(early, F.col("event_ts"))).alias("first_seen_train_ts"), F.min(F.when(~early, F.col("event_ts"))).alias("first_seen_dev_ts"))
    rows = t.articles.select("article_id").join(seen, "article_id", "left")
    return rows.withColumn("first_seen_any_ts", F.least("first_seen_train_ts", "first_seen_dev_ts"))


@query("p8_available_as_of", with_views("articles", "impressions", more=("f AS (SELECT article_id, min(event_ts) AS first_ts FROM impressions GROUP BY article_id)",)) + "SELECT article_id FROM articles LEFT JOIN f USING (article_id) WHERE first_ts <= 820000000")
def p8(t):
    first = t.impressions.groupBy("article_id").agg(F.min("event_ts").alias("first_ts"))
    return t.articles.select("article_id").join(first, "article_id", "left").where("first_ts <= 820000000").select("article_id")


@query("p10_active_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 3 DAY AND event_type IN ('view', 'click')")
def p10(t):
    return t.events.where("ts >= timestamp_ntz'2024-01-25 00:00:00' - interval 3 days and event_type in ('view', 'click')").select("event_id")


@query("p11_substring_search", r"SELECT p_partkey FROM part WHERE p_name ILIKE '%ING%' ESCAPE '\' OR p_brand ILIKE '%d#1%' ESCAPE '\' OR p_type ILIKE '%100\%%' ESCAPE '\'")
def p11(t):
    def holds(column, part):
        safe = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return F.ilike(F.col(column), F.lit(f"%{safe}%"))

    return t.part.where(holds("p_name", "ING") | holds("p_brand", "d#1") | holds("p_type", "100%")).select("p_partkey")


@query("p15_visible_excerpt", "WITH b AS (SELECT doc_id, text, substr(text, 1, 1000) AS s FROM documents), c AS (SELECT *, length(s) - strpos(reverse(s), chr(10)) + 1 AS cut FROM b) "
    "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text WHEN length(text) <= 1000 THEN text WHEN strpos(reverse(s), chr(10)) > 0 AND cut - 1 >= 700 THEN substr(s, 1, cut - 1) ELSE s END) AS visible FROM c")
def p15(t):
    """The whole text where rights allow, else an excerpt that ends with a line if one ends late enough."""
    s = F.substring("text", 1, 1000)
    back = F.locate("\n", F.reverse(s))
    end = F.length(s) - back
    excerpt = F.when(F.length("text") <= 1000, F.col("text")).when((back > 0) & (end >= 700), F.substring(s, F.lit(1), end)).otherwise(s)
    return t.documents.select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(excerpt)).alias("visible"))


@query("p22_backfill_candidates", "WITH p AS (SELECT * FROM (VALUES ('src1', 0), ('src2', 1), ('src3', 1)) v(source, priority)) SELECT doc_id, priority::INT AS priority FROM (SELECT doc_id, priority, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN p USING (source) WHERE lang IS DISTINCT FROM 'de') WHERE k <= 5")
def p22(t):
    policy = F.broadcast(t.spark.createDataFrame([("src1", 0), ("src2", 1), ("src3", 1)], "source string, priority int"))
    rows = t.documents.where(~F.col("lang").eqNullSafe("de")).join(policy, "source")
    return ordered.top_per_group(rows, ["source"], [F.col("n_chars").desc(), "doc_id"], 5, "k").select("doc_id", "priority")


@query("j2_inner_stats", with_views("articles", "impressions", more=(HOT,)) + "SELECT article_id, title, clicks, impressions FROM articles JOIN hot USING (article_id)")
def j2(t):
    return t.articles.join(item_counts(t), "article_id").select("article_id", "title", "clicks", "impressions")


@query("j11_reference_guard", "SELECT (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l.l_partkey))::BIGINT AS items, (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey))::BIGINT AS users, (SELECT count(*) FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s.s_nationkey AND n_nationkey <> 7))::BIGINT AS topics")
def j11(t):
    """How many rows refer to something that is not there, for three references."""
    missing = lambda rows, dim, a, b, name: rows.join(dim, rows[a] == dim[b], "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    counts = missing(t.lineitem, t.part, "l_partkey", "p_partkey", "items").unionByName(missing(t.orders, t.customer, "o_custkey", "c_custkey", "users"))
    counts = counts.unionByName(missing(t.supplier, t.nation.where("n_nationkey <> 7"), "s_nationkey", "n_nationkey", "topics"))
    return counts.groupBy().pivot("name", ["items", "users", "topics"]).agg(F.first("n"))


@query("j18_desc_nulls_first", "SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey ORDER BY last_order DESC NULLS FIRST, c_custkey LIMIT 25")
def j18(t):
    last = t.orders.where("o_orderstatus = 'P' and o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").orderBy(F.col("last_order").desc_nulls_first(), "c_custkey").limit(25)


@query("j20_factor_scores", "SELECT o_orderkey, round(coalesce(list_sum(list_transform(range(1, 65), lambda i: u.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 0.0), 6) AS score FROM orders LEFT JOIN embeddings u ON u.vec_id = o_custkey LEFT JOIN embeddings v ON v.vec_id = o_orderkey % 700")
def j20(t):
    """User and item factors by key; 0 where either is missing."""
    user = t.embeddings.select(F.col("vec_id").alias("o_custkey"), F.col("embedding").alias("u"))
    item = t.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 700).alias("item")).join(user, "o_custkey", "left").join(item, "item", "left")
    return rows.select("o_orderkey", F.round(F.coalesce(text.dot(F.col("u"), F.col("v")), F.lit(0.0)), 6).alias("score"))


@query("j23_topic_overlap", with_views("user_events", more=("s AS (SELECT user_id, list_sort(list(DISTINCT topic_id)) AS a FROM user_events WHERE event_type = 'recommendation_click' GROUP BY 1)", "q AS (SELECT user_id, list_sort(list(DISTINCT topic_id)) AS b FROM user_events WHERE event_type = 'signup' GROUP BY 1)")) +
    "SELECT user_id, len(list_intersect(a, b))::INT AS shared, len(list_distinct(list_concat(a, b)))::INT AS everything FROM s JOIN q USING (user_id)")
def j23(t):
    of = lambda k, n: t.user_events.where(F.col("event_type") == k).groupBy("user_id").agg(F.collect_set("topic_id").alias(n))
    return of("recommendation_click", "a").join(of("signup", "b"), "user_id").select("user_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("everything"))


@query("a3_filtered_counts", with_views("impressions") + "SELECT user_id, count(*) FILTER (WHERE clicked = 1)::BIGINT AS clicks, count(*) FILTER (WHERE position = 1)::BIGINT AS first_places, (10 * count(*) FILTER (WHERE clicked = 1) + count(*))::BIGINT AS hot FROM impressions GROUP BY user_id")
def a3(t):
    clicks = F.count_if(F.col("clicked") == 1)
    return t.impressions.groupBy("user_id").agg(clicks.alias("clicks"), F.count_if(F.col("position") == 1).alias("first_places"), scores.hot_score(clicks, F.count("*")).alias("hot"))


@query("a5_item_counts", with_views("impressions", more=(HOT,)) + "SELECT article_id, impressions, clicks, hot FROM hot")
def a5(t):
    return item_counts(t).select("article_id", "impressions", "clicks", "hot")


@query("a10_nearest_rank", "WITH s AS (SELECT l_returnflag, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, q[(round_even((len(q) - 1) * 0.95, 0) + 1)::INT] AS p95 FROM s")
def a10(t):
    """The value at place round((n - 1) * p) of the sorted values, from counts per value."""
    per = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("k"))
    w = Window.partitionBy("l_returnflag")
    per = per.withColumn("upto", F.sum("k").over(w.orderBy("l_quantity"))).withColumn("n", F.sum("k").over(w))
    return per.where(F.col("upto") >= F.bround((F.col("n") - 1) * 0.95) + 1).groupBy("l_returnflag").agg(F.min("l_quantity").alias("p95"))


@query("a17_topic_vote", with_views("articles", "impressions", more=(HOT, "v AS (SELECT category AS topic, hot * 1.0 AS w FROM articles JOIN hot USING (article_id) UNION ALL SELECT category || '/' || subcategory, hot * 1.25 FROM articles JOIN hot USING (article_id))")) + "SELECT topic, sum(w)::DOUBLE AS vote FROM v GROUP BY topic ORDER BY vote DESC, topic LIMIT 10")
def a17(t):
    rows = t.articles.join(item_counts(t), "article_id")
    keys = F.array(F.struct(F.col("category").alias("topic"), F.lit(1.0).alias("f")), F.struct(F.concat("category", F.lit("/"), "subcategory").alias("topic"), F.lit(1.25).alias("f")))
    votes = rows.select("hot", F.explode(keys).alias("k")).groupBy("k.topic").agg(F.sum(F.col("hot") * F.col("k.f")).alias("vote"))
    return votes.orderBy(F.col("vote").desc(), "topic").limit(10)


@query("a19_suggestions", "SELECT lower(trim(p_name)) AS query_key, count(*)::BIGINT AS n, min(p_name) AS label FROM part GROUP BY 1 ORDER BY n DESC, query_key LIMIT 20")
def a19(t):
    return t.part.groupBy(F.lower(F.trim("p_name")).alias("query_key")).agg(F.count("*").alias("n"), F.min("p_name").alias("label")).orderBy(F.col("n").desc(), "query_key").limit(20)


@query("a29_label_histograms", "SELECT quality::INT AS quality, toxic::INT AS toxic, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def a29(t):
    return t.labels.groupBy(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n"))


@query("a32_oldest_age", "SELECT event_type, date_diff('second', min(ts), TIMESTAMP '2024-02-01 00:00:00')::BIGINT AS oldest FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def a32(t):
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return t.events.groupBy("event_type").agg((F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp(F.min(second))).alias("oldest"))


@query("w4_ratio_split", with_views("requests", more=("r AS (SELECT *, row_number() OVER (ORDER BY event_ts, request_id) AS k, count(*) OVER () AS n FROM requests)",)) + "SELECT CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.85, 0) THEN 'validation' ELSE 'test' END AS split, count(*)::BIGINT AS n, min(request_id)::BIGINT AS least FROM r GROUP BY 1")
def w4(t):
    """Split by count in order of time. Places come from counts per time and the order within a time."""
    per = ordered.running_before(t.requests.groupBy("event_ts").agg(F.count("*").alias("c")), "event_ts", ["c"])
    placed = t.requests.join(per.select("event_ts", F.col("before_c").alias("before")), "event_ts").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("event_ts").orderBy("request_id")))
    n = t.requests.count()
    split = F.when(F.col("k") <= round(n * 0.7), "train").when(F.col("k") <= round(n * 0.85), "validation").otherwise("test")
    return placed.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("request_id").alias("least"))


@query("w5_tail_sample", with_views("requests") + "SELECT request_id FROM requests ORDER BY event_ts DESC, request_id DESC LIMIT 100")
def w5(t):
    return t.requests.orderBy(F.col("event_ts").desc(), F.col("request_id").desc()).limit(100).select("request_id")


@query("w9_first_positive", with_views("impressions") + "SELECT request_id, min(position) FILTER (WHERE clicked = 1)::INT AS first_positive FROM impressions GROUP BY request_id")
def w9(t):
    return t.impressions.groupBy("request_id").agg(F.min(F.when(F.col("clicked") == 1, F.col("position"))).alias("first_positive"))


@query("l2_hot_fallback", with_views("articles", "impressions", more=(HOT,)) + "SELECT article_id, coalesce(hot, 0)::BIGINT AS hot FROM articles LEFT JOIN hot USING (article_id) ORDER BY coalesce(hot, 0) DESC, article_id LIMIT 60")
def l2(t):
    rows = t.articles.select("article_id").join(item_counts(t), "article_id", "left").select("article_id", F.coalesce("hot", F.lit(0)).alias("hot"))
    return rows.orderBy(F.col("hot").desc(), "article_id").limit(60)


@query("l7_feed_order", with_views("impressions", more=(HOT,)) + "SELECT request_id, 'N' || article_id AS news_id, row_number() OVER (PARTITION BY request_id ORDER BY hot DESC, 'N' || article_id)::INT AS rank FROM impressions JOIN hot USING (article_id)")
def l7(t):
    """Ids are compared as text here, so N10 comes before N2."""
    rows = t.impressions.join(item_counts(t).select("article_id", "hot"), "article_id").withColumn("news_id", F.concat(F.lit("N"), "article_id"))
    return rows.select("request_id", "news_id", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("hot").desc(), "news_id")).alias("rank"))


@query("l9_penalty_selection", "WITH g AS (SELECT n_nationkey / 100.0::DOUBLE AS penalty, 0.6 - n_nationkey * 0.001 AS recall, 0.5 - (n_nationkey % 9) * 0.01 AS similarity, 1.0 + (n_nationkey % 4) AS coverage FROM nation) SELECT penalty::DOUBLE AS penalty FROM g WHERE recall >= 0.6 * 0.98 ORDER BY similarity, coverage DESC, recall DESC, penalty LIMIT 1")
def l9(t):
    k = F.col("n_nationkey")
    grid = t.nation.select((k / 100.0).alias("penalty"), (0.6 - k * 0.001).alias("recall"), (0.5 - k % 9 * 0.01).alias("similarity"), (1.0 + k % 4).alias("coverage"))
    return grid.where(F.col("recall") >= 0.6 * 0.98).orderBy("similarity", F.col("coverage").desc(), F.col("recall").desc(), "penalty").limit(1).select("penalty")


@query("u2_null_scan", "SELECT 'documents' AS name, count(*) FILTER (WHERE text IS NULL)::BIGINT AS nulls FROM documents UNION ALL SELECT 'pages', count(*) FILTER (WHERE url IS NULL) FROM pages UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders UNION ALL SELECT 'part', count(*) FILTER (WHERE p_name IS NULL) FROM part")
def u2(t):
    out = None
    for name, column in (("documents", "text"), ("pages", "url"), ("orders", "o_custkey"), ("part", "p_name")):
        part = getattr(t, name).agg(F.count_if(F.col(column).isNull()).alias("nulls")).select(F.lit(name).alias("name"), "nulls")
        out = part if out is None else out.unionByName(part)
    return out


@query("f1_search_text", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS digest FROM documents")
def f1(t):
    return t.documents.select("doc_id", F.md5(text.search_text(F.col("text"))).alias("digest"))


@query("f15_topic_strengths", with_views("user_events", more=(SIGNALS, "q AS (SELECT event_id, user_id, topic_id, d FROM s WHERE event_type = 'recommendation_click')", "x AS (SELECT event_id, unnest(list_distinct([topic_id, (topic_id + 3) % 16])) AS topic, topic_id, d FROM q)")) + "SELECT event_id, topic::INT AS topic, (CASE WHEN topic = topic_id THEN d ELSE d * 0.5 END)::DOUBLE AS strength FROM x")
def f15(t):
    """Topics of the article count in full, topics only of the query by half."""
    rows = t.user_events.where("event_type = 'recommendation_click'").withColumn("d", scores.event_strength(F.col("event_type"), F.col("dwell_ms")))
    topics = F.array_union(F.array("topic_id"), F.array((F.col("topic_id") + 3) % 16))
    each = rows.select("event_id", "topic_id", "d", F.explode(topics).alias("topic"))
    return each.select("event_id", "topic", F.when(F.col("topic") == F.col("topic_id"), F.col("d")).otherwise(F.col("d") * 0.5).alias("strength"))


@query("f21_base_score", with_views("impressions", more=(HOT,)) + "SELECT article_id, round(CASE WHEN hot > 0 THEN hot / (hot + 100.0) ELSE 0 END, 6)::DOUBLE AS base_score FROM hot")
def f21(t):
    return item_counts(t).select("article_id", F.round(scores.base_score(F.col("hot")), 6).alias("base_score"))


@query("f23_factor_boost", "SELECT c_custkey, round(0.15 / (1 + exp(-least(20.0, greatest(-20.0, c_acctbal / 500.0)))), 6)::DOUBLE AS boost FROM customer")
def f23(t):
    return t.customer.select("c_custkey", F.round(scores.als_boost(F.col("c_acctbal") / 500.0), 6).alias("boost"))


@query("f34_parse_time", "SELECT o_orderkey, (epoch_us(o_orderdate + INTERVAL 30780 SECOND) // 1000000)::BIGINT AS ts FROM orders")
def f34(t):
    """Times as the logs write them, back to seconds (UTC)."""
    written = F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr("interval 30780 seconds"), "M/d/yyyy h:mm:ss a")
    return t.orders.select("o_orderkey", F.unix_timestamp(F.try_to_timestamp(written, F.lit("M/d/yyyy h:mm:ss a"))).alias("ts"))


@query("f39_fingerprint", "SELECT event_id, sha256(concat_ws('|', event_type, user_id::VARCHAR, regexp_extract(props, '[0-9]+'))) AS fingerprint FROM events")
def f39(t):
    """What an event says, without when."""
    return t.events.select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.regexp_extract("props", "[0-9]+", 0)), 256).alias("fingerprint"))


@query("f43_retry_delay", "SELECT s_suppkey, least(300, pow(2, least(s_suppkey % 12, 8)))::BIGINT AS delay FROM supplier")
def f43(t):
    return t.supplier.select("s_suppkey", scores.retry_delay(F.col("s_suppkey") % 12).alias("delay"))


@query("f47_block_ids", "SELECT conv_id, turn, substr(sha256(conv_id || chr(31) || turn || chr(31) || role || chr(31) || text), 1, 16) AS block_id FROM conversations")
def f47(t):
    return t.conversations.select("conv_id", "turn", F.substring(F.sha2(F.concat_ws("\x1f", "conv_id", "turn", "role", "text"), 256), 1, 16).alias("block_id"))


@query("c12_reference_check", "SELECT e.event_id, CASE WHEN o.o_orderkey IS NULL THEN 'unknown_request' WHEN o.o_custkey % 3 <> e.user_id % 3 THEN 'other_user' ELSE 'ok' END AS outcome FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id * 2")
def c12(t):
    asked = t.orders.select((F.col("o_orderkey") / 2).alias("event_id"), "o_custkey").where("event_id = floor(event_id)").withColumn("event_id", F.col("event_id").cast("long"))
    outcome = F.when(F.col("o_custkey").isNull(), "unknown_request").when(F.col("o_custkey") % 3 != F.col("user_id") % 3, "other_user").otherwise("ok")
    return t.events.join(asked, "event_id", "left").select("event_id", outcome.alias("outcome"))


@query("c14_ensure_profiles", with_views("user_events") + "SELECT c_custkey AS user_id, CASE WHEN c_custkey IN (SELECT user_id FROM user_events) THEN 'kept' ELSE 'seeded' END AS origin FROM customer")
def c14(t):
    """Profiles are made for those customers who have none."""
    wanted = t.customer.select(F.col("c_custkey").alias("user_id"))
    have = t.user_events.select("user_id").distinct()
    return wanted.join(have, "user_id", "left_semi").withColumn("origin", F.lit("kept")).unionByName(wanted.join(have, "user_id", "left_anti").withColumn("origin", F.lit("seeded")))


@query("c20_search_hidden", "SELECT count(*) FILTER (WHERE p_type = 'PROMO')::BIGINT AS hidden, count(*) FILTER (WHERE p_type <> 'PROMO')::BIGINT AS shown FROM part WHERE contains(p_name, 'ring')")
def c20(t):
    """Of all hits of a search, how many the user's rules hide."""
    hits = t.part.where(F.contains("p_name", F.lit("ring")))
    return hits.agg(F.count_if(F.col("p_type") == "PROMO").alias("hidden"), F.count_if(F.col("p_type") != "PROMO").alias("shown"))


@query("c21_reading_revision", "SELECT o_custkey AS user_id, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS revision FROM orders GROUP BY 1")
def c21(t):
    """A token that changes when any state of the user does."""
    states = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    joined = F.array_join(F.transform(states, lambda s: F.concat_ws(":", s["o_orderkey"], s["o_orderstatus"])), ",")
    return t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.sha2(joined, 256).alias("revision"))


@query("c23_latest_generation", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1")
def c23(t):
    """Of the jobs of an article only the result of the last generation counts."""
    last = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("event_id", "value")).alias("x"))
    return last.select("user_id", "x.event_id", "x.value")


@query("k2_topics_by_article", with_views("articles") + "SELECT article_id, category || ',' || subcategory AS topics FROM articles")
def k2(t):
    bridge = t.articles.select("article_id", F.posexplode(F.array("category", "subcategory")).alias("source_rank", "topic"))
    lists = bridge.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("source_rank", "topic")))["topic"].alias("topics"))
    return lists.select("article_id", F.array_join("topics", ",").alias("topics"))


#: Fixed value: a job that has failed so often is given up.
ATTEMPTS = 5


@query("k13_job_states", "WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS failures FROM events) SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'completed' WHEN failures >= 5 THEN 'failed' WHEN event_type = 'error' THEN 'retry' ELSE 'pending' END AS state, failures::BIGINT AS failures FROM e WHERE k = 1")
def k13(t):
    """The state of each job after its last event, given how often it has failed."""
    per = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.count_if(F.col("event_type") == "error").alias("failures"))
    state = F.when(F.col("last") == "purchase", "completed").when(F.col("failures") >= ATTEMPTS, "failed").when(F.col("last") == "error", "retry").otherwise("pending")
    return per.select("user_id", state.alias("state"), "failures")


@query("k24_last_write_wins", "SELECT o_custkey AS user_id, o_orderpriority AS rule, arg_max(o_orderstatus, o_orderkey) AS effect FROM orders GROUP BY ALL")
def k24(t):
    return t.orders.groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("rule")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("effect"))


@query("k26_catalog_topics", with_views("articles") + "SELECT title, string_agg(DISTINCT category, ',' ORDER BY category) AS topics FROM articles GROUP BY title")
def k26(t):
    return t.articles.groupBy("title").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("topics"))


@query("k32_evidence", with_views("user_events", more=(SIGNALS,)) + "SELECT user_id, count(*)::BIGINT AS evidence, max(event_ts)::BIGINT AS last_event_ts FROM s WHERE d <> 0 GROUP BY user_id")
def k32(t):
    return profile.signals(t.user_events).groupBy("user_id").agg(F.count("*").alias("evidence"), F.max("event_ts").alias("last_event_ts"))


@query("k35_topic_dimension", with_views("articles", more=("k AS (SELECT 'category:' || category AS topic_key FROM articles UNION ALL SELECT 'subcategory:' || category || '/' || subcategory FROM articles)",)) + "SELECT topic_key, count(*)::BIGINT AS articles FROM k GROUP BY topic_key")
def k35(t):
    keys = F.array(F.concat(F.lit("category:"), "category"), F.concat(F.lit("subcategory:"), "category", F.lit("/"), "subcategory"))
    return t.articles.select(F.explode(keys).alias("topic_key")).groupBy("topic_key").agg(F.count("*").alias("articles"))


@query("k37_bijective_ids", "SELECT (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1))::BIGINT AS repeated_names, (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1))::BIGINT AS repeated_ids")
def k37(t):
    """Keys that stand for several ids, and ids that stand for several keys."""
    repeated = lambda c: t.part.groupBy(c).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(c).alias("name"), "n")
    both = repeated("p_name").unionByName(repeated("p_partkey")).groupBy().pivot("name", ["p_name", "p_partkey"]).agg(F.first("n"))
    return both.select(F.col("p_name").alias("repeated_names"), F.col("p_partkey").alias("repeated_ids"))


@query("ts12_changed_titles", "WITH v AS (SELECT conv_id, turn, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, sum(CASE WHEN p IS DISTINCT FROM h THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS generation FROM v")
def ts12(t):
    """A new generation for each version of a key whose content differs from the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", F.md5("text").alias("h")).withColumn("changed", ~F.col("h").eqNullSafe(F.lag("h").over(w)))
    return rows.select("conv_id", "turn", F.sum(F.col("changed").cast("int")).over(w).alias("generation"))


@query("ts14_visible_dwell", "WITH v AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) SELECT user_id, least(86400000, sum(date_diff('millisecond', date_trunc('second', ts), date_trunc('second', nxt))) FILTER (WHERE event_type = 'view'))::BIGINT AS visible_ms FROM v GROUP BY user_id")
def ts14(t):
    """Time from each showing to the next event, a day at most."""
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = t.events.select("user_id", "event_type", second.alias("s"), F.lead(second).over(Window.partitionBy("user_id").orderBy("event_id")).alias("nxt"))
    shown = F.sum(F.when(F.col("event_type") == "view", (F.col("nxt") - F.col("s")) * 1000))
    return rows.groupBy("user_id").agg(F.when(shown.isNotNull(), F.least(F.lit(86_400_000), shown)).otherwise(86_400_000).cast("long").alias("visible_ms"))


@query("ts15_has_updates", "SELECT event_type, max(event_id) > 9900 AS has_updates FROM events GROUP BY event_type")
def ts15(t):
    return t.events.groupBy("event_type").agg((F.max("event_id") > 9900).alias("has_updates"))
