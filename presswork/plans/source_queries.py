"""Files written from the test tables and read back through the sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.plans.bindings import with_views
from presswork.plans.registry import query
from presswork.sources import artifacts, batches, impressions, policies, search_files
from presswork.sources.logs import shared_path
from presswork.streaming import contract


def written_text(t, lines, name: str, compression: str = "none") -> str:
    path = shared_path(t.spark, name)
    lines.write.option("compression", compression).text(path)
    return path


def news_file(t, version: str = "a") -> str:
    """News as tab-separated lines: some with a bad id, a blank category, a lacking column or a broken list."""
    key = F.col("p_partkey")
    entities = F.when(key % 13 == 0, "{").otherwise("[]")
    columns = [F.concat(F.when(key % 7 == 0, "X").otherwise("N"), key), F.when(key % 11 == 0, " ").otherwise(F.col("p_type")), F.col("p_brand"), F.concat(F.lit('"'), "p_name"), F.lit(version), F.lit("http://x"), entities]
    line = F.concat_ws("\t", *columns)
    return written_text(t, t.part.select(F.when(key % 17 == 0, line).otherwise(F.concat(line, F.lit("\t[]")))), "news")


NEWS_SQL = "nw AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'wrong_column_count' WHEN p_partkey % 7 = 0 THEN 'bad_news_id' WHEN p_partkey % 11 = 0 THEN 'blank_category' WHEN p_partkey % 13 = 0 THEN 'bad_entities' END AS problem, p_type, p_name FROM part)"


@query("s1_tsv_scan", "SELECT (CASE WHEN p_partkey % 7 = 0 THEN 'X' ELSE 'N' END) || p_partkey AS news_id, '\"' || p_name AS title, CASE WHEN p_partkey % 17 = 0 THEN 'wrong_column_count' END AS problem FROM part")
def s1(t):
    """Lines cut at tabs; a quote is part of the field."""
    return impressions.read_tsv(t.spark, news_file(t), impressions.NEWS).select("news_id", "title", "problem")


@query("s2_news_rows", f"WITH {NEWS_SQL} SELECT coalesce(problem, 'ok') AS problem, count(*)::BIGINT AS n FROM nw GROUP BY 1")
def s2(t):
    return impressions.problem_counts(impressions.read_news(t.spark, news_file(t)))


BEHAVIOUR = "bh AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'blank_id' WHEN o_orderkey % 23 = 0 THEN 'bad_time' WHEN o_orderkey % 29 = 0 THEN 'no_candidates' END AS problem, o_custkey, (epoch_us(o_orderdate) // 1000000)::BIGINT AS ts FROM orders)"


def behaviours(t):
    key = F.col("o_orderkey")
    columns = [F.when(key % 19 == 0, " ").otherwise(key.cast("string")), F.concat(F.lit("U"), "o_custkey"), F.when(key % 23 == 0, "yesterday").otherwise(F.date_format("o_orderdate", "M/d/yyyy h:mm:ss a")), F.concat_ws(" ", F.concat(F.lit("N"), key % 50), F.lit("N7")), F.when(key % 29 == 0, "").otherwise(F.concat(F.lit("N"), key % 60, F.lit("-1 N8-0")))]
    return impressions.read_behaviours(t.spark, written_text(t, t.orders.select(F.concat_ws("\t", *columns)), "behaviours"), "dev")


@query("s3_behaviour_rows", f"WITH {BEHAVIOUR} SELECT 'mind:dev:' || o_orderkey AS request_id, o_custkey AS user_id, ts AS event_ts, 2::INT AS candidate_count, 1::INT AS positive_count FROM bh WHERE problem IS NULL")
def s3(t):
    return impressions.requests_table(behaviours(t)).select("request_id", "user_id", "event_ts", "candidate_count", "positive_count")


@query("s3_behaviour_problems", f"WITH {BEHAVIOUR} SELECT coalesce(problem, 'ok') AS problem, count(*)::BIGINT AS n FROM bh GROUP BY 1")
def s3_problems(t):
    return impressions.problem_counts(behaviours(t))


@query("s4_cross_split_load", f"WITH {NEWS_SQL} SELECT 'N' || p_partkey AS news_id, p_type AS category, '\"' || p_name AS title FROM nw WHERE problem IS NULL")
def s4(t):
    """Two splits that agree give each article once."""
    parts = [impressions.read_news(t.spark, news_file(t)) for _ in range(2)]
    return impressions.load_articles(parts).select("news_id", "category", "title")


@query("s5_repeated_requests", "SELECT o_custkey AS request_id, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def s5(t):
    return impressions.repeated_requests(t.orders.select(F.col("o_custkey").alias("request_id")))


@query("s6_batched_writer", "SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def s6(t):
    """Rows written as compressed Parquet in a folder for each value, and read back."""
    path = shared_path(t.spark, "table")
    impressions.write_table(t.lineitem, path, "l_returnflag")
    return t.spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("s7_selected_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (1, 3, 5, 8, 13, 21, 34)")
def s7(t):
    return impressions.read_selected(t.spark, f"{t.folder}/lineitem.parquet", "l_orderkey", [1, 3, 5, 8, 13, 21, 34], ["l_orderkey", "l_partkey", "l_quantity"])


@query("s8_train_stats", with_views("impressions") + "SELECT article_id, count(*)::BIGINT AS impressions, sum(clicked)::BIGINT AS clicks FROM impressions WHERE event_ts < 900000000 GROUP BY article_id")
def s8(t):
    """Counters of the training split in one scan with map-side sums."""
    return t.impressions.where("event_ts < 900000000").groupBy("article_id").agg(F.count("*").alias("impressions"), F.sum("clicked").alias("clicks"))


def search_documents(t):
    key = F.col("p_partkey")
    return t.part.select(F.concat(F.lit("N"), key).alias("news_id"), F.col("p_name").alias("headline"), F.when(key % 3 != 0, F.col("p_brand")).alias("abstract"), F.array((key % 25).cast("int")).alias("topic_ids"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("subcategory"))


DOCUMENTS = "SELECT 'N' || p_partkey AS news_id, p_name AS headline, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS abstract, '' AS subcategory FROM part"


@query("s9_search_documents", DOCUMENTS)
def s9(t):
    """Documents for search from Parquet, absent texts empty."""
    path = shared_path(t.spark, "documents")
    impressions.write_table(search_documents(t), path)
    rows = t.spark.read.parquet(path)
    return rows.select("news_id", "headline", *(F.coalesce(c, F.lit("")).alias(c) for c in ("abstract", "subcategory")))


@query("s10_json_documents", DOCUMENTS)
def s10(t):
    """The same as JSON lines, written and read back."""
    path = shared_path(t.spark, "documents")
    search_files.write_documents(search_documents(t), path)
    return search_files.read_documents(t.spark, path).select("news_id", "headline", "abstract", "subcategory")


def query_files(t):
    key = F.col("item_id")
    asked = t.benchmark.select(F.concat(F.lit("q"), key).alias("query_id"), "text", F.lit("all").alias("slice"), F.when(key % 2 == 0, "test").otherwise("calibration").alias("split"), F.lit("").alias("intended_meaning"), F.lit(True).alias("expected_relevant"), F.array(key).alias("anchor_article_ids"))
    judged = t.benchmark.select(F.concat(F.lit("q"), key).alias("query_id"), F.explode(F.array(key, key + 1)).alias("article_id"), (key % 3).cast("int").alias("relevance"), F.lit("high").alias("confidence"), F.lit("model").alias("label_source"), F.lit(False).alias("human_reviewed"))
    paths = [shared_path(t.spark, name) for name in ("queries", "qrels")]
    for rows, path in zip((asked, judged), paths, strict=True):
        rows.write.json(path)
    queries = search_files.read_queries(t.spark, paths[0])
    return queries, search_files.read_qrels(t.spark, paths[1], queries)


@query("s11_queries_qrels", "SELECT split, relevance, count(*)::BIGINT AS n FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'test' ELSE 'calibration' END AS split, (item_id % 3)::INT AS relevance, unnest([0, 1]) FROM benchmark) GROUP BY ALL")
def s11(t):
    """Checked queries and their checked judgements."""
    queries, judged = query_files(t)
    return judged.join(queries, "query_id").groupBy("split", "relevance").agg(F.count("*").alias("n"))


@query("k19_label_merge", "SELECT relevance, count(*)::BIGINT AS n FROM (SELECT (item_id % 3)::INT AS relevance, unnest([0, 1]) FROM benchmark) GROUP BY ALL")
def k19(t):
    """Two files of labels that together cover the pool."""
    _, judged = query_files(t)
    halves = [judged.where(F.col("article_id") % 2 == k) for k in (0, 1)]
    return search_files.merge_labels(halves, judged.select("query_id", "article_id")).groupBy("relevance").agg(F.count("*").alias("n"))


@query("k20_review_apply", "SELECT human_reviewed, relevance, count(*)::BIGINT AS n FROM (SELECT item_id % 5 = 0 AND k = 0 AS human_reviewed, CASE WHEN item_id % 5 = 0 AND k = 0 THEN 2 ELSE (item_id % 3)::INT END AS relevance FROM (SELECT item_id, unnest([0, 1]) AS k FROM benchmark)) GROUP BY ALL")
def k20(t):
    _, judged = query_files(t)
    number = F.substring("query_id", 2, 20).cast("long")
    review = judged.where((number % 5 == 0) & (F.col("article_id") == number)).select("query_id", "article_id", F.lit(2).alias("relevance"))
    return search_files.apply_review(judged, review).groupBy("human_reviewed", "relevance").agg(F.count("*").alias("n"))


@query("s12_minute_batch", "SELECT page_id % 6 = 0 AS malformed, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN page_id % 6 <> 0 THEN url END)::BIGINT AS urls FROM pages GROUP BY 1")
def s12(t):
    """A gzip batch of JSON lines in which broken lines are rows of their own."""
    good = F.to_json(F.struct("url", F.lit("t").alias("title"), F.lit("en").alias("lang")))
    lines = t.pages.select(F.when(F.col("page_id") % 6 == 0, F.concat(F.lit('{"url": '), "page_id")).otherwise(good))
    rows = batches.read_json_lines(t.spark, written_text(t, lines, "batch", "gzip"))
    return rows.groupBy("malformed").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("s13_latest_batch", "SELECT o_custkey, (max(epoch_us(o_orderdate)) // 1000000)::BIGINT AS latest FROM orders GROUP BY 1")
def s13(t):
    """The newest time of a feed whose items are in no order."""
    item = F.concat(F.lit("<item><pubDate>"), F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, " GMT").otherwise(" +0000"), F.lit("</pubDate></item>"))
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>"))
    return t.orders.groupBy("o_custkey").agg(feed.alias("feed")).select("o_custkey", F.unix_timestamp(batches.latest_batch_time(F.col("feed"))).alias("latest"))


@query("s14_feed_item", "SELECT o_custkey, 'text of ' || max(o_orderkey) AS body FROM orders GROUP BY 1")
def s14(t):
    """The full text of one item of a feed, found by its canonical address."""
    from presswork.functions.text import canonical_url

    item = F.struct(F.concat(F.lit("HTTP://News.example/a?utm_source=x&id="), "o_orderkey", F.lit("#top")).alias("link"), F.concat(F.lit("text of "), "o_orderkey").alias("body"))
    feeds = t.orders.groupBy("o_custkey").agg(F.collect_list(item).alias("items"), F.concat(F.lit("http://news.example/a?id="), F.max("o_orderkey")).alias("wanted"))
    rows = feeds.select("o_custkey", "wanted", F.explode("items").alias("i"))
    return rows.where(canonical_url(F.col("i.link")) == F.col("wanted")).select("o_custkey", "i.body")


@query("s21_dataset_fingerprint", "SELECT 'same' AS verdict, count(*)::BIGINT AS n FROM orders")
def s21(t):
    """The fingerprint does not depend on the order of rows or files, and changes with any value."""
    one = impressions.fingerprint(t.orders)
    other = impressions.fingerprint(t.orders.repartition(7, "o_custkey"))
    changed = impressions.fingerprint(t.orders.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") == 1).cast("int")))
    return t.orders.agg(F.lit("same" if one == other != changed else "different").alias("verdict"), F.count("*").alias("n"))


@query("s23_artifact_load", "SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1")
def s23(t):
    """A table read back only after kind, version, source, count and fingerprint have been checked."""
    path, source = shared_path(t.spark, "artifact"), "orders-1"
    artifacts.write_artifact(t.part, path, "catalog", 3, source)
    return artifacts.read_artifact(t.spark, path, "catalog", 3, source).groupBy("p_type").agg(F.count("*").alias("n"))


@query("k65_artifact_gate", "SELECT * FROM (VALUES ('as_written', 'warm'), ('missing', 'cold'), ('other_source', 'cold'), ('other_version', 'cold')) AS v(given, state)")
def k65(t):
    """Factors are used only if their card fits; otherwise the engine starts cold."""
    path = shared_path(t.spark, "factors")
    artifacts.write_artifact(t.region, path, "factors", 2, "s1")
    tries = {"as_written": (path, 2, "s1"), "missing": (path + "-none", 2, "s1"), "other_source": (path, 2, "s2"), "other_version": (path, 1, "s1")}
    return t.spark.createDataFrame([(name, artifact_state(t.spark, *x)) for name, x in tries.items()], "given string, state string")


def artifact_state(spark, path: str, version: int, source: str) -> str:
    """warm if the factors at the path can be used, else cold."""
    from pyspark.errors import AnalysisException

    try:
        artifacts.read_artifact(spark, path, "factors", version, source)
    except (ValueError, AnalysisException):
        return "cold"
    return "warm"


@query("s25_id_map", "SELECT p_brand, row_number() OVER (ORDER BY p_brand)::BIGINT AS number FROM (SELECT DISTINCT p_brand FROM part)")
def s25(t):
    """Numbers for keys, written as JSON and read back."""
    path = shared_path(t.spark, "ids")
    impressions.id_map(t.part, "p_brand").write.json(path)
    return t.spark.read.schema("p_brand string, number long").json(path)


@query("k39_json_objects", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 2 END::INT AS n FROM part")
def k39(t):
    """The members of a JSON array of objects; null where the text is anything else."""
    key = F.col("p_partkey")
    raw = F.when(key % 8 == 0, F.lit('{"a": 1}')).when(key % 8 == 4, F.lit("[1, 2]")).otherwise(F.concat(F.lit('[{"a": '), key, F.lit('}, {"b": 2}]')))
    return t.part.select("p_partkey", object_count(raw).alias("n"))


def object_count(raw):
    members = F.from_json(raw, "array<string>")
    fine = F.ltrim(raw).startswith("[") & F.forall(members, lambda m: m.startswith("{"))
    return F.when(fine, F.size(members))


@query("k41_decode_report", f"WITH {BEHAVIOUR} SELECT count(*)::BIGINT AS rows, count(problem)::BIGINT AS broken, min(ts) FILTER (WHERE problem IS NULL)::BIGINT AS first_ts FROM bh")
def k41(t):
    """Inspection: what can't be decoded is counted, not raised."""
    return behaviours(t).agg(F.count("*").alias("rows"), F.count("problem").alias("broken"), F.min(F.when(F.col("problem").isNull(), F.col("event_ts"))).alias("first_ts"))


@query("k44_allow_list", "SELECT 'd' || n_nationkey || '.org' AS domain, CASE WHEN n_nationkey % 2 = 0 THEN 'zh' ELSE 'en' END AS language, n_nationkey / 25.0::DOUBLE AS quality_weight FROM nation")
def k44(t):
    """A checked list of publishers from a JSON file."""
    key = F.col("n_nationkey")
    policy = F.struct(F.concat(F.lit("d"), key, F.lit(".org")).alias("domain"), F.array(F.when(key % 2 == 0, "zh").otherwise("en")).alias("languages"), (key / 25.0).alias("quality_weight"))
    path = written_text(t, t.nation.agg(F.to_json(F.collect_list(policy))).coalesce(1), "allowed")
    return policies.read_allow_list(t.spark, path).select("domain", F.element_at("languages", 1).alias("language"), "quality_weight")


def wire_events(t):
    """User events as version 5 of the contract."""
    kind = F.col("event_type")
    return t.user_events.where("event_type <> 'signup'").select(
        F.lit(5).alias("schema_version"), F.concat(F.lit("e"), "event_id").alias("event_id"), kind.alias("event_type"), "user_id", F.lit("mind").alias("source_space"), F.concat(F.lit("N"), "topic_id").alias("article_id"),
        F.lit(None).cast("string").alias("query_key"), F.lit("feed").alias("surface"), F.lit("api").alias("source"), "event_ts", F.when(kind == "dwell", F.least("dwell_ms", F.lit(contract.DAY_MS))).alias("dwell_ms"),
    )


@query("k56_wire_round_trip", with_views("user_events") + "SELECT event_type, count(*)::BIGINT AS n, sum(event_ts)::BIGINT AS ts FROM user_events WHERE event_type <> 'signup' GROUP BY 1")
def k56(t):
    """Events encoded as messages, decoded, checked and accepted."""
    good, _ = contract.accept(contract.encode(wire_events(t)))
    return good.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_ts").alias("ts"))


@query("k57_training_messages", with_views("user_events") + "SELECT 'e' || event_id AS event_id, CASE WHEN event_type = 'downvote' THEN 0 ELSE 1 END::INT AS label FROM user_events WHERE event_type IN ('recommendation_click', 'upvote', 'downvote')")
def k57(t):
    """What travels to training: labelled events about an article."""
    good, _ = contract.accept(contract.encode(wire_events(t)))
    return contract.training_labels(good).select("event_id", "label")


@query("k46_source_checkpoints", "SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'error')::BIGINT AS last_good, count(*) FILTER (WHERE event_type = 'error' AND event_id > coalesce(good, -1))::BIGINT AS failures FROM (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS good FROM events) GROUP BY user_id")
def k46(t):
    """Each source's last good batch, and the failures since."""
    good = F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).over(Window.partitionBy("user_id"))
    rows = t.events.select("user_id", "event_id", "event_type", good.alias("good"))
    return rows.groupBy("user_id").agg(F.max("good").alias("last_good"), F.count_if((F.col("event_type") == "error") & (F.col("event_id") > F.coalesce("good", F.lit(-1)))).alias("failures"))
