"""Projections, predicates, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import scores, text
from presswork.operators import ordered
from presswork.plans.bindings import with_views
from presswork.plans.registry import query

HOT = "hot AS (SELECT article_id, count(*)::BIGINT AS impressions, sum(clicked)::BIGINT AS clicks, (sum(clicked) * 10 + count(*))::BIGINT AS hot FROM impressions GROUP BY article_id)"


def item_counts(t, impressions=None):
    per = (t.impressions if impressions is None else impressions).groupBy("article_id").agg(F.count("*").alias("impressions"), F.sum("clicked").alias("clicks"))
    return per.withColumn("hot", scores.hot_score(F.col("clicks"), F.col("impressions")))


@query("p1_id_regex", "SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]+') AS valid, CASE WHEN regexp_full_match(c_name, 'Customer#[0-9]+') THEN regexp_extract(c_name, '#([0-9]+)', 1)::BIGINT END AS number FROM customer")
def p1(t):
    valid = F.col("c_name").rlike("^Customer#[0-9]+$")
    return t.customer.select("c_custkey", valid.alias("valid"), F.when(valid, F.regexp_extract("c_name", "#([0-9]+)$", 1).cast("long")).alias("number"))


CANDIDATES = "(SELECT 'N' || l_partkey || '-' || CASE WHEN l_returnflag = 'R' THEN '1' WHEN l_returnflag = 'A' THEN '0' ELSE 'x' END AS c FROM lineitem)"


@query("p2_candidate_decode", f"SELECT regexp_extract(c, '^(N[0-9]+)-([01])$', 1) AS news_id, CASE WHEN regexp_matches(c, '^N[0-9]+-[01]$') THEN regexp_extract(c, '^(N[0-9]+)-([01])$', 2)::INT END AS clicked, count(*)::BIGINT AS n FROM {CANDIDATES} GROUP BY ALL")
def p2(t):
    flag = F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "0").otherwise("x")
    c = F.concat(F.lit("N"), F.col("l_partkey"), F.lit("-"), flag)
    part = lambda k: F.regexp_extract(c, "^(N[0-9]+)-([01])$", k)
    return t.lineitem.select(part(1).alias("news_id"), F.when(part(2) != "", part(2).cast("int")).alias("clicked")).groupBy("news_id", "clicked").agg(F.count("*").alias("n"))


@query("p3_posexplode_candidates", with_views("impressions", more=(
    "a AS (SELECT request_id, list(article_id ORDER BY position, article_id) AS c FROM impressions GROUP BY request_id)",)) +
    "SELECT request_id, i::INT AS candidate_position, c[i + 1] AS article_id FROM a, range(0, len(c)) r(i)")
def p3(t):
    lists = t.impressions.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "article_id")))["article_id"].alias("c"))
    return lists.select("request_id", F.posexplode("c").alias("candidate_position", "article_id"))


@query("p4_request_projection", with_views("impressions") + "SELECT request_id, count(*)::BIGINT AS candidate_count, sum(clicked)::BIGINT AS positive_count FROM impressions GROUP BY request_id")
def p4(t):
    return t.impressions.groupBy("request_id").agg(F.count("*").alias("candidate_count"), F.sum("clicked").alias("positive_count"))


@query("p6_source_domain", r"SELECT page_id, coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', ''), ''), 'unknown-source') AS domain FROM pages")
def p6(t):
    return t.pages.select("page_id", text.source_domain(F.col("url")).alias("domain"))


_TRACKED = ", ".join(f"'{k}'" for k in text.TRACKING)


@query("f28_canonical_url", rf"""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS x FROM pages),
k AS (SELECT page_id, x, list_sort(list_filter(string_split(x.q, '&'), lambda p: p <> '' AND string_split(lower(p), '=')[1] NOT IN ({_TRACKED}))) AS ps FROM u)
SELECT page_id, lower(x.s) || '://' || lower(x.h) || x.p || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical FROM k""")
def f28(t):
    return t.pages.select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query("f29_article_id", "SELECT page_id, 'L' || substr(sha256(url), 1, 32) AS article_id FROM pages")
def f29(t):
    return t.pages.select("page_id", text.live_article_id(F.col("url")).alias("article_id"))


QUERY_NAMES = [("q1", "red"), ("q2", "small ring"), ("q3", "gear"), ("q4", "zzz"), ("q5", "blue w")]
QUERY_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in QUERY_NAMES) + ") v(query_id, query_text))"


@query("p12_match_cascade", with_views("articles", more=(QUERY_SQL,
    "m AS (SELECT query_id, article_id, CASE WHEN title = query_text THEN 1 WHEN starts_with(title, query_text) THEN 2 WHEN contains(title, query_text) THEN 3 END AS pass FROM articles, q)",
    "b AS (SELECT *, min(pass) OVER (PARTITION BY query_id) AS best FROM m WHERE pass IS NOT NULL)")) + "SELECT query_id, article_id, pass::INT AS pass FROM b WHERE pass = best")
def p12(t):
    """Exact, prefix or substring matches of the queries, whichever comes first with any."""
    queries = F.broadcast(t.spark.createDataFrame(QUERY_NAMES, "query_id string, query_text string"))
    title, q = F.col("title"), F.col("query_text")
    met = t.articles.join(queries, F.contains(title, q))
    met = met.withColumn("pass", F.when(title == q, 1).when(F.startswith(title, q), 2).otherwise(3))
    best = met.groupBy("query_id").agg(F.min("pass").alias("pass"))
    return met.join(F.broadcast(best), ["query_id", "pass"]).select("query_id", "article_id", "pass")


ALLOWED = [("example.com", 0.8), ("example.org", 0.6), ("net", 0.3)]


@query("p14_allow_list", r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN ('.' || host) LIKE '%.example.com' THEN 'example.com' WHEN ('.' || host) LIKE '%.example.org' THEN 'example.org' WHEN ('.' || host) LIKE '%.net' THEN 'net' END AS policy,
CASE WHEN ('.' || host) LIKE '%.example.com' THEN 0.8 WHEN ('.' || host) LIKE '%.example.org' THEN 0.6 WHEN ('.' || host) LIKE '%.net' THEN 0.3 END::DOUBLE AS quality FROM h""")
def p14(t):
    """First policy of the list whose domain is the host or above it."""
    host = F.concat(F.lit("."), F.lower(F.try_parse_url("url", F.lit("HOST"))))
    rows = t.pages.select("page_id", host.alias("host"))
    pick = lambda k: F.coalesce(*(F.when(F.endswith("host", F.lit("." + p[0])), F.lit(p[k])) for p in ALLOWED))
    return rows.select("page_id", pick(0).alias("policy"), pick(1).alias("quality"))


RULES = [(1, "keyword", "red", "prefer", True), (2, "keyword", "ring", "reduce", True), (3, "topic", "promo", "block", True), (4, "topic", "brand#3", "prefer", True), (5, "keyword", "blue", "block", False)]
RULES_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}', '{e}', {b})" for i, k, v, e, b in RULES) + ") v(rule_id, kind, value, effect, enabled))"
RULES_MET = "m AS (SELECT article_id, bool_or(effect = 'block') AS blocked, sum(CASE effect WHEN 'prefer' THEN 1.0 WHEN 'reduce' THEN -1.0 ELSE 0.0 END)::DOUBLE AS boost, string_agg(rule_id::VARCHAR, ',' ORDER BY rule_id) AS reasons " \
    "FROM articles JOIN r ON enabled AND CASE kind WHEN 'keyword' THEN contains(lower(title), value) ELSE value IN (lower(category), lower(subcategory)) END GROUP BY article_id)"


def rule_effects(articles, rules):
    """Per article: blocked, boost and the rules that matched. The rules of a user are few; they are broadcast."""
    hit = F.when(F.col("kind") == "keyword", F.contains(F.lower("title"), F.col("value"))).otherwise(F.col("value").isin(F.lower("category"), F.lower("subcategory")))
    met = articles.join(F.broadcast(rules.where("enabled")), hit)
    change = F.when(F.col("effect") == "prefer", 1.0).when(F.col("effect") == "reduce", -1.0).otherwise(0.0)
    return met.groupBy("article_id").agg(F.bool_or(F.col("effect") == "block").alias("blocked"), F.sum(change).alias("boost"), F.array_join(F.array_sort(F.collect_list("rule_id")).cast("array<string>"), ",").alias("reasons"))


def _rules(t):
    return t.spark.createDataFrame(RULES, "rule_id int, kind string, value string, effect string, enabled boolean")


@query("p17_rules_join", with_views("articles", more=(RULES_SQL, RULES_MET)) + "SELECT article_id, blocked, boost, reasons FROM m")
def p17(t):
    return rule_effects(t.articles, _rules(t))


@query("c19_rule_boost_rank", with_views("articles", "impressions", more=(HOT, RULES_SQL, RULES_MET,
    "s AS (SELECT article_id, coalesce(hot, 0) + 100 * coalesce(boost, 0.0) AS score FROM articles LEFT JOIN hot USING (article_id) LEFT JOIN m USING (article_id) WHERE NOT coalesce(blocked, false))")) +
    "SELECT article_id, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, article_id)::INT AS rank FROM s ORDER BY score DESC, article_id LIMIT 50")
def c19(t):
    effects = rule_effects(t.articles, _rules(t))
    rows = t.articles.select("article_id").join(item_counts(t), "article_id", "left").join(effects, "article_id", "left").where(~F.coalesce("blocked", F.lit(False)))
    rows = rows.select("article_id", (F.coalesce("hot", F.lit(0)) + 100 * F.coalesce("boost", F.lit(0.0))).alias("score"))
    top = rows.orderBy(F.col("score").desc(), "article_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "article_id")))


@query("p18_event_violations", with_views("user_events") + """SELECT event_id, CASE WHEN array_length(v) > 0 THEN array_to_string(v, ',') ELSE '' END AS violations FROM (SELECT event_id, list_filter([
 CASE WHEN event_type NOT IN ('recommendation_click', 'upvote', 'downvote', 'dwell') THEN 'event_type' END, CASE WHEN event_type = 'dwell' AND dwell_ms IS NULL THEN 'dwell_missing' END,
 CASE WHEN dwell_ms NOT BETWEEN 0 AND 86400000 THEN 'dwell_range' END, CASE WHEN event_type <> 'dwell' AND dwell_ms IS NOT NULL THEN 'dwell_unexpected' END, CASE WHEN topic_id IS NULL THEN 'topic' END], lambda x: x IS NOT NULL) AS v FROM user_events)""")
def p18(t):
    kind, dwell = F.col("event_type"), F.col("dwell_ms")
    checks = {"event_type": ~kind.isin("recommendation_click", "upvote", "downvote", "dwell"), "dwell_missing": (kind == "dwell") & dwell.isNull(), "dwell_range": ~dwell.between(0, 86_400_000), "dwell_unexpected": (kind != "dwell") & dwell.isNotNull(), "topic": F.col("topic_id").isNull()}
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return t.user_events.select("event_id", F.array_join(broken, ",").alias("violations"))


@query("p19_schema_migrate", with_views("user_events") + "SELECT event_id, 5 AS schema_version, coalesce(CASE WHEN event_id % 4 >= 1 THEN 'live' END, 'mind') AS source_space, CASE WHEN event_id % 4 = 0 THEN 'N' || topic_id ELSE 'L' || topic_id END AS article_id FROM user_events")
def p19(t):
    """Versions 2 to 5 (here by id) to 5: old ones have no space and plain article ids."""
    version = F.col("event_id") % 4 + 2
    return t.user_events.select("event_id", F.lit(5).alias("schema_version"), F.when(version >= 3, "live").otherwise("mind").alias("source_space"), F.concat(F.when(version == 2, "N").otherwise("L"), F.col("topic_id")).alias("article_id"))


@query("p20_body_gates", r"""SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 300 THEN 'too_short' WHEN length(text) > 200000 THEN 'too_long'
 WHEN lang = 'en' AND (len(regexp_extract_all(text, '[A-Za-z]')) < 50 OR len(regexp_extract_all(text, '[㐀-鿿]')) > greatest(20, len(regexp_extract_all(text, '[A-Za-z]')) // 2)) THEN 'language_mismatch' END AS problem FROM documents""")
def p20(t):
    return t.documents.select("doc_id", text.body_problem(F.col("text"), F.col("lang")).alias("problem"))


@query("p23_link_state", "WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) "
    "SELECT event_id, (CASE WHEN bad THEN count(CASE WHEN bad THEN 1 END) OVER (PARTITION BY user_id, g ORDER BY event_id) ELSE 0 END)::BIGINT AS failures, (bad AND count(CASE WHEN bad THEN 1 END) OVER (PARTITION BY user_id, g ORDER BY event_id) >= 3) AS inactive FROM e")
def p23(t):
    """Consecutive failures of each link so far; three make it inactive."""
    bad = F.col("event_type") == "error"
    rows = t.events.select("user_id", "event_id", bad.alias("bad")).withColumn("g", F.sum((~F.col("bad")).cast("int")).over(Window.partitionBy("user_id").orderBy("event_id")))
    failures = F.when(F.col("bad"), F.count_if("bad").over(Window.partitionBy("user_id", "g").orderBy("event_id"))).otherwise(0)
    return rows.select("event_id", failures.alias("failures"), (failures >= 3).alias("inactive"))


@query("j1_left_article", with_views("articles", "impressions") + "SELECT category, count(*)::BIGINT AS impressions, sum(clicked)::BIGINT AS clicks, count(a.article_id)::BIGINT AS matched FROM impressions i LEFT JOIN articles a ON a.article_id = i.article_id GROUP BY category")
def j1(t):
    a = t.articles.select("article_id", "category", F.lit(1).alias("hit"))
    return t.impressions.join(a, "article_id", "left").groupBy("category").agg(F.count("*").alias("impressions"), F.sum("clicked").alias("clicks"), F.count("hit").alias("matched"))


@query("j3_semi_topic", with_views("articles", "impressions") + "SELECT request_id, count(*)::BIGINT AS n FROM impressions i WHERE EXISTS (SELECT 1 FROM articles a WHERE a.article_id = i.article_id AND a.category = 'PROMO') GROUP BY request_id")
def j3(t):
    return t.impressions.join(t.articles.where("category = 'PROMO'"), "article_id", "left_semi").groupBy("request_id").agg(F.count("*").alias("n"))


@query("j4_anti_seen", with_views("articles", "impressions") + "SELECT article_id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM impressions i WHERE i.article_id = a.article_id AND i.clicked = 1)")
def j4(t):
    return t.articles.select("article_id").join(t.impressions.where("clicked = 1"), "article_id", "left_anti")


@query("j5_lateral_unnest", "SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w")
def j5(t):
    return t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("j6_topic_match_sum", with_views("articles", "impressions", more=(HOT,)) + "SELECT category, subcategory, sum(hot)::BIGINT AS hot_sum, max(hot)::BIGINT AS hot_max, count(*)::BIGINT AS n FROM articles JOIN hot USING (article_id) GROUP BY ALL")
def j6(t):
    return t.articles.join(item_counts(t), "article_id").groupBy("category", "subcategory").agg(F.sum("hot").alias("hot_sum"), F.max("hot").alias("hot_max"), F.count("*").alias("n"))


@query("j8_left_state_coalesce", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS served, coalesce(spend, 0.0)::DOUBLE AS spend FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, round(sum(o_totalprice), 2) spend FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def j8(t):
    state = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("served"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return t.customer.select("c_custkey").join(state, "c_custkey", "left").select("c_custkey", F.coalesce("served", F.lit(0)).alias("served"), F.coalesce("spend", F.lit(0.0)).alias("spend"))


STAGE = "stage AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_brand || '*' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey + 1000000, p_brand FROM part WHERE p_partkey % 50 = 0)"


@query("j9_full_outer_diff", f"WITH {STAGE} SELECT coalesce(a.p_partkey, b.p_partkey) AS article_id, CASE WHEN a.p_partkey IS NULL THEN 'insert' WHEN b.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS change FROM part a FULL JOIN stage b ON a.p_partkey = b.p_partkey WHERE a.p_brand IS DISTINCT FROM b.p_brand")
def j9(t):
    old = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("old"), F.lit(True).alias("was"))
    changed = t.part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 7 == 0, F.concat("p_brand", F.lit("*"))).otherwise(F.col("p_brand")).alias("new"))
    new = changed.unionByName(t.part.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 1000000).alias("k"), F.col("p_brand").alias("new"))).withColumn("is_", F.lit(True))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("is_").isNull(), "delete").otherwise("update")
    return old.join(new, "k", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("k").alias("article_id"), change.alias("change"))


@query("j10_anti_delete", f"WITH {STAGE} SELECT p_partkey FROM part WHERE p_partkey IN (SELECT p_partkey FROM stage)")
def j10(t):
    """What is left once rows absent from the stage are deleted: a snapshot rewritten by a semi join."""
    stage = t.part.where("p_partkey % 11 <> 0").select("p_partkey").unionByName(t.part.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 1_000_000).alias("p_partkey")))
    return t.part.select("p_partkey").join(stage, "p_partkey", "left_semi")


@query("j16_asof_counts", with_views("impressions", more=("c AS (SELECT article_id, count(*) FILTER (WHERE event_ts < 900000000)::BIGINT AS impressions, coalesce(sum(clicked) FILTER (WHERE event_ts < 900000000), 0)::BIGINT AS clicks FROM impressions GROUP BY article_id)",)) + "SELECT *, (clicks * 10 + impressions)::BIGINT AS hot FROM c")
def j16(t):
    before = F.col("event_ts") < 900_000_000
    per = t.impressions.groupBy("article_id").agg(F.count_if(before).alias("impressions"), F.coalesce(F.sum(F.when(before, F.col("clicked"))), F.lit(0)).alias("clicks"))
    return per.withColumn("hot", scores.hot_score(F.col("clicks"), F.col("impressions")))


@query("j17_library", "SELECT c_custkey, n_name, n_nationkey IS NOT NULL AS available FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = c_nationkey")
def j17(t):
    nations = t.nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.lit(True).alias("hit"))
    return t.customer.join(nations, "c_nationkey", "left").select("c_custkey", "n_name", F.coalesce("hit", F.lit(False)).alias("available"))


@query("a1_split_summary", with_views("impressions") + "SELECT CASE WHEN event_ts < 900000000 THEN 'train' ELSE 'dev' END AS split, count(*)::BIGINT AS candidates, sum(clicked)::BIGINT AS positives, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT request_id)::BIGINT AS requests, min(event_ts)::BIGINT AS first_ts FROM impressions GROUP BY 1")
def a1(t):
    split = F.when(F.col("event_ts") < 900_000_000, "train").otherwise("dev").alias("split")
    return t.impressions.groupBy(split).agg(F.count("*").alias("candidates"), F.sum("clicked").alias("positives"), F.countDistinct("user_id").alias("users"), F.countDistinct("request_id").alias("requests"), F.min("event_ts").alias("first_ts"))


@query("a2_category_hist", with_views("articles") + "SELECT category, count(*)::BIGINT AS n FROM articles WHERE trim(category) <> '' GROUP BY category ORDER BY n DESC, category")
def a2(t):
    return t.articles.where(F.trim("category") != "").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "category")


@query("a4_item_stats", with_views("articles", "impressions", more=(HOT,)) + "SELECT article_id, coalesce(clicks, 0)::BIGINT AS clicks, coalesce(impressions, 0)::BIGINT AS impressions, round(ln(1 + coalesce(clicks, 0)) + coalesce(clicks::DOUBLE / impressions, 0.0), 6) AS hot FROM articles LEFT JOIN hot USING (article_id)")
def a4(t):
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = t.articles.select("article_id").join(item_counts(t), "article_id", "left")
    return rows.select("article_id", zero("clicks").alias("clicks"), zero("impressions").alias("impressions"), F.round(scores.catalog_hot_score(zero("clicks"), zero("impressions")), 6).alias("hot"))


@query("a6_category_share", with_views("articles") + "SELECT category, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM articles GROUP BY category")
def a6(t):
    return t.articles.groupBy("category").agg(F.count("*").alias("n")).select("category", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


HISTORY = "h AS (SELECT user_id, category, count(*) AS n FROM impressions JOIN articles USING (article_id) WHERE clicked = 1 GROUP BY ALL)"


@query("a7_history_profile", with_views("articles", "impressions", more=(HISTORY,)) + "SELECT user_id, category, round(n::DOUBLE / sum(n) OVER (PARTITION BY user_id), 6) AS weight, sum(n) OVER (PARTITION BY user_id)::BIGINT AS history_length FROM h")
def a7(t):
    return user_profile(t).select("user_id", "category", F.round("weight", 6).alias("weight"), "history_length")


def user_profile(t):
    per = t.impressions.where("clicked = 1").join(t.articles, "article_id").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return per.select("user_id", "category", (F.col("n") / total).alias("weight"), total.alias("history_length"))


@query("a8_distribution", "SELECT l_returnflag, count(*)::BIGINT AS n, min(l_quantity) AS least, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def a8(t):
    q = lambda f: F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY l_quantity)")
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("a9_percentile", "SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_linestatus")
def a9(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.percentile("l_extendedprice", 0.5), 6).alias("p50"), F.round(F.percentile("l_extendedprice", 0.95), 6).alias("p95"))


@query("a11_ctr_quantiles", with_views("impressions", more=(HOT, "c AS (SELECT clicks::DOUBLE / impressions AS ctr FROM hot)")) + "SELECT f AS fraction, round(CASE f WHEN 0.0 THEN quantile_cont(ctr, 0.0) WHEN 0.25 THEN quantile_cont(ctr, 0.25) WHEN 0.5 THEN quantile_cont(ctr, 0.5) WHEN 0.75 THEN quantile_cont(ctr, 0.75) WHEN 0.95 THEN quantile_cont(ctr, 0.95) ELSE quantile_cont(ctr, 1.0) END, 6) AS ctr FROM c, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (0.95), (1.0)) v(f) GROUP BY f")
def a11(t):
    points = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    q = item_counts(t).agg(F.percentile(F.col("clicks") / F.col("impressions"), points).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*map(F.lit, points)).alias("fraction"), F.col("q").alias("ctr"))).alias("x")).select("x.fraction", F.round("x.ctr", 6).alias("ctr"))


@query("a12_exposure_share", with_views("impressions", more=(HOT, "r AS (SELECT impressions, row_number() OVER (ORDER BY impressions DESC, article_id) AS k, count(*) OVER () AS n FROM hot)")) + "SELECT round(sum(impressions) FILTER (WHERE k <= greatest(1, round_even(n * 0.01, 0)))::DOUBLE / sum(impressions), 6) AS top_1, round(sum(impressions) FILTER (WHERE k <= greatest(1, round_even(n * 0.1, 0)))::DOUBLE / sum(impressions), 6) AS top_10 FROM r")
def a12(t):
    """Share of impressions of the most shown 1 % and 10 % of articles, from the histogram of counts (ties count in part)."""
    per = item_counts(t).groupBy("impressions").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.orderBy(F.col("impressions").desc()))  # one row for each distinct count
    per = per.withColumn("upto", upto).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(1))))

    def share(f):
        place = F.greatest(F.lit(1), F.bround(F.col("n") * f))
        inside = F.greatest(F.lit(0), F.least(F.col("k"), place - F.col("upto") + F.col("k")))
        return F.round(F.sum(F.col("impressions") * inside) / F.sum(F.col("impressions") * F.col("k")), 6)

    return per.agg(share(0.01).alias("top_1"), share(0.1).alias("top_10"))


@query("a13_overlap", "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT (SELECT count(*) FROM a)::BIGINT AS n_left, (SELECT count(*) FROM b)::BIGINT AS n_right, (SELECT count(*) FROM a JOIN b USING (o_custkey))::BIGINT AS n_both")
def a13(t):
    per = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "P").alias("b"))
    return per.agg(F.count_if("a").alias("n_left"), F.count_if("b").alias("n_right"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))


@query("a14_blank_ratio", "SELECT round(avg(CASE WHEN trim(coalesce(text, '')) = '' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS text_blank, round(avg(CASE WHEN trim(coalesce(lang, '')) = '' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS lang_blank FROM documents")
def a14(t):
    blank = lambda c: F.round(F.avg((F.trim(F.coalesce(c, F.lit(""))) == "").cast("double")), 6)
    return t.documents.agg(blank("text").alias("text_blank"), blank("lang").alias("lang_blank"))


@query("a15_order_anomaly", "WITH e AS (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events) SELECT user_id, count(*) FILTER (WHERE back)::BIGINT AS anomalies FROM e GROUP BY user_id")
def a15(t):
    back = F.col("value") < F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", back.alias("back")).groupBy("user_id").agg(F.count_if("back").alias("anomalies"))


@query("a20_listagg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY n_regionkey")
def a20(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query("a21_status_counts", "SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def a21(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("a22_watermark", with_views("user_events") + "SELECT user_id, max(greatest(event_ts, coalesce(event_ts + dwell_ms // 1000, event_ts)))::BIGINT AS watermark FROM user_events GROUP BY user_id")
def a22(t):
    end = F.greatest("event_ts", F.col("event_ts") + F.floor(F.col("dwell_ms") / 1000))
    return t.user_events.groupBy("user_id").agg(F.max(end).alias("watermark"))


@query("a23_zero_fill_counts", "SELECT r_name, coalesce(n, 0)::BIGINT AS n FROM region LEFT JOIN (SELECT n_regionkey, count(*) n FROM nation WHERE n_nationkey % 5 <> 2 AND n_regionkey <> 3 GROUP BY 1) ON n_regionkey = r_regionkey")
def a23(t):
    per = t.nation.where("n_nationkey % 5 <> 2 AND n_regionkey <> 3").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return t.region.join(F.broadcast(per), "r_regionkey", "left").select("r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("a28_reason_counts", "SELECT CASE WHEN length(coalesce(text, '')) < 300 THEN 'too_short' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def a28(t):
    reason = F.when(F.length(F.coalesce("text", F.lit(""))) < 300, "too_short").otherwise("kept")
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("w1_hot_rank", with_views("impressions", more=(HOT,)) + "SELECT article_id, hot, row_number() OVER (ORDER BY hot DESC, article_id)::INT AS rank FROM hot ORDER BY hot DESC, article_id LIMIT 200")
def w1(t):
    order = [F.col("hot").desc(), "article_id"]
    return item_counts(t).select("article_id", "hot").orderBy(*order).limit(200).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("w2_prior_counts", with_views("impressions") + "SELECT request_id, article_id, (count(*) OVER w)::BIGINT AS prior_impressions, coalesce(sum(clicked) OVER w, 0)::BIGINT AS prior_clicks FROM impressions WINDOW w AS (PARTITION BY article_id ORDER BY event_ts, request_id, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w2(t):
    return ordered.prior_counts(t.impressions, "article_id", ["event_ts", "request_id", "position"]).select("request_id", "article_id", "prior_impressions", "prior_clicks")


@query("w3_chrono_split", with_views("requests", more=("n AS (SELECT count(*) AS n FROM requests)", "c AS (SELECT event_ts AS cutoff FROM (SELECT event_ts, row_number() OVER (ORDER BY event_ts) - 1 AS i FROM requests), n WHERE i = least(greatest(round_even(n * 0.8, 0), 1), n - 1))")) + "SELECT CASE WHEN event_ts < cutoff THEN 'train' ELSE 'test' END AS split, count(*)::BIGINT AS n, min(event_ts)::BIGINT AS first_ts, max(event_ts)::BIGINT AS last_ts FROM requests, c GROUP BY 1")
def w3(t):
    cutoff = ordered.chronological_cutoff(t.requests, 0.8)
    split = F.when(F.col("event_ts") < cutoff, "train").otherwise("test")
    return t.requests.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


@query("w6_islands", "WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(ch::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e) SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*)::BIGINT AS size FROM i GROUP BY ALL")
def w6(t):
    return ordered.islands(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type").groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("size"))


@query("w10_confirm_query", "WITH q AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') SELECT event_id, (SELECT max(q.event_id) FROM q WHERE q.user_id = c.user_id AND q.ts <= c.ts) AS query_id FROM c")
def w10(t):
    """The latest query of the user at the time of each click."""
    clicks = t.events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    asked = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("query_id"))
    return ordered.as_of(clicks, asked, ["user_id"], "ts", "ts", ["query_id"]).select("event_id", "query_id")


@query("w11_recent_queries", with_views("user_events", more=("d AS (SELECT user_id, topic_id, max(event_id) AS event_id FROM user_events GROUP BY ALL)",)) + "SELECT user_id, topic_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM d) WHERE rank <= 5")
def w11(t):
    return ordered.latest_k(t.user_events, "user_id", "event_id", "topic_id", 5, True, "event_id").select("user_id", "topic_id", "rank")


@query("w11_recent_clicks", with_views("user_events") + "SELECT user_id, event_id, topic_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM user_events WHERE event_type = 'recommendation_click') WHERE rank <= 10")
def w11b(t):
    return ordered.latest_k(t.user_events.where("event_type = 'recommendation_click'"), "user_id", "event_id", "topic_id", 10, False, "event_id").select("user_id", "event_id", "topic_id", "rank")


@query("w15_distinct_on", with_views("articles", "impressions", more=(HOT,)) + "SELECT DISTINCT ON (category) category, article_id FROM articles JOIN hot USING (article_id) ORDER BY category, article_id")
def w15(t):
    return t.articles.join(item_counts(t), "article_id").groupBy("category").agg(F.min("article_id").alias("article_id"))


@query("l1_topk_hot", with_views("articles", "impressions", more=(HOT,)) + "SELECT category, article_id, hot, rank::INT AS rank FROM (SELECT category, article_id, hot, row_number() OVER (PARTITION BY category ORDER BY hot DESC, article_id) AS rank FROM articles JOIN hot USING (article_id)) WHERE rank <= 20")
def l1(t):
    return ordered.top_per_group(t.articles.join(item_counts(t), "article_id"), ["category"], [F.col("hot").desc(), "article_id"], 20).select("category", "article_id", "hot", "rank")


@query("l3_md5_sample", "SELECT p_partkey FROM part ORDER BY md5(p_partkey::VARCHAR || 'seed-7'), p_partkey LIMIT 40")
def l3(t):
    return ordered.hashed_sample(t.part.select("p_partkey"), "p_partkey", "seed-7", 40)


@query("l4_unseen_page", with_views("articles", "impressions") + "SELECT article_id FROM articles WHERE article_id NOT IN (SELECT article_id FROM impressions WHERE user_id < 50) ORDER BY md5(article_id::VARCHAR || 's'), article_id LIMIT 30")
def l4(t):
    unseen = t.articles.select("article_id").join(t.impressions.where("user_id < 50"), "article_id", "left_anti")
    return ordered.hashed_sample(unseen, "article_id", "s", 30)


@query("l10_slot_blend", with_views("impressions", more=(
    "o AS (SELECT request_id, article_id, row_number() OVER (PARTITION BY request_id ORDER BY position, article_id) AS rank FROM impressions)",
    "ads AS (SELECT DISTINCT request_id, 2 AS slot, -1 AS item FROM impressions WHERE request_id % 3 = 0)",
    "p AS (SELECT r.request_id, g.position, ads.item AS ad, sum(CASE WHEN ads.item IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r.request_id ORDER BY g.position) AS k FROM (SELECT DISTINCT request_id FROM impressions) r, range(1, 7) g(position) LEFT JOIN ads ON ads.request_id = r.request_id AND ads.slot = g.position)",
    "f AS (SELECT p.request_id, p.position, p.ad, o.article_id, min(CASE WHEN p.ad IS NULL AND o.article_id IS NULL THEN p.position END) OVER (PARTITION BY p.request_id) AS gap FROM p LEFT JOIN o ON p.ad IS NULL AND o.request_id = p.request_id AND o.rank = p.k)")) +
    "SELECT request_id, position::INT AS position, coalesce(ad, article_id)::BIGINT AS item, ad IS NOT NULL AS is_sponsored FROM f WHERE gap IS NULL OR position < gap")
def l10(t):
    rows = t.dealt_impressions()
    organic = rows.select("request_id", F.col("article_id").alias("item"), F.row_number().over(Window.partitionBy("request_id").orderBy("position", "article_id")).alias("rank"))
    ads = rows.where("request_id % 3 = 0").select("request_id").distinct().select("request_id", F.lit(-1).cast("long").alias("item"), F.lit(2).alias("slot"))
    return ordered.blend_slots(organic, ads, "request_id", 6)


@query("l14_snapshot_page", with_views("impressions", more=("s AS (SELECT request_id, list(article_id ORDER BY position, article_id) AS items FROM impressions GROUP BY request_id)",)) + "SELECT request_id, array_to_string(items[3:4], ',') AS page, len(items) > 4 AS has_more FROM s")
def l14(t):
    lists = t.impressions.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "article_id")))["article_id"].alias("items"))
    return lists.select("request_id", F.array_join(F.slice("items", 3, 2).cast("array<string>"), ",").alias("page"), (F.size("items") > 4).alias("has_more"))


@query("l15_offset_lookahead", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 21 OFFSET 40")
def l15(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").offset(40).limit(21).select("c_custkey")


@query("l18_nulls_first", with_views("user_events", more=("c AS (SELECT topic_id, max(dwell_ms) FILTER (WHERE topic_id % 3 <> 0) AS last_checked FROM user_events GROUP BY topic_id)",)) + "SELECT topic_id, last_checked FROM c ORDER BY last_checked ASC NULLS FIRST, topic_id LIMIT 10")
def l18(t):
    per = t.user_events.groupBy("topic_id").agg(F.max(F.when(F.col("topic_id") % 3 != 0, F.col("dwell_ms"))).alias("last_checked"))
    return per.orderBy(F.col("last_checked").asc_nulls_first(), "topic_id").limit(10)


@query("u1_union_priority", "WITH u AS (SELECT o_custkey AS k, 0 AS priority, o_orderkey AS v FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT k, priority::INT AS priority, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, v) AS r FROM u) WHERE r = 1")
def u1(t):
    side = lambda s, p: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"), F.lit(p).alias("priority"), F.col("o_orderkey").alias("v"))
    first = side("P", 0).unionByName(side("F", 1)).groupBy("k").agg(F.min(F.struct("priority", "v")).alias("x"))
    return first.select("k", "x.*")


TOPICS = "k AS (SELECT DISTINCT 'category:' || category AS topic_key FROM articles UNION SELECT DISTINCT 'subcategory:' || category || '/' || subcategory FROM articles)"


@query("u3_topic_dim", with_views("articles", more=(TOPICS,)) + "SELECT topic_key, row_number() OVER (ORDER BY topic_key)::INT AS topic_id FROM k")
def u3(t):
    return topic_dimension(t)


def topic_dimension(t):
    """Topics numbered from 1 in order of their keys; there are few."""
    keys = t.articles.select(F.explode(F.array(F.concat(F.lit("category:"), "category"), F.concat(F.lit("subcategory:"), "category", F.lit("/"), "subcategory"))).alias("topic_key")).distinct()
    return keys.withColumn("topic_id", F.row_number().over(Window.orderBy("topic_key")))


@query("k36_article_topics", with_views("articles", more=(TOPICS, "d AS (SELECT topic_key, row_number() OVER (ORDER BY topic_key)::INT AS topic_id FROM k)", "b AS (SELECT article_id, 0 AS source_rank, 'category:' || category AS topic_key FROM articles UNION ALL SELECT article_id, 1, 'subcategory:' || category || '/' || subcategory FROM articles)")) + "SELECT article_id, source_rank::INT AS source_rank, topic_id FROM b JOIN d USING (topic_key)")
def k36(t):
    pairs = t.articles.select("article_id", F.posexplode(F.array(F.concat(F.lit("category:"), "category"), F.concat(F.lit("subcategory:"), "category", F.lit("/"), "subcategory"))).alias("source_rank", "topic_key"))
    return pairs.join(topic_dimension(t), "topic_key").select("article_id", "source_rank", "topic_id")


@query("u4_except", "SELECT DISTINCT l_partkey FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def u4(t):
    return t.lineitem.select("l_partkey").subtract(t.lineitem.where("l_returnflag = 'R'").select("l_partkey"))


@query("u5_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u5(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(t.orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("k25_state_defaults", "SELECT c_custkey, coalesce(saved, false) AS saved, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS saved, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey")
def k25(t):
    state = t.orders.where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("saved"), F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(state, "c_custkey", "left").select("c_custkey", F.coalesce("saved", F.lit(False)).alias("saved"), F.coalesce("n", F.lit(0)).alias("n"))


@query("s22_content_fingerprint", "SELECT count(*)::BIGINT AS n, sum(('0x' || substr(md5(l_orderkey || '|' || l_partkey || '|' || l_linenumber || '|' || l_returnflag), 1, 8))::BIGINT)::VARCHAR AS fingerprint FROM lineitem")
def s22(t):
    """A fingerprint of rows that does not depend on their order or on files."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")), 1, 8), 16, 10).cast("long")
    return t.lineitem.agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("fingerprint"))
