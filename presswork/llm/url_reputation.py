"""URL filter by rules and by the reputation of hosts, learnt with empirical-Bayes shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import letters_lowered, staged, table

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    return letters_lowered(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does. The rules are a short fixed list."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(F.concat(F.lit("."), host).endswith("." + h) & path.startswith(p), h + p, v) for v, h, p in ordered]
    name, verdict = (F.coalesce(*(F.when(fit, F.lit(x[i])) for fit, *x in fits)) if fits else F.lit(None).cast("string") for i in (0, 1))
    return name, verdict


def _spread(groups: DataFrame, parent: str) -> float:
    """The beta-binomial intra-class correlation of groups around their parents' means, by moments, in [0.01, 0.99]."""
    p = F.col("b") / F.col("n")
    per = groups.where("n > 0").groupBy(parent).agg(
        F.sum(F.col("n") * (p - F.col("m")) * (p - F.col("m")) / (F.col("m") * (1 - F.col("m")))).alias("s"),
        (F.count("*") - 1).alias("k"),
        (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("x"),
    )
    s, k, x = per.agg(F.sum("s"), F.sum("k"), F.sum("x")).first()
    if s is None or x - k <= 0:
        return 0.01
    return min(0.99, max(0.01, (s - k) / (x - k)))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Beta-binomial posterior of the share of bad pages of each host.

    pages: id, host. outcomes: id, bad (0 or 1), the labelled pages; of several labels of a page the worst counts.
    The prior of a host is centred on its registered domain (last two labels of the name), that of a domain on
    its suffix (last label), that of a suffix on all pages; how tightly is estimated from the labelled pages.
    Returns host, n, b, mean, lower: the posterior mean and the bound that lies z deviations below it. Hosts
    without a labelled page get what their domain or suffix says. Ports do not count as part of the name.
    """
    worst = outcomes.groupBy("id").agg(F.max("bad").cast("long").alias("bad"))
    name = F.regexp_replace("host", r":[0-9]*$", "")
    hosts = staged(
        pages.join(worst, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
        .withColumn("domain", F.substring_index(name, ".", -2)).withColumn("suffix", F.substring_index(name, ".", -1))
    )
    total, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    root = (bad + 1) / (total + 2)

    def posterior(level: DataFrame, rho: float) -> DataFrame:
        kappa = 1 / rho - 1
        return level.withColumn("post", (F.lit(kappa) * F.col("m") + F.col("b")) / (F.lit(kappa) + F.col("n")))

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).withColumn("m", F.lit(root)).withColumn("all", F.lit(1))
    suffixes = posterior(suffixes, _spread(suffixes, "all")).select("suffix", F.col("post").alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).join(suffixes, "suffix")
    domains = posterior(domains, _spread(domains, "suffix")).select("domain", F.col("post").alias("m"))
    leaves = hosts.join(domains, "domain")
    rho = _spread(leaves, "domain")
    size = F.lit(1 / rho - 1) + F.col("n")
    sd = F.sqrt(F.col("post") * (1 - F.col("post")) / (size + 1))
    return posterior(leaves, rho).select("host", "n", "b", F.col("post").alias("mean"), (F.col("post") - z * sd).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = 1.645, block_from: float = 0.5) -> DataFrame:
    """A verdict for each page: the longest fitting rule's, else block where even the lower posterior bound of its
    host's share of bad pages is above `block_from`, else allow.

    outcomes: (id, bad), which may be empty. A null url, or one without ://, has an empty host and path; such
    pages share one host. Rows are judged one by one, so repeated rows come back repeated. Returns the id, host,
    path, rule (null if none fits), verdict and lower (the bound). Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    reputation = host_reputation(rows.select("id", "host"), outcomes, z).select("host", "lower")
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("lower") > block_from, "block").otherwise("allow")
    return rows.join(reputation, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(ruled, learnt).alias("verdict"), "lower"
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are joined to pages by number: a page is bad if the label says low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _rho_sql(groups: str, parent: str) -> str:
    return f"""(SELECT CASE WHEN sum(s) IS NULL OR sum(x) - sum(k) <= 0 THEN 0.01 ELSE least(0.99, greatest(0.01, (sum(s) - sum(k)) / (sum(x) - sum(k)))) END
      FROM (SELECT sum(n * (b / n - m) * (b / n - m) / (m * (1 - m))) s, count(*) - 1 k, sum(n) - sum(n * n) / sum(n) x
            FROM {groups} WHERE n > 0 GROUP BY {parent}))"""


_FITS = " ".join(
    f"WHEN ('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2])))
)
_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP3_SQL = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL_PARTS}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '{URL_PARTS}', 2), '') AS path FROM pages),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b, regexp_replace(host, ':[0-9]*$', '') AS name FROM p LEFT JOIN o ON o.doc_id = p.page_id GROUP BY host),
h AS (SELECT *, array_to_string(list_slice(string_split(name, '.'), -2, NULL), '.') AS domain, string_split(name, '.')[-1] AS suffix FROM h0),
s0 AS (SELECT suffix, sum(n) n, sum(b) b, (SELECT (sum(b) + 1) / (sum(n) + 2) FROM h) AS m, 1 AS one FROM h GROUP BY suffix),
rs AS (SELECT 1 / {_rho_sql("s0", "one")} - 1 AS k),
s AS (SELECT suffix, (k * m + b) / (k + n) AS m FROM s0, rs),
d0 AS (SELECT domain, h.suffix, sum(n) n, sum(b) b, any_value(s.m) m FROM h JOIN s USING (suffix) GROUP BY domain, h.suffix),
rd AS (SELECT 1 / {_rho_sql("d0", "suffix")} - 1 AS k),
d AS (SELECT domain, (k * m + b) / (k + n) AS m FROM d0, rd),
l AS (SELECT h.*, d.m FROM h JOIN d USING (domain)),
rh AS (SELECT 1 / {_rho_sql("l", "domain")} - 1 AS k),
r AS (SELECT host, (k * m + b) / (k + n) AS post, k + n AS size FROM l, rh)
SELECT page_id, host, path, CASE {_FITS.format(*(f"'{h}{q}'" for _, h, q in _ORDERED))} END AS rule,
  CASE {_FITS.format(*(f"'{v}'" for v, _, _ in _ORDERED))} WHEN post - 1.645 * sqrt(post * (1 - post) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN r USING (host)
"""
