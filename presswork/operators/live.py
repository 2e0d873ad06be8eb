"""Live news: record classification, near-duplicate titles, diversified lists, topics and page structure."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions import text
from presswork.sources.logs import staged

#: Fixed value: titles of pages that are no articles.
INVALID_TITLE = r"(?i)^(404|page\s+expired|not\s+found|access\s+denied)\b"
#: Fixed value: path segments of listings.
LISTINGS = ("tag", "tags", "topic", "topics", "category", "categories", "series")
DAY = 86_400
SAME_TITLE = 0.92


def rejection_reason(url: Column, host: Column, allowed: Column, language: Column, title: Column, age_seconds: Column, max_age: int = 72 * 3600, future: int = 1800) -> Column:
    """The first rule that a record breaks, in the order in which they are checked; null if it breaks none.

    allowed: the languages of the policy of the record's host, null if there is none.
    """
    valid = F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))
    listing = F.exists(F.split(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), "/"), lambda s: F.lower(s).isin(*LISTINGS))
    clean = F.trim(F.coalesce(title, F.lit("")))
    return (
        F.when(~valid, "invalid_metadata").when(allowed.isNull(), "domain_not_allowed")
        .when(~F.coalesce(F.array_contains(allowed, F.lower(F.trim(language))), F.lit(False)), "unsupported_language")
        .when(clean == "", "missing_title").when(clean.rlike(INVALID_TITLE) | listing, "invalid_page")
        .when((age_seconds > max_age) | (age_seconds < -future), "stale_article")
    )


def title_classes(articles: DataFrame, window: int = DAY) -> DataFrame:
    """Articles of the same plain title and time slot as one class: rep (the smallest id), plain, slot, first and last
    time, size. Slots are `window` long, so any two members of a class are close enough in time."""
    rows = articles.select("id", "discovered_at", text.plain_title(F.col("title")).alias("plain"), F.floor(F.col("discovered_at") / window).alias("slot"))
    return rows.where("plain <> '' AND slot IS NOT NULL").groupBy("plain", "slot").agg(F.min("id").alias("rep"), F.min("discovered_at").alias("first"), F.max("discovered_at").alias("last"), F.count("*").alias("size"))


def near_title_pairs(articles: DataFrame, threshold: float = SAME_TITLE, window: int = DAY) -> DataFrame:
    """Links (a, b, similarity, same) of articles within `window` seconds whose title trigrams are that alike.

    Articles: id, title, discovered_at. Articles of one title and slot are a class; its members are linked to the
    smallest of them (same), and classes by these where any two of their members are close enough in time. So copies
    give no pair for each two of them, and no link between different titles is lost. Candidates share a rare
    trigram: of the sorted-by-rarity trigrams of a title, two that alike must share one of the first
    n - ceil(threshold * n) + 1. Only hashes, sizes and times are joined on these; titles come in for the pairs that
    are left, and are cut into trigrams once for each. Articles without a title or time take no part.
    """
    classes = staged(title_classes(articles, window), "title-classes")  # read six times
    members = _members(articles, classes, window).where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(True).alias("same")).distinct()
    return _class_links(classes, threshold, window).withColumn("same", F.lit(False)).unionByName(members)


def all_near_title_pairs(articles: DataFrame, threshold: float = SAME_TITLE, window: int = DAY) -> DataFrame:
    """Every pair (a, b, similarity), a < b, of articles within `window` seconds whose title trigrams are that alike.

    Titles are compared once for each two classes, as in near_title_pairs; the links of classes, and each class with
    itself, are then spread over their members, whose times decide. So the work grows with the pairs that are there.
    """
    classes = staged(title_classes(articles, window), "title-classes")
    own = classes.where("size > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    links = staged(_class_links(classes, threshold, window).unionByName(own), "title-links")  # so that their number is known to the joins
    members = _members(articles, classes, window)
    side = lambda s: members.select(F.col("rep").alias(s), F.col("id").alias(f"id_{s}"), F.col("discovered_at").alias(f"t_{s}"))
    pairs = links.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(((F.col("a") != F.col("b")) | (F.col("id_a") < F.col("id_b"))) & (F.abs(F.col("t_a") - F.col("t_b")) <= window))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")


def _members(articles: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """rep, id and discovered_at of the articles of each class."""
    rows = articles.select("id", "discovered_at", text.plain_title(F.col("title")).alias("plain"), F.floor(F.col("discovered_at") / window).alias("slot"))
    return rows.join(classes.select("plain", "slot", "rep"), ["plain", "slot"]).select("rep", "id", "discovered_at")


def _class_links(classes: DataFrame, threshold: float, window: int) -> DataFrame:
    """(a, b, similarity) of any two classes that near_title_pairs links."""
    grams = lambda plain: F.array_distinct(F.transform(text.trigrams(plain), lambda g: F.xxhash64(g)))
    each = classes.select("rep", F.posexplode(grams(F.col("plain"))).alias("_", "gram"))
    rarity = each.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = Window.partitionBy("rep").orderBy("df", "gram")
    n = F.count("*").over(Window.partitionBy("rep"))
    ranked = each.join(rarity, "gram").select("rep", "gram", F.row_number().over(ordered).alias("k"), n.alias("n"))
    prefix = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    keyed = prefix.select("rep", "gram", "n").join(classes.select("rep", "slot", "first", "last"), "rep")
    left = keyed.select(F.col("rep").alias("rep_a"), "gram", F.col("n").alias("n_a"), F.col("slot").alias("slot_a"), F.col("last").alias("last_a"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    right = keyed.select(F.col("rep").alias("rep_b"), "gram", F.col("n").alias("n_b"), "slot", F.col("first").alias("first_b"))
    alike = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))
    close = F.when(F.col("slot_a") == F.col("slot"), F.col("rep_a") < F.col("rep_b")).otherwise(F.col("first_b") - F.col("last_a") <= window)
    met = left.join(right, ["gram", "slot"]).where(alike & close).select("rep_a", "rep_b", (F.col("n_a") + F.col("n_b")).alias("n")).distinct()
    titles = lambda side: classes.select(F.col("rep").alias(f"rep_{side}"), F.col("plain").alias(f"plain_{side}"))
    pairs = met.join(titles("a"), "rep_a").join(titles("b"), "rep_b")
    shared = F.size(F.array_intersect(text.trigrams(F.col("plain_a")), text.trigrams(F.col("plain_b"))))
    pairs = pairs.where(shared * (1 + threshold) >= threshold * F.col("n") - 1e-6)
    similarity = text.jaccard(text.trigrams(F.col("plain_a")), text.trigrams(F.col("plain_b")))
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def _grams(title: str) -> set[str]:
    flat = "".join(c for c in title.lower() if c.isalnum())
    return {flat[i : i + 3] for i in range(len(flat) - 2)} if len(flat) >= 3 else {flat} - {""}


def _alike(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def diversify(candidates: DataFrame, limit: int, group: str = "request_id") -> DataFrame:
    """A list per request: best score first, but no publisher three times in a row, no title like the one before, and
    every language of the candidates before the list ends. If nothing fits, the best that is left.

    candidates: request, article_id, score, discovered_at, publisher, language, title: a request's worth each.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "discovered_at", "article_id"], ascending=[False, False, True])
        left = list(zip(rows["article_id"], rows["publisher"], rows["language"], (_grams(t or "") for t in rows["title"]), strict=True))
        wanted, out = set(rows["language"]), []
        while left and len(out) < limit:
            missing = wanted - {x[2] for x in out}
            tail = bool(missing) and len(out) + len(missing) >= limit
            pick = 0
            for i, (_, publisher, language, grams) in enumerate(left):
                row = len(out) >= 2 and out[-1][1] == publisher == out[-2][1]
                if not row and not (out and _alike(out[-1][3], grams) >= SAME_TITLE) and not (tail and language not in missing):
                    pick = i
                    break
            out.append(left.pop(pick))
        return pd.DataFrame({group: rows[group].iloc[0], "article_id": [x[0] for x in out], "rank": range(1, len(out) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, article_id {kinds['article_id']}, rank int")


PROTOTYPES = 4096


def classify_topics(vectors: DataFrame, prototypes: DataFrame, threshold: float = 0.7, margin: float = 0.025, most: int = 3, general: int = 1_000_014) -> DataFrame:
    """Up to three topics per article: similarity to a prototype above the threshold and within the margin of the
    best; the general topic where there is none.

    vectors: id, vec, keyword (topic -> share of its keywords met, may be null). prototypes: topic_id, proto: the
    taxonomy. A block of about PROTOTYPES of it is broadcast as one array at a time, and each vector keeps its best of a
    block in its own row, so no pair of a vector and a prototype is ever a row.
    """
    blocks, best = -(-prototypes.count() // PROTOTYPES) or 1, None
    for block in range(blocks):
        part = prototypes.where((F.pmod(F.xxhash64("topic_id"), F.lit(blocks)) == block) & F.col("proto").isNotNull())
        together = part.agg(F.collect_list(F.struct("topic_id", "proto")).alias("taxonomy"))
        score = lambda p: 0.9 * text.cosine(F.col("vec"), p["proto"]) + 0.1 * F.coalesce(F.try_element_at("keyword", p["topic_id"]), F.lit(0.0))
        rated = F.transform("taxonomy", lambda p: F.struct((-F.round(score(p), 9)).alias("key"), p["topic_id"].alias("topic_id"), score(p).alias("score")))  # noqa: B023
        first = F.slice(F.array_sort(F.filter(rated, lambda r: r["score"].isNotNull())), 1, most)
        met = vectors.join(F.broadcast(together)).select("id", first.alias("best"))
        best = met if best is None else best.unionByName(met)
    if blocks > 1:
        best = best.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most).alias("best"))
    top = F.try_element_at("best", F.lit(1))["score"]
    fits = F.filter("best", lambda r: (r["score"] >= threshold) & (top - r["score"] <= margin))
    none = F.array(F.struct(F.lit(0.0).alias("key"), F.lit(general).alias("topic_id"), F.lit(0.0).alias("score")))
    chosen = best.select("id", F.posexplode(F.when(F.size(fits) > 0, F.transform(fits, lambda r: F.struct(r["key"], r["topic_id"].cast("int").alias("topic_id"), r["score"]))).otherwise(none)).alias("place", "r"))
    return chosen.select("id", F.col("r.topic_id").alias("topic_id"), (F.col("place") + 1).alias("rank"), F.col("r.score").alias("score"))


BLOCKS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("url", T.StringType()), T.StructField("block_id", T.StringType())]))
_TYPES = {"p": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "li": "list_item", "blockquote": "quote", "figcaption": "caption"}
_SKIP = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.kind, self.parts, self.skipped = [], None, [], 0

    def close_block(self):
        words = " ".join("".join(self.parts).split())
        if self.kind and words:
            self.blocks.append((self.kind, words, None))
        self.kind, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipped += 1
        elif not self.skipped and tag in _TYPES:
            self.close_block()
            self.kind = _TYPES[tag]
        elif not self.skipped and tag == "img":
            url = dict(attrs).get("src") or ""
            if url.startswith(("http://", "https://")):
                kind = self.kind
                self.close_block()
                self.blocks.append(("image", dict(attrs).get("alt") or "", url))
                self.kind = kind

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in _TYPES:
            self.close_block()

    def handle_data(self, data):
        if not self.skipped and self.kind:
            self.parts.append(data)


@F.pandas_udf(BLOCKS)
def html_blocks(html: pd.Series) -> pd.Series:
    """The headings, paragraphs, list items, quotes, captions and images of a page, in order, each with an id that
    depends on its place and content."""
    import hashlib

    def parse(source):
        parser = _Blocks()
        parser.feed(source or "")
        parser.close_block()
        return [{"type": k, "text": t, "url": u, "block_id": hashlib.sha256(f"{i}\0{k}\0{t}\0{u or ''}".encode()).hexdigest()[:16]} for i, (k, t, u) in enumerate(parser.blocks)]

    return html.map(parse)
