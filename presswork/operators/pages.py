"""Pages as rows: tokens with places, elements as stretches from their opening to their closing token, blocks of text and
pictures from what lies inside the container and outside of noise, and the gates that a page passes to become a body.

HTML is cut into tokens by one expression; which token closes which is a matter of running depths, and being inside an
element one of comparing places. Everything is bounded by the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text

TOKEN = r"(?is)<!--.*?-->|<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>|<[^>]*>|[^<]+"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
TYPES = {"p": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "li": "list_item", "blockquote": "quote", "figcaption": "caption"}
NOISE = ("nav", "header", "footer", "aside", "form", "button", "select", "iframe", "dialog")
STRUCTURE = (*NOISE, "article", "main", "div", "section", "ul", "ol", "table", "tr", "td", "th", "figure", "body", "html", "head", "title")
NOISE_CLASS = r"""(?i)\b(class|id)\s*=\s*["'][^"']*\b(ad|ads|advert|promo|share|social|related|newsletter|cookie|comments)\b"""
CONTAINER_CLASS = r"""(?i)\b(class|id|itemprop)\s*=\s*["'][^"']*\b(article-?body|story-?body|main-?content|post-?content)\b"""
PAYWALL = r"(?i)\bclass\s*=\s*[\"'][^\"']*\bpaywall\b|subscribe to continue reading"
#: The entities that are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
SHORT_LEAST, LEAST, MOST = 200, 300, 200_000


def decoded(raw: Column) -> Column:
    """Entities as characters, white space collapsed."""
    for name, character in ENTITIES:
        raw = F.replace(raw, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def tokens(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, pos, raw, tag, kind) of each token; kind: open, close, void, text or skip (comments, scripts, declarations)."""
    rows = pages.where(F.col(html).isNotNull()).select(F.col(page).alias("page"), F.posexplode(F.regexp_extract_all(html, F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kind = (
        F.when(~F.startswith("raw", F.lit("<")), "text").when((tag == "") | tag.isin("script", "style", "noscript"), "skip")
        .when(F.startswith("raw", F.lit("</")), "close").when(tag.isin(*VOID) | F.endswith("raw", F.lit("/>")), "void").otherwise("open")
    )
    return rows.select("page", "pos", "raw", tag.alias("tag"), kind.alias("kind"))


def elements(nodes: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(page, tag, raw, open, close) of the elements with these tags.

    An element ends at the next token of its tag and depth: its closing token, or, where that is missing, the next
    opening one; without either, with the page.
    """
    own = nodes.where(F.col("tag").isin(*tags) & F.col("kind").isin("open", "close"))
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    depth = F.sum(step).over(Window.partitionBy("page", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    level = own.withColumn("level", depth + F.when(F.col("kind") == "close", 1).otherwise(0))
    following = F.lead("pos").over(Window.partitionBy("page", "tag", "level").orderBy("pos"))
    return level.withColumn("close", F.coalesce(following, F.lit(1 << 30))).where("kind = 'open'").select("page", "tag", "raw", F.col("pos").alias("open"), "close")


def containers(parts: DataFrame) -> DataFrame:
    """(page, first, last): the element that holds a page's article: one named so, else an article, else main; the
    longest of several, then the first. parts: elements."""
    order = F.when(F.col("raw").rlike(CONTAINER_CLASS), 0).when(F.col("tag") == "article", 1).when(F.col("tag") == "main", 2)
    fit = parts.withColumn("o", order).where("o IS NOT NULL")
    best = F.min(F.struct("o", (F.col("open") - F.col("close")).alias("span"), "open", "close"))
    return fit.groupBy("page").agg(best.alias("b")).select("page", F.col("b.open").alias("first"), F.col("b.close").alias("last"))


def blocks(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, position, type, text, url, block_id) of the headings, paragraphs, list items, quotes, captions and pictures
    inside each page's container (the whole page if it has none) and outside of noise, in order.

    A picture inside a paragraph splits it: what stands before and after are paragraphs of their own. A paragraph that
    repeats a caption of its page is left out. Pictures without an http address are too. Pages that are null or hold no
    block have no rows.
    """
    nodes = tokens(pages, page, html)
    parts = elements(nodes, STRUCTURE)
    noise = parts.where(F.col("tag").isin(*NOISE) | F.col("raw").rlike(NOISE_CLASS)).groupBy("page").agg(F.collect_list(F.struct("open", "close")).alias("noise"))
    at = Window.partitionBy("page").orderBy("pos")
    edge = F.col("kind").isin("open", "close") & F.col("tag").isin(*TYPES, *STRUCTURE)
    rows = nodes.withColumns({
        "segment": F.sum(edge.cast("int")).over(at), "piece": F.sum((F.col("tag") == "img").cast("int")).over(at),
        "inside": F.last(F.when(edge, F.when(F.col("kind") == "open", F.col("tag")).otherwise("")), ignorenulls=True).over(at),
    })
    rows = rows.where(((F.col("kind") == "text") | F.col("tag").isin("br", "img")) & (F.col("kind") != "close"))
    rows = rows.join(containers(parts), "page", "left").where("first IS NULL OR pos > first AND pos < last").join(noise, "page", "left")
    rows = rows.where(~F.coalesce(F.exists("noise", lambda n: (F.col("pos") > n["open"]) & (F.col("pos") < n["close"])), F.lit(False)))

    kind = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    words = rows.where((F.col("tag") != "img") & F.col("inside").isin(*TYPES)).groupBy("page", "segment", "piece").agg(
        F.min("pos").alias("pos"), F.first(F.element_at(kind, F.col("inside"))).alias("type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("tag") == "br", " ").otherwise(F.col("raw")).alias("t")))), lambda x: x["t"]), "").alias("t"),
    )
    words = words.select("page", "pos", "type", decoded(F.col("t")).alias("text"), F.lit(None).cast("string").alias("url")).where("text <> ''")
    clones = words.where("type = 'caption'").select("page", "text", F.lit("paragraph").alias("type")).distinct()
    words = words.join(clones, ["page", "text", "type"], "left_anti")
    value = lambda name: decoded(F.regexp_extract("raw", rf"""(?i)\b{name}\s*=\s*["']([^"']*)""", 1))
    pictures = rows.where("tag = 'img'").select("page", "pos", F.lit("image").alias("type"), value("alt").alias("text"), value("src").alias("url")).where(F.col("url").rlike("(?i)^https?://"))
    both = words.select("page", "pos", "type", "text", "url").unionByName(pictures).withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1)
    block_id = F.substring(F.sha2(F.concat_ws("\0", F.col("page").cast("string"), F.col("position").cast("string"), "type", "text", F.coalesce("url", F.lit(""))), 256), 1, 16)
    return both.select(F.col("page").alias(page), "position", "type", "text", "url", block_id.alias("block_id"))


def picture_identity(url: Column) -> Column:
    """What an address says of the picture, whatever its size or crop: host and path without query, size segments and
    size endings."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(www\.)?", ""), r"[?#].*$", "")
    plain = F.regexp_replace(plain, r"/(\d{2,4}x\d{2,4}|w\d{2,4}|\d{2,4})(?=/)", "")
    return F.regexp_replace(plain, r"[-_.@](\d{2,4}x\d{2,4}|\d{2,4}w?|[23]x|crop|small|medium|large|thumb|thumbnail|scaled)(?=\.[a-z]{3,4}$)", "")


def without_main_picture(body: DataFrame, main: DataFrame, page: str = "page_id") -> DataFrame:
    """The blocks less the pictures that are their page's main picture (page, url) in another size, and less those that
    repeat an earlier picture of the page; places stay."""
    known = main.select(F.col(page), picture_identity(F.col("url")).alias("identity")).distinct().withColumn("main", F.lit(True))
    rows = body.withColumn("identity", F.when(F.col("type") == "image", picture_identity(F.col("url"))))
    pictures = rows.where("identity IS NOT NULL").withColumn("again", F.row_number().over(Window.partitionBy(page, "identity").orderBy("position")))
    left = pictures.where("again = 1").join(known, [page, "identity"], "left_anti").drop("again")
    return rows.where("identity IS NULL").unionByName(left).drop("identity")


def accepted_bodies(pages: DataFrame, page: str = "page_id", html: str = "html", title: str | None = None, language: str = "language") -> DataFrame:
    """(page, code, body) of each page: why it gives no body (null if it does), and the body.

    The gates in turn, each over what is still open: empty_page, paywalled, no_content (no block of prose), title_mismatch
    (none of the page's title and main headings holds the expected title or is held by it), then too_short, too_long or
    language_mismatch of the prose: headings, paragraphs and quotes. 300 characters are asked for, or 200 if the page has one
    article whose only main heading is the expected title. title: the column of what is expected, by default the page's own.
    """
    raw = F.coalesce(F.col(html), F.lit(""))
    own = F.regexp_extract(raw, r"(?is)<title[^>]*>(.*?)</title>", 1)
    asked = pages.select(F.col(page), F.col(html).alias("html"), F.col(language).alias("language"), (F.col(title) if title else decoded(own)).alias("expected"), text.plain_title(decoded(own)).alias("own"))
    early = F.when(F.trim(F.coalesce("html", F.lit(""))) == "", "empty_page").when(F.col("html").rlike(PAYWALL), "paywalled")
    asked = asked.withColumn("early", early)
    open_ = asked.where("early IS NULL")
    found = blocks(open_.select(F.col(page), "html"), page, "html")
    prose = found.where(F.col("type").isin("heading", "paragraph", "quote")).groupBy(page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda b: b["text"]), "\n\n").alias("body")
    )
    heads = open_.select(F.col(page), F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), lambda h: text.plain_title(decoded(F.regexp_replace(h, "<[^>]*>", "")))).alias("heads"), (F.regexp_count("html", F.lit(r"(?i)<article\b")) == 1).alias("one_article"))
    rows = asked.join(prose, page, "left").join(heads, page, "left")
    want = text.plain_title(F.coalesce("expected", F.lit("")))
    named = F.filter(F.concat(F.coalesce("heads", F.array().cast("array<string>")), F.array("own")), lambda h: h != "")
    mismatch = (want != "") & (F.size(named) > 0) & ~F.exists(named, lambda h: F.contains(h, want) | F.contains(want, h))
    exact = (want != "") & (F.size("heads") == 1) & (F.element_at("heads", 1) == want) & F.col("one_article")
    problem = F.when(F.coalesce(exact, F.lit(False)), text.body_problem(F.col("body"), F.col("language"), SHORT_LEAST, MOST)).otherwise(text.body_problem(F.col("body"), F.col("language"), LEAST, MOST))
    code = F.coalesce("early", F.when(F.col("body").isNull(), "no_content").when(mismatch, "title_mismatch").otherwise(problem))
    return rows.select(F.col(page), code.alias("code"), F.when(code.isNull(), F.col("body")).alias("body"))
