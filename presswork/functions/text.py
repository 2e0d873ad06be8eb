"""Text and URL functions as column expressions; those that Spark lacks in Python."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)?"
#: Query parameters that only track visitors.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


def search_text(text: Column) -> Column:
    """Lower case, and one space for each stretch of white space of any script."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def search_terms(text: Column) -> Column:
    """The whole phrase and its first five tokens of three characters or more, each once."""
    phrase = search_text(text)
    tokens = F.slice(F.filter(search_tokens(text), lambda t: F.length(t) >= 3), 1, 5)
    return F.array_distinct(F.filter(F.concat(F.array(phrase), tokens), lambda t: F.length(t) >= 3))


def lexical_score(terms: Column, title: Column, body: Column) -> Column:
    """Share of the terms that the title (twice) and the body hold."""
    t, b = search_text(F.coalesce(title, F.lit(""))), search_text(F.coalesce(body, F.lit("")))
    hits = F.aggregate(terms, F.lit(0), lambda s, x: s + F.contains(t, x).cast("int") * 2 + F.contains(b, x).cast("int"))
    return F.coalesce(F.try_divide(hits.cast("double"), 3.0 * F.size(terms)), F.lit(0.0))


def source_domain(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown-source"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, tracking parameters dropped and the others sorted."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    name = lambda p: F.substring_index(F.lower(p), "=", 1)
    params = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), query)


def live_article_id(url: Column) -> Column:
    return F.concat(F.lit("L"), F.substring(F.sha2(url, 256), 1, 32))


def plain_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", "")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text; one of fewer than three characters is its own only gram."""
    # one pass over the text: each match looks three characters ahead and takes one
    many = F.when(F.length(text) > 3, F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))."), F.lit(1))).otherwise(F.array(text))
    return F.array_distinct(many)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    ratio = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))


# Functions of whole texts take them a hundred at a time: an Arrow batch is 10,000 rows, whatever their length.
@F.udf(T.StringType(), useArrow=False)
def normal_form(t: str | None) -> str | None:
    """Compatibility normal form (NFKC) with white space collapsed."""
    return None if t is None else " ".join(unicodedata.normalize("NFKC", t).split())


def content_hash(title: Column, summary: Column) -> Column:
    return F.sha2(F.concat(normal_form(F.coalesce(title, F.lit(""))), F.lit("\n"), normal_form(F.coalesce(summary, F.lit("")))), 256)


def content_hash_ascii(title: Column, summary: Column) -> Column:
    """content_hash where texts are known to be in normal form; stays in the JVM."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.sha2(F.concat(flat(title), F.lit("\n"), flat(summary)), 256)


def chinese_characters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\\u3400-\\u9fff]"))


def latin_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def body_problem(body: Column, language: Column, least: int = 300, most: int = 200_000) -> Column:
    """Why a body can't be published (null if it can): its length, or a script that belies its language."""
    han, latin = chinese_characters(body), latin_letters(body)
    wrong = F.when(language == "zh", han < 20).when(language == "en", (latin < 50) | (han > F.greatest(F.lit(20), F.floor(latin / 2)))).otherwise(False)
    return F.when(F.length(F.coalesce(body, F.lit(""))) < least, "too_short").when(F.length(body) > most, "too_long").when(wrong, "language_mismatch")


def embedding_text(**parts: Column) -> Column:
    """One labelled line for each part that is not blank."""
    line = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    return F.concat_ws("\n", *(line(name.replace("_", " "), c) for name, c in parts.items()))


def hybrid_similarity(factor_cosine: Column, topics_a: Column, topics_b: Column) -> Column:
    """The factors' cosine brought into [0, 1] where it is finite, else the topics' Jaccard similarity."""
    finite = factor_cosine.isNotNull() & ~F.isnan(factor_cosine) & (F.abs(factor_cosine) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor_cosine))).otherwise(jaccard(topics_a, topics_b))


def moment(value: Column) -> Column:
    """ISO time to seconds since 1970; a time without a zone is UTC, what is no time null."""
    zoned = F.when(value.rlike(r"(Z|[+-]\d\d:?\d\d)$"), value).otherwise(F.concat(value, F.lit("Z")))
    return F.unix_seconds(F.try_to_timestamp(zoned))


def whole_numbers(key: Column) -> Column:
    """The whole numbers of a query key; empty if any of its words is none."""
    words = F.split(F.trim(F.regexp_replace(key, r"\s+", " ")), " ")
    fine = F.forall(words, lambda w: w.rlike("^[0-9]+$"))
    return F.when(fine, F.transform(words, lambda w: w.cast("long"))).otherwise(F.array().cast("array<long>"))


ENTITY = "array<struct<Label:string,Type:string,WikidataId:string,Confidence:string,SurfaceForms:array<string>>>"


def entities(raw: Column) -> Column:
    """The entities of a JSON array as (label, kind, wikidata, confidence): the first of each Wikidata id, or of each
    label without one; confidence null unless within [0, 1]; members without a label dropped."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    got = F.filter(F.coalesce(F.from_json(raw, ENTITY), F.array().cast(ENTITY)), lambda e: e.isNotNull() & blank(e["Label"]).isNotNull())
    key = lambda e: F.coalesce(F.concat(F.lit("w:"), F.lower(blank(e["WikidataId"]))), F.concat(F.lit("l:"), F.lower(blank(e["Label"]))))
    keys = F.transform(got, key)
    first = F.filter(got, lambda e, i: F.array_position(keys, key(e)) == i + 1)
    code = lambda e: F.upper(F.trim(F.coalesce(e["Type"], F.lit(""))))
    share = lambda e: e["Confidence"].try_cast("double")
    return F.transform(
        first,
        lambda e: F.struct(
            blank(e["Label"]).alias("label"),
            F.when(code(e) == "P", "person").when(code(e) == "O", "organization").when(code(e) == "G", "location").otherwise("other").alias("kind"),
            blank(e["WikidataId"]).alias("wikidata"),
            F.when(share(e).between(0, 1), share(e)).alias("confidence"),
        ),
    )


@F.udf(T.StringType(), useArrow=False)
def folded(t: str | None) -> str | None:
    """NFKC, case folded, stripped: how rules compare texts."""
    return None if t is None else unicodedata.normalize("NFKC", t).casefold().strip()


@F.udf(T.StringType(), useArrow=False)
def body_text(t: str | None) -> str | None:
    """A body in NFKC without control characters, its paragraphs on one line each with an empty line between them."""
    if t is None:
        return None
    t = unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n")
    t = "".join(c for c in t if c in "\n\t" or unicodedata.category(c) != "Cc")
    paragraphs, lines = [], []
    for line in [*t.split("\n"), ""]:
        if line.strip():
            lines.append(line)
        elif lines:
            paragraphs.append(" ".join(" ".join(lines).split()))
            lines = []
    return "\n\n".join(paragraphs)
