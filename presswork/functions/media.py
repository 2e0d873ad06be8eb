"""Pictures, addresses and encodings of publisher pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The first bytes of picture files, in hexadecimal.
SIGNATURES = (("^FFD8FF", "image/jpeg"), ("^89504E470D0A1A0A", "image/png"), ("^474946383[79]61", "image/gif"), ("^52494646.{8}57454250", "image/webp"))
#: The character sets that pages may be in.
CHARSETS = ("utf-8", "gb18030", "gbk", "gb2312", "iso-8859-1", "windows-1252")


def image_type(body: Column) -> Column:
    """Media type by the first bytes; null for anything else."""
    start, out = F.substring(F.hex(body), 1, 24), F.lit(None).cast("string")
    for pattern, kind in SIGNATURES:
        out = F.when(start.rlike(pattern), kind).otherwise(out)
    return out


def srcset_best(srcset: Column) -> Column:
    """The address with the largest width or density of a srcset (a density counts a thousand times a width); of equals
    the last in order of text; null if there is none."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")
    size = lambda p: F.regexp_extract(F.lower(p), r"\s([0-9]*\.?[0-9]+)[wx]?$", 1).try_cast("double")
    score = lambda p: F.coalesce(F.floor(size(p) * F.when(F.lower(p).endswith("x"), 1000).otherwise(1)), F.lit(0))
    best = F.array_max(F.transform(parts, lambda p: F.struct(score(p).alias("score"), F.regexp_extract(p, r"^(\S+)", 1).alias("url"))))
    return best["url"]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def allowed_host(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or below one."""
    name = F.regexp_replace(F.lower(host), r"\.$", "")
    out = F.lit(False)
    for domain in domains:
        out = out | (name == domain) | name.endswith("." + domain)
    return out


def media_url(url: Column, base: Column, domains: tuple[str, ...]) -> Column:
    """A picture's address made absolute and secure; null if it is blank, names a user, or is not at an allowed host."""
    text = F.trim(url)
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    full = F.when(text.startswith("//"), F.concat(F.lit("https:"), text)).when(text.rlike("^[A-Za-z]+:"), text).when(text.startswith("/"), F.concat(root, text)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), text))
    secure = F.regexp_replace(full, r"^http://([^/?#:]*)(:[0-9]+)?", "https://$1")
    fine = (text != "") & secure.startswith("https://") & ~F.regexp_extract(secure, r"^https://([^/?#]*)", 1).contains("@") & allowed_host(host_of(secure), domains)
    return F.when(fine, secure)


def url_problem(url: Column) -> Column:
    """Why an address can't be shown: no host, a user in it, a port of its own, or no HTTPS; null if it can."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    port = F.regexp_extract(place, r":([0-9]+)$", 1)
    return F.when(F.coalesce(host_of(url), F.lit("")) == "", "no_host").when(place.contains("@"), "user").when((port != "") & (port != "443"), "port").when(~F.lower(url).startswith("https://"), "scheme")


def publisher_tags(tags: Column, domain: str, most: int = 50) -> Column:
    """Keyword and tone tags of a publisher's own site, the first of each address, `most` at the most.

    tags: array of (type, name, url). The limit is that of an article's card.
    """
    own = F.filter(tags, lambda t: t["type"].isin("keyword", "tone") & (F.trim(t["name"]) != "") & allowed_host(host_of(t["url"]), (domain,)))
    urls = F.transform(own, lambda t: t["url"])
    return F.slice(F.filter(own, lambda t, i: F.array_position(urls, t["url"]) == i + 1), 1, most)


@F.udf(T.StringType(), useArrow=False)  # a hundred pages at a time; Arrow would hold 10,000, whatever their length
def _decoded(body, charsets):
    """By the first of the charsets that fits."""
    for name in charsets if body is not None else ():
        try:
            if name is not None:
                return bytes(body).decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return None


def page_text(body: Column, content_type: Column) -> Column:
    """A page's bytes as text: by the header's charset, else the one that its first 4,096 bytes name, else UTF-8, else
    GB 18030; null if none fits. Charsets that are not in CHARSETS are passed over."""
    head = F.decode(F.substring(body, 1, 4096), "iso-8859-1")
    named = lambda text: F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)charset\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)", 1))
    fine = lambda name: F.when(name.isin(*CHARSETS), name)
    tries = (fine(named(content_type)), fine(named(head)), F.lit("utf-8"), F.lit("gb18030"))
    return _decoded(body, F.array(*tries))


def merged_images(api: Column, page: Column) -> Column:
    """The blocks of one version of a text with the pictures of another put in where they are anchored.

    Blocks are (kind, value). A picture goes before the text block that follows it in its own version, if that text
    occurs exactly once, and the text before it stands right before it there too (or it is first in both); pictures
    that are there already stay as they are.
    """
    texts = lambda blocks: F.filter(blocks, lambda b: b["kind"] != "image")
    place = lambda b, i: F.struct(b["kind"].alias("kind"), b["value"].alias("value"), i.alias("at"))
    numbered = F.transform(page, place)
    images = F.filter(numbered, lambda b: (b["kind"] == "image") & ~F.exists(api, lambda a: (a["kind"] == "image") & (a["value"] == b["value"])))
    before = lambda b: F.get(F.reverse(F.filter(numbered, lambda x: (x["kind"] != "image") & (x["at"] < b["at"]))), F.lit(0))["value"]
    after = lambda b: F.get(F.filter(numbered, lambda x: (x["kind"] != "image") & (x["at"] > b["at"])), F.lit(0))["value"]
    values = F.transform(texts(api), lambda b: b["value"])
    anchored = F.transform(images, lambda b: F.struct(b["kind"].alias("kind"), b["value"].alias("value"), before(b).alias("before"), after(b).alias("after")))
    once = lambda v: F.size(F.filter(values, lambda x: x == v)) == 1
    position = lambda v: F.array_position(values, v)
    fits = lambda b: b["after"].isNotNull() & once(b["after"]) & F.when(b["before"].isNull(), position(b["after"]) == 1).otherwise(once(b["before"]) & (position(b["before"]) + 1 == position(b["after"])))
    good = F.filter(anchored, fits)
    plain = lambda b: F.struct(b["kind"].alias("kind"), b["value"].alias("value"))
    return F.flatten(F.transform(api, lambda a: F.concat(F.transform(F.filter(good, lambda g: (a["kind"] != "image") & (g["after"] == a["value"])), plain), F.array(plain(a)))))
