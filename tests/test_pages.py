"""Pages as node rows: containers, noise, split paragraphs, pictures, gates; against hand-made pages and a stack parser."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.operators import pages

PAGE = """<!DOCTYPE html><html><head><title>Harbour &amp; bridge</title><script>var t = "</p><p>no</p>";</script></head><body>
<nav><p>Menu</p></nav><div class="teaser"><p>Outside</p></div>
<article><header><p>By line</p></header><h1>Harbour &amp;  bridge</h1>
<p>One <b>two</b><br>three <img src="https://a.example/p.jpg" alt="A &quot;pier&quot;"> four</p>
<div class="box related"><div><p>Noise</p></div><p>More noise</p></div>
<figure><img src="https://a.example/q.jpg"><figcaption>The quay</figcaption></figure><p>The quay</p><p>  </p>
<ul><li>First<li>Second</ul><blockquote>Said so</blockquote><img src="data:x"><p>Last</article><footer><p>Foot</p></footer></body></html>"""


def found(spark, html):
    return [(r.type, r.text, r.url) for r in pages.blocks(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("position").collect()]


def test_blocks_of_a_page(spark):
    assert found(spark, PAGE) == [
        ("heading", "Harbour & bridge", None), ("paragraph", "One two three", None), ("image", 'A "pier"', "https://a.example/p.jpg"), ("paragraph", "four", None),
        ("image", "", "https://a.example/q.jpg"), ("caption", "The quay", None), ("list_item", "First", None), ("list_item", "Second", None), ("quote", "Said so", None), ("paragraph", "Last", None),
    ]


@pytest.mark.parametrize("html, texts", [
    (None, []), ("", []), ("no tags at all", []), ("<p>whole page", ["whole page"]), ("<p>a</p></div></article><p>b", ["a", "b"]),
    ("<main><p>in main</p></main><p>out</p>", ["in main"]), ("<article><p>short</p></article><article><p>the longer one</p><p>x</p></article>", ["the longer one", "x"]),
    ("<main><p>m</p><div id='story-body'><p>named</p></div></main>", ["named"]), ("<article><aside><p>no</p></article><p>out</p>", []), ("<p>&lt;p&gt; &amp;lt;</p>", ["<p> &lt;"]),
])
def test_odd_pages(spark, html, texts):
    assert [t for _, t, _ in found(spark, html)] == texts


def test_block_ids_differ_between_pages_and_places(spark):
    rows = spark.createDataFrame([(1, "<p>x</p><p>x</p>"), (2, "<p>x</p>")], "page_id int, html string")
    assert pages.blocks(rows).select("block_id").distinct().count() == 3


def stretches(tokens):
    """Elements by a stack for each tag: (tag, open, close)."""
    stacks, out = {}, []
    for pos, (tag, kind) in enumerate(tokens):
        stack = stacks.setdefault(tag, [])
        if kind == "open":
            stack.append(pos)
        elif stack:
            out.append((tag, stack.pop(), pos))
    return sorted(out)


def test_elements_equal_a_stack_where_all_close(spark):
    rng = random.Random(7)
    for _ in range(3):
        html, tokens, open_ = "", [], []
        for _ in range(120):
            if open_ and rng.random() < 0.5:
                tag = open_.pop()
                html, tokens = html + f"</{tag}>", [*tokens, (tag, "close")]
            else:
                tag = rng.choice(["div", "section", "article"])
                open_.append(tag)
                html, tokens = html + f"<{tag}>", [*tokens, (tag, "open")]
        while open_:
            tag = open_.pop()
            html, tokens = html + f"</{tag}>", [*tokens, (tag, "close")]
        nodes = pages.tokens(spark.createDataFrame([(1, html)], "p int, h string"), "p", "h")
        assert sorted((r.tag, r.open, r.close) for r in pages.elements(nodes, ("div", "section", "article")).collect()) == stretches(tokens)


def test_main_picture_goes_in_any_size(spark):
    same = ["https://www.a.example/img/640x480/pier-800x600.jpg?w=3", "http://a.example/img/pier.jpg", "https://a.example/img/w300/pier-thumb.jpg#x", "https://a.example/IMG/pier@2x.jpg"]
    other = ["https://a.example/img/pier2.jpg", "https://b.example/img/pier.jpg", "https://a.example/img/pier-photo.jpg"]
    body = [(1, i, "image", "", u) for i, u in enumerate([*same, *other, other[0].replace(".jpg", "-1200w.jpg")])] + [(1, 20, "paragraph", "x", None), (2, 0, "image", "", same[1]), (2, 1, "image", "", same[0])]
    rows = spark.createDataFrame(body, "page_id int, position int, type string, text string, url string")
    main = spark.createDataFrame([(1, same[0]), (1, same[1])], "page_id int, url string")
    got = pages.without_main_picture(rows, main).orderBy("page_id", "position").collect()
    assert [(r.page_id, r.position) for r in got] == [(1, 4), (1, 5), (1, 6), (1, 20), (2, 0)]


def test_gates_in_turn(spark):
    prose, short = "<p>" + "Plain words of a body. " * 20 + "</p>", "<p>" + "Plain words of a body. " * 10 + "</p>"
    page = lambda body, title="A title", head="A title": f"<html><head><title>{title}</title></head><article><h1>{head}</h1>{body}</article></html>"
    cases = [
        (None, "A title", "empty_page"), ("  ", "A title", "empty_page"), (page('<div class="x paywall"></div>' + prose), "A title", "paywalled"), ("<html><nav><p>x</p></nav></html>", "A title", "no_content"),
        (page(prose), "Something else", "title_mismatch"), (page(prose), "a TITLE!", None), (page(prose), "", None), (page(short), "A title", None), (page(short, head="A title of its own"), "A title", "too_short"),
        (page(short) + "<article></article>", "A title", "too_short"), (page("<p>x</p>"), "A title", "too_short"), (page("<p>" + "1 " * 400 + "</p>", "1", "1"), "1", "language_mismatch"),
    ]
    rows = spark.createDataFrame([(i, h, t, "en") for i, (h, t, _) in enumerate(cases)], "page_id int, html string, expected_title string, language string")
    got = {r.page_id: r for r in pages.accepted_bodies(rows, title="expected_title").collect()}
    assert [got[i].code for i in range(len(cases))] == [c for _, _, c in cases]
    assert got[5].body.startswith("A title\n\nPlain words") and got[4].body is None
    assert pages.accepted_bodies(rows.where("false"), title="expected_title").count() == 0


def test_entities():
    assert pages.ENTITIES[-1][0] == "&amp;"


def test_decoded(spark):
    assert spark.range(1).select(pages.decoded(F.lit(" a&nbsp;&amp;lt; \n b ")).alias("x")).first().x == "a &lt; b"
