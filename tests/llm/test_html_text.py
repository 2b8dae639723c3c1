import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidelog.llm.html_text import FEATURES, blocks, extract_pages, features, labelled_table, train

PAGE = """<!DOCTYPE html><html><head><title>Head title</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site-header"><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now, it is a long advert text</div><div id="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>A  title &amp; more</h1><p><b>First para &lt;one&gt;&nbsp;with&#32;space.<br><p>Yes.<p>A <a href="/x">link</a> inside a longer paragraph.</p>
<div class="advert-box"><p>Advert in the article</p></div><form><label>Mail</label><input><button>Send</button></form><p>Last.</p></article>
<aside>Sidebar text of some length</aside><section class="comments"><h2>Comments</h2><p>I liked this article a lot, thank you for it.</p></section>
<footer>&copy; site &middot; all words</footer></body></html>"""
TEXT = "A title & more\nFirst para <one> with space.\nYes.\nA link inside a longer paragraph.\nLast."


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    return {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in extract_pages(df).collect()}


def test_article_only(spark):
    odd = [
        ("cut", PAGE[: PAGE.index("Last.") + 3]), ("null", None), ("empty", ""), ("plain", "just a plain text without any element at all"),
        ("tags", "<div><p></p></div>"), ("comment", "<p>one two three four five six</p><!-- open"), ("tag", "<p>one two three four five six</p><a href="),
        ("deep", "<div>" * 3000 + "<p>one two three four five six" + "</div>" * 3000), ("script", "<p>one two three four five six<script>if (a<b)"),
        ("end", "</div></p>one two three four five six</article>"), ("attr", "<p title='a > b' class=x>one two three four five six</p>"),
    ]
    got = run(spark, [(1, "whole", PAGE, 0), (1, "whole", PAGE, 0), (None, None, PAGE, None), *((i, n, h, 0) for i, (n, h) in enumerate(odd))])
    six = "one two three four five six"
    assert got[1, "whole"] == (TEXT, len(TEXT)) == got[None, None]
    by = {name: text for (_, name), (text, _) in got.items()}
    assert by["cut"] == TEXT[:-2]
    assert by["null"] == by["empty"] == by["tags"] == ""
    assert by["plain"] == "just a plain text without any element at all"
    assert {by[n] for n in ("comment", "tag", "deep", "script", "end", "attr")} == {six}


def test_no_pages(spark):
    assert run(spark, []) == {}


def test_blocks_and_tree():
    found = blocks("<nav><a>x y</a></nav><main><p>a<br>b</p></main>")
    assert [(b[0], b[1], b[2]) for b in found] == [("x y", 2, 2), ("a b", 2, 0)]
    assert [b[3:] for b in found] == [(True, False), (False, True)]
    table = labelled_table()
    assert (train().predict(table[:, :-1]) == table[:, -1]).mean() > 0.97


def splits(tree):
    return set() if tree.column is None else {FEATURES[tree.column]} | splits(tree.low) | splits(tree.high)


def plain(page):
    """The article of the given pages, read by their template."""
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1].replace("<br>", " ")
    pieces = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(x for x in pieces if x)


def test_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_pages(pages).collect()}
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert found == {i: (t, len(t)) for i, t in want.items()}


def test_neighbours_decide_where_nothing_is_marked():
    tree = train()
    assert {"words_+0", "link_density_+0", "words_-1", "link_density_-1", "words_+1"} <= splits(tree)
    right = n = whole = 0
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    for page in pages:
        found = blocks(page)
        rows = features(found)
        rows[:, -2:] = 0
        same = (tree.predict(rows) > 0.5) == np.array([inside and not furniture for *_, furniture, inside in found])
        right, n, whole = right + same.sum(), n + len(same), whole + same.all()
    assert right > 0.99 * n and whole > 0.95 * len(pages)


TEXTS = ["A heading of the page", "The first paragraph has a few more words than the heading has.", "And a last one."]


@pytest.mark.parametrize(
    "element",
    [
        '<p class="advert">Buy this now</p>', "<p hidden>Buy this now</p>", '<p class="cookie-notice">We use cookies</p>', "<p class='x ad y'>Buy</p>", '<div style="color:red; DISPLAY : none">Buy</div>',
        "<div class=ad data-u=http://x/>Buy this now</div>", "<div class=ad/>Buy</div>", '<div aria-hidden="true"><p>Buy</p></div>', '<ul><li class="ad">Buy</ul>', '<section id="comments"><p>I liked it</p></section>',
        '<div class="share-buttons">Share it</div>', '<div class="search-box">Find</div>', '<div role="complementary">See too</div>', '<span class="ad">Buy</span>', "<b hidden>Buy</b>", "<template><p>x</p></template>",
    ],
)
def test_furniture_inside_an_article(spark, element):
    page = f"<article><h1>{TEXTS[0]}</h1><p>{TEXTS[1]}</p>{element}<p>{TEXTS[2]}</p></article>"
    assert run(spark, [(1, "u", page, 0)])[1, "u"][0] == "\n".join(TEXTS)


@pytest.mark.parametrize(
    "start, end",
    [
        ('<div title="the hidden truth">', "</div>"), ('<div style="overflow: hidden ; color: red">', "</div>"), ('<div class="side-effects">', "</div>"), ('<div class="long-form">', "</div>"),
        ('<section class="search-results-study">', "</section>"), ('<p data-hidden="no">', "</p>"), ("<div id=form-of-life>", "</div>"), ('<p title="display: none">', "</p>"), ("<p>", ""), ("<p><br/>", "<p>"),
        ("<p><a href=/x class=plain>", "</a></p>"), ("<div alt='class=ad'>", "</div>"),
    ],
)
def test_article_text_that_looks_marked(spark, start, end):
    page = f"<article><h1>{TEXTS[0]}</h1>{start}{TEXTS[1]}{end}<p>{TEXTS[2]}</p></article>"
    assert run(spark, [(1, "u", page, 0)])[1, "u"][0] == "\n".join(TEXTS)


def test_marked_words_inside_a_block():
    found = blocks('<article><p>Some <span class="ad">bought </span>words <a href=x>and links</a>.</p><p class=ad>x<div>y</div></article>')
    assert [(b[0], b[1], b[2], b[3]) for b in found] == [("Some words and links.", 4, 2, False), ("x", 1, 0, True), ("y", 1, 0, False)]
