"""Main text: the cut against all labellings, planted pages, and the table's articles by a plain reading."""

import html as std
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import htmltext, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("seed", range(6))
def test_cut_equals_all_labellings(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        own = rng.integers(-6, 7, n).tolist()
        pairs = [(i, j, int(rng.integers(0, 5))) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        edges = [{} for _ in range(n)]
        for i, j, c in pairs:
            edges[i][j] = edges[j][i] = c
        cost = lambda s: sum(max(o, 0) if not x else max(-o, 0) for o, x in zip(own, s)) + sum(c for i, j, c in pairs if s[i] != s[j])  # noqa: E731, B023
        every = list(itertools.product([False, True], repeat=n))
        least = min(map(cost, every))
        most = [any(s[i] for s in every if cost(s) == least) for i in range(n)]
        assert htmltext.minimum_cut(list(own), edges) == most


def plain_articles(page):
    """h1 and paragraphs of the one article of a page, read by patterns."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = re.split(r"</?(?:p|h\d)>", m[1])
    parts = [" ".join(std.unescape(re.sub(r"<br>", " ", p).replace("<b>", "").replace("</b>", "")).split()) for p in parts]
    return " ".join(p for p in parts if p)


def test_query_equals_a_plain_reading(spark):
    got = {r["page_id"]: r for r in queries.op11_html_extraction(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == plain_articles(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
        assert got[r["page_id"]]["url"] == r["url"]


PLANTED = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style></head><body class="menu-open">
<a href="#c" class="skip-link">Skip to content</a>
<header><h1>Site</h1><form><input><label>Find</label><button>Go</button></form></header>
<div class="cookie-notice"><div><p>We use cookies to make this page better for you. Please read on, and say yes.</p></div></div>
<nav><ul><li><a href="/">Home<li><a href=/about>About us</a></ul></nav>
<div id="layout-with-sidebar"><main>
<article class="post"><header class="entry-header"><h1>A  title &amp; more</h1></header>
<p>First para&shy;graph with <b>bold</b><i>er</i> words,<br>a break &lt;b&gt; and&nbsp;space.
<p>Second.<!-- not <p>this</p> --><script>var x = "</p><p>no";</script>
<div class="advertisement"><p>Buy our fine things today. They are the best, we say.</p></div>
<ul><li>One<li>Two <a href="x">linked</a></ul><table><tr><td>c1<td>c2<tr><td>c3</table>
<aside><p>An aside of some length that reads like prose. It goes on for a while.</p></aside>
<blockquote>Quoted.</blockquote><pre>  code
   lines</pre><p>5 < 6 &ampx; &#8364;&#x41;</p><p hidden>unseen</p>
<footer>Filed under things</footer></article>
<section id="comments"><h2>3 comments</h2><div class="comment"><p>I liked this article a lot. Well said, as ever.</p></div><form><textarea>Your comment</textarea></form></section>
</main><div class="sidebar"><article><p>A related story that is rather good.</p></article></div></div>
<footer><p>&copy; 2020 Site. All rights reserved.</p></footer></body></html>"""
WANTED = "A title & more First para\xadgraph with bolder words, a break <b> and space. Second. One Two linked c1 c2 c3 Quoted. code lines 5 < 6 &x; €A"
PROSE = "This is a long sentence of ordinary prose that says something, and then goes on to say more of it. It even has a second sentence."
UNMARKED = "<body><div><a href=a>Home</a> <a href=b>News</a> <a href=c>Contact</a></div><div><h2>Heading of it</h2><p>" + f"</p><p>{PROSE} ".join([""] * 6) + "</p><p>Short one.</p><p>" + PROSE + "</p></div><div><ul><li><a href=d>Imprint</a><li><a href=e>Terms</a><li><a href=f>Privacy</a></ul></div></body>"


@pytest.fixture(scope="module")
def weights(spark):
    return htmltext.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_planted_page(weights):
    assert htmltext.main_text(PLANTED, weights)[0] == WANTED
    assert htmltext.main_text(PLANTED, None)[0] == WANTED


def test_page_without_marks_is_judged_by_its_texts(weights):
    text = htmltext.main_text(UNMARKED, weights)[0]
    assert text.count("ordinary prose") == 6
    assert "Short one." in text
    assert "News" not in text
    assert "Privacy" not in text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("  \n", ""), ("<p>", ""), ("plain text only", "plain text only"), ("<article><p>Cut &am", "Cut &am"), ("<article><p>Cut &amp", "Cut &"), ("<article><p>a</p", "a"),
        ("<article><p>a<a href=\"x", "a"), ("<article><script>if (a < b) {", ""), ("<article>a<!-- b", "a"), ("<article><button>b <p>c", "b c"), ("<article><p>a</article><nav>x</nav>", "a"),
        ("</div></p></article><main>x", "x"), ("<ARTICLE><P>UP</P></ARTICLE><NAV>no</NAV>", "UP"), ("<form><article><p>In a form</p></article><p>no</p></form>", "In a form"),
        ("<article class='post category-social tag-menu'><p>a</p></article><article class='comment reply'><p>b</p></article>", "a"),
        ("<article><p class=a data-x='>'>q</p>", "q"), ("<article><p>a\x00b</p>", "a\x00b"), ("<article><div><p>1<div>2</div>3</div>4", "1 2 3 4"),
    ],
)
def test_odd_pages(weights, page, text):
    assert htmltext.main_text(page, weights)[0] == text


def test_long_and_pathological_pages(weights):
    """Work stays near linear: many blocks without marks, deep nesting, unclosed tags."""
    many = "".join(f"<div><p>{PROSE if i % 3 else 'Tip'}</p><a href=x>more {i}</a></div>" for i in range(4000))
    assert htmltext.main_text(f"<body>{many}</body>", weights)[0].count("ordinary prose") == 2666
    for page in ("<div>" * 20000 + "x", "<li><div>" * 10000 + "x", "<button>" * 20000 + "x", "</p>" * 50000 + "x", "<p>" * 20000 + "x", '<a href="' * 9999, "<" * 50000 + "x"):
        htmltext.main_text(page, weights)


def test_clashing_columns_nulls_and_repeats(spark, weights):
    rows = [(None, None, None), (1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (2, "v", "")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("text", F.lit("x")).withColumn("a.b", F.lit(1))
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in htmltext.extract(pages, weights).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "v", "", 0)], key=str)
    none = spark.createDataFrame([], SCHEMA)
    assert htmltext.train(none) is None
    assert htmltext.extract(none, None).count() == 0
