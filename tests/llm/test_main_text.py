"""Main text of pages, made by hand and given."""

from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.llm.main_text import main_blocks, main_text
from fleetlens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = "This sentence is long enough, has commas, and reads like the prose that an article is made of. "


def text(page):
    return "\n".join(main_blocks(page)[0])


def test_given_pages(spark):
    """The given pages have one article each, with unclosed tags, and some are cut."""
    found = {r.page_id: r for r in QUERIES["op12_main_text"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        inner = page.html.split("<article>")[1].split("</article>")[0].split("<footer")[0]
        blocks = [html.unescape(re.sub(r"<[^>]*>?", "", b)) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        want = "\n".join(t for b in blocks if (t := " ".join(b.split())))
        assert (found[page.page_id].text, found[page.page_id].n_chars, found[page.page_id].url) == (want, len(want), page.url)


def test_plain_divisions_are_told_by_score():
    page = f"""<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Contact</a></div>
      <div><div><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG * 2}</p></div>
      <div><a href=4>{LONG}</a><a href=5>{LONG}</a></div></div>
      <div>All rights reserved</div></body>"""
    assert text(page) == "\n".join(["Head", LONG.strip(), "Short.", (LONG * 2).strip()])


@pytest.mark.parametrize(
    "noise",
    [
        f"<nav><p>{LONG}</p></nav>",
        f"<header><p>{LONG}</p></header>",
        f"<footer><p>{LONG}</p></footer>",
        f"<aside><p>{LONG}</p></aside>",
        f"<div class='cookie-notice'><p>{LONG}</p></div>",
        f"<div id=topAd><p>{LONG}</p></div>",
        f"<section id='comments'><h3>Comments</h3><article class=comment><p>{LONG * 5}</p></article></section>",
        f"<div class='comment-list'><div class='comment-body'><p>{LONG * 9}</p></div></div>",
        f"<form><p>{LONG}</p><input value=x><button>Go</button></form>",
        f"<div role='navigation'><p>{LONG}</p></div>",
        f"<script>var a = '<p>{LONG}</p>';</script>",
        "<style>p > a {color: red}</style>",
        f"<!-- <p>{LONG}</p> -->",
        f"<noscript><p>{LONG}</p></noscript>",
        f"<div style='display: none'><p>{LONG}</p></div>",
        "<ul class='related'><li><a>one</a></li><li><a>two</a></li></ul>",
    ],
)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content with-sidebar'>{}</div>"])
def test_noise_before_after_and_within(noise, wrap):
    body = f"<h1>Title</h1><p>{LONG}</p>" + "{}" + f"<p>Second, <b>bold</b> and <a href=x>linked</a>.</p><ul><li>One</li><li>Two</li></ul><p>{LONG}</p>"
    want = "\n".join(["Title", LONG.strip(), "Second, bold and linked.", "One", "Two", LONG.strip()])
    head = "<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>"
    assert text(head + noise + wrap.format(body.format("")) + "</body></html>") == want
    assert text(head + wrap.format(body.format("")) + noise) == want
    if not noise.startswith("<header"):  # within an article a header holds its title
        assert text(head + wrap.format(body.format(noise))) == want


def test_sections_of_one_article_stay_together():
    sections = "".join(f"<div class=part><p>{LONG * n}</p></div>" for n in (1, 6, 2))
    assert text(f"<body><div>{sections}</div><div class=sidebar><p>{LONG * 3}</p></div></body>") == "\n".join((LONG * n).strip() for n in (1, 6, 2))


def test_menu_inside_and_references():
    page = f"<article><ul><li><a>A</a></li><li><a>B</a></li><li><a>C</a></li></ul><p>a&nbsp;b &lt;p&gt; &amp; &#233; &eacute; x&amp</p><p>{LONG}</p></article>"
    assert text(page) == f"a b <p> & é é x&\n{LONG.strip()}"


def test_broken_markup():
    assert text("<p>one<p>two<b>bold<p>three</b> end") == "one\ntwobold\nthree end"
    assert text("<div><p>It's <a title=\"a > b\" href='x'>a link</a> and more text, it's fine.</p></div>") == "It's a link and more text, it's fine."
    assert text("<p class=a'b>it's</p><p>don't</p>") == "it's\ndon't"
    assert text("a < b and c > d") == "a < b and c > d"
    assert text("<article><p>cut here <a hre") == "cut here"
    assert text("<article><p>kept</p><script>var x = 1") == "kept"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text("</div></p><p>x</p></body></html><p>y</p>") == "x\ny"
    assert text("<title>t</title><p>no head and no body</p>") == "no head and no body"
    assert text("plain text\n without  tags") == "plain text without tags"


def test_empty_pages():
    for page in ("", "   ", "<html></html>", "<nav>menu</nav>", "<!-- x", "<"):
        assert text(page) == ("<" if page == "<" else "")


def test_nulls_and_clashing_names(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "<p>x</p>", "c"), (None, "<p>x</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = pages.withColumn("main", main_text(F.col("html"))).select("page_id", "text", "main.n_chars", "main.text").collect()
    assert sorted((r[1], r[2], r[3]) for r in found) == [("a", 0, ""), ("b", 0, ""), ("c", 1, "x"), ("c", 1, "x")]
    assert pages.limit(0).select(main_text(F.col("html"))).collect() == []


@pytest.mark.parametrize("part", ["<p>a", "<div>a", "<b>a", "<a href='", "<", "<p>a</p><ul><li><a>b</a></li></ul>", "&amp;<!--"])
def test_long_pages_take_time_in_proportion(part):
    began = time.time()
    main_blocks(part * 2000)
    small = time.time() - began
    began = time.time()
    main_blocks(part * 8000)
    assert time.time() - began < 1 + 8 * small
