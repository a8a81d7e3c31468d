"""Main text against a plain reading of the given pages, and on page layouts that they do not have."""

from __future__ import annotations

import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import maintext, queries

LONG = "A paragraph of the article, long enough to be told from a menu by its ratio of text to tags."


def plain(page: str) -> str:
    """The blocks of the article of a given page, whose layout is known."""
    article = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_whole_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, sf, "pages").collect()}
    found = queries.op11_main_text(spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: plain(h) for i, h in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in found)


LAYOUTS = {
    "article with comments, form and notice": (
        f"<body class='has-sidebar'><div class='cookie-notice'>{LONG}</div><header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>{LONG}</p><p>Short.</p>"
        f"<form><label>Mail</label><input></form><div class='ad-slot'>{LONG}</div><section id='comments'><article class='comment'><p>{LONG}</p></article></section></article></main>"
        f"<aside>{LONG}</aside><footer>{LONG}</footer></body>",
        f"Title\n{LONG}\nShort.",
    ),
    "no article element": (
        f"<div class='menu-bar'><a href=a>Home</a></div><div id='content'><h1>T</h1><p>{LONG}</p><p>Two.</p><p>{LONG}</p></div><div class='sidebar widget'><p>{LONG}</p></div><div class=footer>{LONG}</div>",
        f"T\n{LONG}\nTwo.\n{LONG}",
    ),
    "lists of links without a class": (f"<ul><li><a href=1>News of today</a><li><a href=2>About us</a><li><a href=3>Imprint</a></ul><h1>T</h1><p>{LONG}<p>{LONG}", f"T\n{LONG}\n{LONG}"),
    "comments under a heading": (f"<article><h1>T</h1><p>{LONG}</p><div><h3>12 Comments</h3><p>{LONG}</p></div></article>", f"T\n{LONG}"),
    "hidden": (f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p></article>", LONG),
    "page inside a form": (f"<form><nav><a>x</a></nav><main><h1>T</h1><p>{LONG}</p></main><input></form>", f"T\n{LONG}"),
    "several articles of equal weight": (f"<main><article><p>{LONG}</p></article><article><p>{LONG} B</p></article><article><p>{LONG} C</p></article></main>", f"{LONG}\n{LONG} B\n{LONG} C"),
    "unclosed elements": ("<article><p>one <b>two<p>three<ul><li>a<li>b</ul>four</article>", "one two\nthree\na\nb\nfour"),
    "table cells": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    "white space and references": ("<article><pre>a\n\t b</pre><p>x&nbsp;&nbsp;y &lt;b&gt; &#x41;&amp;amp; &copy</p></article>", "a b\nx y <b> A&amp; ©"),
    "script and style inside": ("<article><p>a<script>if (1<2) '</p>'</script> b<style>p{}</style></p></article>", "a b"),
    "no markup": ("only text &amp; more", "only text & more"),
    "menu only": ("<nav><ul><li><a href=x>x</a></ul></nav>", ""),
    "empty": ("", ""),
    "blank": (" \n ", ""),
    "unclosed comment": (f"<article><p>{LONG}</p><!-- <p>no</p></article>", LONG),
    "sections and declarations": (f"<!DOCTYPE x><![if y]><article><p>{LONG}<![CDATA[no]]><?no?></p></article>", LONG),
    "cut off in a tag": (f"<article><p>{LONG}</p><p class='x", LONG),
    "stray ends": ("</div></p></article>text</b>", "text"),
    "inline elements set apart": ("<article><p>a <span class='share'>tweet</span>b <em class='notice'>c</em></p></article>", "a b c"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    page, text = LAYOUTS[layout]
    assert maintext.main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=200), max_size=8), st.sampled_from(["article", "main", "div"]), st.booleans())
def test_paragraphs_come_back(texts, tag, closed):
    page = f"<html><body><nav><a href=x>menu</a></nav><{tag}>" + "".join(f"<p>{html.escape(t)}" + "</p>" * closed for t in texts) + f"</{tag}><footer>end</footer>"
    want = [" ".join(html.unescape(html.escape(t)).split()) for t in texts]
    assert maintext.main_text(page) == "\n".join(t for t in want if t)


PIECES = ["<![foo[", "<![", "<!", "<!--", "-->", "<?x", "]]>", "<![CDATA[", "<!DOCTYPE", "<p", "<p>", "</p>", "</", "<", "<a href='", "'", ">", "&#", "&#x", "&#99999999999;", "<script>", "</script>", "<table>", "<td>", "</table>", "<li>", "<ul>", "text", "<title>", "<head>", "<form>", "<header>", "<h1>", "<article>", "</article>"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_any_text_is_read(page):
    assert maintext.main_text(page) is not None


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p>" * 100_000, "</div>" * 100_000, "<p><td>" + "<b>" * 50_000 + "</p>" * 50_000, "<!--" * 100_000, "<" * 100_000, "<a " * 50_000, "<form>" * 50_000 + "<h1>x"])
def test_long_pages_of_one_kind(page):
    began = time.time()
    maintext.main_text(page)
    assert time.time() - began < 20


def test_content_is_a_cluster():
    menu, prose = ("Home", 0, 4, 4), ("word " * 60, 0, 2, 0)
    assert maintext.content_lines([menu] * 5 + [prose] * 4 + [menu] * 5).tolist()[1:4] == [False] * 3
    assert maintext.content_lines([menu] * 5 + [prose] * 4 + [menu] * 5).tolist()[5:9] == [True] * 4
    assert maintext.content_lines([prose] * 3).all()


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", None), (2, "u", "<article>" + "<p>long text " * 50_000, "y"), (3, "", "<div>" * 3000 + "deep", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = maintext.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 1), (1, 0), (1, 0), (2, 50_000 * 10 - 1), (3, 4)]
    assert maintext.extract(pages.limit(0)).collect() == []
    assert maintext.extract(pages, keep=()).columns == ["text", "n_chars"]
    with pytest.raises(ValueError, match="text and n_chars"):
        maintext.extract(pages, keep=("text",))
