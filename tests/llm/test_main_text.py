"""Main text of pages: articles between boilerplate in several layouts."""

import pytest
from hypothesis import given, settings, strategies as st

from tidelens.llm.main_text import extract, main_text

PARTS = ["A heading of the article", "First paragraph with enough words to stand out from all that surrounds it on the page, by far.",
         "Short.", "Second paragraph, quoting “this” & that, again long enough to be taken for running text in a window.", "Bye."]
HTML = ["<h1>A heading of\n the article</h1>", "<p>First paragraph with <b>enough</b> words to stand <a href='/x'>out</a> from all that surrounds it on the&#32;page, by far.", "<p>Short.</p>",
        "<p>Second paragraph, quoting &ldquo;this&rdquo; &amp; that,<br>again long enough to be taken for running text in a window.</p>", "<p>Bye.</p>"]
ARTICLE = "\n".join(HTML)
WANT = "\n\n".join(PARTS)
HEAD = "<!DOCTYPE html><html><head><title>Not this title, however long it may be for a page</title><style>p > b {content: '</p>'}</style></head>"
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(9)) + "</ul>"
TEXT = "This text is not of the article although it is long enough to be taken for it by its length alone, as it goes on."


@pytest.mark.parametrize("body", [
    f"<nav>{MENU}</nav><article>{ARTICLE}</article><footer>{TEXT}</footer>",
    f"<header><h1>Site</h1><p>{TEXT}</p></header><main>{ARTICLE}<form><label>Name</label><input><p>{TEXT}</p></form></main><aside>{TEXT}</aside>",
    f"<div class='site-header'>{TEXT}</div><div id='content'>{ARTICLE}</div><div class='sidebar'>{TEXT}</div><div id=comments><p>{TEXT}</p><p>{TEXT}</p></div>",
    f"{MENU}<div>{ARTICLE}</div>{MENU}<div>&copy; 2020 Somebody &middot; all rights</div>",
    f"<div class=wrap><div class=menu>{MENU}</div><div class='post has-sidebar'>{ARTICLE}<div class='ad'>{TEXT}</div></div><div class='cookie-notice'>{TEXT}</div></div>",
    f"<div class='page-header'><article>{ARTICLE}</article></div><section class='comments'><article><p>{TEXT} {TEXT} {TEXT}</p></article></section>",
    f"<article><header>{HTML[0]}<p>By somebody</p></header>{''.join(HTML[1:])}<script>if (a < b) document.write('<p>{TEXT}</p>');</script><!-- <p>{TEXT}</p> --></article>",
    f"<div role=navigation>{TEXT}</div><div>" + "".join(f"<div>{h}</div>" for h in HTML) + "</div><div style='display: none'>" + TEXT + "</div>",
    f"<article>{HTML[0]}{HTML[1]}<div class='advert'>{TEXT}</div><p>Short.</p><span class='promo'>{TEXT}</span>{HTML[3]}<p>Bye.</p><div class='share'>Share this</div></article>",
    f"<table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr></table>",
    f"<article>{ARTICLE}<noscript>{TEXT}</noscript><button>{TEXT}</button></article><script>never closed <p>{TEXT}</p>",
])
def test_article_stays_and_the_rest_goes(body):
    assert main_text(f"{HEAD}<body>{body}</body></html>") == WANT


def test_short_articles_and_odd_pages():
    assert main_text("<article><h1>Be.</h1><p>Be.</p></article>") == "Be.\n\nBe."
    assert main_text("<article><p><a href=x>All of it is a link</a></p></article>") == "All of it is a link"
    assert main_text("") == main_text(None) == main_text("<html><nav>x</nav></html>") == ""
    assert main_text("No markup\n at all") == "No markup at all"
    assert main_text("<p>a<") == "a<" and main_text("<p title=\"never closed>text</p> more") in ("text more", "text\n\nmore", "")
    assert main_text("<article>" + "<p>word word word</p>" * 20_000 + "</article>").count("\n\n") == 19_999
    assert main_text("<article><p>x\x00y&nbsp;&#x1F389; z</article>") == "x\x00y 🎉 z"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "<b", ">", "<script>", "</script>", "<!--", "-->", "\"", "&amp;", "&#0;",
                                 "text of some length ", "<nav>", "</nav>", "<header>", "</header>", "<br/>", "<h1>", "</section>"]), max_size=30))
def test_broken_markup_never_fails(pieces):
    out = main_text("".join(pieces))
    assert all(b and b == " ".join(b.split()) for b in out.split("\n\n")) or out == ""


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "t", 5), (1, "u", f"<article>{ARTICLE}</article>", "t", 6), (None, None, None, None, None), (2, "v", "", "t", 1)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = sorted(map(tuple, extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract(spark.createDataFrame([], schema)).count() == 0
