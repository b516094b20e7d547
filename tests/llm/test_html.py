"""Operator 10: broken tags, hostile pages, and what the tree decides by."""

import os
import re
import time

import pytest

from lodestar.llm import html_extract as h

TREE = h.train()
LONG = "The town council met on Monday evening to hear what people who live near the river think about the new bridge, and nearly all who spoke were in favour of it, though some asked for lower costs and for a path."


def text(html):
    return h.main_text(html, TREE)


def questions(tree):
    return set() if tree.low is None else {h.FEATURES[tree.feature]} | questions(tree.low) | questions(tree.high)


def test_words_and_densities_decide():
    assert set(h.FEATURES) == {f"{f}{at}" for f in ("words", "density") for at in ("", "_before", "_after")}
    asked = questions(TREE)
    assert {"words", "density"} <= asked and asked & {"words_before", "density_before"} and asked & {"words_after", "density_after"}


@pytest.mark.parametrize(
    "html,want",
    [
        ('<p class="x>Hello</p><p>world "quoted" here</p><p>And more</p>', "And more"),
        ("<p data-x=it's>one two three</p><p>don't stop</p>", "one two three don't stop"),
        ('<p title="never closed>one two three</p>', "one two three"),
        (f'<div class="header-image"><p>{LONG}</p></div>', LONG),
        (f'<div class="post social"><p>{LONG}</p></div>', LONG),
        (f'<article><p>{LONG}</p><div class="legal"><p>Some words about the law.</p></div></article>', f"{LONG} Some words about the law."),
        (f"<html><head><meta charset=utf-8><title>T</title><p>{LONG}", LONG),
        (f"<head><title>T</title><body><nav><a href=/>Home</a></nav><h1>Bridge</h1><p>{LONG}</p><footer>end</footer>", f"Bridge {LONG}"),
        ("a < b and <3 c", "a < b and <3 c"),
        ("<p>one<!-- two --> three<![CDATA[four]]> five</p>", "one three five"),
        ("<p>one</p><!-- never closed <p>two</p>", "one"),
        (f"<div class=cookie-consent><p>We use cookies.</p></div><p>{LONG}</p>", LONG),
        (f"<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><h1>Bridge</h1><p>{LONG}</p><div><a href=3>Next page</a></div>", f"Bridge {LONG}"),
        (f"<article><p>{LONG}</p><div class='ad-slot'>Buy our fine shoes today</div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><div class='promo'><p>{LONG}</p></div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='advert'><p>{LONG}</p></div><p>End.</p></article>", f"{LONG} End."),
        (f"<div class='sidebar'>{LONG}</div><p>{LONG} Yes.</p><div class='cookie-notice'>{LONG}</div>", f"{LONG} Yes."),
        (f"<div id='header'>The Daily Paper, your voice in the valley, now with a fine new look and much more to read</div><p>{LONG}</p><div class='menu'>one two</div><div id=footer>{LONG}</div>", LONG),
        (f"<article><div class='header'>Head line</div><p>{LONG}</p><ul><li><a href=1>One</a></li><li><a href=2>Two of them</a></li></ul></article>", f"Head line {LONG} One Two of them"),
        ("<ul><li><a href=1>One</a></li></ul><p>The bridge will be open on Monday.</p>", "The bridge will be open on Monday."),
        (f"<p>{LONG}</p><div class='usercomments'><p>{LONG} I agree.</p></div><div id='comment_list'>no</div><div class='commentary'><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<article class='sponsored'><p>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG}</p></article><div><p>{LONG} Elsewhere.</p></div>", LONG),
        (f"<article hidden><p>{LONG}</p></article><div style='display: none'>no</div><p>{LONG}</p>", LONG),
    ],
)
def test_pages(html, want):
    assert text(html) == want


@pytest.mark.parametrize("piece", ['<a "', "<a ='", '<a x="', "<", "<a", "</", "<!--", "<![CDATA[", "<select>", "<title>", "<p class=", "<a x=\"'", "<div>", "&amp", "= '", "</div>x", "<div class='a b c'>x", "stack"])
def test_hostile_pages_take_linear_time(piece):
    html = "<div>" * 100_000 + "</nav>" * 80_000 if piece == "stack" else piece * (1_000_000 // len(piece))
    started = time.process_time()
    h.main_text(html, TREE)
    assert time.process_time() - started < 6


def test_words_around_a_block_decide():
    """The same block is main text between prose and none in a list of links."""
    page = lambda *sizes: [h.Block("x", n, links, False, False) for n, links in sizes]
    assert h.chosen(page((60, 0), (9, 0), (70, 0)), TREE)[1] and not h.chosen(page((60, 0), (9, 0), (8, 8)), TREE)[1]
    assert not h.chosen(page((8, 8), (4, 0), (0, 0), (50, 0))[:2] + page((8, 8), (50, 0)), TREE)[1]


def test_without_main_text_blocks_without_links_stay(spark):
    assert text("<div><a href=1>one two</a></div><div>a b</div><div><a href=2>three</a></div>") == "a b"
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def slow_blocks(html):
    """Blocks of well-formed markup by the standard library's reader: texts and whether a link holds them."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.parts, self.link, self.raw = [], [], 0, 0

        def flush(self):
            words = "".join(t for t, _ in self.parts).split()
            if words:
                self.out.append((" ".join(words), len(words), min(len(words), sum(len(t.split()) for t, link in self.parts if link))))
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style", "title")
            if tag == "a":
                self.link = 1
            elif tag == "br":
                self.parts.append((" ", self.link))
            elif tag not in h.INLINE and tag not in h.SILENT:
                self.flush()

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style", "title")
            if tag == "a":
                self.link = 0
            elif tag not in h.INLINE and tag not in h.SILENT:
                self.flush()

        def handle_data(self, data):
            if not self.raw:
                self.parts.append((data, self.link))

    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the shared tables are not here")
def test_blocks_and_articles_of_given_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html.endswith("</html>")]
    assert pages
    for html in pages:
        assert [(b.text, b.words, b.linked) for b in h.blocks(html)] == slow_blocks(html)
        inner = re.search("<article>(.*)</article>", html, re.S)[1]
        assert text(html) == " ".join(t for t, _, _ in slow_blocks(inner))


def test_labelled_table_is_learnt():
    import numpy as np

    table = np.array(h.LABELLED, float)
    assert (h.is_main(TREE, table[:, :-1]) == table[:, -1]).mean() > 0.97
