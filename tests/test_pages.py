"""Stored pages: elements against a slow tree, hostile pages, and the rules for facts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.sources import markup, pages

SELECTORS = {"a": "div.x a[href]", "b": "ul > li", "c": "#i, p.y span:not(.z):not([q])", "d": "div div p", "e": '[data-k*="v"] b, i[data-k^="v"]', "f": "*"}


def random_page(rng):
    """Well-formed markup, so that any reader sees the same tree; with quotes, references, comments and raw text."""
    def element(depth):
        tag = rng.choice(["div", "div", "span", "ul", "b", "i", "section"]) if depth < 6 else "b"
        said = {}
        for name, values in (("class", ["x", "y z", "x y"]), ("id", ["i"]), ("data-k", ["v", "uv", "vw", ""]), ("q", [""]), ("href", ["/a?b=1&c=2"])):
            if rng.random() < 0.3:
                said[name] = rng.choice(values)
        inner = [element(depth + 1) if rng.random() < 0.6 else rng.choice(["one", " two\n three ", "&amp;", "<!-- <b>no</b> -->", "x > y", "<script>if (a<b) '<p>'</script>", "<br>"]) for _ in range(rng.randrange(4))] if depth < 6 else ["leaf"]
        if tag == "ul":
            inner = [("li", {"class": "x"}, ["item", element(depth + 2)]) for _ in range(2)]
        return (tag, said, inner)

    return [element(0) for _ in range(3)]


def written(node, rng):
    if isinstance(node, str):
        return node
    tag, said, inner = node
    quote = lambda v: rng.choice([f'"{v}"', f"'{v}'"]) if v or rng.random() < 0.5 else '""'
    attributes = "".join(f" {k}={quote(v.replace('&', '&amp;'))}" for k, v in said.items())
    return f"<{rng.choice([tag, tag.upper()])}{attributes}{rng.choice(['', ' '])}>" + "".join(written(x, rng) for x in inner) + f"</{tag}>"


def expected(nodes):
    """(kinds, attributes) of all elements by looking at every selector for every path."""
    out = []
    has = lambda n, c: c in n[1].get("class", "").split()

    def walk(node, path):
        if isinstance(node, str):
            if node == "<br>":
                out.append((["f"], {}))
            if node.startswith("<script"):
                out.append((["f"], {}))
            return
        tag, said, inner = node
        kinds = []
        if tag == "a" and "href" in said and any(n[0] == "div" and has(n, "x") for n in path):
            kinds.append("a")
        if tag == "li" and path and path[-1][0] == "ul":
            kinds.append("b")
        if said.get("id") == "i" or tag == "span" and not has(node, "z") and "q" not in said and any(n[0] == "p" and has(n, "y") for n in path):
            kinds.append("c")
        if tag == "p" and sum(n[0] == "div" for n in path) >= 2:
            kinds.append("d")
        if tag == "b" and any("v" in n[1].get("data-k", "") for n in path) or tag == "i" and said.get("data-k", "").startswith("v"):
            kinds.append("e")
        out.append((kinds + ["f"], said))
        for x in inner:
            walk(x, [*path, node])

    for n in nodes:
        walk(n, [])
    return out


def test_selectors_against_every_path():
    rng, steps = random.Random(3), markup.Selectors(SELECTORS)
    for _ in range(300):
        nodes = random_page(rng)
        _, found = markup.parse("".join(written(n, rng) for n in nodes), steps)
        by = {}
        for e in found:
            by.setdefault(e["pos"], [set(), dict(e["attributes"])])[0].add(e["kind"])
        assert [(x[0], x[1]) for _, x in sorted(by.items())] == [(set(k), a) for k, a in expected(nodes)]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>one<p>two<div>three</div>", ["one", "two"]),
        ("<ul><li><p>a<li><p>b</ul>c", ["a", "b"]),
        ("<p class=x>a <b>b</p> c</b>", ["a b"]),
        ("<p>a<br>b &lt;c&gt;</p>", ["a\nb <c>"]),
        ("<p>a<script><p>no</p></script>b<style>p{}</style></p>", ["ab"]),
        ("<p title='never closed>a<p>b", ["a", "b"]),
        ("<table><tr><td><p>a<td><p>b<tr><td><p>c</table>", ["a", "b", "c"]),
        ("</p></div><p>a", ["a"]),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", ["", "", "yes"]),
        ("<p>a</p", ["a"]),
        ("", []),
    ],
)
def test_loose_markup(html, want):
    _, found = markup.parse(html, markup.Selectors({"p": "p"}))
    assert [e["text"] for e in found] == want


def test_links_of_any_spelling():
    _, found = markup.parse("<a href='/x'>Ann</a><A HREF=/y><b>Bob</b> Lee</a><a name=z>no</a><a href=\"/w\">one<a href=/v>two", markup.Selectors({"a": "a[href]"}))
    assert [(dict(e["attributes"])["href"], e["text"]) for e in found] == [("/x", "Ann"), ("/y", "Bob Lee"), ("/w", "one"), ("/v", "two")]


PIECES = ['<a "', "<a ='", '<a x="', "<", "<a", "</", "<!--", "<![CDATA[", "<select>", "<title>", "<p class=", "<a x=\"'", "<div>", "&amp", "= '", "</div>x", "<li>", "<span>x", "<div class='results-div' data-name=x>y", "<ul><li><span>z", "</nav>", "<td>", "<div></nav>"]


@pytest.mark.parametrize("piece", PIECES)
def test_hostile_pages_take_linear_time(piece):
    steps = markup.Selectors(pages.SELECTORS)
    html = piece * (1_000_000 // len(piece)) if piece != "<div></nav>" else "<div>" * 100_000 + "</nav>" * 80_000
    started = time.process_time()
    markup.parse(html, steps)
    assert time.process_time() - started < 6


def test_bad_selectors_are_errors():
    for bad in ("a,", "", "a >", "a:first"):
        with pytest.raises(ValueError, match="selector"):
            markup.compile_selector(bad)


def profile(spark, *lines):
    return tuple(pages.profile(spark.createDataFrame([(1, "\n".join(lines))], "page_id long, text string")).select("name", "department", "title").first() or ())


def test_lines_of_a_profile(spark):
    assert profile(spark, "A", "x", "Global Search", "Wei CHAN", "Division of Life Science", "Chair Professor, Institute for Advanced Study") == ("Wei CHAN", "Division of Life Science", "Chair Professor, Institute for Advanced Study")
    assert profile(spark, "Director, Example Centre", "Contact Lee") == ("Contact Lee", "", "Director, Example Centre")
    assert profile(spark, "Department office", "School  of Law", "PhD, Some College") == ("Department office", "School of Law", "")
    assert profile(spark, "Dean of Students", "Professor Ann Lee", "陈 Lee") == ("Professor Ann Lee", "", "Dean of Students")
    assert profile(spark, "Follow us", "Bo") == ("Follow us", "", "") and pages.profile(spark.createDataFrame([(1, "Follow us\nBo")], "page_id long, text string"), ("Follow us",)).first()["name"] == "Bo"
    assert profile(spark, "a@b.edu", "(852) 2", "Room 3", "ab@c") == ("ab@c", "", "")


def test_interests_between_headings(spark):
    def told(*lines):
        r = pages.interests(spark.createDataFrame([(1, "\n".join(lines))], "page_id long, text string")).first()
        return None if r is None else r.interests

    assert told("Research Interest", "old", "RESEARCH INTEREST", "lasers", "LASERS", "ox", "quantum dots", "Awards and Honours", "no") == "lasers; quantum dots"
    assert told("My research interests:", "lasers", "Educational work") == "lasers"
    assert told("My research interests:", "no", "Research interest", "lasers") == "lasers"
    assert told("A line about my research interest and more", "x y z") is None and told("Research Interest") == ""


def test_facts_of_nothing(spark):
    empty = markup.read(spark.createDataFrame([], "page_id long, html string"), pages.SELECTORS)
    blank = markup.read(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string"), pages.SELECTORS)
    for found, n in ((empty, 0), (blank, 2)):
        assert [tuple(r)[1:] for r in pages.facts(found).collect()] == [("", "", "", "", "")] * n
        assert pages.name_urls(found, "b").count() == pages.publications(found).count() == pages.leading_projects(found).count() == pages.personal_web(found).count() == 0


def test_cards_and_projects(spark):
    html = """<div class="results-div" data-name=" Ann "><a href=other>x</a><a href="/profiles.php?a">A</a><a href="/profiles.php?b">B</a></div><div class=results-div data-name="ANN"><a href=http://h/profiles.php>A</a></div>
    <div class=results-div data-name=""><a href=/profiles.php>none</a></div><div class=results-div data-name=Bo></div>
    <li data-proj=leading><div class=col-12><span class=badge>x</span></div><div class=col-12><span>second column</span></div><li data-proj=leading><div class=col-12><span> </span><span>one <span>two</span></span></div><span class=text-info>é"F"</span>"""
    found = markup.read(spark.createDataFrame([(1, html)], "page_id long, html string"), pages.SELECTORS)
    assert [(r.key, r.name, r.url) for r in pages.name_urls(found, "http://b").collect()] == [("ann", "ANN", "http://h/profiles.php")]
    assert [(r.project, r.funding) for r in pages.leading_projects(found).collect()] == [("one two", 'F')]
    assert {r.name for r in pages.site_names(pages.cards(found)).collect()} == {"Ann", "Bo"}
