"""Facts from stored pages: cards of a listing, a profile's lines and interests, its personal page, publications and projects.

``found`` is ``markup.read(pages, SELECTORS)``: a row a page (page_id, text, elements). Elements of one thing (a card, an item, a block)
meet by the number of the nearest one around them, so each fact is one aggregation of small rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_quoted, clean_whitespace, latest_year, strong_key
from . import markup

# Where pages keep their facts.
SELECTORS = {
    "card": "div.results-div[data-name]",
    "card link": 'div.results-div[data-name] a[href*="profiles.php"]',
    "contact": "div.contact ul.fa-ul",
    "item": "div.contact ul.fa-ul li",
    "icon": "div.contact ul.fa-ul li i.fa-id-card-alt",
    "item link": "div.contact ul.fa-ul li a[href]",
    "block": "div.pubBlock",
    "heading": "div.pubBlock h5",
    "paper": "div.pubBlock blockquote a[href]",
    "project": 'li[data-proj="leading"]',
    "column": 'li[data-proj="leading"] div.col-12',
    "label": 'li[data-proj="leading"] div.col-12 span:not(.fa-li):not(.badge):not(.text-info):not(.text-success)',
    "funding": 'li[data-proj="leading"] span.text-info',
}
PERSONAL = "personal web"
# The rules for lines of a profile, as patterns over whole words or lines.
DEPARTMENTS = r"(?iu)^(Department|Division|School)\s+of(?U)\b"
RANKS = r"(?iuU)\b(Professor|Lecturer|Instructor|Director|Dean)\b"
DEGREES = r"(?iuU)\b(PhD|Ph\.D|M\.S|M\.Phil|B\.S|B\.Eng|University|Institute)\b"
SKIPPED = (
    "A", "Global Search", "Research Interest", "Publications", "Projects", "Teaching", "RPG Supervision", "Privacy Policy", "Copyright", "Office of Institutional", "Google Scholar", "ORCID", "Scopus",
    r"\(\d{3}\)\s*\d", r"Room\s+\d", r".*@.*\..*", "Personal Web", "View Profile",
)
HAN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
STOPS = (
    "Publications", "Projects", "Teaching", "RPG Supervision", "Privacy Policy", "Copyright", "Office of Institutional", "Awards", "Qualifications", "Work Experience", "Professional Activity", "Courses Taught", "Education",
)
INTEREST, LONGEST_HEADING, LEAST_LETTERS = "research interest", 30, 3
MIN_YEAR = 2020


def _of(found: DataFrame, outer: str, *inner: str) -> DataFrame:
    """page_id, kind, number (of the nearest outer element, for itself its own), pos, attributes, text, within of these kinds' elements."""
    kinds = (outer, *inner)
    rows = found.select("page_id", F.explode(F.filter("elements", lambda e: e["kind"].isin(*kinds))).alias("e")).select("page_id", "e.*")
    number = F.when(F.col("kind") == outer, F.col("pos")).otherwise(F.col("within")[outer])
    return rows.withColumn("number", number).where("number IS NOT NULL")


def _first(kind: str, value: Column) -> Column:
    """The value of the group's first element of a kind."""
    mine = F.col("kind") == kind
    return F.min_by(F.when(mine, value), F.when(mine, F.col("pos")))


def elements(pages: DataFrame, selector: str) -> DataFrame:
    """page_id, pos, attributes, text of the elements that fit a selector."""
    return markup.exploded(markup.read(pages, {"it": selector}), "it").drop("within")


def name_urls(found: DataFrame, base: str) -> DataFrame:
    """page_id, key, name, url, pos: cards with a name (their own, else their text) and a link; a relative url gets the base; the last card of a key counts.

    found may have been read with other selectors for ``card`` and ``card link``."""
    cards = _of(found, "card", "card link").groupBy("page_id", "number").agg(_first("card", F.coalesce(F.trim(F.col("attributes")["data-name"]), F.col("text"))).alias("name"), _first("card link", F.col("attributes")["href"]).alias("href"))
    named = cards.where("name <> '' AND href <> ''").withColumn("key", strong_key(F.col("name"))).where("key <> ''")
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    last = named.select("page_id", "key", F.struct(F.col("number").alias("pos"), "name", url.alias("url")).alias("x")).groupBy("page_id", "key").agg(F.max("x").alias("x"))
    return last.select("page_id", "key", "x.name", "x.url", "x.pos")


def cards(found: DataFrame) -> DataFrame:
    """page_id, pos, name of every card."""
    return markup.exploded(found, "card").select("page_id", "pos", F.coalesce(F.col("attributes")["data-name"], "text").alias("name"))


def site_names(named: DataFrame) -> DataFrame:
    """name, at: cleaned names (page_id, pos, name) in page order, the first of each key."""
    rows = named.select(clean_whitespace(F.col("name")).alias("name"), F.struct("page_id", "pos").alias("at")).withColumn("key", strong_key(F.col("name"))).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at")).select("name", "at")


def lines(texts: DataFrame) -> DataFrame:
    """texts: page_id, text. page_id, pos, line: the non-blank lines."""
    return texts.select("page_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]")).alias("pos", "line")).withColumn("line", clean_whitespace(F.col("line"))).where("line <> ''")


def profile(texts: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """page_id, department, title, name of texts (page_id, text); ``skipped``: further lines, as patterns, that a site has on every page.

    The department is the first line that begins as one, the title the first other line with a rank, and the name the first line
    that is neither a department, nor that title, nor a degree: a second line with a rank may be a name. One-letter lines, lines that are
    skipped as a whole and lines with Han letters do not count."""
    skip = rf"(?iu)^({'|'.join((*SKIPPED, *skipped))})$"
    is_ = {"d": F.col("line").rlike(DEPARTMENTS), "r": F.col("line").rlike(RANKS), "e": F.col("line").rlike(DEGREES)}
    rows = lines(texts).where((F.length("line") > 1) & ~F.col("line").rlike(skip) & ~F.col("line").rlike(HAN)).withColumns(is_).withColumn("at", F.struct("pos", "line"))
    first = lambda good: F.min(F.when(good, F.col("at")))
    # The two first lines with a rank: the earlier is the title, the other can be the name.
    ranked = F.array_sort(F.collect_list(F.when(F.col("r") & ~F.col("d"), F.struct("at", "e"))))
    seen = rows.groupBy("page_id").agg(first(F.col("d")).alias("department"), ranked.alias("ranked"), first(~F.col("d") & ~F.col("e") & ~F.col("r")).alias("plain"))
    other = F.filter(F.slice("ranked", 2, F.greatest(F.size("ranked"), F.lit(1))), lambda x: ~x["e"])
    name = F.array_min(F.filter(F.array(F.col("plain"), F.get(other, F.lit(0))["at"]), lambda x: x.isNotNull()))
    told = {"department": F.col("department"), "title": F.get("ranked", F.lit(0))["at"], "name": name}
    return seen.select("page_id", *[F.coalesce(c["line"], F.lit("")).alias(k) for k, c in told.items()])


def interests(texts: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """page_id, interests: lines after the last heading, up to the first that begins as a further section; distinct, joined by ``; ``.

    The heading is a line of these words alone; on a page without one, a short line that holds them. Pages without either have no row."""
    rows = lines(texts)
    low = F.lower("line")
    weak = low.contains(INTEREST) & (F.length("line") < LONGEST_HEADING)
    head = rows.groupBy("page_id").agg(F.coalesce(F.max(F.when(low == INTEREST, F.col("pos"))), F.max(F.when(weak, F.col("pos")))).alias("from")).where("`from` IS NOT NULL")
    inside = rows.join(head, "page_id").where("pos > `from`")
    stop = inside.where(F.col("line").rlike(rf"(?iu)^({'|'.join((*STOPS, *stops))})")).groupBy("page_id").agg(F.min("pos").alias("to"))
    kept = inside.join(stop, "page_id", "left").where("to IS NULL OR pos < to").where(F.length("line") >= LEAST_LETTERS)
    once = kept.groupBy("page_id", F.lower("line").alias("k")).agg(F.min(F.struct("pos", "line")).alias("x")).groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    said = head.select("page_id").join(once, "page_id", "left")
    return said.select("page_id", F.coalesce(F.array_join(F.transform("x", lambda x: x["line"]), "; "), F.lit("")).alias("interests"))


def personal_web(found: DataFrame) -> DataFrame:
    """page_id, url: the link of the first contact item that has the icon or says so; pages without one have no row."""
    rows = _of(found, "item", "icon", "item link")
    link = F.struct(F.col("attributes")["href"].alias("href"), F.lower(clean_whitespace(F.col("text"))).alias("said"))
    items = rows.groupBy("page_id", "number").agg(F.min(F.col("within")["contact"]).alias("contact"), F.bool_or(F.col("kind") == "icon").alias("icon"), _first("item link", link).alias("link"))
    good = F.col("link").isNotNull() & (F.col("icon") | (F.col("link.said") == PERSONAL))
    # Only the first list of contacts on a page is looked at.
    best = items.groupBy("page_id", "contact").agg(F.min(F.when(good, F.struct("number", "link.href"))).alias("x")).groupBy("page_id").agg(F.min_by("x", "contact").alias("x"))
    return best.select("page_id", F.nullif(F.col("x.href"), F.lit("")).alias("url")).where("url IS NOT NULL")


def publications(found: DataFrame, least: int = MIN_YEAR) -> DataFrame:
    """page_id, pos, title: different titles, in order, of blocks whose heading's latest year is ``least`` or later."""
    rows = _of(found, "block", "heading", "paper")
    title = F.struct("pos", clean_whitespace(F.col("text")).alias("title"))
    blocks = rows.groupBy("page_id", "number").agg(_first("heading", F.col("text")).alias("heading"), F.collect_list(F.when(F.col("kind") == "paper", title)).alias("titles"))
    recent = blocks.where(latest_year(F.col("heading")) >= least).select("page_id", F.inline("titles")).where("title <> ''")
    return recent.groupBy("page_id", "title").agg(F.min("pos").alias("pos")).select("page_id", "pos", "title")


def leading_projects(found: DataFrame) -> DataFrame:
    """page_id, pos, project, funding: items marked as leading that are shown; the first label of the first column is the project."""
    rows = _of(found, "project", "column", "label", "funding")
    column = F.when(F.col("kind") == "column", F.col("pos")).when(F.col("kind") == "label", F.col("within")["column"])
    text = clean_whitespace(F.col("text"))
    columns = rows.withColumn("column", column).groupBy("page_id", "number", "column").agg(
        F.min(F.when((F.col("kind") == "label") & (text != ""), F.struct("pos", text.alias("t")))).alias("label"),
        _first("funding", text).alias("funding"),
        F.bool_or((F.col("kind") == "project") & (F.col("attributes")["style"].rlike(r"(?i)display\s*:\s*none") | F.array_contains(F.map_keys("attributes"), "hidden"))).alias("hidden"),
    )
    items = columns.groupBy("page_id", "number").agg(F.min_by("label", "column").alias("label"), F.max("funding").alias("funding"), F.coalesce(F.bool_or("hidden"), F.lit(False)).alias("hidden")).where("NOT hidden")
    told = items.select("page_id", F.col("number").alias("pos"), clean_quoted(F.col("label.t")).alias("project"), clean_quoted(F.col("funding")).alias("funding"))
    return told.where("project <> ''")


def facts(found: DataFrame, urls: DataFrame | None = None, skipped: tuple[str, ...] = (), stops: tuple[str, ...] = ()) -> DataFrame:
    """page_id, name, department, title, interests, url of profile pages; urls (page_id, url) are the pages' own, where there is no personal one."""
    told = found.select("page_id").join(profile(found, skipped), "page_id", "left").join(interests(found, stops), "page_id", "left").join(personal_web(found).withColumnRenamed("url", "web"), "page_id", "left")
    told = told.join(urls.select("page_id", "url"), "page_id", "left") if urls is not None else told.withColumn("url", F.lit(""))
    return told.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "department", "title", "interests")], F.coalesce("web", "url", F.lit("")).alias("url"))
