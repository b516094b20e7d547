"""Queries over files and texts that are made from the shared tables: ingest, profiles from pages, keyword chains, updates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored
from .functions import terms, text, vectors
from .operators import keywords, profile, validate
from .plans import match, update
from .queries import _CANDIDATES, _PAIRS, _RELEVANCE, _asked, _in, _texts
from .registry import query, table
from .sources import ingest, markup, pages, workbook
from .streaming import keyed


def _csv(df: DataFrame, place: str) -> str:
    df.write.option("header", True).option("quoteAll", True).mode("overwrite").csv(place)
    return place


@query("""SELECT c_name AS name, c_mktsegment AS research_interests, '' AS title, CAST(c_nationkey AS VARCHAR) AS office, 0 AS missing, (SELECT count(*) FROM customer) AS counted, 0 AS broken FROM customer""")
def people_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with loose headers: synonyms, a missing column, another column as attribute; a path that is not there is an empty table."""
    place = stored.new_folder(spark, "files")
    c = table(spark, sf_dir, "customer")
    path = _csv(c.select(F.col("c_name").alias(" Names "), F.col("c_mktsegment").alias("Research  Interests"), F.col("c_nationkey").alias("Office")), f"{place}/people")
    chosen = ingest.first_existing(spark, [f"{place}/none", path, f"{place}/later"])
    people = ingest.complete(ingest.read_csv(spark, chosen), ("name", "research_interests", "title"))
    none = ingest.read_csv(spark, f"{place}/none", missing=("name", "paper")).count()
    counts = ingest.row_count(spark, path), ingest.row_count(spark, f"{place}/none")
    return people.select("name", "research_interests", "title", F.col("attributes")["office"].alias("office"), F.lit(none).alias("missing"), F.lit(counts[0]).cast("long").alias("counted"), F.lit(counts[1]).alias("broken"))


@query("""WITH y AS (SELECT DISTINCT split_part(o_orderpriority, '-', 2) AS s, year(o_orderdate) AS year FROM orders), f AS (SELECT s, year, CASE WHEN year % 2 = 0 THEN s ELSE lower(s) END || '_' || year || '.csv' AS file FROM y),
m AS (SELECT upper(regexp_extract(s, '[A-Za-z]+$')) AS source, file FROM f UNION ALL SELECT 'EAS', 'other_' || c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT 'listed' AS what, upper(regexp_extract(s, '[A-Za-z]+$')) AS source, year, file FROM f
UNION ALL SELECT 'largest', '', 0, max(file) FROM f UNION ALL SELECT 'merged', source, 0, file FROM m UNION ALL SELECT 'enabled', '', 0, file FROM f WHERE year % 2 = 0 UNION ALL SELECT 'fallback', '', 0, 'f.csv'""")
def yearly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files named after priorities and years of orders: discovered, the largest name, merged with configured sources, those enabled, the fallback."""
    orders = table(spark, sf_dir, "orders").select(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("s"), F.year("o_orderdate").alias("y"), "o_orderdate")
    name = F.concat(F.when(F.col("y") % 2 == 0, F.col("s")).otherwise(F.lower("s")), F.lit("_"), F.col("y").cast("string"), F.lit(".csv"))
    listing = orders.groupBy(F.concat(F.lit("x:/folder/"), name).alias("path")).agg(F.unix_timestamp(F.max("o_orderdate")).alias("modified"))
    found, file = ingest.named_files(listing), F.element_at(F.split("path", "/"), -1).alias("file")
    none, zero = F.lit("").alias("source"), F.lit(0).alias("year")
    configured = table(spark, sf_dir, "customer").select(F.concat(F.lit("x:/other_"), "c_mktsegment").alias("path"), F.lit(None).cast("string").alias("source_id")).distinct()
    merged = ingest.merge_sources(found.select("path", F.col("source").alias("source_id")), configured)
    switched = found.select("path", F.col("source").alias("source_id"), (F.col("year") % 2 == 0).alias("enabled"))
    told = [
        found.select(F.lit("listed").alias("what"), "source", "year", file), ingest.latest(found, by="path").select(F.lit("largest").alias("what"), none, zero, file), merged.select(F.lit("merged").alias("what"), F.col("source_id").alias("source"), zero, file),
        ingest.enabled_sources(switched, "x/f.csv").select(F.lit("enabled").alias("what"), none, zero, file), ingest.enabled_sources(switched.where("year(current_date()) < 0"), "x/f.csv").select(F.lit("fallback").alias("what"), none, zero, file),
    ]
    return functools.reduce(DataFrame.unionByName, told)


_COLUMNS = {"pi": "p i", "title": "Title", "overview": "Overview", "app_1": "App 1", "app_2": "App 2", "app_3": "App 3", "industry_1": "Industry"}


@query("""WITH p AS (SELECT p_partkey % 10 + 1 AS k, p_partkey, p_size, p_name || ' ' || p_type || ' ' || p_brand AS t FROM part WHERE p_partkey % 13 <> 0)
SELECT s_suppkey AS id, count(p_partkey) AS projects, count(p_partkey) FILTER (WHERE p_size % 2 = 0) AS eas, md5(coalesce(string_agg(t, '|' ORDER BY t), '')) AS texts FROM supplier LEFT JOIN p ON k = s_suppkey GROUP BY 1""")
def deeptech_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technology projects of two files with configured headers, attached to people by a key that ignores case and blanks."""
    place = stored.new_folder(spark, "files")
    part = table(spark, sf_dir, "part")
    pi = F.when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.concat(F.lit(" PERSON  "), (F.col("p_partkey") % 10 + 1).cast("string")))
    named = part.select("p_size", pi.alias("P I"), F.col("p_name").alias("TITLE"), F.concat(F.lit(" "), "p_name").alias("Overview"), F.col("p_type").alias("App 1"), F.lit("").alias("App 2"), F.lit(" ").alias("App 3"), F.col("p_brand").alias("Industry"))
    files = {source: _csv(named.where(f"p_size % 2 = {odd}").drop("p_size"), f"{place}/{source}") for source, odd in (("EAS", 0), ("BMH", 1))}
    projects = ingest.union_sources({source: ingest.read_csv(spark, path) for source, path in files.items()}, _COLUMNS)
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Person "), "s_suppkey").alias("name"))
    told = profile.attach_projects(people, projects)
    texts = F.array_join(F.array_sort(F.transform("deeptech", profile.project_text)), "|")
    return told.select("id", F.size("deeptech").cast("long").alias("projects"), F.size(F.filter("deeptech", lambda p: p["source"] == "EAS")).cast("long").alias("eas"), F.md5(texts.cast("binary")).alias("texts"))


@query("""SELECT p_partkey AS raw_row_index, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-2025-' || p_partkey AS startup_id, 2025 AS source_year, p_name AS company_name, 'Ann Lee|' || p_brand AS people, replace(p_type, ' ', '|') AS categories FROM part""")
def startup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Startups of a yearly file: ids, people as a numbered list, categories by comma."""
    place = stored.new_folder(spark, "files")
    people = F.concat(F.lit("1. Ann  Lee;\n2. "), "p_brand")
    path = _csv(table(spark, sf_dir, "part").select(F.col("p_name").alias("Company_Name"), people.alias("People"), F.replace("p_type", F.lit(" "), F.lit(", ,")).alias("Category"), F.col("p_partkey").alias("raw_row_index")), f"{place}/startup_2025.csv")
    rows = ingest.startups(ingest.read_csv(spark, path), {}, "startup_2025.csv")
    return rows.select(F.col("raw_row_index").cast("long").alias("raw_row_index"), "startup_id", "source_year", "company_name", F.array_join("people", "|").alias("people"), F.array_join("categories", "|").alias("categories"))


@query("""SELECT 'STARTUP_' || (2020 + p_size % 4) AS file, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) AS raw_row_index,
 trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || (2020 + p_size % 4) || '-' || row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) AS startup_id, p_name || ' <&> "x"' AS company_name, replace(p_type, ' ', '|') AS categories, CAST(p_size AS VARCHAR) AS funding FROM part""")
def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Startups of four yearly workbooks, written from parts and read back sheet by sheet."""
    folder = stored.new_folder(spark, "workbooks")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("STARTUP_"), (2020 + F.col("p_size") % 4).cast("string")).alias("file"), "p_partkey", F.concat("p_name", F.lit(' <&> "x"')).alias("Company  Name"), F.replace("p_type", F.lit(" "), F.lit(", ")).alias("Category"), F.col("p_size").alias("Funding"), F.lit(None).cast("string").alias("Website"))
    workbook.write_workbooks(rows, folder, "file", "p_partkey")
    read = ingest.read_xlsx(spark, folder)
    told = []
    for year in range(2020, 2024):
        one = read.where(F.col("_file").endswith(f"STARTUP_{year}.xlsx"))
        numbered = one.withColumn("raw_row_index", F.col("_row"))
        found = ingest.startups(numbered, {"company_name": "company name"}, f"startup_{year}.xlsx")
        told.append(found.select(F.lit(f"STARTUP_{year}").alias("file"), "raw_row_index", "startup_id", "company_name", F.array_join("categories", "|").alias("categories"), "funding"))
    return functools.reduce(DataFrame.unionByName, told).withColumn("startup_id", F.regexp_replace("startup_id", "-x-(20)", "-$1"))


@query("""WITH c AS (SELECT c_custkey AS r, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'P ' || c_custkey % 40 END AS name, c_mktsegment AS department, 'T ' || c_nationkey % 3 AS title, c_custkey % 2 = 0 AS is_engineering, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_custkey % 7 END::DOUBLE AS years FROM customer),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name, department, title ORDER BY r) = 1)
SELECT r, CASE WHEN name = '' THEN 'Professor ' || row_number() OVER (ORDER BY r) ELSE name END AS name, department, title, is_engineering, years FROM k""")
def clean_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned people: blank names numbered, repeated rows dropped, truth and numbers from text (unreadable years as -1 here)."""
    key = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        key.alias("_row"), F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit(" P "), (key % 40).cast("string"))).alias("name"), F.concat(F.lit(" "), "c_mktsegment").alias("department"), F.concat(F.lit("T "), (F.col("c_nationkey") % 3).cast("string")).alias("title"),
        F.when(key % 2 == 0, "no").otherwise("").alias("is_engineering"), F.when(key % 3 == 0, "many").otherwise((key % 7).cast("string")).alias("years_since_phd"),
    )
    years = F.when(F.isnan("years_since_phd"), -1.0).otherwise(F.col("years_since_phd"))
    return profile.clean_people(raw).select(F.col("_row").alias("r"), "name", "department", "title", "is_engineering", years.alias("years"))


# Stored pages ---------------------------------------------------------------------------------------------------------


_LINKS = {"card": "nav li", "card link": "nav li > a[href]"}
_KEY = "strip_accents(lower(replace(replace(replace(replace(trim(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')))"


@query(rf"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS name, generate_subscripts(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS pos FROM pages)
SELECT page_id, trim(name) AS name, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://site.example' || href END AS url FROM a WHERE trim(name) <> ''
QUALIFY row_number() OVER (PARTITION BY page_id, {_KEY} ORDER BY pos DESC) = 1
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and urls of the entries of a page's menu: relative urls get the base, of names with one key the last counts."""
    return pages.name_urls(markup.read(table(spark, sf_dir, "pages"), _LINKS), "https://site.example").select("page_id", "name", "url")


@query(r"""
WITH p AS (SELECT page_id, unnest(string_split(html, '<p>')[2:]) AS part FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(part, '^(.*?)(?:</p>|</article>|<footer|<h1|<div|<ul|$)', 1, 's'), '<[^>]*(>|$)', ' ', 'g'), '&[a-z]*;?', ' ', 'g') AS t FROM p)
SELECT page_id, count(*) AS paragraphs, count(*) FILTER (WHERE regexp_matches(t, '\b(19|20)\d{2}\b')) AS dated, sum(len(regexp_extract_all(t, '[^\s]+')))::BIGINT AS words FROM t WHERE trim(t, E' \t\n\r') <> '' GROUP BY 1""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages, closed or not, with text of their own; those that name a year; their words (a reference counts as a blank)."""
    given = table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "&[a-z]*;?", " "))
    lines = pages.elements(given, "p").where(text.strip(F.col("text")) != "")
    words = F.size(F.split(text.clean_whitespace(F.col("text")), " "))
    return lines.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.count_if(text.latest_year(F.col("text")).isNotNull()).alias("dated"), F.sum(words).alias("words"))


@query(rf"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS name, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), 1) AS pos FROM pages)
SELECT page_id AS at, trim(name) AS name FROM a WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY page_id, pos) = 1""")
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all menus in page order, the first of each key (case, accents and special blanks ignored)."""
    found = markup.read(table(spark, sf_dir, "pages"), _LINKS)
    return pages.site_names(pages.cards(found)).select(F.col("at.page_id").alias("at"), "name")


_LINES = (
    "Chair Professor, Institute for Advanced Study", "Global Search", "Wei CHAN", "Division of Life Science", "Director, Example Centre", "Contact Lee", "A", "x", "PhD in Physics", "School of  Law, Dean", "陈 Professor", "Research Interest", "Lasers",
    "lasers", "ox", "Awards and Honours", "My Research Interest list", "Office of Institutional Research", "Department office", "(852) 2", "a@b.edu", "Professorial ties", "PUBLICATIONS 2020", "A research interest with very many words", "Lecturer at University",
)
_DEPARTMENT, _RANK, _DEGREE = r"^(Department|Division|School)\s+of\b", r"\b(Professor|Lecturer|Instructor|Director|Dean)\b", r"\b(PhD|Ph[.]D|M[.]S|M[.]Phil|B[.]S|B[.]Eng|University|Institute)\b"


def _says(pattern: str, line: str = "e.l") -> str:
    return f"regexp_matches({line}, '{pattern}', 'i')"


def _state(name: str = "s.name", department: str = "s.department", title: str = "s.title", line: str = "''") -> str:
    return f"{{'name': {name}, 'department': {department}, 'title': {title}, 'l': {line}}}"


@query(rf"""
WITH g AS (SELECT p_partkey // 7 AS page_id, list(CASE WHEN p_size % 5 = 0 THEN p_name ELSE [{", ".join(f"'{' '.join(x.split())}'" for x in _LINES)}][(p_partkey * 31 + p_size) % {len(_LINES)} + 1] END ORDER BY p_partkey) AS x FROM part GROUP BY 1),
k AS (SELECT page_id, list_filter(x, lambda l: length(l) > 1 AND NOT {_says('^(A|Global Search|Research Interest|Publications|Projects|Teaching|RPG Supervision|Privacy Policy|Copyright|Office of Institutional|Google Scholar|ORCID|Scopus|[(][0-9]{3}[)]\\s*[0-9]|Room\\s+[0-9]|.*@.*[.].*|Personal Web|View Profile)$', 'l')} AND NOT regexp_matches(l, '[一-鿿㐀-䶿]')) AS x FROM g),
f AS (SELECT page_id, list_reduce(list_prepend({_state("''", "''", "''")}, list_transform(x, lambda l: {_state("''", "''", "''", 'l')})), lambda s, e: CASE
  WHEN {_says(_DEPARTMENT)} AND s.department = '' THEN {_state(department='e.l')}
  WHEN {_says(_RANK)} AND s.title = '' AND NOT {_says(_DEPARTMENT)} THEN {_state(title='e.l')}
  WHEN s.name = '' AND NOT {_says(_DEPARTMENT)} AND NOT {_says(_DEGREE)} THEN {_state(name='e.l')}
  ELSE {_state()} END) AS s FROM k),
h AS (SELECT page_id, x, coalesce(list_max(list_filter(range(1, len(x) + 1), lambda i: lower(x[i]) = 'research interest')), list_max(list_filter(range(1, len(x) + 1), lambda i: contains(lower(x[i]), 'research interest') AND length(x[i]) < 30))) AS b FROM g),
e AS (SELECT *, list_min(list_filter(range(b + 1, len(x) + 1), lambda i: {_says('^(Publications|Projects|Teaching|RPG Supervision|Privacy Policy|Copyright|Office of Institutional|Awards|Qualifications|Work Experience|Professional Activity|Courses Taught|Education)', 'x[i]')})) AS e FROM h WHERE b IS NOT NULL),
i AS (SELECT page_id, list_filter(x[b + 1:coalesce(e - 1, len(x))], lambda l: length(l) >= 3) AS x FROM e),
o AS (SELECT page_id, list_reduce(list_prepend('', x), lambda s, l: CASE WHEN contains('; ' || lower(s) || '; ', '; ' || lower(l) || '; ') THEN s WHEN s = '' THEN l ELSE s || '; ' || l END) AS interests FROM i)
SELECT g.page_id, coalesce(s.name, '') AS name, coalesce(s.department, '') AS department, coalesce(s.title, '') AS title, coalesce(interests, '') AS interests FROM g LEFT JOIN f USING (page_id) LEFT JOIN o USING (page_id)""")
def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for the lines of a profile, against the same rules as a loop over lines: names of parts among lines that are easily mistaken."""
    part = table(spark, sf_dir, "part")
    some = F.element_at(F.array(*[F.lit(x) for x in _LINES]), ((F.col("p_partkey") * 31 + F.col("p_size")) % len(_LINES) + 1).cast("int"))
    rows = part.select(F.expr("p_partkey div 7").alias("page_id"), "p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(some).alias("line"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"])
    texts = rows.groupBy("page_id").agg(F.array_join(lists, " \n\t").alias("text"))
    told = texts.select("page_id").join(pages.profile(texts), "page_id", "left").join(pages.interests(texts), "page_id", "left")
    return told.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "department", "title", "interests")])


#: A profile page with what real pages have: quotes of both kinds and none, ends left out, nested tags, comments, a hidden item, references.
_PROFILE = """<!doctype html><html><head><title>Professor Nobody</title><script>if (a < b) document.write("<h1>Dean</h1>")</script></head><body>
<header><a href=/>Global  Search</a></header><h2>Wei <b>PERSON</b> {k}</h2><div>Department of<br>(852) 2</div><div class='dept'>Department of {segment}</div><p>Chair Professor, Institute for Advanced Study<p>PhD, Some University
<div class="card contact"><ul class="list fa-ul"><li><i class="fas fa-phone"></i> <a href="tel:1">(852) 2</a><li><span class='fa-li'><i class="fas fa-{icon}"></i></span><a title='x > y' href='{web}'>{said}</a></ul></div>
<h3>Research Interest</h3><ul><li>lasers<li>LASERS<li>ox</li><li>R&amp;D of <em>{segment}</em> dots</ul><h3>Awards and Honours</h3><p>none</p>
<div class="pubBlock"><h5>2019 &ndash; 2021</h5><blockquote><a href=1>Paper   {k}</a>, <a href='2'>Second <i>paper</i></a><a name=x>no link</a></blockquote><blockquote><a href=3>Paper {k}</a></blockquote></div>
<!-- <div class="pubBlock"><h5>2024</h5><blockquote><a href=4>no</a></blockquote></div> --><div class='pubBlock'><h5>2018</h5><blockquote><a href=5>old</a></blockquote></div>
<ul><li data-proj="leading"><span>outside</span><div class="row col-12"><span class="fa-li">x</span><span class='badge'>PI</span><span>&quot;Tom's <b>cell</b> {k}'&quot;</span><span>later</span></div><span class="small text-info">RGC "{k}"</span></li>
<li data-proj=leading style="DISPLAY : none"><div class=col-12><span>hidden</span></div></li><li data-proj="other"><div class=col-12><span>other</span></div></ul></body>"""


@query("""SELECT c_custkey AS page_id, 'Department of' AS department, 'Chair Professor, Institute for Advanced Study' AS title, 'Wei PERSON ' || c_custkey AS name, 'lasers; R&D of ' || c_mktsegment || ' dots' AS interests,
 CASE c_custkey % 3 WHEN 2 THEN 'http://page/' || c_custkey ELSE '/own?a=1&b=2' END AS url, 'Tom''s cell ' || c_custkey || chr(39) AS project, 'RGC "' || c_custkey AS funding, 'Paper ' || c_custkey || '|Second paper' AS papers FROM customer""")
def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of stored profile pages: lines by rules, interests, the personal page (by icon, by text, else the page's own), leading projects, recent papers."""
    # Pages take far longer than their rows are long: they are dealt by number, not left in the file's one or two parts.
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    c = markup.dealt(c.select("c_custkey", "c_mktsegment"), "c_custkey")
    html = F.lit(_PROFILE.replace("{web}", "/own?a=1&amp;b=2"))
    for name, value in {"k": F.col("c_custkey").cast("string"), "segment": F.col("c_mktsegment"), "icon": F.when(n == 0, "id-card-alt").otherwise("globe"), "said": F.when(n == 1, "Personal  <b>WEB</b>").otherwise("My web")}.items():
        html = F.replace(html, F.lit(f"{{{name}}}"), value)
    found = stored.materialize(markup.read(c.select(F.col("c_custkey").alias("page_id"), html.alias("html")), pages.SELECTORS), "pages")
    urls = c.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("http://page/"), "c_custkey").alias("url"))
    papers = pages.publications(found).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), "|").alias("papers"))
    return pages.facts(found, urls).join(pages.leading_projects(found).drop("pos"), "page_id", "left").join(papers, "page_id", "left")


@query(r"""SELECT p_partkey, 'P Retail Price' AS label, printf('%.3f', p_retailprice) AS price, CASE WHEN length(p_name || '_' || p_brand || '.xlsx') > 24 THEN left(p_name || '_' || p_brand || '.xlsx', 16) || '...' || '.xlsx' ELSE p_name || '_' || p_brand || '.xlsx' END AS file,
 lower(p_name) AS weak, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' the ' || p_type), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x <> 'the'))), ' ') AS words FROM part""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute labels, fixed numbers, shortened file names, weak keys and the keywords of a query."""
    p = table(spark, sf_dir, "part")
    words = text.query_keywords(F.concat_ws(" the ", "p_name", "p_type"), ["the"])
    return p.select("p_partkey", text.attribute_label(F.lit("p_retail_price")).alias("label"), text.fixed(F.col("p_retailprice")).alias("price"), text.short_name(F.concat("p_name", F.lit("_"), "p_brand", F.lit(".xlsx"))).alias("file"),
                    text.weak_key(F.concat(F.lit("  "), F.upper("p_name"))).alias("weak"), F.array_join(F.array_sort(words), " ").alias("words"))


_FILTERED = """f AS (SELECT query_id, string_agg(candidate, ' ' ORDER BY rank) FILTER (WHERE rank <= 7 AND score >= 0.5) AS strong, string_agg(candidate, ' ' ORDER BY rank) FILTER (WHERE rank <= 3) AS weak FROM k GROUP BY 1),
fq AS (SELECT a.query_id, coalesce(strong, weak, query) AS filtered_query FROM asked a LEFT JOIN f USING (query_id))"""


@query(f"""{_CANDIDATES}, {_FILTERED},
ks AS (SELECT query_id, candidate AS keyword, score AS weight, rank AS place FROM k WHERE score >= 0.45 AND length(candidate) >= 3 AND NOT {_in(terms.STOPWORDS, 'candidate')}),
kt AS (SELECT query_id, unnest(regexp_split_to_array(filtered_query, '[^a-zA-Z0-9]+')) AS keyword, generate_subscripts(regexp_split_to_array(filtered_query, '[^a-zA-Z0-9]+'), 1) AS place FROM fq WHERE query_id NOT IN (SELECT query_id FROM ks)),
kw AS (SELECT query_id, arg_min(keyword, place) AS keyword, 0.4 AS weight, min(place) AS place FROM kt WHERE length(keyword) >= 3 AND NOT {_in(terms.STOPWORDS, 'lower(keyword)')} GROUP BY query_id, lower(keyword))
SELECT query_id, keyword, round(weight, 6) AS weight, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, place) AS rank FROM (SELECT * FROM ks UNION ALL SELECT * FROM kw) QUALIFY rank <= 12""")
def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that results are shown with: extracted ones, else the query's tokens."""
    asked = _asked(spark, sf_dir)
    scored = keywords.score(keywords.candidates(asked))
    return keywords.keyword_candidates(scored, keywords.filtered_query(asked, scored)).withColumn("weight", F.round("weight", 6))


@query()
def chunk_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords from noun chunks and heads of a trained tagger: what users say in conversations, and benchmark items."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))
    return keywords.score(keywords.chunk_candidates(said.unionByName(items))).withColumn("score", F.round("score", 6))


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT *, sim + 0.2 * weight + CASE WHEN described THEN 0.1 ELSE 0 END AS score FROM p),
b AS (SELECT query_id, entity_id, keyword, max(score) AS score FROM s WHERE (literal OR sim >= 0.3) AND score >= 0.24 GROUP BY 1, 2, 3), m AS (SELECT query_id, keyword, round(max(score), 6) AS score FROM b GROUP BY 1, 2)
SELECT * FROM m UNION ALL SELECT DISTINCT query_id, 'fallback', 0.4 FROM p WHERE query_id NOT IN (SELECT query_id FROM m)""")
def merged_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each keyword over a query's results; queries without a match take the fallback."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    pairs = spark.sql(_PAIRS)
    fallback = pairs.select("query_id").distinct().select("query_id", F.lit("fallback").alias("keyword"), F.lit(0.4).alias("score"))
    return keywords.merged_highlights(keywords.matched_keywords(pairs, most=1000), fallback).withColumn("score", F.round("score", 6))


@query(f"""{_RELEVANCE}, r AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, id) AS rank FROM sims QUALIFY rank <= 3)
SELECT query_id, round(max(similarity), 6) AS similarity, string_agg(left(text, 100), '|' ORDER BY rank) AS suggestions, string_agg(split_part(left(text, 100), ';', 1), ', ' ORDER BY rank) FILTER (WHERE rank <= 2) AS areas FROM r JOIN documents ON doc_id = id GROUP BY 1""")
def query_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a weak query is pointed to: the beginnings of the three nearest texts of the corpus, and the first parts of the best two."""
    docs = _texts(table(spark, sf_dir, "documents"), "doc_id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    told = validate.corpus_similarity(asked, docs, vectors.TfIdf.fit(docs)).where("similarity > 0")
    return told.select("query_id", F.round("similarity", 6).alias("similarity"), F.array_join("areas", "|").alias("suggestions"), validate.area_names(F.col("areas")).alias("areas"))


@query("""WITH kept AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM kept))
SELECT c_custkey AS id, CAST(count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS papers, CAST(count(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS projects FROM kept LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1""")
def update_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update in stages over keyed tables: people join and depart, papers and projects are added and go with their people, and the merged table is published.

    Customers stand for people, their orders for papers and projects; the published table is read in another session."""
    place = stored.new_folder(spark, "update")
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    people, papers, projects = (keyed.KeyedTable(spark, f"{place}/{n}", key, "at", buckets=8) for n, key in (("people", "id"), ("papers", "o_orderkey"), ("projects", "o_orderkey")))
    departed = c.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"))

    def info() -> None:
        people.apply(c.select(F.col("c_custkey").alias("id"), F.lit("add").alias("op"), F.lit(1).alias("at")))
        people.apply(departed.select("id", F.lit("delete").alias("op"), F.lit(2).alias("at")))

    def added(to: keyed.KeyedTable, rows: DataFrame) -> None:
        to.apply(rows.select("o_orderkey", F.col("o_custkey").alias("id"), F.lit("add").alias("op"), F.lit(1).alias("at")))
        gone = to.read().join(departed, "id", "left_semi")
        to.apply(gone.select("o_orderkey", "id", F.lit("delete").alias("op"), F.lit(2).alias("at")))

    def merge() -> None:
        count = lambda t, n: t.read().groupBy("id").agg(F.count("*").alias(n))
        merged = people.read().select("id").join(count(papers, "papers"), "id", "left").join(count(projects, "projects"), "id", "left").na.fill(0, ["papers", "projects"])
        keyed.publish(merged, f"{place}/merged")

    steps = {"info": info, "publication": lambda: added(papers, o.where("o_orderstatus = 'F'")), "project": lambda: added(projects, o.where("o_orderstatus <> 'F'")), "merge": merge}
    told = update.run_update(steps, lambda percent, stage: None)
    if told["status"] != "completed":
        raise RuntimeError(f"{told['stage']}: {told['error']}")
    return keyed.published(spark, f"{place}/merged")


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, vectors.TfIdf]:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("company"), F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.col("p_type").alias("category"))
    fields: dict[str, Column] = {f: F.col(f) for f in match.FIELD_WEIGHTS}
    long = parts.select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), match.field_text(c, f).alias("text")) for f, c in fields.items()])))
    model = vectors.TfIdf.fit(long.select(F.concat_ws("/", "id", "field").alias("id"), "text"))
    return parts, long, model


@query()
def keyword_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of queries against their six best results by vectors, and what is shown of them (parts stand for startups)."""
    parts, long, model = _similar(spark, sf_dir)
    asked = parts.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat("company", F.lit(" "), "category").alias("query"))
    named = asked.withColumnRenamed("query", "text")
    first = vectors.first_of_each(long.where("field = 'description'").select("id", "text"), 10, "text")
    near = vectors.text_cosine(model, named, first).select("query", "text", F.round("similarity", 9).alias("score"))
    ranked = stored.materialize(match.best_of_classes(named, near, first, ["text"], 10), "ranked")
    weighed = keywords.keyword_candidates(keywords.score(keywords.candidates(asked)), asked.withColumn("filtered_query", F.col("query")))
    pairs = match.keyword_pairs(ranked, long, weighed.select("query_id", "keyword", "weight"), model)
    shown = keywords.display_keywords(weighed, pairs.select("query_id", "keyword", "sim")).select("query_id", F.lit(0).cast("long").alias("id"), "keyword", F.round("score", 6).alias("score"), "rank")
    matched = keywords.matched_keywords(pairs).select("query_id", F.col("entity_id").alias("id"), "keyword", F.round("score", 6).alias("score"), "rank")
    return shown.unionByName(matched)


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3),
p AS (SELECT o_custkey AS query_id, l_orderkey AS id, l_linenumber AS project, l_discount AS relevance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT r.query_id, r.id, r.rank, o.o_orderpriority AS name, coalesce((SELECT string_agg(project || ':' || printf('%.2f', relevance), ' ' ORDER BY n) FROM p WHERE p.id = r.id AND n <= 2), '') AS projects FROM r JOIN orders o ON o.o_orderkey = r.id""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they are shown: fields of the entity and its best projects (orders stand for people, order lines for projects)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("name"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("project"), F.lit(False).alias("blank"), F.col("l_discount").alias("similarity"))
    ranked = match.top_k(orders.select("query_id", "id", "score"), 3)
    projects = match.rank_projects(lines.join(orders.select("query_id", "id"), "id"))
    told = match.result_rows(ranked, orders, ["name"], projects, 2)
    shown = F.array_join(F.transform("projects", lambda p: F.concat(p["project"].cast("string"), F.lit(":"), F.format_string("%.2f", p["relevance"]))), " ")
    return told.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "name", shown.alias("projects"))

