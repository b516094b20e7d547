"""Column functions over strings and arrays of strings. Python's idea of white space and words is Unicode's: ``(?U)``."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"
# Invisible characters that names lose, and letters that are spelt out.
INVISIBLE = r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{2060}\x{feff}\x{00ad}]"
_INVISIBLE = re.compile("[\u200b-\u200f\u2028-\u202f\u2060\ufeff\u00ad]")
SPELT_OUT = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "AE", "Ö": "OE", "Ü": "UE", "ß": "ss"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Null becomes the empty string; outer white space goes."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def clean_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def weak_key(c: Column) -> Column:
    """Lower case, single blanks: the key that joins technology projects."""
    return F.lower(clean_whitespace(c))


@lru_cache(maxsize=1)
def _marks() -> dict[int, None]:
    """Combining marks, which a name loses."""
    return dict.fromkeys(c for c in range(0x110000) if unicodedata.category(chr(c)) == "Mn")


def _plain(name: str) -> str:
    """References decoded, invisible characters gone, umlauts spelt out, accents gone."""
    seen = _INVISIBLE.sub("", html.unescape(name) if "&" in name else name)
    for letter, spelt in SPELT_OUT.items():
        seen = seen.replace(letter, spelt)
    return unicodedata.normalize("NFKD", seen).translate(_marks())


@F.pandas_udf(StringType())
def _decompose(names: pd.Series) -> pd.Series:
    return names.map(_plain, na_action="ignore")


def strong_key(c: Column) -> Column:
    """References decoded once, invisible characters and accents gone, umlauts spelt out, lower case, single blanks.

    Python sees only texts with a reference or with letters beyond ASCII (``translate`` takes three times as long)."""
    given = F.coalesce(c, F.lit(""))
    simple = given.rlike(r"^[\x00-\x25\x27-\x7F]*$")
    return F.lower(clean_whitespace(F.when(simple, given).otherwise(_decompose(F.when(~simple, given)))))


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def clean_quoted(c: Column) -> Column:
    """ASCII, single blanks, no quotes in front and no double ones at the end (project names and funding)."""
    return F.regexp_replace(F.regexp_replace(clean_whitespace(ascii_only(c)), r"""^["']+""", ""), r'''["]+$''', "")


def token_set(c: Column) -> Column:
    """Distinct [a-z0-9]+ runs of the lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0)))


def vector_tokens(c: Column) -> Column:
    """Tokens of the vectoriser: two word characters or more, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\b\w+\b"), F.lit(0)))


def distinct_ignoring_case(items: Column) -> Column:
    """The first of each spelling, in order."""
    keys = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def split_numbered(c: Column) -> Column:
    """``1. a 2. b`` as its items; without a marker the whole text; trimmed, single blanks, distinct."""
    text = F.coalesce(c, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?<!\S)\d+\.\s*(.*?)(?=(?<!\S)\d+\.\s*|$)"), F.lit(1))
    items = F.when(F.size(found) > 0, found).otherwise(F.array(text))
    tidy = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[ \t\n;,]+|[ \t\n;,]+$", ""), r"\s+", " "))
    return distinct_ignoring_case(F.filter(tidy, lambda x: x != ""))


def split_list(c: Column, pattern: str = ",") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: strip(x)), lambda x: x != "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def startup_id(name: Column, year: Column, row: Column) -> Column:
    return F.concat_ws("-", F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("startup")), F.coalesce(year.cast("string"), F.lit("na")), row.cast("string"))


def title_class(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.contains("assistant"), "assistant").when(t.contains("lecturer"), "lecturer").when(t.contains("associate"), "associate").otherwise("professor")


#: Years in a text (fixed format).
YEAR = r"\b(19\d{2}|20\d{2})\b"


def latest_year(c: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))


def valid_keyword(c: Column, stop: list[str]) -> Column:
    """Not a stop word; two characters with a Han character, three otherwise."""
    han = c.rlike(r"[一-鿿]")
    return ~F.lower(c).isin(stop) & F.when(han, F.length(c) >= 2).otherwise(F.length(c) >= 3)


def query_keywords(c: Column, stop: list[str]) -> Column:
    """Distinct valid keywords of a query split at other characters than letters, digits and Han."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-zA-Z0-9一-鿿]+")
    return F.array_distinct(F.filter(parts, lambda x: valid_keyword(x, stop)))


def escape_html(c: Column) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), c)


def highlight(c: Column, keywords: list[str]) -> Column:
    """Keywords in <mark>, one after the other over the escaped text, whatever their case."""
    quote = lambda k: "".join("\\" + ch if not ch.isalnum() and ch.isascii() and not ch.isspace() else ch for ch in k)
    flag = lambda k: "(?i)" if any(ch.isascii() and ch.isalnum() for ch in k) else ""
    return reduce(lambda out, k: F.regexp_replace(out, f"{flag(k)}({quote(k)})", "<mark>$1</mark>"), keywords, escape_html(F.coalesce(c, F.lit(""))))


def hits(c: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.lower(c).contains(k)))


def summarize(c: Column, keywords: Column, most: int = 200) -> Column:
    """Short texts whole; else the fragments with most keywords first, as long as they fit; no text: a notice."""
    parts = split_list(c, "[;,]")
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-hits(p, keywords)).alias("n"), i.alias("i"), p.alias("p"))))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def add(state: Column, x: Column) -> Column:
        longer = F.when(state["out"] == "", x["p"]).otherwise(F.concat(state["out"], F.lit(", "), x["p"]))
        fits = ~state["done"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(state["out"]).alias("out"), (state["done"] | ~fits).alias("done"))

    filled = F.aggregate(ranked, start, add, lambda state: state["out"])
    filled = F.when(filled == "", F.substring(F.get(ranked, F.lit(0))["p"], 1, most)).otherwise(filled)
    cut = F.concat(strip(F.substring(c, 1, most)), F.lit("…"))
    picked = F.when(F.length(filled) < F.length(c), F.concat(filled, F.lit("…"))).otherwise(filled)
    none = F.coalesce(c, F.lit("")) == ""
    return F.when(none, "No research interests provided.").when(F.length(c) <= most, c).when((F.size(keywords) == 0) | (F.size(parts) <= 1), cut).otherwise(picked)


def chips(c: Column, keywords: Column) -> Column:
    """Struct: up to five short fragments with a keyword (matched), up to three without (context)."""
    parts = F.filter(split_list(c, "[;,]"), lambda p: F.length(p) < 60)
    return F.struct(F.slice(F.filter(parts, lambda p: hits(p, keywords) > 0), 1, 5).alias("matched"), F.slice(F.filter(parts, lambda p: hits(p, keywords) == 0), 1, 3).alias("context"))


def tech_edges(c: Column) -> Column:
    """Lines and bullets; a text of nothing but bullets is split at ; and |."""
    raw = F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("\n"))
    bullets = F.filter(F.transform(F.split(raw, r"\n+|(?=•)"), lambda x: strip(F.regexp_replace(strip(x), r"^•\s*", ""))), lambda x: x != "")
    return F.when(F.size(bullets) > 0, bullets).otherwise(split_list(raw, r"[;|]+"))


def source_class(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("bmh", "mes"), t).otherwise("eas")


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


#: ``[n/m]`` in a log line, with two groups (fixed format).
MARKER = r"\[\s*(\d{1,9})\s*/\s*(\d{1,9})\s*\]"
#: Shapes of log lines that name a person (fixed formats), in order of precedence.
NAMED = (
    r"\[\s*\d+\s*/\s*\d+\s*\]\s*Scraping:\s*(.+)$",
    r"\[\s*\d+\s*/\s*\d+\s*\]\s*Processing\s+(?:publication|project):\s*(.+)$",
    r"^\s*(?:\[\s*\d+\s*/\s*\d+\s*\]\s*)?([^:]{2,120}):\s+\d+\s+publications\b",
    r"^\s*(?:\[\s*\d+\s*/\s*\d+\s*\]\s*)?([^:]{2,120}):\s+\d+\s+leading projects\b",
    r"Processing\s*:\s*([a-zA-Z][a-zA-Z\s.\-']{1,120})",
)


def progress_marker(line: Column) -> Column:
    """Struct (current, total) of ``[n/m]``, current at most total; null without a marker or with total 0."""
    number = lambda g: F.nullif(F.regexp_extract(line, MARKER, g), F.lit("")).cast("int")
    return F.when(number(2) > 0, F.struct(F.least(number(1), number(2)).alias("current"), number(2).alias("total")))


def name_in_line(line: Column) -> Column:
    """The person that a log line is about, by the first shape that fits."""
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(line, f"(?i){shape}", 1)), F.lit("")) for shape in NAMED])


def attribute_label(c: Column) -> Column:
    """``research_area`` as ``Research Area``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def fixed(c: Column, digits: int = 3) -> Column:
    """A number with so many digits after the point; null as a dash."""
    return F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit("-"))


def short_name(c: Column, most: int = 24) -> Column:
    """A file name of more than ``most`` characters: its beginning, three dots and its ending with the extension."""
    extension = F.regexp_extract(c, r"(\.[^.]*)$", 1)
    head = F.substring(c, F.lit(1), F.greatest(F.lit(most) - F.length(extension) - 3, F.lit(1)))
    return F.when(F.length(c) > most, F.concat(head, F.lit("..."), extension)).otherwise(c)
