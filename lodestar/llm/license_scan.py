"""Operator 6 (native): licence scan by digests of canonical whole texts.

A text is canonical after lower-casing, dropping copyright and rights lines,
turning every run of characters that are neither letters nor digits into one
space, and writing variant spellings one way.  Its SHA-256 is hash-joined with
the digests of known licences, which pass through the same expression.  One pass
over the texts; only the digest takes part in the join.  Whole texts are looked up:
a notice inside a longer text is not one.

The table of known licences is a parameter: ``KNOWN`` here, or any table of texts
(``license_id``, ``body``), such as one read from a folder with ``texts_from``.  Its
digests are broadcast while they are counted to be few.

Defined results: a null text counts as empty; an empty canonical text matches no
licence; null ids are kept; repeated rows are judged each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN
from .mixing import bounded_broadcast

#: Variant spellings and the form that stands for them (fixed values).
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "organisation": "organization",
    "organisations": "organizations",
    "authorised": "authorized",
    "authorisation": "authorization",
    "favour": "favor",
    "judgement": "judgment",
    "merchantibility": "merchantability",
    "non infringement": "noninfringement",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "https": "http",
}
#: A line that starts with a copyright notice or reserves all rights, with the line break before it.
RIGHTS_LINE = r"\n[^\p{L}\p{N}\n©(]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by )|©|\(c\)[ \t]|all rights reserved)[^\n]*"
#: Digest of the empty text, which is no licence.
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
NOT_A_WORD = r"[^\p{L}\p{N}]+"


_REPLACED = [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in SPELLINGS.items()]


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.concat(F.lit("\n"), out, F.lit("\n")), RIGHTS_LINE, "")
    # Two blanks between words, so that each word has its own and neighbours are replaced as well.
    out = F.regexp_replace(out, NOT_A_WORD, "  ")
    for said, meant in _REPLACED:
        out = F.replace(out, F.lit(said), F.lit(meant))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_table(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    return spark.createDataFrame(list(known.items()), "license_id string, body string")


def texts_from(spark: SparkSession, folder: str) -> DataFrame:
    """license_id (the file's name without its ending) and body of every text file of a folder."""
    name = F.regexp_extract(F.col("path"), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.format("binaryFile").load(folder).select(name.alias("license_id"), F.decode("content", "UTF-8").alias("body"))


def known_digests(known: DataFrame) -> DataFrame:
    """license_id, without the form in brackets, and canonical digest; equal texts under several names keep the first name."""
    named = F.regexp_replace("license_id", r" \([^)]*\)$", "")
    return known.groupBy(digest(F.col("body")).alias("known_sha256")).agg(F.min(named).alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, canonical_sha256, license_id (null unless the whole text is a known licence)."""
    judged = docs.select("doc_id", digest(F.col("text")).alias("canonical_sha256"))
    known = known_table(docs.sparkSession) if known is None else known
    table = known_digests(known).where(F.col("known_sha256") != NOTHING)
    table = bounded_broadcast(table, known.count())
    return judged.join(table, F.col("canonical_sha256") == F.col("known_sha256"), "left").select("doc_id", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _sql() -> str:
    def canon(text: str) -> str:
        out = f"regexp_replace(chr(10) || lower(coalesce({text}, '')) || chr(10), '{RIGHTS_LINE}', '', 'g')"
        out = f"regexp_replace({out}, '{NOT_A_WORD}', '  ', 'g')"
        for said, meant in _REPLACED:
            out = f"replace({out}, '{said}', '{meant}')"
        return f"sha256(trim(replace({out}, '  ', ' '), ' '))"

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    return rf"""
WITH known AS (SELECT {canon('body')} AS known_sha256, min(regexp_replace(license_id, ' \([^)]*\)$', '')) AS license_id FROM (VALUES {rows}) AS t(license_id, body) GROUP BY 1),
judged AS (SELECT doc_id, {canon('text')} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id, license_id IS NOT NULL AS is_license
FROM judged LEFT JOIN known ON canonical_sha256 = known_sha256
"""


SQL = _sql()
