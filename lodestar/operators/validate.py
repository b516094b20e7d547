"""Query validation: an ordered cascade over a table of queries; the first rule that fits decides.

Every rule is a nullable struct (rule, status, confidence, message); rules that
need the corpus take the best similarity as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import strip, words
from ..functions.topk import sparse_topk
from ..functions.vectors import TfIdf, nearest_texts

INVALID, WEAK, UNCLEAR, VALID = "invalid", "weak_relevance", "needs_clarification", "valid"
_HINTS = {
    INVALID: ["Name a technology or a field of research", "For instance: sensors that find leaks in water pipes"],
    WEAK: ["Say what is technical about the task", "People and companies here do engineering"],
    UNCLEAR: ["Add a method or a material", "Add what it is to be used for"],
    VALID: [],
}
_SOME_AREAS = "sensors, robotics, materials, circuits"


def _known(w: Column) -> Column:
    return w.isin(terms.COMMON) | w.isin(terms.DOMAIN)


def _count(text: Column, of: str) -> Column:
    """Characters of the text that are among the given ones."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{of}]", ""))


def gibberish(tokens: Column) -> Column:
    """tokens: the lower-cased query split at white space, one at least."""
    w, n = F.get(tokens, F.lit(0)), F.length(F.get(tokens, F.lit(0)))
    row = F.greatest(*[_count(w, keys) for keys in ("qwertyuiop", "asdfghjkl", "zxcvbnm")])
    vowels = _count(w, "aeiou")
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(w, F.lit("[^aeiou]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))
    single = (
        ((n >= 5) & (row / n >= 0.7))
        | ((n > 5) & ((vowels == 0) | ((vowels / n < 0.15) & ~_known(w)) | ((run >= 5) & ~_known(w))))
        | ((n <= 4) & ~_known(w))
    )
    none_known = F.size(F.filter(tokens, lambda x: _known(x))) == 0
    same = (F.array_min(F.transform(tokens, lambda x: F.length(x))) == F.array_max(F.transform(tokens, lambda x: F.length(x)))) & (n <= 4)
    short = F.forall(tokens, lambda x: F.length(x) <= 3)
    return F.when(F.size(tokens) == 1, single).otherwise((short | same) & none_known)


def _result(rule: str, status: str, confidence: float, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(rule).alias("rule"), F.lit(status).alias("status"), F.lit(float(confidence)).alias("confidence"), said.alias("message"))


def _named(matches: Column, most: int | None = None) -> Column:
    """Matching terms in a message, sorted (a set has no order of its own)."""
    ordered = F.sort_array(matches)
    return F.array_join(F.slice(ordered, 1, most) if most else ordered, ", ")


def area_names(areas: Column, most: int = 2) -> Column:
    """The first part (before a semicolon) of the nearest texts, as a list in one text; empty without any."""
    return F.array_join(F.transform(F.slice(F.coalesce(areas, F.array().cast("array<string>")), 1, most), lambda x: F.get(F.split(x, ";"), F.lit(0))), ", ")


def validate(queries: DataFrame, similarity: Column | None = None, low: float = 0.25, weak: float = 0.35, areas: Column | None = None) -> DataFrame:
    """queries: query_id, query (and more). Adds rule, status, confidence, message, suggestions.

    similarity: the best cosine with the corpus, null where it is not known; without it those two rules never fire.
    areas: the nearest texts of the corpus, best first; a query that those rules turn away is pointed to them."""
    q = F.col("__q")
    df = queries.withColumn("__q", strip(F.coalesce("query", F.lit("")))).withColumn("__lower", F.lower("__q"))
    df = df.withColumn("__tokens", F.filter(F.split("__lower", r"(?U)\s+"), lambda x: x != "")).withColumn("__words", words(F.col("__lower")))
    lower, tokens, found = F.col("__lower"), F.col("__tokens"), F.col("__words")
    padded = F.concat(F.lit(" "), lower, F.lit(" "))
    casual = F.exists(terms.literal(terms.CONVERSATIONAL), lambda p: F.contains(padded, F.concat(F.lit(" "), p, F.lit(" "))))
    content = F.filter(found, lambda x: ~x.isin(terms.CONVERSATIONAL_WORDS) & (F.length(x) > 2))
    off = F.filter(found, lambda x: x.isin(terms.OFF_TOPIC))
    domain = F.filter(found, lambda x: x.isin(terms.DOMAIN))
    real = F.filter(domain, lambda x: ~x.isin(terms.GENERIC))
    other = F.filter(found, lambda x: x.isin(terms.NOT_ENGINEERING))
    meaningful = F.filter(tokens, lambda x: (F.length(x) > 1) & ~x.isin(terms.CONVERSATIONAL_WORDS))
    long_words = F.filter(tokens, lambda x: F.length(x) > 2)
    generic = F.forall(long_words, lambda x: x.isin(terms.CONTEXT) | x.isin(terms.FILTERED) | x.isin(terms.STOPWORDS))
    rules = [
        (q == "", _result("V01", INVALID, 1.0, "The query is empty.")),
        (q.rlike(r"(?U)^[\d\s\W]+$"), _result("V02", INVALID, 1.0, "The query holds numbers or symbols only.")),
        (gibberish(tokens), _result("V03", INVALID, 0.9, "The query does not look like words.")),
        (casual, _result("V04", INVALID, 0.95, "This looks like conversation, not a research query.")),
        ((F.size(content) == 0) & (F.size(found) > 0), _result("V05", INVALID, 0.9, "The query has no technical or research terms.")),
        ((F.size(off) > 0) & (F.size(domain) == 0), _result("V06", INVALID, 0.85, F.concat(F.lit("'"), _named(off), F.lit("' is not engineering research.")))),
        (F.size(meaningful) < 1, _result("V07", INVALID, 0.85, "The query is too brief.")),
        ((F.size(other) >= 2) & (F.size(real) == 0), _result("V08", WEAK, 0.75, F.concat(F.lit("The query seems to be about '"), _named(other, 3), F.lit("'.")))),
        ((F.size(other) >= 1) & (F.size(other) > F.size(real)), _result("V09", WEAK, 0.65, F.concat(F.lit("The query about '"), _named(other, 3), F.lit("' may not fit the expertise here.")))),
        ((F.size(other) >= 1) & (F.size(real) == 0), _result("V10", WEAK, 0.6, "The query may have little to do with engineering.")),
    ]
    if similarity is not None:
        rules += [(similarity < low, _result("V11", INVALID, 0.85, "The query matches no research area in the corpus.")), (similarity < weak, _result("V12", WEAK, 0.7, "The query is only weakly related to the corpus."))]
    rules += [(generic & (F.size(long_words) <= 3), _result("V13", UNCLEAR, 0.7, "The query is too generic."))]
    first = F.coalesce(*[F.when(fits, result) for fits, result in rules], _result("V14", VALID, 0.9, "The query is valid."))
    hints = F.lit(None)
    for status, said in _HINTS.items():
        hints = F.when(F.col("__r.status") == status, F.array(*map(F.lit, said)).cast("array<string>")).otherwise(hints)
    if areas is not None:
        near = area_names(areas)
        covered = F.concat(F.lit("Some areas that are covered: "), F.coalesce(F.nullif(near, F.lit("")), F.lit(_SOME_AREAS)))
        hints = F.when(F.col("__r.rule") == "V11", F.array(F.lit(_HINTS[INVALID][0]), covered)).when((F.col("__r.rule") == "V12") & (near != ""), F.array(F.lit(_HINTS[WEAK][0]), F.concat(F.lit("Related areas: "), near))).otherwise(hints)
    return df.withColumn("__r", first).select(*queries.columns, "__r.rule", "__r.status", "__r.confidence", "__r.message", hints.alias("suggestions"))


def corpus_similarity(queries: DataFrame, corpus: DataFrame, model: TfIdf, most: int = 3, length: int = 100, rows: DataFrame | None = None) -> DataFrame:
    """Adds ``similarity``, the best cosine of each query with the corpus texts (id, text), 0 without a common term, and ``areas``: the beginnings of the ``most`` nearest texts, best first.

    Queries of one text are compared once. rows: ``model.among`` of the corpus and the queries, where it is there already."""
    asked = queries.select(F.coalesce("query", F.lit("")).alias("id")).distinct().withColumn("text", F.col("id"))
    near = nearest_texts(model, asked, corpus, most) if rows is None else sparse_topk(model.vectors(asked), rows, most)
    said = near.join(corpus.select(F.col("id").alias("entity_id"), F.substring("text", 1, length).alias("t")), "entity_id", "left")
    best = said.groupBy("query_id").agg(F.max("similarity").alias("similarity"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("areas"))
    told = queries.withColumn("__asked", F.coalesce("query", F.lit(""))).join(best.withColumnRenamed("query_id", "__asked"), "__asked", "left").drop("__asked").na.fill(0.0, ["similarity"])
    return told.withColumn("areas", F.coalesce("areas", F.array().cast("array<string>")))
