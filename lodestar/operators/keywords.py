"""Keyword extraction over a table of queries: candidates, context-aware scores, filtered query.

``candidates`` needs no grammar: phrases are the longest runs of content words
(no stop or filter word, no punctuation between), unknown single words count as
nouns, and a word's head is the next word.  ``chunk_candidates`` takes noun chunks, tags and
heads from a trained tagger (``functions.tagging``).  All other rules are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tagging, terms
from ..functions.text import valid_keyword

TOKEN = r"(?U)[\w](?:[\w'-]*\w)?"


def _content(w: Column) -> Column:
    return ~w.isin(terms.STOPWORDS) & ~w.isin(terms.FILTERED)


def _tokens(queries: DataFrame) -> Column:
    marked = F.regexp_replace(F.lower(F.coalesce("query", F.lit(""))), r"(?U)[^\w\s'-]+", " \u0000 ")
    return F.filter(F.split(marked, r"(?U)[\s]+"), lambda t: t != "")


def chunk_candidates(queries: DataFrame) -> DataFrame:
    """The same as ``candidates``, and ``noun``: phrases are noun chunks without their stop and filter words, with the chunk's head; of a word, its tag and head."""
    told = tagging.tagged(queries.select("query_id", _tokens(queries).alias("tokens"))).select("query_id", F.inline("words"))
    good = told.where(_content(F.col("w")) & F.col("w").rlike(r"(?U)\w"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"])
    runs = good.where("chunk IS NOT NULL").groupBy("query_id", "chunk").agg(F.min("pos").alias("pos"), F.count("*").cast("int").alias("length"), F.array_join(listed, " ").alias("candidate"), F.max_by("w", "pos").alias("head"))
    phrases = runs.where(F.length("candidate") > 2).select("query_id", "candidate", F.lit(0).alias("order"), "pos", "length", "head", F.lit(True).alias("noun"))
    words = good.where(F.length("w") > 2).select("query_id", F.col("w").alias("candidate"), F.lit(1).alias("order"), "pos", F.lit(1).alias("length"), "head", (F.col("tag") == "N").alias("noun"))
    first = Window.partitionBy("query_id", "candidate").orderBy("order", "pos")
    both = phrases.unionByName(words).withColumn("n", F.row_number().over(first)).where("n = 1")
    return both.select("query_id", "candidate", F.when(F.col("order") == 0, "phrase").otherwise("word").alias("kind"), "length", "head", (F.col("order") * 1_000_000 + F.col("pos")).alias("position"), "noun")


def candidates(queries: DataFrame) -> DataFrame:
    """query_id, candidate, kind (phrase or word), length, head, position of the first occurrence."""
    rows = queries.select("query_id", F.posexplode(_tokens(queries)).alias("pos", "w"))
    along = Window.partitionBy("query_id").orderBy("pos")
    rows = rows.withColumn("good", _content(F.col("w")) & (F.col("w") != "\u0000") & F.col("w").rlike(r"(?U)\w"))
    rows = rows.withColumn("head", F.lead("w").over(along)).withColumn("run", F.sum((~F.col("good")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    good = rows.where("good")
    runs = good.groupBy("query_id", "run").agg(F.min("pos").alias("pos"), F.count("*").cast("int").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("candidate"))
    phrases = runs.where(F.length("candidate") > 2).select("query_id", "candidate", F.lit(0).alias("order"), "pos", "length", F.lit(None).cast("string").alias("head"))
    words = good.where(F.length("w") > 2).select("query_id", F.col("w").alias("candidate"), F.lit(1).alias("order"), "pos", F.lit(1).alias("length"), "head")
    # A one-word phrase hides the word; among phrases, and among words, the first occurrence stands.
    first = Window.partitionBy("query_id", "candidate").orderBy("order", "pos")
    both = phrases.unionByName(words).withColumn("n", F.row_number().over(first)).where("n = 1")
    return both.select("query_id", "candidate", F.when(F.col("order") == 0, "phrase").otherwise("word").alias("kind"), "length", "head", (F.col("order") * 1_000_000 + F.col("pos")).alias("position"))


def _among(parts: Column, table: list[str]) -> Column:
    return F.size(F.filter(parts, lambda x: x.isin(table)))


def score(found: DataFrame, least: float = 0.3) -> DataFrame:
    """query_id, candidate, score, rank of candidates at ``least`` or more."""
    parts = F.split("candidate", " ")
    df = found.withColumns({"high": _among(parts, terms.HIGH), "medium": _among(parts, terms.MEDIUM), "context": _among(parts, terms.CONTEXT)})
    df = df.withColumn("high_in_query", F.sum("high").over(Window.partitionBy("query_id")))
    base = F.when(F.col("high") > 0, 0.85 + 0.05 * F.least("high", F.lit(3))).when(F.col("medium") > 0, 0.65 + 0.05 * F.least("medium", F.lit(3))).when(F.col("context") > 0, 0.5)
    noun = F.col("noun") if "noun" in found.columns else F.lit(True)
    base = base.otherwise(F.when((F.col("kind") == "word") & noun, 0.55).otherwise(0.4))
    less = F.when((F.col("high_in_query") > 0) & (F.col("context") > 0) & (F.col("high") == 0), F.least(F.lit(0.3), F.col("high_in_query") * 0.1)).otherwise(0.0)
    phrase = F.when((F.col("kind") == "phrase") & (F.col("length") >= 2), F.when((F.col("high") > 0) | (F.col("medium") > 0), 0.15).otherwise(0.08)).otherwise(0.0)
    head = F.when((F.col("kind") == "word") & F.coalesce(F.col("head").isin(terms.HIGH) | F.col("head").isin(terms.MEDIUM), F.lit(False)), 0.1).otherwise(0.0)
    total = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base - less + phrase + head)), 10)
    kept = df.withColumn("score", total).where((F.col("score") >= least) & (F.length("candidate") > 2))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "position"))).select("query_id", "candidate", "score", "rank")


def query_context(found: DataFrame) -> DataFrame:
    """Counts of high, medium and context terms of each query (the first table decides) and its domain focus."""
    w = found.select("query_id", F.explode(F.split("candidate", " ")).alias("w"))
    kind = F.when(F.col("w").isin(terms.HIGH), "h").when(F.col("w").isin(terms.MEDIUM), "m").when(F.col("w").isin(terms.CONTEXT), "c")
    counted = w.groupBy("query_id").agg(*[F.count_if(kind == k).alias(n) for k, n in (("h", "high"), ("m", "medium"), ("c", "context"))])
    total = F.col("high") + F.col("medium") + F.col("context")
    return counted.withColumn("domain_focus", F.when(total == 0, 0.3).otherwise(F.least(F.lit(1.0), (F.col("high") * 0.4 + F.col("medium") * 0.2) / total + 0.3)))


def filtered_query(queries: DataFrame, scored: DataFrame) -> DataFrame:
    """Adds filtered_query: the candidates of rank 1 to 7 with 0.5 or more, else of rank 1 to 3, else the query itself."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "candidate", "score")))
    lists = scored.where("rank <= 7").groupBy("query_id").agg(ordered.alias("k"))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["candidate"]), " ")
    strong = F.filter("k", lambda x: x["score"] >= 0.5)
    picked = F.when(F.size(strong) > 0, names(strong)).otherwise(names(F.slice("k", 1, 3)))
    return queries.join(lists.select("query_id", picked.alias("filtered_query")), "query_id", "left").withColumn("filtered_query", F.coalesce("filtered_query", "query"))


def match_query(queries: DataFrame, scored: DataFrame, most: int = 6, least: float = 0.45) -> DataFrame:
    """Adds match_query: the base query and up to ``most`` keywords of weight ``least`` that it lacks as whole tokens."""
    joined = scored.where(F.col("score") >= least).join(queries.select("query_id", F.lower("base_query").alias("base")), "query_id")
    absent = joined.where(~F.contains(F.concat(F.lit(" "), F.col("base"), F.lit(" ")), F.concat(F.lit(" "), F.lower("candidate"), F.lit(" "))))
    taken = absent.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= most)
    added = taken.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "candidate"))), lambda x: x["candidate"]), " ").alias("added"))
    return queries.join(added, "query_id", "left").withColumn("match_query", F.concat_ws(" ", "base_query", "added")).drop("added")


def keyword_candidates(scored: DataFrame, queries: DataFrame, least: float = 0.45, most: int = 6) -> DataFrame:
    """query_id, keyword, weight: extracted keywords of ``least`` or more, best per spelling; without any the query's tokens at 0.4."""
    strong = scored.where((F.col("score") >= least) & valid_keyword(F.col("candidate"), terms.STOPWORDS)).groupBy("query_id", F.lower("candidate").alias("key")).agg(F.max(F.struct(F.col("score"), (-F.col("rank")).alias("r"), F.col("candidate").alias("keyword"))).alias("b"))
    strong = strong.select("query_id", "b.keyword", F.col("b.score").alias("weight"), (-F.col("b.r")).alias("place"))
    tokens = queries.join(strong.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.posexplode(F.split("filtered_query", r"[^a-zA-Z0-9一-鿿]+")).alias("place", "keyword"))
    weak = tokens.where(valid_keyword(F.col("keyword"), terms.STOPWORDS)).groupBy("query_id", F.lower("keyword").alias("key")).agg(F.min(F.struct("place", "keyword")).alias("b")).select("query_id", "b.keyword", F.lit(0.4).alias("weight"), "b.place")
    both = strong.unionByName(weak)
    return both.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "place"))).where(F.col("n") <= 2 * most).select("query_id", "keyword", "weight", F.col("n").alias("rank"))


def record_similarity(similarity: dict[str, Column], weights: dict[str, float], literal: Column) -> Column:
    """Similarity of a keyword and a record: weighted field similarities, 0.08 more if the record says it, never below 0."""
    total = sum((F.lit(float(weights[f])) * F.coalesce(c, F.lit(0.0)) for f, c in similarity.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), total + F.when(literal, 0.08).otherwise(0.0))


def display_keywords(weighed: DataFrame, similarity: DataFrame, least: float = 0.24, most: int = 6) -> DataFrame:
    """similarity: query_id, keyword, sim with each of the top records. 0.65 best + 0.35 weight, at ``least`` or more; else the best two."""
    best = similarity.groupBy("query_id", "keyword").agg(F.max("sim").alias("best"))
    scored = weighed.join(best, ["query_id", "keyword"], "left").withColumn("score", 0.65 * F.coalesce("best", F.lit(0.0)) + 0.35 * F.col("weight"))
    by = Window.partitionBy("query_id")
    ranked = scored.withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "rank"))).withColumn("good", F.count_if(F.col("score") >= least).over(by))
    return ranked.where(((F.col("score") >= least) & (F.col("n") <= most)) | ((F.col("good") == 0) & (F.col("n") <= 2))).select("query_id", "keyword", "score", F.col("n").alias("rank"))


def matched_keywords(pairs: DataFrame, least: float = 0.24, most: int = 6) -> DataFrame:
    """pairs: query_id, entity_id, keyword, weight, sim, literal (in the text), described (in the description).

    sim + 0.2 weight (+ 0.1 if described); a keyword that is nowhere literal needs sim of 0.06 more."""
    total = F.col("sim") + 0.2 * F.col("weight") + F.when(F.col("described"), 0.1).otherwise(0.0)
    kept = pairs.withColumn("score", total).where((F.col("literal") | (F.col("sim") >= least + 0.06)) & (F.col("score") >= least))
    best = kept.groupBy("query_id", "entity_id", F.lower("keyword").alias("key")).agg(F.max(F.struct("score", "keyword")).alias("b"))
    order = Window.partitionBy("query_id", "entity_id").orderBy(F.desc("b.score"), "key")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "entity_id", "b.keyword", "b.score", "rank")


def merged_highlights(matched: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, keyword, score: the best of each spelling over all results; queries without any take the fallback's."""
    best = matched.groupBy("query_id", F.lower("keyword").alias("key")).agg(F.max(F.struct("score", "keyword")).alias("b")).select("query_id", "b.keyword", "b.score")
    return best.unionByName(fallback.join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "keyword", "score"))
