"""Rows with equal texts are scored once, and rankings by classes are those over all rows."""

import random

from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.operators import validate
from lodestar.plans import match

WORDS = ["laser", "gel", "dots", "robot", "vision", "solar"]


def _startups(n, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(WORDS), " ".join(rng.choices(WORDS, k=2)), rng.choice(WORDS[:2])) for i in range(n)]


def test_copies_meet_once(spark):
    texts = spark.createDataFrame([(w,) for w in WORDS * 40], "text string")
    model = vectors.TfIdf.fit(texts.select(F.monotonically_increasing_id().alias("id"), "text"))
    told = vectors.text_cosine(model, texts, texts).collect()
    assert len(told) == len(WORDS) and all(r.query == r.text and abs(r.similarity - 1) < 1e-9 for r in told)


def test_startups_by_class_are_those_over_all_rows(spark):
    rows = _startups(150)
    fields = list(match.FIELD_WEIGHTS)
    startups = spark.createDataFrame(rows, "id int, company string, description string, category string")
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 155) for i in range(0, 150, 2)], "src int, dst int")
    queries = spark.createDataFrame([(q, " ".join(random.Random(q).choices([*WORDS, "unseen"], k=2))) for q in range(12)] + [(20, "nothing")], "query_id int, query string")
    _, got = match.match_startups(queries, startups, edges, k=6, validate_query=False, gamma=0.1)
    keyed = startups.select(F.inline(F.array(*[F.struct(F.concat_ws("/", "id", F.lit(f)).alias("id"), F.col(f).alias("text")) for f in fields])))
    model = vectors.TfIdf.fit(keyed)
    near = vectors.sparse_cosine(model.transform(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))), model.transform(keyed))
    near = near.select("query_id", F.split("entity_id", "/")[0].cast("int").alias("id"), F.split("entity_id", "/")[1].alias("field"), "similarity")
    wide = near.groupBy("query_id", "id").agg(*[F.max(F.when(F.col("field") == f, F.col("similarity"))).alias(f) for f in fields])
    semantic = wide.select("query_id", "id", match.semantic_score({f: F.col(f) for f in fields}).alias("score")).where("score > 0")
    want = match.rank_related_startups(queries, semantic, startups, edges, k=6)
    plain = lambda df: [tuple(r) for r in df.select("query_id", "rank", "id", F.round("score", 9)).orderBy("query_id", "rank").collect()]
    assert plain(got) == plain(want)


def test_queries_of_one_text_are_compared_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "id int, text string")
    seen = []
    plain = validate.nearest_texts
    monkeypatch.setattr(validate, "nearest_texts", lambda model, queries, *rest: seen.append(queries.count()) or plain(model, queries, *rest))
    asked = spark.createDataFrame([(q, "laser gel") for q in range(50)] + [(99, None)], "query_id int, query string")
    told = validate.corpus_similarity(asked, docs, vectors.TfIdf.fit(docs)).collect()
    assert seen == [2] and len(told) == 51 and {len(r.areas) for r in told if r.query_id < 99} == {2}


def test_rare_terms_and_repeated_ids(spark, monkeypatch):
    """Terms beyond those that tasks hold are looked up by a join; texts of one id are one text."""
    docs = spark.createDataFrame([(1, "laser laser gel"), (2, "gel dots robot"), (2, "vision gel"), (3, "the"), (4, None)], "id int, text string")
    model = vectors.TfIdf.fit(docs)
    plain = lambda: sorted((r.id, r.term, round(r.weight, 12)) for r in model.transform(docs).collect())
    want = plain()
    monkeypatch.setattr(vectors, "HEAD", 2)
    assert plain() == want and {i for i, _, _ in want} == {1, 2} and sum(i == 2 for i, _, _ in want) == 4
