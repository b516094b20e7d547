"""The person search pairs queries only with who can be among the best; the ranking is that over all pairs."""

import random

from pyspark.sql import functions as F

from lodestar import stored
from lodestar.functions import vectors
from lodestar.plans import match

WORDS = [f"word{i}" for i in range(40)]


def test_people_within_bounds_are_those_over_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    people = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randrange(2, 9))), 0.1 + i / 10_000 if i % 9 else None) for i in range(240)], "id int, text string, priority double")
    edges = spark.createDataFrame([(rng.randrange(250), rng.randrange(250)) for _ in range(300)], "src int, dst int")
    asked = spark.createDataFrame([(q, " ".join(rng.choices(WORDS, k=3))) for q in range(12)] + [(20, "unseen"), (21, "")], "query_id int, query string")
    written, plain = {}, stored.materialize
    monkeypatch.setattr(stored, "materialize", lambda df, name: written.update({name: plain(df, name)}) or written[name])
    model = vectors.TfIdf.fit(people.select("id", "text"))
    pairs = vectors.sparse_cosine(model.transform(asked.select(F.col("query_id").alias("id"), F.col("query").alias("text"))), model.transform(people.select("id", "text")))
    pairs = pairs.withColumn("similarity", F.round("similarity", 9))
    told = lambda df: [tuple(r) for r in df.select("query_id", "rank", "id", F.round("score", 8)).orderBy("query_id", "rank").collect()]
    for gamma, beta in ((0.1, 0.2), (0.9, 1.0)):
        written.clear()
        want = match.rank_related(asked, match.related(pairs), people, edges, k=4, gamma=gamma, beta=beta)
        _, got = match.match_people(asked, people, edges, k=4, validate_query=False, gamma=gamma, beta=beta)
        assert told(got) == told(want) and len(told(got)) == 14 * 4
        if gamma == 0.1:
            near = written["near-pairs"].count()
            assert 0 < near < pairs.count() / 2 and written["open-queries"].count() < 6


def test_people_with_copies_go_to_the_smaller_id(spark):
    people = spark.createDataFrame([(i, "laser gel" if i % 2 else "robot vision laser", 0.5) for i in range(20)], "id int, text string, priority double")
    asked = spark.createDataFrame([(1, "laser gel")], "query_id int, query string")
    _, got = match.match_people(asked, people, spark.createDataFrame([(0, 19)], "src int, dst int"), k=4, validate_query=False)
    assert [r.id for r in got.orderBy("rank").collect()] == [19, 1, 3, 5]
