"""Numbers of TF-IDF vectors, and vectors of chosen terms, are those of whole vectors, also where terms are beyond those that tasks hold."""

import random

import pytest

from lodestar import stored
from lodestar.functions import vectors

WORDS = [f"word{i}" for i in range(60)]


@pytest.mark.parametrize("head", [3, 100])
def test_summary_and_chosen_terms(spark, monkeypatch, head):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices(WORDS, weights=range(60, 0, -1), k=rng.randrange(1, 30)))) for i in range(50)] + [(50, "the"), (51, None), (52, "word59 word58")]
    docs = spark.createDataFrame(texts, "id int, text string")
    asked = spark.createDataFrame([(1, "word59 word3"), (2, "word58 unseen"), (3, "")], "id int, text string")
    model = vectors.TfIdf.fit(docs)
    whole = {r.id: dict(zip(r.terms, r.weights, strict=True)) for r in model.vectors(docs).collect()}
    # Terms asked for that few texts have are not among the most frequent ones.
    monkeypatch.setattr(vectors, "HEAD", head)
    monkeypatch.setattr(vectors, "TOKENS", 100)
    written, plain = {}, stored.materialize
    monkeypatch.setattr(stored, "materialize", lambda df, name: written.update({name: plain(df, name)}) or written[name])
    told = {r.id: r for r in model.summary(docs).collect()}
    assert told.keys() == whole.keys() and ("rare-sums" in written) == (head < 60)
    for i, v in whole.items():
        assert (told[i].terms, told[i].largest, told[i].total) == (len(v), pytest.approx(max(v.values())), pytest.approx(sum(v.values())))
    written.clear()
    kept = {r.id: dict(zip(r.terms, r.weights, strict=True)) for r in model.among(docs, model.vectors(asked)).collect()}
    want = {i: {t: w for t, w in v.items() if t in ("word59", "word58", "word3")} for i, v in whole.items()}
    assert kept.keys() == {i for i, v in want.items() if v}
    for i, v in kept.items():
        assert v == pytest.approx(want[i])


def test_texts_without_a_known_term(spark):
    docs, none = spark.createDataFrame([(1, "laser gel")], "id int, text string"), spark.createDataFrame([(1, "unseen"), (2, None)], "id int, text string")
    model = vectors.TfIdf.fit(docs)
    assert model.summary(none).isEmpty() and model.among(none, model.vectors(docs)).isEmpty() and model.among(docs, model.vectors(none)).isEmpty()
