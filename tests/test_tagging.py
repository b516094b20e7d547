"""The tagger against exhaustive search, cross-validation, and noun chunks against a plain version."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import tagging, terms
from lodestar.operators import keywords


def test_viterbi_against_all_sequences():
    weights = tagging.fitted()
    for words in (["a", "smart", "camera"], ["we", "need", "cheap", "sensors"], ["zzz", "in", "qqq"], ["x"]):
        def total(tags):
            out, before = 0.0, "^"
            for i, t in enumerate(tags):
                out += weights.get((before, t), 0.0) + sum(weights.get((f, t), 0.0) for f in tagging.features(words, i))
                before = t
            return out

        best = max(map(total, itertools.product(tagging.TAGS, repeat=len(words))))
        assert total(tagging.viterbi(words, weights)) == pytest.approx(best)
    assert tagging.viterbi([], weights) == ""


def test_held_out_accuracy(monkeypatch):
    table, right, n = tagging.sentences(), 0, 0
    for k in range(6):
        monkeypatch.setattr(tagging, "sentences", lambda k=k: [s for i, s in enumerate(table) if i % 6 != k])
        tagging.fitted.cache_clear()
        weights = tagging.fitted()
        for s in table[k::6]:
            told = tagging.viterbi([w for w, _ in s], weights)
            right += sum(a == b for a, (_, b) in zip(told, s, strict=True))
            n += len(s)
    tagging.fitted.cache_clear()
    assert right / n > 0.7


def test_chunks_and_heads():
    assert tagging.chunks("DJNPNN") == [(1, 3), (4, 6)] and tagging.chunks("JJ") == [] and tagging.chunks("NJVMN") == [(0, 1), (3, 5)] and tagging.chunks("") == []
    # storage of nuclear waste: nuclear under waste, waste under storage
    assert tagging.heads("NPJN") == [0, 1, 3, 0] and tagging.heads("NPDN") == [0, 1, 2, 0] and tagging.heads("NVN") == [0, 1, 2]


def plain(query):
    weights, out = tagging.fitted(), {}
    rows, count, start = [], 0, 0
    for part in re.split(r"[^\w\s'-]+", (query or "").lower()):
        words = part.split()
        tags = tagging.viterbi(words, weights)
        head = tagging.heads(tags)
        for k, (a, b) in enumerate(tagging.chunks(tags)):
            good = [(start + i, words[i]) for i in range(a, b) if words[i] not in terms.STOPWORDS and words[i] not in terms.FILTERED]
            if len(" ".join(w for _, w in good)) > 2:
                out.setdefault(" ".join(w for _, w in good), ("phrase", len(good), good[-1][1], True))
        rows += [(w, words[head[i]], tags[i] == "N") for i, w in enumerate(words)]
        start += len(words) + 1
    for w, h, noun in rows:
        if w not in terms.STOPWORDS and w not in terms.FILTERED and len(w) > 2 and re.search(r"\w", w):
            out.setdefault(w, ("word", 1, h, noun))
    return out


def test_candidates_against_a_plain_version(spark):
    queries = ["Efficient graphene sensor system, using cheap polymers!", "storage of nuclear waste", "we need a smart camera for the detection of defects; a smart camera", "", None, "the of and", "— !!", "sensor - network"]
    rows = list(enumerate(queries))
    got = {}
    for r in keywords.chunk_candidates(spark.createDataFrame(rows, "query_id int, query string")).collect():
        got.setdefault(r.query_id, {})[r.candidate] = (r.kind, r.length, r["head"], r.noun)
    assert got == {i: plain(q) for i, q in rows if plain(q)}
    scored = keywords.score(keywords.chunk_candidates(spark.createDataFrame(rows[:3], "query_id int, query string")))
    assert scored.where(F.col("score") > 1).count() == 0 and scored.count() > 3
    assert keywords.chunk_candidates(spark.createDataFrame([], "query_id int, query string")).count() == 0
