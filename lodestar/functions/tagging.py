"""A tagger of parts of speech and the noun chunks it gives: an averaged structured perceptron with Viterbi decoding.

The model is fitted on the driver from the small labelled table of ``tagged.py`` (some 60 sentences) and broadcast; queries are tagged in Arrow batches,
a row at a time. A chunk is a run of adjectives, numbers and nouns that ends in a noun; its head is that last noun. A word's head is the
head of its chunk; the head of the last noun of a chunk is the next chunk's behind a preposition (``storage of waste``: waste under storage), else
itself."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagged import sentences

TAGS = "DJNVRPCOM"
ROUNDS = 6
_START = "^"


def features(words: list[str], i: int) -> list[str]:
    """What a word says about its tag, beside the tag before it; more (neighbours, prefixes) did worse in cross-validation on so small a table."""
    w = words[i]
    return [f"w={w}", f"2={w[-2:]}", f"3={w[-3:]}", ""]


def viterbi(words: list[str], weights: dict[tuple[str, str], float]) -> str:
    """The best tags; ties go to the tag that comes first in TAGS."""
    if not words:
        return ""
    get = weights.get
    best = {_START: (0.0, "")}
    for i in range(len(words)):
        own = features(words, i)
        told = {}
        for t in TAGS:
            emitted = sum(get((f, t), 0.0) for f in own)
            score, path = max(((s + get((p, t), 0.0), path) for p, (s, path) in best.items()), key=lambda x: x[0])
            told[t] = (score + emitted, path + t)
        best = told
    return max(best.values(), key=lambda x: x[0])[1]


@lru_cache(maxsize=1)
def fitted() -> dict[tuple[str, str], float]:
    """Averaged weights: (feature, tag), and (tag before, tag)."""
    weights: dict[tuple[str, str], float] = defaultdict(float)
    total: dict[tuple[str, str], float] = defaultdict(float)
    step = 1
    table = [([w for w, _ in s], "".join(t for _, t in s)) for s in sentences()]
    for _ in range(ROUNDS):
        for words, want in table:
            got = viterbi(words, weights)
            if got != want:
                for tags, change in ((want, 1.0), (got, -1.0)):
                    before = _START
                    for i, t in enumerate(tags):
                        for key in ((f, t) for f in [*features(words, i), before]):
                            weights[key] += change
                            total[key] += step * change
                        before = t
            step += 1
    return {k: w - total[k] / step for k, w in weights.items() if w - total[k] / step}


def chunks(tags: str) -> list[tuple[int, int]]:
    """(first, behind the last) of each noun chunk: the longest run of J, M and N, up to its last N."""
    out, at = [], 0
    while at < len(tags):
        end = at
        while end < len(tags) and tags[end] in "JMN":
            end += 1
        last = tags.rfind("N", at, end)
        if last >= 0:
            out.append((at, last + 1))
        at = end + 1 if end == at else end
    return out


def heads(tags: str) -> list[int]:
    """The place of each word's head: a chunk's last noun, for that noun the noun before a preposition in front of the chunk; else the word itself."""
    out = list(range(len(tags)))
    found = chunks(tags)
    for k, (first, end) in enumerate(found):
        for i in range(first, end - 1):
            out[i] = end - 1
        if k and found[k - 1][1] == first - 1 and tags[first - 1] == "P" or k and found[k - 1][1] == first - 2 and tags[first - 2 : first] == "PD":
            out[end - 1] = found[k - 1][1] - 1
    return out


def tagged(rows: DataFrame) -> DataFrame:
    """rows: query_id, tokens (array of words and marks; a mark, ``\\0``, parts sentences). query_id and an array of (pos, w, tag, chunk, head): chunk numbers from 0, null outside, head is a word."""
    model = rows.sparkSession.sparkContext.broadcast(fitted())
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("w", pa.string()), ("tag", pa.string()), ("chunk", pa.int32()), ("head", pa.string())]))

    def one(tokens: list[str] | None, weights: dict[tuple[str, str], float]) -> list[dict]:
        out: list[dict] = []
        count = start = 0
        for end in [i for i, t in enumerate(tokens or []) if t == "\0"] + [len(tokens or [])]:
            words = (tokens or [])[start:end]
            tags = viterbi(words, weights)
            placed = {i: count + k for k, (a, b) in enumerate(chunks(tags)) for i in range(a, b)}
            for i, (w, h) in enumerate(zip(words, heads(tags), strict=True)):
                out.append({"pos": start + i, "w": w, "tag": tags[i], "chunk": placed.get(i), "head": words[h]})
            count += len(chunks(tags))
            start = end + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t, model.value) for t in batch.column(1).to_pylist()], kind)], names=["query_id", "words"])

    schema = f"query_id {rows.schema['query_id'].dataType.simpleString()}, words array<struct<pos int, w string, tag string, chunk int, head string>>"
    return rows.select("query_id", F.col("tokens")).mapInArrow(run, schema)
