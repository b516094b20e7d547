"""Operator 9 against a plain version that shares no code with it."""

import collections
import random
import struct

import xxhash

from lodestar.llm import syncmer


def longs(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain_anchors(text):
    words = [longs(w) for w in (text or "").lower().split()]
    inner = [longs(a, b) for a, b in zip(words, words[1:])]
    out = []
    for i in range(len(inner) - syncmer.K + syncmer.S):
        runs = inner[i : i + syncmer.K - syncmer.S + 1]
        if min(runs) in (runs[0], runs[-1]):
            out.append((i, longs(runs[0], runs[-1]) % (1 << 32)))
    if words and not out:
        h = 0
        for w in words:
            h = longs(h, w)
        out = [(0, h % (1 << 32))]
    return out


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    votes = collections.Counter()
    last, first = {h: p for p, h in a}, {h: p for p, h in reversed(b)}
    for h in last.keys() & first.keys():
        votes[first[h] - last[h]] += 1
    shifts = {0} | ({min(votes, key=lambda d: (-votes[d], d))} if votes else set())
    common = max(len({(p + d, h) for p, h in a} & set(b)) for d in shifts)
    return common / (len(a) + len(b) - common)


def told(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = syncmer.with_likeness(syncmer.with_anchors(syncmer.with_anchors(df, "a", "x"), "b", "y"), "x", "y", "like")
    return sorted(df.select("i", "x", "y", "like").collect())


def test_anchors_and_likeness_equal_the_plain_version(spark):
    rng = random.Random(21)
    prose = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    pairs = []
    for _ in range(120):
        a = prose(rng.randrange(40), rng.choice([2, 30, 3000]))
        words = a.split()
        at = rng.randrange(len(words) + 1)
        pairs.append((a, rng.choice([a, prose(9, 3000) + " " + a, " ".join(words[at:]), " ".join([*words[:at], "New", *words[at:]]), prose(20, 30), a + " " + a])))
    pairs += [("", ""), (None, ""), ("", "one"), ("hello", "world"), ("plant", "music"), ("p q r s t", "u v w x y"), ("Same Words", "same  words"), ("line two\n" * 50, "line two\n" * 50)]
    for row, (a, b) in zip(told(spark, pairs), pairs, strict=True):
        x, y = plain_anchors(a), plain_anchors(b)
        assert [(v >> 32, v % (1 << 32)) for v in row.x] == x and [(v >> 32, v % (1 << 32)) for v in row.y] == y
        assert row.like == plain_likeness(x, y), (a, b)


def test_short_texts_are_alike_only_if_equal(spark):
    like = [r.like for r in told(spark, [("hello", "world"), ("p q r s t", "u v w x y"), ("p q r s t", "P q r  s t"), ("", "x"), ("", None), ("one two", "one")])]
    assert like == [0, 0, 1, 0, 1, 0]


def test_a_shifted_passage_matches_on_one_diagonal(spark):
    rng = random.Random(22)
    passage = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    (row,) = told(spark, [(passage, "some words in front of it " + passage)])
    assert row.like > 0.9


def test_ids_that_repeat_and_null_ids(spark):
    rows = [(None, "b c"), (None, "a"), (1, "z"), (1, "y"), (1, "y")]
    got = syncmer.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS anchors", "2 AS next")).collect()
    assert len(got) == 5 and sorted((r.doc_id or 9, r.n_chars) for r in got) == [(1, 1), (1, 1), (1, 1), (9, 1), (9, 3)]
    near = {(r.doc_id, r.fingerprint): r.near_next for r in got}
    assert sorted(r.near_next for r in got) == [0, 0, 0, 0, 1] and len(near) == 4


def test_plan_is_native(spark):
    plan = syncmer.fingerprint_documents(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
