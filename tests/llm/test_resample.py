"""Operator 13: against a plain version; brackets that miss; ranges; the cases that it must bear."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import resample as rs

DOCS = "doc_id long, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(rows, target):
    count = lambda texts: [(lambda b: b)(zlib.crc32(w.encode()) % 10000) for t in texts for w in words(t)]
    s, t = [0] * 10000, [0] * 10000
    for b in count(x for _, x in rows):
        s[b] += 1
    for b in count(target):
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + 10000) / ((s[b] + 1.0) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        own = [gain[b] for b in count([x])]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    return sorted(map(repr, map(tuple, out)))


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    vocabulary = [f"wort{i}" for i in range(200)] + ["Éa", "ÑANDÚ", "日本", "a.b-c", "X1"]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows = [(i, prose(rng.choice([0, 1, 5, 19, 20, 21, 80, 200]))) for i in range(n)]
    rows += [(None, prose(30)), (None, prose(30)), (None, None), (3, rows[3][1]), (3, rows[3][1]), (5, prose(40)), (6, ""), (n, prose(20_000))]
    return rows, [prose(50) for _ in range(20)] + [None, ""]


def frames(spark, rows, target):
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("own")).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    return docs, spark.createDataFrame([(t,) for t in target], "text string")


def test_against_plain_version(spark):
    rows, target = corpus()
    got = rs.resample(*frames(spark, rows, target))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for c, t in got.dtypes} == {"bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == plain(rows, target)


def test_many_ranges_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(rs, "RANGE_ROWS", 3)
    rows, target = corpus(300, 9)
    text = rows[7][1] + " " + " ".join(f"wort{i}" for i in range(30))
    rows += [(9999, text)] * 200
    docs, wanted = frames(spark, rows, target)
    assert sorted(map(repr, map(tuple, rs.resample(docs, wanted).collect()))) == plain(rows, target)
    assert sorted(r.doc_id or -1 for r in rs.drawn(docs, wanted).collect()) == sorted(int(x) if x != "None" else -1 for x in (r[1:].split(",")[0] for r in plain(rows, target) if not r.endswith("None)")))


def test_brackets_widen_until_they_hold(spark, monkeypatch):
    """A sketch whose quantiles are far off costs rounds, not rows."""
    seen, real = [], F.percentile_approx
    monkeypatch.setattr(rs.F, "percentile_approx", lambda col, ends, accuracy: seen.append(ends) or real(col, [min(1.0, e + 0.08) for e in ends], accuracy))
    rows, target = corpus(500, 2)
    assert sorted(map(repr, map(tuple, rs.resample(*frames(spark, rows, target)).collect()))) == plain(rows, target)
    assert len(seen) > 2


@pytest.mark.parametrize("rows,target", [([], []), ([], ["a b"]), ([(1, "x " * 30)], []), ([(i, "x y " * 15) for i in range(30)], []), ([(1, None), (None, "")], ["a"])])
def test_empty_and_tied(spark, rows, target):
    assert sorted(map(repr, map(tuple, rs.resample(*frames(spark, rows, target)).collect()))) == plain(rows, target)
