import random
from dataclasses import replace

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def near_copies(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(160)]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(40)] if i % 3 == 0 else list(base)
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words), "en", "s", 1))
    return rows


@pytest.mark.parametrize("chunk", [1024, 8])
def test_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = near_copies(150) + [(900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, "One\tTWO", "en", "s", 0), (903, "one two", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("print", F.lit(1))
    got = {r.doc_id: (r.p, r.component_id) for r in simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("print")).alias("p"), "component_id").collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    assert {d: f"{p:016x}" for d, p in prints.items()} == {d: v[0] for d, v in got.items()}
    assert brute_components(prints) == {d: v[1] for d, v in got.items()}


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "a b c d")], schema)
    assert sorted(simhash.near_duplicates(rows).select("component_id").collect(), key=str) == [(5,), (5,), (5,), (None,)]


def test_keys_share_a_block_at_the_largest_distance():
    rng = random.Random(3)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        for fingerprints in (0, 1 << 22, 1 << 28, 1 << 40):
            keys = simhash.block_keys([a.to_bytes(8, "little"), b.to_bytes(8, "little")], simhash.close_plan(fingerprints))
            assert (keys[0] == keys[1]).any()
    with pytest.raises(ValueError):
        simhash.block_keys([bytes(8)], replace(simhash.CLOSE, cuts=((0, 32), (32, 32)), agree=2))
