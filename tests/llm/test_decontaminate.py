"""Operator 1: every pattern of substitutions meets a seed; the joined result equals a plain search of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate as d


def met(words, item):
    """Whether a seed of the item stands in the text on the item's diagonal 3."""
    with np.errstate(over="ignore"):
        for number, first, hashes in d.item_seeds(item):
            mine = d.seed_hashes(words, d.ALL_MASKS[number], number)
            for k, h in enumerate(hashes):
                if first + k + 3 < len(mine) and mine[first + k + 3] == h:
                    return True
    return False


@pytest.mark.parametrize("n", [*range(1, 20), 20])
def test_every_allowed_pattern_of_substitutions_meets_a_seed(n):
    rng = np.random.default_rng(n)
    item = rng.integers(0, 1 << 60, n).astype(np.uint64)
    most = int(n * (1 - d.SIMILARITY) + 1e-9)
    patterns = [p for k in range(most + 1) for p in combinations(range(n), k)]
    for pattern in patterns if len(patterns) < 2500 else random.Random(1).sample(patterns, 2500):
        changed = item.copy()
        changed[list(pattern)] = rng.integers(0, 1 << 60, len(pattern)).astype(np.uint64)
        words = np.concatenate((rng.integers(0, 1 << 60, 3, np.uint64), changed, rng.integers(0, 1 << 60, 2, np.uint64)))
        assert met(words, item), pattern
        assert d.overlap(words, item, 3) is not None


def test_longest_overlap_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 40)) < 0.7
        n = len(equal)
        best = max((j - i for i in range(n) for j in range(i + 1, n + 1) if equal[i] and equal[j - 1] and 5 * equal[i:j].sum() >= 4 * (j - i)), default=0)
        first, got, same = d.longest_overlap(equal)
        assert got == best and same == equal[first : first + got].sum()


def plain(text, item):
    """The longest overlap of two texts over all diagonals."""
    with np.errstate(over="ignore"):
        words, other = d.word_hashes((text or "").encode()), d.word_hashes((item or "").encode())
    found = [x for k in range(-len(other), len(words)) if len(other) and (x := d.overlap(words, other, k))]
    return max(((n, same, -first) for first, n, same in found), default=None)


def test_joined_result_equals_a_search_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(d, "LISTED", 2)
    rng = random.Random(3)
    prose = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    items = [(i, " ".join(prose(rng.choice([1, 3, 5, 7, 9, 10, 12, 13, 14, 30]), 200))) for i in range(40)] + [(90, None), (91, ""), (92, "what is it"), (3, "what is it")]
    docs = []
    for i in range(80):
        words = prose(60, 200)
        passage = (items[i % 40][1]).split()
        for k in rng.sample(range(len(passage)), len(passage) // 5):
            passage[k] = "other"
        docs.append((i, " ".join([*words[:20], *passage, *words[20:]])))
    docs += [(0, docs[0][1]), (1, "so what is it then"), (None, items[9][1]), (None, "WHAT is, it?"), (200, None), (201, "")]
    want = sorted(((str(i), item, *x[:2]) for i, text in docs for item, other in items if (x := plain(text, other))), key=str)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    got = sorted(((str(r.doc_id), r.item_id, r.n_words, r.equal_words) for r in d.contaminated(df, bench).collect()), key=str)
    assert got == want and len(want) > 60
    kept = d.decontaminate(df.withColumn("__row", F.lit(4)), bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, text in docs if not any(plain(text, other) for _, other in items))
    assert d.contaminated(df.limit(0), bench).count() == 0 and d.contaminated(df, bench.limit(0)).count() == 0
    assert d.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_large_sides_are_shuffled_to_the_same_result(spark, monkeypatch):
    rng = random.Random(5)
    items = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(25))) for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(r.item_id, f"some words before {r.text} and after") for r in items.collect()], "doc_id long, text string")
    whole = sorted(d.contaminated(docs, items).collect())
    monkeypatch.setattr(d, "SEED_ROWS", 0)
    monkeypatch.setattr(d, "FOUND_ROWS", 0)
    monkeypatch.setattr(d, "BITS", (6, 8))
    assert sorted(d.contaminated(docs, items).collect()) == whole and len(whole) == 20
