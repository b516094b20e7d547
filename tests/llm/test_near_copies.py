import random

import numpy as np
import pytest

from lodestar.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    ids = sorted(r[0] for r in rows)
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i in ids}
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if j < i and label[i] != label[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def replaced(rng, words, n):
    """One contiguous passage of n words is replaced."""
    at = rng.randrange(len(words) - n)
    return [*words[:at], *(f"n{rng.randrange(10**6)}" for _ in range(n)), *words[at + n :]]


def corpus(n, seed=3):
    """Originals, and a copy of each with one passage of 9.5 % or 12.5 % replaced: Jaccard 0.81 and 0.76."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(replaced(rng, words, 57 if i % 4 else 75)))]
    return rows


def test_replaced_passages_meet_at_any_size():
    """Pairs of Jaccard 0.81 have a common key, whatever the corpus: keys do not depend on its size."""
    rows = corpus(200)
    with np.errstate(over="ignore"):
        keys = [set(enumerate(near_copies.band_keys(near_copies.shingle_set(t.encode())).tolist())) for _, t in rows]
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(200) if i % 4)


@pytest.mark.parametrize("chunk", [512, 3])
def test_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng = random.Random(1)
    rows = corpus(60)
    base = [f"b{rng.randrange(5000)}" for _ in range(100)]
    for k in range(40):  # one group around a text, at 0.6 to 1 to each other
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(100)] = f"x{k}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000, ""), (2001, None), (2002, "One\tTWO"), (2003, "one two"), (2004, "one")]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_chains_below_the_pivot():
    """Members that are close to each other and not to the key's first."""
    a, b, c = (np.arange(k, k + 100, dtype=np.uint64) for k in (0, 30, 35))
    assert near_copies.run_links([a, b, c], np.arange(3), True) == []
    assert near_copies.run_links([a, b, c], np.arange(3), False) == [(1, 2)]
    assert near_copies.run_links([a, b, c], np.array([0, 7, 7]), False) == []


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_copies.near_copies(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (5, "d e f"), (7, "d E f"), (None, "a b c")], schema)
    assert sorted(near_copies.near_copies(rows).select("component_id").collect(), key=str) == [(5,), (5,), (5,), (5,), (None,)]


def test_fingerprints_alone_find_close_texts(spark):
    """SimHash blocks and Hamming distance give candidates of their own: without MinHash keys, texts with one word changed still meet."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    with np.errstate(over="ignore"):
        printed = lambda w: np.frombuffer(near_copies.fingerprint(near_copies.rolled_hashes(near_copies.shingle_hashes(" ".join(w).encode(), 1), 3), 64), np.uint64)
        others = ([*words[:1500], f"other{k}", *words[1501:]] for k in range(50))
        changed = next(w for w in others if np.bitwise_count(printed(words) ^ printed(w))[0] <= 3)
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"v{rng.randrange(5000)}" for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = docs.mapInArrow(near_copies._signatures, "doc_id long, node long, keys array<long>, print binary")
    assert near_copies._by_prints(classes.select("node", "print")).count() == 1
