"""Name joins against all pairs: parts of names, and the best overlap."""

import random

import pytest

from lodestar.operators import maintain


def names(rng, n, most):
    words = [f"w{i}" for i in range(40)]
    return [" ".join(rng.choice(words[: rng.choice([3, 8, 40])]) for _ in range(rng.randrange(0, most))) for _ in range(n)]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_departed_names_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(maintain, "HOT_WORD", hot)
    rng = random.Random(hot)
    stored = [(x, rng.choice(["Professor", "Visiting Fellow", None]), i) for i, x in enumerate(names(rng, 150, 5))]
    listed = [x for x in names(rng, 60, 7) if len(x.split()) > 1] + ["w5", "", None]
    got = maintain.departed_names(spark.createDataFrame(stored, "name string, title string, _row long"), spark.createDataFrame([(x,) for x in listed], "name string"))
    sets, want, seen = [set((x or "").split()) for x in listed if (x or "").split()], set(), set()
    for name, title, row in stored:
        key = " ".join(name.split())
        if title == "Visiting Fellow" or not key or key in seen:
            continue
        seen.add(key)
        if not any(s <= set(name.split()) or set(name.split()) <= s for s in sets):
            want.add(row)
    assert {r._row for r in got.collect()} == want and want


def test_a_word_that_all_names_share(spark):
    n = 20_000
    stored = spark.range(n).selectExpr("concat('lee x', id) AS name", "'' AS title", "id AS _row")
    listed = spark.range(0, 2 * n, 2).selectExpr("concat('lee x', id, ' jr') AS name")
    assert maintain.departed_names(stored, listed).count() == n // 2


@pytest.mark.parametrize("short", [6, 2])
def test_best_overlap_against_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(maintain, "SHORT", short)
    rng = random.Random(short)
    asked, pages = names(rng, 80, 5) + names(rng, 20, 9), names(rng, 120, 5) + names(rng, 20, 10)
    got = maintain.resolve(spark.createDataFrame(list(enumerate(asked)), "id long, name string"), spark.createDataFrame([(x, f"u{i}", i) for i, x in enumerate(pages)], "name string, url string, _row long"))
    listed = {}
    for i, x in enumerate(pages):
        key = " ".join(x.split())
        if key:
            listed[key] = (listed.get(key, (i,))[0], f"u{i}")  # the first row's place, the last row's url
    want = set()
    for i, x in enumerate(asked):
        key = " ".join(x.split())
        if key in listed:
            want.add((i, listed[key][1], 1.0, "exact"))
        elif key:
            best = max(((len(set(key.split()) & set(p.split())) / max(len(set(key.split())), len(set(p.split()))), -at, url) for p, (at, url) in listed.items()))
            if best[0] >= 0.5:
                want.add((i, best[2], best[0], "fuzzy"))
    assert {tuple(r) for r in got.collect()} == want and any(w[3] == "fuzzy" for w in want)
