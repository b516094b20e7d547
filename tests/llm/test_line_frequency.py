"""Operator 11: against a plain version, and the cases that it must bear."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_frequency as lf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


def norm(line):
    return re.sub("[0-9]", "0", " ".join(WORD.findall(line.lower())))


def plain(rows):
    """What judge gives, by lists and dictionaries."""
    texts = {(s, t or "") for _, t, s in rows}
    hosts, lines = Counter(s for s, _ in texts), defaultdict(set)
    for s, t in texts:
        for line in t.split("\n"):
            if WORD.search(line):
                lines[s, norm(line)].add(t)
    frequent = {k for k, v in lines.items() if len(v) > lf.LEAST_TEXTS and 100 * len(v) > lf.PERCENT * hosts[k[0]]}
    out = []
    for i, t, s in rows:
        t = t or ""
        words = WORD.findall(t)
        own = [line for line in t.split("\n") if WORD.search(line)]
        grams = defaultdict(list)
        for k in range(len(words) - 4):
            grams[tuple(words[k : k + 5])].append(k)
        repeated = {k + j for v in grams.values() if len(v) > 1 for k in v for j in range(5)}
        cut = [line for line in own if (s, norm(line)) in frequent]
        left = len(words) - sum(len(WORD.findall(line)) for line in cut)
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        kept = not failed and left >= lf.WORDS_LEFT and 100 * left >= lf.PERCENT_LEFT * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(repeated), failed, kept, left, len({norm(line) for line in cut})))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}{rng.choice(['', '#', 'é', '日本'])}" for _ in range(n))
    rows = []
    for i in range(200):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [prose(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), f"All rights  RESERVED {rng.randrange(1000)}" if host == "a" else "Terms of use")
        if rng.random() < 0.2:
            lines += [lines[0], "", " \t", lines[0]]
        if rng.random() < 0.1:
            lines = [f"all rights reserved {i} {prose(2)}" for _ in range(3)]
        rows.append((i, "\n".join(lines), host))
    rows += [(500 + i, rows[0][1], "a") for i in range(40)]  # copies count once
    return rows + [(None, None, None), (None, "", "a"), (7, "\n\n \n", "b"), (7, "x " * 30, "b"), (8, rows[3][1], None), (8, rows[3][1], None), (9, "long " + prose(20000), "c")]


def test_against_plain_version(spark):
    rows = corpus()
    docs = table(spark, rows).withColumn("row", F.lit("own")).withColumn("lines", F.lit(1)).withColumn("digest", F.lit(2))
    got = lf.judge(docs)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left", "lines_cut"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))


def test_shuffled_lines_agree_with_broadcast_ones(spark, monkeypatch):
    rows = corpus(8)
    monkeypatch.setattr(lf, "BROADCAST_LINES", 0)
    assert sorted(map(repr, map(tuple, lf.judge(table(spark, rows)).collect()))) == sorted(map(repr, plain(rows)))


def test_boilerplate_is_rejected_and_cut(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    menu = "Home News Sport Weather Contact us today for all offers and prices"
    rows = [(i, f"{menu}\n{prose(120)}\n{menu}", "h") for i in range(40)] + [(100 + i, f"{menu}\n{prose(2)}", "h") for i in range(20)] + [(200, f"{menu}\n{prose(3)}", "other")]
    got = {r.doc_id: r for r in lf.judge(table(spark, rows)).collect()}
    assert all(got[i].kept and got[i].words_left == 120 for i in range(40)) and not any(got[100 + i].kept or got[100 + i].base_failed for i in range(20))
    assert got[200].kept
    docs = table(spark, rows).withColumn("__row", F.lit(5)).withColumn("a.b", F.lit("x"))
    cleaned = lf.clean(docs)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert set(texts) == {*range(40), 200} and all(texts[i] == rows[i][1].split("\n")[1] for i in range(40)) and texts[200] == rows[-1][1]


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_empty(spark, rows):
    got = lf.judge(table(spark, rows)).collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in got] == [(i, 0, False) for i, _, _ in rows]
    assert lf.clean(table(spark, rows)).count() == 0
