import random

from lodestar.llm import chunk_dedup


def test_repeated_rows_and_null_ids(spark):
    """Runs and spans belong to rows: neither a repeated row nor another text without an id breaks or takes them."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, own = words(134), words(30)
    repeated = " ".join([*own, *passage, *words(10)])
    short, long = " ".join(words(25)), " ".join([*words(200), *passage, *words(5)])
    other = " ".join([*words(40), *passage])
    rows = [(1, " ".join(passage)), (5, repeated), (5, repeated), (6, " ".join(words(90))), (None, short), (None, long), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = chunk_dedup.repeated_passages(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ["5", "5", "None", "None"]
    assert all(r.n_words >= 110 and r.first_doc_id == 1 for r in found)
    kept = sorted(chunk_dedup.remove_repeats(docs).select("doc_id", "text").collect(), key=str)
    assert len(kept) == len(rows)
    by_text = [r.text for r in kept]
    assert short in by_text and rows[0][1] in by_text and rows[3][1] in by_text
    for text in (repeated, repeated, long, other):
        start = " ".join(text.split()[:25])
        assert sum(len(t.split()) <= len(text.split()) - 110 for t in by_text if t.startswith(start)) == (2 if text == repeated else 1)


def plain_passages(rows, min_words):
    """Runs of chunks that a smaller id has, by sets and loops: (id, first word, words, smallest first id)."""
    import xxhash

    def cut(text):
        words = (text or "").encode().lower().split()
        joined = b" ".join(words)
        hashes, end = [], -1
        for w in words:
            end += len(w) + 1
            hashes.append(sum(int(chunk_dedup.GEAR[joined[end - 1 - k]]) << k for k in range(min(end, chunk_dedup.WINDOW))) % 2**64)
        out, start = [], 0
        for i in range(len(words)):
            near = [hashes[j] for j in range(max(0, i - chunk_dedup.REACH), i)], hashes[i + 1 : i + 1 + chunk_dedup.REACH]
            inner = chunk_dedup.REACH <= i < len(words) - chunk_dedup.REACH
            if i == len(words) - 1 or (inner and all(hashes[i] < h for h in near[0]) and all(hashes[i] <= h for h in near[1])):
                out.append((start, i + 1 - start, xxhash.xxh3_64_intdigest(b" ".join(words[start : i + 1]))))
                start = i + 1
        return out

    chunks = [(10**9 if i is None else i, cut(t)) for i, t in rows]
    first = {}
    for i, parts in chunks:
        for _, _, d in parts:
            first[d] = min(first.get(d, i), i)
    found = []
    for i, parts in chunks:
        run = None
        for at, n, d in [*parts, (None, 0, None)]:
            if d is not None and first[d] < i:
                run = (run[0], run[1] + n, min(run[2], first[d])) if run else (at, n, first[d])
            elif run:
                found.append((i, *run))
                run = None
    return sorted(x for x in found if x[2] >= min_words)


def test_passages_against_plain_version(spark):
    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared = [words(n) for n in (60, 134, 25, 12)]
    rows = []
    for i in range(40):
        text = words(rng.randrange(1, 120))
        for passage in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        rows.append((rng.choice([i, i, i, 3, None]), " ".join(text)))
    rows += rows[:6] + [(70, ""), (71, None), (72, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __row", "'x' AS __spans", "2 AS digest", "3 AS row").repartition(5)
    got = sorted((10**9 if r.doc_id is None else r.doc_id, r.first_word, r.n_words, r.first_doc_id) for r in chunk_dedup.repeated_passages(docs, 5).collect())
    assert got == plain_passages(rows, 5) and len(got) > 20
    kept = chunk_dedup.remove_repeats(docs.selectExpr("*", "'y' AS __id", "4 AS __cut"), 5)
    assert kept.columns == [*docs.columns, "__id", "__cut"] and {(r["__row"], r["__spans"], r["__cut"]) for r in kept.collect()} == {(1, "x", 4)} and kept.count() <= len(rows)
    assert chunk_dedup.remove_repeats(docs.limit(0)).count() == 0
