import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=3000):
    return [rng.choice("abcdefgh") * 2 + f"{rng.randrange(size):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    rows = {i: words(rng, 150) for i in range(40)}
    rows[50] = list(rows[3])  # exact copy
    rows[51] = list(rows[4])  # near copy: two words changed
    rows[51][20], rows[51][90] = "changed", "words"
    passage = words(rng, 60)
    rows[52], rows[53] = words(rng, 80) + passage, words(rng, 80) + passage + words(rng, 20)
    item = words(rng, 30)
    rows[54] = words(rng, 60) + item + words(rng, 60)
    docs = [(i, " ".join(w), "en", f"s{i % 3}", 0) for i, w in rows.items()]
    return docs + [(60, "123 !!", "en", "s1", 0), (61, None, None, None, 0)], " ".join(item), " ".join(passage)


def test_stages(spark, tmp_path):
    rows, item, passage = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    everything = {r[0] for r in rows}
    assert set(seen["language_id"]) == everything - {60, 61}
    assert set(seen["near_dedup"]) == everything - {60, 61, 50, 51}
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["near_dedup"]) and passage in cut[52].text and passage not in cut[53].text
    assert all(cut[i].text == seen["near_dedup"][i].text for i in cut if i != 53) and cut[53].n_chars == len(cut[53].text)
    assert set(seen["benchmark_decontamination"]) == set(cut) - {54}
    assert {r.copies for r in seen["mixing_sources"].values()} <= {1, 2}
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, seen["mixing_sources"].values()))


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_bear_nulls_repeats_and_clashing_names(spark, tmp_path):
    sf = str(tmp_path)
    rng = random.Random(5)
    text, other = " ".join(words(rng, 120)), " ".join(words(rng, 90))
    rows = [(7, text, "en", "a", 1), (7, text, "en", "a", 1), (8, text, "en", "b", 2), (None, other, "en", None, 3), (None, other, None, None, 4), (9, other + " end", "en", "b", 5), (9, "quite another text of this id", "en", "b", 6), (10, None, "en", "b", 7), (11, "", None, "b", None)]
    names = ("score", "lang_pred", "__row", "__lang_score", "copies", "Size", "Taken", "a.b", "place", "item", "print", "node")
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.count() <= before
        if name != "mixing_sources":
            assert docs.columns == columns and {tuple(r[n] for n in names) for r in docs.collect()} == {tuple(f"own {n}" for n in names)}
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["7", "9", "9", "None", "None"]
    assert {c.lower() for c in docs.columns} >= {"a.b", "size", "taken", "copies"} and len(docs.columns) == len({c.lower() for c in docs.columns})
    assert {r["__row"] for r in docs.collect()} == {"own __row"} and all(r.copies in (1, 2) and r.text for r in docs.collect())


def test_labels_without_a_prototype_are_an_error(spark, monkeypatch):
    from lodestar.llm import langid

    assert langid.hash_below(20_000, 10**12) > -(1 << 63) and langid.hash_below(20_000, 4 * 10**10) - -(1 << 63) == 20_000 * 2**64 // (4 * 10**10) and langid.hash_below(5, 5) == 1 << 63
    monkeypatch.setattr(langid, "hash_below", lambda sample, count: -(1 << 63))
    docs = spark.createDataFrame([(i, f"some words {i}", "en", "s", 1) for i in range(9)], SCHEMA)
    with pytest.raises(ValueError, match="no prototype"):
        langid.train(docs, sample=3)


def test_what_is_white_space_alone_goes(spark):
    from lodestar.llm import chunk_dedup

    text = " ".join(words(random.Random(2), 400))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "\n\n" + text, "en", "s", 1), (3, "\t" + text + "\v", "en", "s", 1), (4, "\n\n", "en", "s", 1), (5, "\n" + text + "\n\nown words", "en", "s", 1)], SCHEMA)
    kept = {r.doc_id: r.text for r in chunk_dedup.remove_repeats(docs).collect()}
    assert set(kept) == {1, 4, 5} and kept[1] == text and kept[4] == "\n\n" and kept[5].endswith("\n\nown words") and len(kept[5]) < len(text) / 4
