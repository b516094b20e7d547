"""Brute force, round trips and the cases that every operator must bear: nulls, empties, ties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import chunk_dedup, decontaminate, html_extract, langid, license_scan, mixing, syncmer, url_filter, warc
from lodestar.llm.license_texts import KNOWN

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(rng, n, vocabulary=500):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


# 1 --------------------------------------------------------------------------------------------------------------------


def test_decontamination_finds_planted_and_substituted_passages(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"b{rng.randrange(400)}" for _ in range(20 + i))) for i in range(12)] + [(50, "alpha beta gamma delta epsilon zeta"), (51, "too short by far"), (52, None), (53, "")]
    docs, planted = [], set()
    for i in range(60):
        words = prose(rng, 80)
        if i % 4 == 0:
            item = i % 12
            passage = items[item][1].split()
            for k in rng.sample(range(len(passage)), len(passage) // 10):
                passage[k] = "changed"
            words[30:30] = passage
            planted.add((i, item))
        docs.append((i, " ".join(words), "s"))
    docs += [(100, "x Alpha, beta; GAMMA delta epsilon zeta!", "s"), (101, "", "s"), (102, None, "s"), (None, items[3][1], "s")]
    planted |= {(100, 50), (None, 3)}
    found = decontaminate.contaminated(documents(spark, docs).withColumn("item_id", F.lit(7)), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == planted
    kept = decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in planted}


# 2 --------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rows = [
        (1, "http://a.com/x"), (2, "https://Example.COM/en/1?q#f"), (3, "http://www.example.com/en/"), (4, "http://x.www.example.com/en/a"), (5, "http://b.net/es/1"), (6, "http://b.net/en/1"),
        (7, "http://notnet/es/"), (8, None), (9, "no scheme"), (10, "http://a.com"), (11, "http://net/fr/?x=/es/"), (6, "http://b.net/en/1"), (None, "http://xcom/"),
    ]
    got = url_filter.judge(spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string")).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.com", "/x", "com/", "allow") and by[2] == ("example.com", "/en/1", "example.com/en/", "block")
    assert by[3][2:] == ("www.example.com/en/", "allow") and by[4][2:] == ("www.example.com/en/", "allow")
    assert by[5][2:] == ("net/es/", "block") and by[6][2] is None and by[7][2] is None
    assert by[8] == ("", "", None, "allow") and by[9] == ("", "", None, "allow") and by[10] == ("a.com", "", None, "allow") and by[11] == ("net", "/fr/", "net/fr/", "block")


def test_rules_from_a_table_agree(spark):
    urls = spark.createDataFrame([("www.example.com", "/en/1"), ("example.com", "/en/"), ("a.b.net", "/fr/x"), ("org", "/")], "host string, path string")
    table = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    got = {(r.host, r.path): (r.rule, r.verdict) for r in url_filter.judged_by_table(urls, table).collect()}
    want = urls.withColumn("f", url_filter.fitting_rule(F.col("host"), F.col("path"), url_filter.RULES)).where("f is not null").collect()
    assert got == {(r.host, r.path): (r.f.rule, r.f.verdict) for r in want}


def test_strangers_under_a_public_domain(spark):
    rows = [(0, "http://bad.co.uk/blocked/", None)] + [(i, f"http://h{i}.co.uk/x", None) for i in range(1, 6)] + [(9, "http://www.bad.co.uk/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, (("bad.co.uk", "/blocked/", "block"),)).collect()}
    assert got == {0: "block", 9: "block", **{i: "allow" for i in range(1, 6)}}


def test_link_edges_against_a_plain_reader(spark):
    html = ["<a href='http://B.com/x'>1</a><a class=c href=//c.org?y>2</a><a href=\"/in\">3</a>", "<A HREF=https://a.com/self><a\nhref = 'http://b.com'>", "<a name=x>no</a><a href=mailto:x@b.com><ahref=http://no.com>", None, "<a " * 30_000 + "href=http://b.com"]
    pages = spark.createDataFrame([(i, "http://a.com/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    started = time.time()
    assert {(r.src, r.dst, r.weight) for r in url_filter.link_edges(pages).collect()} == {("a.com", "b.com", 3.0), ("a.com", "c.org", 1.0)}
    assert time.time() - started < 20


def test_propagation_against_dense_iteration(spark):
    rng = random.Random(2)
    n = 9
    links = {(a, b): float(rng.randint(1, 3)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.25}
    trust, distrust = np.zeros(n), np.zeros(n)
    trust[0], trust[1], distrust[n - 1] = 0.75, 0.25, 1.0

    def rank(weights, seed):
        out = weights.sum(axis=1)
        x = seed.copy()
        for _ in range(300):
            move = (weights / np.where(out > 0, out, 1)[:, None]).T @ x
            x = 0.15 * seed + 0.85 * (move + x[out == 0].sum() * seed)
        return x

    w = np.zeros((n, n))
    for (a, b), v in links.items():
        w[a, b] = v
    hosts = spark.createDataFrame([(f"h{i}", float(trust[i]), float(distrust[i])) for i in range(n)], "host string, trust_seed double, distrust_seed double")
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", v) for (a, b), v in links.items()], "src string, dst string, weight double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(hosts, edges).collect()}
    t, d = rank(w, trust), rank(w.T, distrust)
    assert got.keys() == {f"h{i}" for i in range(n)}
    for i in range(n):
        assert got[f"h{i}"] == pytest.approx((t[i], d[i]), abs=2e-6)


def test_links_to_blocked_hosts_block(spark):
    chain = [(10 + k, f"http://c{k}.org/", f'<a href="http://c{k - 1}.org/">x</a>' if k else '<a href="http://bad.net/es/1">x</a>') for k in range(30)]
    rows = [(1, "http://bad.net/es/1", ""), (8, "http://bad.net/fr/1", ""), (2, "http://friend.org/1", '<a href="http://bad.net/es/1">x</a>'), (3, "http://good.com/1", "<a class=x HREF=//linked.org/p>y</a>"), (4, "http://linked.org/1", ""), (5, "http://alone.org/", None), (6, "http://bad.net/en/1", "<a href=/es/1>inside</a>"), (7, "http://shop.bad.net/", None), *chain]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = url_filter.judge(pages.withColumn("host", F.lit("clash")).withColumn("trust", F.lit(9)))
    got = {r.page_id: r.verdict for r in told.collect()}
    # A chain of 30 hosts that leads to a blocked one, a subdomain of it and its pages without a rule.
    assert got == {1: "block", 8: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block"} | {10 + k: "block" for k in range(30)}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_edges_between_a_host_and_its_parent_domain(spark):
    hosts = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("10.0.0.1",), ("",), ("net",), ("x.net:8080",)], "host string")
    got = {(r.src, r.dst) for r in url_filter.family_edges(hosts).collect()}
    up = {("a.b.example.com", "b.example.com"), ("b.example.com", "example.com")}
    assert got == up | {(b, a) for a, b in up}


# 4 --------------------------------------------------------------------------------------------------------------------


def test_water_filling_against_the_clamping_loop(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 50, 1000, 7]) for i in range(7)}
        table = spark.createDataFrame([*sizes.items(), (None, 40)], "source string, source_size long")
        got = {r.source: r.target for r in mixing.water_fill(table, (3, 1, 2), 1.5, 2.0).collect()}
        order = [*sorted(sizes), None]
        size = {**sizes, None: 40}
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        left, free, want = 1.5 * sum(size.values()), set(order), {}
        while free:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * level > 2 * size[s]}
            if not over:
                want |= {s: weight[s] * level for s in free}
                break
            want |= {s: 2.0 * size[s] for s in over}
            left -= sum(2 * size[s] for s in over)
            free -= over
        assert got == pytest.approx(want)


def test_mix_takes_near_the_target_and_reruns_agree(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(600, None, "a"), (None, "one two", "b"), (601, "one two", "b"), (601, "one two", "b")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and got and sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r.source == source]
        assert sum(r.size for r in mine) == mine[0].source_size and abs(sum(r.taken for r in mine) - mine[0].target) <= 60
        assert all(r.taken <= 2 * r.size for r in mine)
    assert mixing.mix(documents(spark, [])).count() == 0


@pytest.mark.parametrize("rows_of_a_range", [50_000, 1])
def test_copies_of_rows(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_of_a_range)
    rows = [(i % 7 if i % 3 else None, f"text {i} " * (1 + i % 5), "ab"[i % 2]) for i in range(60)]
    docs = documents(spark, rows).withColumn("size", F.lit(9)).withColumn("copy", F.lit("x")).withColumn("__text", F.lit(2))
    counted = mixing.mixture(docs).collect()
    repeated = mixing.repeat_rows(docs).collect()
    assert sum(r.copies for r in counted) == len(repeated) and {r.text for r in repeated} == {r.text for r in counted} <= {t for _, t, _ in rows}
    for r in counted:
        mine = [x for x in repeated if x.text == r.text]
        assert [x.copy for x in sorted(mine, key=lambda x: x.copy)] == list(range(1, r.copies + 1)) and {x.doc_id for x in mine} == {r.doc_id}
    assert sum(r.taken for r in mixing.mix(docs).collect()) == sum(r.taken for r in counted)


# 5 --------------------------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "er", "and", "th"], "fr": ["le", "eau", "que", "ment", "é", "oi"], "de": ["sch", "ung", "ein", "ich", "der", "ü"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30))
        rows.append((i, text, lang if i % 5 else None, "s", 1, lang))
    rows += [(1000, None, "en", "s", 0, "und"), (1001, "12 !! 34", "en", "s", 0, "und"), (1002, "", None, "s", 0, "und"), (1003, "\U0001f600 \U0001f680", "en", "s", 0, "und"), (None, "the and thing", "en", "s", 0, "en")]
    docs = spark.createDataFrame(rows, DOCS + ", true string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[r[0]].held_out == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    right = [got[r[0]].lang_pred == r[5] for r in rows]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].score for k in (1000, 1001, 1002, 1003)] == [0, 0, 0, 0]


def test_language_without_training_rows(spark):
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_vectors_equal_the_plain_definition():
    text = "abca"
    line = langid.letters(text)
    want = np.zeros(langid.DIM)
    for i in range(len(line) - 2):
        want += np.roll(langid._letter(int(line[i])), 2) * np.roll(langid._letter(int(line[i + 1])), 1) * langid._letter(int(line[i + 2])).astype(float)
    assert np.allclose(langid.vectors([text])[0], want / np.linalg.norm(want), atol=1e-6)
    assert not langid.vectors([None, "", "7"]).any() and langid.vectors(["\U00020000"]).any()


def test_prototypes_and_nearest_language_equal_the_plain_definition(spark):
    rng = random.Random(31)
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 200))), lang) for i in range(60) for lang, letters in (("b", "abcde fg"), ("a", "efghi jk"), ("c", "xyzab cd")) if i % 3 == ord(lang) % 3]
    languages, got = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {}
    for _, text, lang in rows:
        want[lang] = want.get(lang, 0) + langid.vectors([text])[0].astype(float)
    assert languages == ["a", "b", "c"]
    table = np.stack([want[x] / np.linalg.norm(want[x]) for x in languages])
    assert np.allclose(got, table, atol=1e-4)
    told = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), languages, got, "p", "q").collect()
    for r in told:
        cosine = table @ langid.vectors([r.text])[0]
        assert r.q == pytest.approx(max(0, cosine.max()), abs=1e-4) and cosine[languages.index(r.p)] >= cosine.max() - 1e-4 and r.score in ("a", "b", "c")


# 6 --------------------------------------------------------------------------------------------------------------------


def test_licences_in_other_spelling(spark):
    mit = KNOWN["MIT"].replace("license", "licence").replace("\n", "\n  ").upper() + "\n"
    rows = [(1, "Copyright (c) 2020 Ann\nAll rights reserved.\n" + mit, "s"), (2, KNOWN["BSD-3-Clause"].replace('"', "''"), "s"), (3, "plain text", "s"), (4, None, "s"), (5, "", "s"), (6, KNOWN["ISC"] + " more", "s"), (None, KNOWN["0BSD"], "s")]
    got = {r.doc_id: (r.license_id, r.is_license) for r in license_scan.scan(documents(spark, rows).withColumn("license_id", F.lit("x"))).collect()}
    assert got == {1: ("MIT", True), 2: ("BSD-3-Clause", True), 3: (None, False), 4: (None, False), 5: (None, False), 6: (None, False), None: ("0BSD", True)}
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_every_known_licence_is_found_in_another_layout(spark):
    names = sorted(KNOWN)
    assert {"Apache-2.0", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0", "MIT", "ISC", "BSD-3-Clause"} <= set(names)
    rows = [(i, "Copyright 2021 Ann\n\n" + re.sub(r"\bLICENSE\b", "LICENCE", KNOWN[n].upper().replace("\n", "\r\n   ")), "s") for i, n in enumerate(names)]
    rows += [(100 + i, KNOWN[n] + "\nOne more line.", "s") for i, n in enumerate(names)]
    got = {r.doc_id: r.license_id for r in license_scan.scan(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(names))] == [n.split(" (")[0] for n in names]
    assert all(got[100 + i] is None for i in range(len(names)))


def test_neighbouring_spellings_and_a_table_of_texts(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Licence licence; sub-licence sub licence.")
    (tmp_path / "Empty.txt").write_text("(c) 2020")
    known = license_scan.texts_from(spark, f"file://{tmp_path}")
    rows = [(1, "license license sublicense sublicense", "s"), (2, "", "s"), (3, "license", "s")]
    assert {r.doc_id: r.license_id for r in license_scan.scan(documents(spark, rows), known).collect()} == {1: "Own-1.0", 2: None, 3: None}


# 7 --------------------------------------------------------------------------------------------------------------------


def test_shared_passages_are_cut_and_clean_documents_stay(spark):
    rng = random.Random(9)
    passage = prose(rng, 55, 3000)
    rows, first = [], None
    for i in range(30):
        words = prose(rng, 120, 3000)
        if i % 3 == 1:
            at = rng.randrange(100)
            words[at:at] = passage
            first = i if first is None else first
        rows.append((i, ("\n" if i % 2 else " ").join(words), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, " ".join(["again"] * 300), "s"), (103, " ".join(prose(rng, 40)) * 2, "s")]
    docs = documents(spark, rows)
    found = chunk_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {i for i in range(30) if i % 3 == 1 and i != first}
    assert {r.first_doc_id for r in found} == {first} and all(20 <= r.n_words <= 56 for r in found)
    kept = {r.doc_id: r for r in chunk_dedup.remove_repeats(docs).collect()}
    assert len(kept) == len(rows)
    for i, text, _ in rows:
        if i in {r.doc_id for r in found}:
            assert " ".join(passage) not in " ".join(kept[i].text.split()) and kept[i].n_chars == len(kept[i].text) < len(text)
        else:
            assert kept[i].text == text


def test_cuts_resist_insertions():
    rng = random.Random(10)
    words = prose(rng, 400, 3000)
    a = set(chunk_dedup.chunks(" ".join(words).encode())[2])
    b = set(chunk_dedup.chunks(" ".join([*words[:50], "inserted", *words[50:]]).encode())[2])
    assert len(a - b) <= 4 and len(a) > 40


def test_rolling_hash_against_the_recurrence():
    data = bytes(random.Random(11).randrange(256) for _ in range(200))
    h, want = 0, []
    for i, byte in enumerate(data):
        h = sum(int(chunk_dedup.GEAR[data[i - k]]) << k for k in range(min(i + 1, chunk_dedup.WINDOW))) % 2**64
        want.append(h)
    with np.errstate(over="ignore"):
        assert chunk_dedup.rolling_hashes(data, np.arange(1, 201)).tolist() == want


# 8 --------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_random_access(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    rng = random.Random(12)
    rows = [(i, f"http://h/{i} x\r\ny", " ".join(prose(rng, rng.randint(1, 80)))) for i in range(60)] + [(100 + i, None, "copy é") for i in range(20)] + [(200, "u", None), (201, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    index = warc.write_bundles(pages, path)
    got = {r.page_id: r for r in warc.read_bundles(spark, path, index).collect()}
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        first.setdefault(data, i)
        r = got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[data] == i else ("revisit", first[data]))
        assert r.payload is None if r.refers_to is not None else bytes(r.payload) == data
    wanted = spark.createDataFrame([(7,), (100,), (999,)], "page_id long")
    assert {r.page_id: bytes(r.payload) for r in warc.read_records(spark, path, index, wanted).collect()} == {7: rows[7][2].encode(), 100: "copy é".encode()}
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_bundle_is_plain_zstandard_too():
    import zstandard

    bundle = warc.Bundle()
    data = [warc.record(i, f"http://x/{i}", bytes([65 + i]) * 300_000, None) for i in range(3)]
    places = [bundle.add(d) for d in data]
    raw = bundle.finish()
    assert len(warc.seek_table(raw)) == 3 and places[2][0] == 2
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(data)
    assert warc.frame(raw, 1) == data[1]


# 9 --------------------------------------------------------------------------------------------------------------------


def test_fingerprints_of_edited_and_next_documents(spark, monkeypatch):
    monkeypatch.setattr(syncmer, "RANGE_ROWS", 7)
    rng = random.Random(13)
    texts = {3 * i: " ".join(prose(rng, rng.randint(1, 300), 3000)) for i in range(40)}
    texts |= {1: "", 2: "é", 4: texts[3], 5: texts[6], 8: texts[9], 500: "ab " * 50, 501: None}
    docs = documents(spark, [(i, t, "s") for i, t in texts.items()]).withColumn("next", F.lit(1)).repartition(3)
    got = {r.doc_id: r for r in syncmer.fingerprint_documents(docs).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for at, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        if following == text:
            assert got[i].near_next == 1
        if len(text) > 1000 and following != text:
            assert got[i].near_edited > 0.45 and got[i].near_next < 0.1
    assert got[3].fingerprint == got[4].fingerprint and got[1].fingerprint == ""
    assert syncmer.fingerprint_documents(documents(spark, [])).count() == 0


def test_anchors_stand_where_equal_passages_stand(spark):
    rng = random.Random(14)
    passage = prose(rng, 60, 3000)
    docs = documents(spark, [(1, " ".join([*prose(rng, 30, 3000), *passage]), "s"), (2, " ".join([*prose(rng, 11, 3000), *passage]), "s")])
    found = {}
    for r in syncmer.anchors(docs).collect():
        found.setdefault(r.hash, {})[r.doc_id] = r.position
    shared = [v for v in found.values() if len(v) == 2]
    assert len(shared) > 15 and {v[1] - v[2] for v in shared} == {19}


# 10 -------------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = """<html><head><title>T</title><script>if (a<b) {"</head>"}</script></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
    <div id="cookie-notice">We use cookies to make this better for all.</div><main><article class="post"><header><h1>Head &amp; more</h1></header>
    <p>One two three <a href="x">four five</a> six.<p>Two <b>bo</b>ld&nbsp;text<br>after</p><div class="advert">Buy now our fine product for all of you!</div>
    <form><label>Mail</label><button>Send</button></form><section id="comments"><article class="comment"><p>I think this is a great article to read.</p></article></section></article></main>
    <div class="sidebar"><p>Popular posts with many words that go on and on for a while.</p></div><footer>&copy; 2024</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain  &lt;words"), (4, "u", "<p>again</p>"), (None, "u", "<script>only")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    by = {(r.page_id, r.text) for r in got}
    assert by == {(1, "Head & more One two three four five six. Two bold text after"), (2, ""), (3, ""), (4, "plain <words"), (4, "again"), (None, "")}
    assert all(r.n_chars == len(r.text) for r in got)
