"""Operators that SQL cannot say, against plain Python that shares no code with them; and readers of workbooks and broken files."""

import collections
import io
import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import terms, text, topk, vectors
from lodestar.operators import evaluate, graph
from lodestar.plans import match
from lodestar.sources import ingest


def tokens(t):
    return [w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in terms.STOPWORDS]


class Plain:
    """TF-IDF by definition."""

    def __init__(self, texts):
        df = collections.Counter(w for t in texts for w in set(tokens(t)))
        self.idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(self, t):
        w = {k: n * self.idf[k] for k, n in collections.Counter(tokens(t)).items() if k in self.idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {k: x / norm for k, x in w.items()} if norm else {}

    def cosine(self, a, b):
        x, y = self.vector(a), self.vector(b)
        return sum(v * y.get(k, 0) for k, v in x.items())


def neighbours(edges, ids):
    near = collections.defaultdict(set)
    for a, b in edges:
        if a in ids and b in ids and a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def ranked(scores, k):
    return [(i, round(s, 6)) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]


def world(seed):
    rng = random.Random(seed)
    vocabulary = [f"term{i}" for i in range(25)]
    people = {i: (" ".join(rng.choices(vocabulary, k=rng.randrange(1, 8))), rng.choice([0.1, 0.5, 0.5, 0.9])) for i in range(30)}
    queries = {q: " ".join(rng.choices([*vocabulary, "unseen"], k=2)) for q in range(6)} | {9: "nothing shared"}
    edges = [(rng.randrange(34), rng.randrange(34)) for _ in range(40)]
    return people, queries, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_match_people(spark, seed):
    people, queries, edges = world(seed)
    model = Plain([t for t, _ in people.values()])
    projects = [(i, p, people[(i + p + 1) % 30][0] if p else " ") for i in range(0, 30, 3) for p in range(2)]
    near = neighbours(edges, people)
    want = {}
    for q, asked in queries.items():
        sims = {i: model.cosine(asked, t) for i, (t, _) in people.items()}
        best = {i: max((0.0 if not t.strip() else model.cosine(asked, t)) for j, _, t in projects if j == i) for i in {p[0] for p in projects}}
        want[q] = ranked({i: 0.8 * s + 0.2 * people[i][1] + 0.1 * (sum(sims[j] for j in near[i]) / len(near[i]) if near[i] else 0) + 0.5 * best.get(i, 0) for i, s in sims.items()}, 8)
    _, got = match.match_people(
        spark.createDataFrame(list(queries.items()), "query_id int, query string"), spark.createDataFrame([(i, *p) for i, p in people.items()], "id int, text string, priority double"), spark.createDataFrame(edges, "src int, dst int"),
        spark.createDataFrame(projects, "id int, project int, text string"), k=8, validate_query=False, use_keywords=False,
    )
    told = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        told[r.query_id].append((r.id, round(r.score, 6)))
    for q in queries:
        assert [s for _, s in told[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)
        assert dict(told[q]).keys() ^ dict(want[q]).keys() <= {i for i, s in [*told[q], *want[q]] if s == pytest.approx(want[q][-1][1], abs=1e-6)}


def test_match_startups(spark):
    people, queries, edges = world(3)
    startups = {i: (t, people[(i + 1) % 30][0], "" if i % 4 else "term1") for i, (t, _) in people.items()}
    names = list(match.FIELD_WEIGHTS)
    filled = {i: [v or match.PLACEHOLDERS[f] for f, v in zip(names, x, strict=True)] for i, x in startups.items()}
    model = Plain([v for x in filled.values() for v in x])
    near = neighbours(edges, startups)
    want = {}
    for q, asked in queries.items():
        score = {}
        for i, x in filled.items():
            sims = dict(zip(names, (model.cosine(asked, v) for v in x), strict=True))
            cover = sum(match.FIELD_WEIGHTS[f] for f in names if sims[f] >= 0.2)
            score[i] = max(0.0, sum(match.FIELD_WEIGHTS[f] * sims[f] for f in names) * (0.55 + 0.45 * cover))
        want[q] = ranked({i: s + 0.1 * (sum(score[j] for j in near[i]) / len(near[i]) if near[i] else 0) for i, s in score.items()}, 5)
    _, got = match.match_startups(
        spark.createDataFrame(list(queries.items()), "query_id int, query string"), spark.createDataFrame([(i, *x) for i, x in startups.items()], "id int, company string, description string, category string"),
        spark.createDataFrame(edges, "src int, dst int"), k=5, validate_query=False,
    )
    told = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        told[r.query_id].append((r.id, round(r.score, 6)))
    for q in queries:
        assert [s for _, s in told[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_results_with_fields_projects_and_keywords(spark):
    people = spark.createDataFrame([(1, "graphene sensor arrays", 0.5, "Ann"), (2, "bridge design", 0.2, "Bo"), (3, "sensor networks", 0.1, "Cy")], "id long, text string, priority double, name string")
    projects = spark.createDataFrame([(1, 7, "graphene films"), (1, 8, " "), (1, 9, "graphene sensor arrays"), (3, 5, "networks")], "id long, project int, text string")
    asked = spark.createDataFrame([(1, "graphene sensor arrays for water")], "query_id long, query string")
    none = spark.createDataFrame([], "src long, dst long")
    _, plain = match.match_people(asked, people, none, projects, k=3, validate_query=False)
    _, told = match.match_people(asked, people, none, projects, k=3, validate_query=False, fields=["name"])
    assert {(r.query_id, r.id, r["rank"]) for r in plain.collect()} == {(r.query_id, r.id, r["rank"]) for r in told.collect()}
    by = {r.name: [p.project for p in r.projects] for r in told.collect()}
    assert by["Ann"][0] == 9 and set(by) == {"Ann", "Bo", "Cy"}
    startups = spark.createDataFrame([(1, "Gra", "graphene sensor arrays for water pipes", "sensor"), (2, "Bri", "steel bridge design", "building")], "id long, company string, description string, category string")
    _, shown = match.match_startups(asked, startups, none, k=2, validate_query=False, shown=True)
    rows = {r.id: r for r in shown.collect()}
    assert rows[1].company == "Gra" and any("graphene" in w for w in rows[1].keywords) and rows[1]["rank"] == 1
    assert {r.keyword for r in match.weighed_keywords(asked).collect()} and match.weighed_keywords(asked.where("false")).count() == 0


def test_sparse_and_whole_neighbour_means_agree(spark):
    rng = random.Random(4)
    ids = spark.range(20)
    edges = spark.createDataFrame([(rng.randrange(22), rng.randrange(22)) for _ in range(40)], "src long, dst long")
    scores = [(q, i, rng.choice([0.0, 0.0, rng.random()])) for q in range(3) for i in range(20)]
    whole = spark.createDataFrame(scores, "query_id int, id long, score double")
    a = {(r.query_id, r.id): r.neighbors for r in graph.neighbor_mean(edges, whole).collect()}
    b = {(r.query_id, r.id): r.neighbors for r in graph.sparse_neighbor_mean(edges, whole.where("score > 0"), ids).collect()}
    assert all(a[k] == pytest.approx(b.get(k, 0.0)) for k in a)


def test_dense_scans_in_passes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [(90, [0.0] * 4), (91, [1.0]), (92, None), (93, [None, 1.0, 1.0, 1.0])] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    good = lambda x: x is not None and None not in x and any(x)
    plain = lambda x, y: 0.0 if not good(x) or not good(y) or len(x) != len(y) else sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y)
    monkeypatch.setattr(topk, "PASS_QUERIES", 30)
    monkeypatch.setattr(topk, "MATRIX", 600)
    got = {(r.query_id, r.entity_id): r.similarity for r in topk.dense_pairs(df, df).collect()}
    assert len(got) == len(rows) ** 2 and all(got[i, j] == pytest.approx(plain(x, y), abs=1e-5) for i, x in rows for j, y in rows)
    best = {}
    for r in topk.dense_topk(df, df, 3).orderBy("query_id", "rank").collect():
        best.setdefault(r.query_id, []).append(r.entity_id)
    for i, _ in rows:
        assert best[i] == sorted((j for j, _ in rows), key=lambda j: (-round(got[i, j], 9), j))[:3]
    none = spark.createDataFrame([], df.schema)
    assert topk.dense_topk(none, df, 3).count() == 0 and topk.dense_topk(df, none, 3).count() == 0 and topk.dense_pairs(none, df).count() == 0


def test_dense_bounds_skip_far_groups():
    rng = np.random.default_rng(3)
    middles = topk.unit_rows(rng.normal(size=(40, 32)))
    rows = topk.unit_rows(np.repeat(middles, 200, axis=0) + rng.normal(size=(8000, 32)) * 0.02)
    queries = topk.unit_rows(middles[:20] + rng.normal(size=(20, 32)) * 0.02)
    scan, best = topk.DenseScan(queries, topk.directions(rows[::7], 64)), topk.Best(20, 10, np.full(20, -np.inf), 9)
    for i in range(0, len(rows), 1000):
        best.add(scan.scores(rows[i : i + 1000], best.bound), np.arange(i, i + 1000))
        best.compact()
    q, s, e = best.compact()
    exact = np.round(queries @ rows.T, 9)
    for k in range(20):
        assert e[q == k].tolist() == sorted(range(len(rows)), key=lambda j: (-exact[k, j], j))[:10]
    assert scan.skipped > 3 * scan.visited


def test_sparse_scan_against_the_join(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.choice([1, 5, 40])))) for i in range(120)] + [(500 + i, "w1 w2 w3") for i in range(20)] + [(900, None), (901, "")], "id long, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(word() for _ in range(6))) for i in range(25)] + [("none", "unheard"), ("null", None)], "id string, text string")
    model = vectors.TfIdf.fit(docs)
    pairs = {}
    for r in vectors.sparse_cosine(model.transform(asked), model.transform(docs)).collect():
        pairs.setdefault(r.query_id, {})[r.entity_id] = round(r.similarity, 9)
    monkeypatch.setattr(topk, "PASS_QUERIES", 10)
    monkeypatch.setattr(topk, "MATRIX", 200)
    got = {}
    for r in vectors.nearest_texts(model, asked, docs, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.entity_id, r.similarity))
    assert got == {q: [(i, pytest.approx(s, abs=2e-9)) for i, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:4]] for q, found in pairs.items()}


def test_rank_among(spark):
    rng = random.Random(8)
    scored = [(q, i, rng.choice([0.1, 0.2, 0.3])) for q in range(6) for i in range(15)]
    truth = [(q, rng.randrange(20)) for q in range(7)]
    got = {r.query_id: r["rank"] for r in evaluate.rank_among(spark.createDataFrame(scored, "query_id int, id int, score double"), spark.createDataFrame(truth, "query_id int, id int")).collect()}
    for q, t in truth:
        order = [i for _, i, s in sorted((r for r in scored if r[0] == q), key=lambda r: (-r[2], r[1]))]
        assert got[q] == (order.index(t) + 1 if t in order else None)


def plain_summary(t, words, most=200):
    if not t:
        return "No research interests provided."
    if len(t) <= most:
        return t
    parts = [p.strip() for p in re.split("[;,]", t) if p.strip()]
    if not words or len(parts) <= 1:
        return t[:most].strip() + "…"
    order = sorted(range(len(parts)), key=lambda i: (-sum(w in parts[i].lower() for w in words), i))
    out = ""
    for i in order:
        longer = f"{out}, {parts[i]}" if out else parts[i]
        if len(longer) > most:
            break
        out = longer
    out = out or parts[order[0]][:most]
    return out + "…" if len(out) < len(t) else out


def test_summaries_and_edges(spark):
    rng = random.Random(6)
    rows = ["".join(rng.choice(["the", "ation", " ", " ", "; ", ", ", "solar", "x", "•", "\n", "|"]) for _ in range(rng.randrange(120))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", text.summarize(F.col("t"), terms.literal(["the", "tion"])).alias("s"), text.tech_edges(F.col("t")).alias("e")).orderBy("i").collect()
    for r, t in zip(got, rows, strict=True):
        assert r.s == plain_summary(t, ["the", "tion"]), t
        lines = [re.sub(r"^•\s*", "", x.strip()).strip() for x in re.split(r"\n+|(?=•)", t or "")]
        assert r.e == [x for x in lines if x], t


def workbook(rows):
    shared = sorted({c for r in rows for c in r if isinstance(c, str) and c})
    cell = lambda c, at: "" if c == "" else f'<c r="{at}"><v>{c}</v></c>' if not isinstance(c, str) else f'<c r="{at}" t="s"><v>{shared.index(c)}</v></c>'
    body = "".join(f'<row r="{i}">' + "".join(cell(c, f"{chr(65 + k)}{i}") for k, c in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "EAS_2024.xlsx").write_bytes(workbook([["P I", "Title", "App 1"], ["Ann", "Laser", ""], ["", "No one", "x"], ["Bo", 12.5, "y"]]))
    (tmp_path / "BMH_2023.xlsx").write_bytes(workbook([["P I", "Title", "App 1"], ["Cy", "Gel"]]))
    df = ingest.read_xlsx(spark, f"file://{tmp_path}")
    got = ingest.deeptech(df, {"pi": "p i", "title": "TITLE", "app_1": "app 1"}).orderBy("pi").collect()
    assert [(r.pi, r.technology_title, r.applications) for r in got] == [("Ann", "Laser", []), ("Bo", "12.5", ["y"]), ("Cy", "Gel", [])]
    started = ingest.startups(ingest.read_xlsx(spark, f"file://{tmp_path}/EAS_2024.xlsx"), {"company_name": "title"}, "startup_2024.xlsx").orderBy("raw_row_index").collect()
    assert [(r.startup_id, r.raw_row_index) for r in started] == [("laser-2024-1", 1), ("no-one-2024-2", 2), ("12-5-2024-3", 3)]


def test_files_that_are_not_there_or_broken(spark, tmp_path):
    assert ingest.read_csv(spark, f"file://{tmp_path}/none.csv", missing=("name",)).columns == ["name", "_row"]
    (tmp_path / "bad.csv").write_bytes(b"name\nZo\xeb\n")
    assert ingest.read_csv(spark, f"file://{tmp_path}/bad.csv", replace=True).first()["name"] == "Zo�"
    assert ingest.row_count(spark, f"file://{tmp_path}/bad.csv") == 1 and ingest.row_count(spark, f"file://{tmp_path}/none.csv") == 0
