"""Hand-worked cases of text rules, profiles, validation, keywords, graphs, metrics and maintenance."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar import config
from lodestar.functions import terms, text, vectors
from lodestar.operators import evaluate, graph, keywords, maintain, profile, validate
from lodestar.plans import match


def one(spark, column, *values):
    """The function of a column over each value, as a list."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.out for r in df.select("i", column(F.col("x")).alias("out")).orderBy("i").collect()]


def test_names(spark):
    assert one(spark, text.strong_key, "MÜLLER, José &amp; Co", " Ann​  Lee ", None, "A&B") == ["mueller, jose & co", "ann lee", "", "a&b"]
    odd = ["a &amp;amp; b", "ﬁne ½", "Łódź", "e\u0301x", "İz", "“Q” – ä", "&#196;&lrm;b"]
    assert one(spark, text.strong_key, *odd) == ["a &amp; b", "fine 1⁄2", "łodz", "ex", "iz", "“q” – ae", "aeb"]
    assert one(spark, text.clean_quoted, "\"Tom's plan'\"", '“ x”') == ["Tom's plan'", "x"]
    assert one(spark, text.weak_key, " Ann\t LEE ", None) == ["ann lee", ""]
    assert one(spark, text.clean_quoted, "\"'Projéct  one'\"", None) == ["Projct one'", ""]


def test_lists(spark):
    assert one(spark, text.split_numbered, "1. Alice  B;\n2. Bob, 3.Carl", "1. Alice  B;\n2. Bob, 3. carl 4. CARL", "x1. no", "", None) == [["Alice B", "Bob", "Carl"], ["Alice B", "Bob", "carl"], ["x1. no"], [], []]
    assert one(spark, text.split_list, "a, ,b", None) == [["a", "b"], []]
    assert one(spark, text.tech_edges, "• one\n• two • three", "a; b", "") == [["one", "two", "three"], ["a; b"], []]


def test_ids_titles_years(spark):
    assert one(spark, lambda x: text.startup_id(x, F.lit(2025), F.lit(1)), "Med AI Lab!") == ["med-ai-lab-2025-1"]
    assert one(spark, lambda x: text.startup_id(x, F.lit(None), F.lit(7)), "") == ["startup-na-7"]
    assert one(spark, text.title_class, "Assistant Professor", "Adjunct Lecturer", "Associate Professor", "Chair Professor", "Dean", None) == ["assistant", "lecturer", "associate", "professor", "professor", "professor"]
    assert one(spark, text.latest_year, "2019, 2021 and 20225", "none") == [2021, None]


def test_progress_lines(spark):
    marker = text.progress_marker
    assert one(spark, lambda x: F.concat_ws("/", marker(x)["current"], marker(x)["total"]), "[3/4] Scraping: Ann", "[ 9 / 4 ] x", "[1/0] x") == ["3/4", "4/4", ""]
    assert one(spark, text.name_in_line, "[3/4] Scraping: Ann", "[1/2] Processing publication: Bo Li ", "Bo Li: 12 publications", "[1/2] Bo: 3 leading projects", "processing: O'Neil", "x") == ["Ann", "Bo Li", "Bo Li", "Bo", "O'Neil", None]


def test_display(spark):
    assert one(spark, lambda x: text.highlight(x, ["solar", "c++"]), "Solar <c++>") == ["<mark>Solar</mark> &lt;<mark>c++</mark>&gt;"]
    long = "; ".join(["a" * 98, "b" * 98, "solar cells"])
    assert one(spark, lambda x: text.summarize(x, terms.literal(["solar"])), None, "short", long, "c" * 300) == ["No research interests provided.", "short", text_of(long), "c" * 200 + "…"]


def text_of(long):
    """What the rule says by plain steps."""
    parts = [p.strip() for p in long.replace(",", ";").split(";")]
    out = ""
    for p in sorted(parts, key=lambda p: -("solar" in p)):
        following = f"{out}, {p}" if out else p
        if len(following) > 200:
            break
        out = following
    return out + ("…" if len(out) < len(long) else "")


def test_profile(spark):
    assert [profile.repeats(w) for w in (5, 2.5, 1.5, 1.0, 0.2, 0.1)] == [15, 8, 4, 3, 1, 1]
    df = spark.createDataFrame([("Assistant", False, None), ("Associate", True, 3.0), ("Professor", False, float("nan"))], "t string, e boolean, y double")
    got = [r[0] for r in df.select(profile.priority(F.col("y"), F.col("t"), F.col("e"))).collect()]
    assert got == pytest.approx([0.5 / 11 + 1.0, 0.975, 1.15])


def test_people(spark):
    info = spark.createDataFrame([(0, "Ann", " D1", "Dean", "no"), (1, "Ann", "D1", "Dean", None), (2, "", "D2", "Dean", "yes"), (3, "Bo", None, None, "")], "_row long, name string, department string, title string, is_engineering string")
    people = profile.clean_people(info)
    got = {r._row: (r.name, r.department, r.is_engineering) for r in people.collect()}
    assert got == {0: ("Ann", "D1", True), 2: ("Professor 2", "D2", True), 3: ("Bo", "", False)}
    projects = spark.createDataFrame([(0, "Ann", "p2", None), (1, None, "px", None), (2, "Ann", None, None), (3, "Ann", "p1", "f")], "_row long, name string, leading_project string, funding string")
    papers = spark.createDataFrame([(0, "Cy", None)], "_row long, name string, paper string")
    merged = {r.name: (r.leading_project, r.funding, r.paper) for r in profile.merge_people(people, projects, papers).collect()}
    assert merged == {"Ann": ("p2 | p1", "f", ""), "Professor 2": ("", "", ""), "Bo": ("", "", "")}
    deeptech = spark.createDataFrame([(1, " ann ", "T2"), (0, "ANN", "T1"), (2, "", "T3")], "_row long, pi string, technology_title string")
    attached = {r.name: [p.technology_title for p in r.deeptech] for r in profile.attach_projects(people, deeptech).collect()}
    assert attached == {"Ann": ["T1", "T2"], "Professor 2": [], "Bo": []}


def test_validation(spark):
    cases = {
        "": ("V01", "invalid", 1.0), "12345 !!": ("V02", "invalid", 1.0), "asdfghjkl": ("V03", "invalid", 0.9), "power": ("V03", "invalid", 0.9), "xyz abc": ("V03", "invalid", 0.9),
        "hello there": ("V04", "invalid", 0.95), "software testing": ("V04", "invalid", 0.95), "marketing campaign strategy": ("V08", "weak_relevance", 0.75), "legal data": ("V14", "valid", 0.9),
        "advanced system": ("V13", "needs_clarification", 0.7), "deep learning for medical imaging": ("V14", "valid", 0.9),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "query_id int, query string")
    got = {r["query"]: (r.rule, r.status, r.confidence) for r in validate.validate(df).collect()}
    assert got == cases
    scored = df.where("query = 'deep learning for medical imaging'").crossJoin(spark.createDataFrame([(0.2,), (0.3,), (0.4,)], "s double"))
    near = validate.validate(scored, similarity=F.col("s"), areas=F.array(F.lit("lasers; optics"), F.lit("dots"), F.lit("x")))
    assert {r.rule: r.suggestions[-1] for r in near.where("rule <> 'V14'").collect()} == {"V11": "Some areas that are covered: lasers, dots", "V12": "Related areas: lasers, dots"}
    assert sorted((r.s, r.rule) for r in validate.validate(scored, similarity=F.col("s")).collect()) == [(0.2, "V11"), (0.3, "V12"), (0.4, "V14")]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "graph neural network, system"), (2, "a novel the")], "query_id int, query string")
    got = {r.candidate: round(r.score, 6) for r in keywords.score(keywords.candidates(df)).collect()}
    assert got == {"graph neural network": 1.0, "neural": 1.0, "graph": 0.8, "network": 0.7, "system": 0.3}
    told = {r.query_id: r.filtered_query for r in keywords.filtered_query(df, keywords.score(keywords.candidates(df))).collect()}
    assert told[2] == "a novel the" and told[1].startswith("graph neural network")


def test_jaccard_and_edges(spark):
    t = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c", "d"]), (3, [])], "id long, tokens array<string>")
    assert [tuple(r) for r in graph.jaccard_pairs(t, 0.15).collect()] == [(1, 2, 0.5)]
    kinds = ("interests", "projects", "papers", "deeptech")
    sets = spark.createDataFrame([(1, ["a", "b", "c"], [], None, ["x", "y", "z", "u", "v"]), (2, ["b", "c", "d"], ["p"], [], ["x", "y", "r", "s", "t"]), (3, [], [], [], ["q"])], "id long, interests array<string>, projects array<string>, papers array<string>, deeptech array<string>")
    assert [(r.src, r.dst, round(r.weight, 6)) for r in graph.person_edges(sets.select("id", *kinds)).collect()] == [(1, 2, 0.225)]
    people = spark.createDataFrame([(1, "d"), (3, "d"), (4, ""), (5, "")], "id long, department string")
    assert [tuple(r) for r in graph.department_links(people).collect()] == [("d", 2, 0.05)]
    edges = spark.createDataFrame([(1, 2, 0.225), (1, 3, 0.3)], "src long, dst long, weight double")
    scores = spark.createDataFrame([(9, 1, 0.5), (9, 2, 0.2), (9, 3, 0.4), (9, 4, 1.0)], "query_id long, id long, score double")
    assert {r.id: round(r.neighbors, 6) for r in graph.neighbor_mean(edges, scores).collect()} == {1: 0.3, 2: 0.5, 3: 0.5, 4: 0.0}
    assert {r.id: round(r.neighbors, 6) for r in graph.neighbor_mean(edges.limit(1), scores, people).collect()} == {1: 0.3, 2: 0.5, 3: 0.5, 4: 0.0}


@pytest.mark.parametrize("chunk,least", [(2000, 0.15), (3, 0.15), (3, 0.5), (2, 0.8)])
def test_prefixes_lose_no_pair(spark, monkeypatch, chunk, least):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(chunk)
    sets = {i: sorted({f"t{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(12))}) for i in range(70)}
    df = spark.createDataFrame([(i, t) for i, t in sets.items()], "id long, tokens array<string>")
    want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in sets.items() for j, b in sets.items() if i < j and a and b}
    got = {(r.src, r.dst): r.jaccard for r in graph.jaccard_pairs(df, least).collect()}
    assert got == {k: v for k, v in want.items() if v >= least}
    reps, members = graph.classes(df)
    whole = graph.expanded(graph.jaccard_pairs(reps, least), members).collect()
    assert {(r.src, r.dst) for r in whole} == {k for k, v in want.items() if v >= least and sets[k[0]] != sets[k[1]]}
    first = {}
    for i, t in sets.items():
        first.setdefault(tuple(t), i)
    assert {(r.src, r.dst) for r in graph.copies(members).collect()} == {(first[tuple(t)], i) for i, t in sets.items() if first[tuple(t)] != i}


def test_scores(spark):
    row = spark.range(1).select(match.semantic_score({"company": F.lit(0.3), "description": F.lit(0.5), "category": F.lit(0.05)}).alias("s"), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero")).first()
    assert row.s == pytest.approx((0.3 * 0.3 + 0.5 * 0.5 + 0.2 * 0.05) * (0.55 + 0.45 * 0.8)) and row.zero == 0.0
    assert match.scaled_weights({"company": "x", "description": -1, "category": 0.7}) == pytest.approx({"company": 0.3, "description": 0.0, "category": 0.7})
    assert match.scaled_weights({"company": 0, "description": 0, "category": 0}) == match.FIELD_WEIGHTS
    sims = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.4), (0, 3, 0.2)], "query_id long, id long, score double")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    projects = spark.createDataFrame([(0, 1, 5, False, 0.7), (0, 1, 4, False, 0.1)], "query_id long, id long, project long, blank boolean, similarity double")
    top = match.rank_people(sims, spark.createDataFrame([(1, 1.0)], "id long, priority double"), edges, match.rank_projects(projects), k=1).first()
    assert (top.id, top["rank"]) == (1, 1) and top.score == pytest.approx(0.48 + 0.2 + 0.03 + 0.35)
    assert match.rank_startups(sims, edges, k=0).count() == 1 and match.top_k(sims, 0).count() == 0


def test_metrics(spark):
    got = evaluate.metrics(spark.createDataFrame([(1, 1), (2, 2), (3, None)], "query_id int, rank int"), 5).first()
    assert tuple(got) == pytest.approx((2 / 3, 0.5, (1 + 1 / math.log2(3)) / 3))
    assert tuple(evaluate.metrics(spark.createDataFrame([], "query_id int, rank int"), 5).first()) == (0.0, 0.0, 0.0)


def test_maintenance(spark):
    existing = spark.createDataFrame([(0, "Allen Huang", "Professor"), (1, "Bo Li", "Visiting Scholar"), (2, "Cy Gone", ""), (3, "cy  GONE", "")], "_row long, name string, title string")
    listed = spark.createDataFrame([("Allen Hao Huang",)], "name string")
    departed = maintain.departed_names(existing, listed)
    assert [r.name for r in departed.collect()] == ["Cy Gone"]
    assert sorted(r.name for r in maintain.remove_departed(existing, departed).collect()) == ["Allen Huang", "Bo Li"]
    assert [tuple(r) for r in maintain.removed_counts(existing, departed).collect()] == [("Cy Gone", 2)]
    none = departed.where("false")
    assert [tuple(r)[1:] for r in maintain.padded_changes(none, none).collect()] == [("", "")]
    names = spark.createDataFrame([(1, "Ann Lee"), (2, "Zed")], "id long, name string")
    pages = spark.createDataFrame([(0, "Lee", "u0"), (1, "lee", "u1")], "_row long, name string, url string")
    assert [(r.id, r.url, r.overlap, r.how) for r in maintain.resolve(names, pages).collect()] == [(1, "u1", 0.5, "fuzzy")]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc 1.;,\n\tÄé", max_size=30), min_size=1, max_size=8))
def test_text_rules_against_python(spark, values):
    import re

    got = one(spark, lambda x: F.struct(text.token_set(x).alias("t"), text.clean_whitespace(x).alias("c"), text.slug(x).alias("s")), *values)
    for v, r in zip(values, got, strict=True):
        assert r.t == list(dict.fromkeys(re.findall(r"[a-z0-9]+", v.lower())))
        assert r.c == re.sub(r"\s+", " ", v).strip()
        assert r.s == re.sub(r"[^a-z0-9]+", "-", v.lower()).strip("-")


def test_settings_reach_the_operators(spark):
    given = {"people": {"alpha": "0.7", "beta": -1, "gamma": "many"}, "startups": {"top_k": 3}, "startup_fields": {"company": 1, "description": 1}, "priority": {"title": 0, "engineering": float("nan")}, "people_graph": {"threshold": 0.9}, "startup_graph": "none", "query": {"keywords": False, "low": 0.1}}
    assert config.people(given) == {"alpha": 0.7, "beta": 0.0, "gamma": 0.1, "k": 10}
    assert config.startups(given) == {"alpha": 1.0, "gamma": 0.1, "k": 3, "least": 0.2, "weights": {"company": 1.0, "description": 1.0, "category": 0.2}}
    assert config.checks(given) == {"validate_query": True, "use_keywords": False, "low": 0.1, "weak": 0.35} and config.startup_graph(given) == {"threshold": 0.22, "weights": (0.571, 0.429)}
    assert config.priority(given)["weights"] == (0.5, 0.0, 0.5) and config.priority(None) == {"weights": (0.5, 0.5, 0.5), "default_years": 10, "bonus": 1.2}
    sets = spark.createDataFrame([(1, ["a", "b"], ["x"], [], []), (2, ["a", "b"], ["x", "y"], [], [])], "id long, interests array<string>, projects array<string>, papers array<string>, deeptech array<string>")
    assert graph.person_edges(sets, **config.person_graph()).count() == 1 and graph.person_edges(sets, **config.person_graph(given)).count() == 0
    people = spark.createDataFrame([(1, "a", "Dean", True, 1.0)], "id long, text string, title string, eng boolean, y double")
    rated = lambda s: people.select(profile.priority(F.col("y"), F.col("title"), F.col("eng"), **config.priority(s)).alias("p")).first().p
    assert rated({"priority": {"title": 0, "engineering": 0}}) == 0.25 and rated({"priority": {"years": 0, "title": 0, "bonus": 2}}) == 1.0
    asked = spark.createDataFrame([(1, "laser")], "query_id long, query string")
    found = spark.createDataFrame([(i, "laser optics", 1.0 / i) for i in range(1, 6)], "id long, text string, priority double")
    none = spark.createDataFrame([], "src long, dst long")
    _, told = match.match_people(asked, found, none, **config.people({"people": {"alpha": 0, "beta": 1, "top_k": 2}}), **{**config.checks(), "validate_query": False})
    assert [(r.id, r.score) for r in told.orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]
