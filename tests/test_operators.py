"""Operators on small tables with values worked out by hand."""

import math
import re

from pyspark.sql import functions as F

from athenor.functions import exprs
from athenor.iterative import betweenness, components, traversal
from athenor.operators import authors, checks, graph, matching, pool, relevance, topics, trajectory


def rows(df):
    return sorted(tuple(r) for r in df.collect())


PATH = [(1, 2), (2, 3), (3, 4)]


def test_hop_distances_on_a_path(spark):
    edges = spark.createDataFrame(PATH, "src int, dst int")
    seeds = spark.createDataFrame([(1,), (9,)], "node int")
    assert rows(traversal.hop_distances(edges, seeds)) == [(1, 0), (2, 1), (3, 2), (4, 3), (9, 0)]


def test_components_of_a_star_a_path_and_loops(spark):
    links = [(0, k) for k in range(1, 80)] + [(100, 101), (101, 102), (102, 103)] + [(5, 5), (200, 200), (None, 1)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert all(got[k] == 0 for k in range(80)) and all(got[k] == 100 for k in range(100, 104)) and 200 not in got


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chain_settles(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.components(chain).select("component").distinct().collect()[0][0] == 0


def test_bridge_between_two_triangles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 7), (4, 5), (5, 6), (4, 6), (7, 4)], "src int, dst int")
    member = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "b")], "node int, cluster string")
    assert dict((r[0], r[2]) for r in rows(graph.bridge_diversity(edges, member)))[7] == 0.5
    assert rows(graph.bridge_papers(edges, member))[0][:3] == (7, "a", "b")


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("g", *e, 1.0) for e in PATH], "g string, src int, dst int, weight double")
    assert {r.node: r.betweenness for r in betweenness.betweenness(edges).collect()} == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}


def test_intro_counts(spark):
    df = spark.createDataFrame([(0,), (8,), (12,), (60,), (100,)], "n int")
    assert [r[0] for r in df.select(exprs.intro_count("n")).collect()] == [0, 2, 10, 15, 20]
    assert [r[0] for r in df.select(exprs.intro_count_plain("n")).collect()] == [0, 8, 10, 15, 20]


def test_adaptive_depth():
    assert [traversal.adaptive_depth(n) for n in (5, 25, 100)] == [5, 10, 12]


def test_rolling_share_stops_only_over_a_full_window(spark):
    for values, stop in (([0] * 10, False), ([1] * 30, False), ([0] * 30, True)):
        df = spark.createDataFrame([("a", i, bool(v)) for i, v in enumerate(values)], "k string, i int, ok boolean")
        assert traversal.rolling_share(df, ["k"], ["i"], "ok").orderBy(F.desc("i")).first().stop is stop


def _authors(spark, first, second):
    papers = spark.createDataFrame([(1, "x", 2000, 0, "v", False), (2, "x", 2001, 0, "v", False), (3, "x", 2003, 0, "v", False)], "paper_id int, author_id string, year int, citation_count int, venue string, is_seed boolean")
    concepts = spark.createDataFrame([(1, first, 1.0, 1), (2, second, 1.0, 1), (3, second, 1.0, 1)], "paper_id int, name string, score double, pos int")
    return papers, concepts


def test_drift_of_equal_and_of_disjoint_years(spark):
    assert trajectory.drift_events(*_authors(spark, "a", "a")).count() == 0
    got = trajectory.drift_events(*_authors(spark, "a", "b")).collect()
    assert [(r.year_from, r.year_to, r.is_jump) for r in got] == [(2000, 2001, True)] and got[0].drift == 1.0


def test_short_phases_merge(spark):
    df = spark.createDataFrame([("a", 0, 2000, 2000, 1), ("a", 1, 2001, 2005, 4), ("a", 2, 2006, 2006, 2)], "author_id string, phase int, first_year int, last_year int, papers bigint")
    assert rows(trajectory.merge_short_phases(df)) == [("a", 0, 2000, 2006, 7)]


def test_rank_percentile_is_an_element(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)], "x double")
    assert trajectory.at_rank(df, "x", 0.9).first()[0] == 9.0


def test_title_hash_and_doi(spark):
    df = spark.createDataFrame([("The Zeta of Alpha: Beta!", "https://doi.org/10.1/AbC.;"), (None, None)], "t string, d string")
    got = df.select(exprs.title_hash("t"), exprs.normalize_doi("d")).collect()
    assert tuple(got[0]) == ("alpha beta zeta", "10.1/abc") and tuple(got[1]) == ("", None)


def test_tiers(spark):
    papers = spark.createDataFrame([(1, "Nature"), (2, "Science"), (3, "J. Org. Chem."), (4, "Random"), (5, "Organic Letters"), (6, "Other")], "i int, venue string")
    first, second = ["Nature", "Science"], ["J. Org. Chem.", "Organic Letters"]
    assert [r.i for r in relevance.tiered(papers, first, second, "i", 6).collect()] == [1, 2, 3, 5, 4, 6]
    assert [r.i for r in relevance.tiered(papers, first, second, "i", 6, "ocean").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.i for r in relevance.tiered(papers, first, second, "i", 6, "tier1_only").collect()] == [1, 2]


def test_confidence_of_checks(spark):
    df = spark.createDataFrame([("a", "error", 0), ("a", "warning", 1), ("a", "info", 0), ("b", "error", 2), ("b", "info", 0)], "agent string, severity string, failed int")
    got = {r.agent: r for r in checks.confidence(df, ["agent"]).collect()}
    assert math.isclose(got["a"].confidence, 1.1 / 1.6) and got["a"].passed and got["a"].warnings == 1
    assert not got["b"].passed and got["b"].errors == 1


def test_fuzzy_titles(spark):
    left = spark.createDataFrame([(1, "Deep learning for protein structure prediction")], "left_id int, title string")
    right = spark.createDataFrame([(2, "Protein structure prediction using deep learning"), (3, "Something else entirely")], "right_id int, title string")
    got = matching.fuzzy_titles(left, right, 0.6).collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 2)] and math.isclose(got[0].similarity, 5 / 6)


def test_names(spark):
    df = spark.createDataFrame([("John Hartwig", "J. Hartwig"), ("Jane Doe", "Ann Doe"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(exprs.names_similar("a", "b")).collect()] == [True, False, None]
    assert authors.without_self(df, "a", "b").count() == 2


def test_merge_keeps_the_best_of_each(spark):
    df = spark.createDataFrame([(1, "Short", None, 3, False, 2), (2, "A longer title", "10.1/x", 1, True, 1)], "record_id int, title string, doi string, citation_count int, is_review boolean, depth int")
    assert tuple(pool.merge(df, F.lit("k")).first()) == ("k", "A longer title", "10.1/x", 3, True, 1, 2)


def test_dedupe_is_idempotent_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    once = pool.dedupe(df, [F.col("k")], [F.desc("v")])
    assert rows(once.select("v")) == [(2,), (3,), (4,)] == rows(pool.dedupe(once, [F.col("k")], [F.desc("v")]).select("v"))


def test_greedy_clusters_use_each_member_once(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (1, 12, "a"), (1, 11, "b"), (1, 13, "b"), (1, 14, "b")], "author_id long, coauthor_id long, concept string")
    got = sorted((r.concept, tuple(r.members)) for r in authors.greedy_clusters(df).collect())
    assert got == [("a", (10, 11, 12)), ("b", (13, 14))]


def test_topic_clusters(spark):
    pairs = spark.createDataFrame([("a", "b", 3), ("a", "c", 2), ("d", "e", 1)], "a string, b string, papers long")
    sizes = spark.createDataFrame([("a", 9), ("b", 5), ("c", 4), ("d", 2), ("e", 1)], "name string, n long")
    assert topics.topic_clusters(pairs, sizes) == [("a", ["b", "c"])]


def test_two_hop_intermediates(spark):
    edges = spark.createDataFrame([(1, 5), (5, 9), (1, 6)], "src int, dst int")
    pairs = spark.createDataFrame([(1, 9), (2, 9)], "a int, b int")
    assert rows(graph.missing_intermediates(edges, pairs)) == [(1, 9, 5)]


def test_fields_fall_back_to_ocean(spark):
    fields = spark.createDataFrame([("Organic Chemistry", ["palladium", "catalysis"], ["coupling"], ["galaxy"])], "field string, key_concepts array<string>, include_terms array<string>, exclude_terms array<string>")
    papers = spark.createDataFrame([(1, "Palladium catalysis of cross-coupling"), (2, "A galaxy survey")], "id int, t string")
    assert [(r.id, r.field) for r in matching.resolve_fields(papers, fields, "t", "id").orderBy("id").collect()] == [(1, "Organic Chemistry"), (2, "ocean")]


def test_fields_by_leaders_venues_and_names(spark):
    kinds = ", ".join(f"{c} array<string>" for c in ("key_concepts", "include_terms", "exclude_terms", "aliases", "known_leaders", "tier1_journals", "tier2_journals"))
    fields = spark.createDataFrame(
        [("Optics", ["laser", "lens"], [], [], ["photonics"], ["Ann Miller"], ["Optics Letters"], ["Light Reviews"]), ("Botany", ["leaf"], ["root"], ["laser"], [], ["Bo Li"], [], ["Plant Notes"])], f"field string, {kinds}"
    )
    papers = spark.createDataFrame(
        [(1, "Laser and lens in photonics", "Optic Letters", ["A. Miller", "Anne Miller"]), (2, "A leaf", "Plant Note", None), (3, "x", None, ["Bo Li"]), (4, None, "light reviews", []), (5, "laser leaf root", "", ["", None])],
        "id int, t string, v string, who array<string>",
    )
    got = {r.id: (r.field, round(r.score, 6), r.strategy) for r in matching.resolve_fields(papers, fields, "t", "id", "v", "who").collect()}
    assert got == {1: ("Optics", 1.0, "tier1_first"), 2: ("Botany", 0.5, "balanced"), 3: ("Botany", 0.3, "broad"), 4: ("ocean", 0.1, "ocean"), 5: ("Botany", 0.35, "broad")}


def test_venue_tiers_equal_difflib(spark):
    from difflib import SequenceMatcher

    venues = ["Nature", "NATURE ", "Nature Physics", "Natures", "Journal of Nature", "Cell", "Cells", "Organic Letters", "Org. Letters", "J. Organic Letters B", "Inorganic Letter", "", None, "C++ (Notes)"]
    first, second = ["Nature", "C++ (Notes)"], ["Organic Letters", "Cell", ""]

    def same(v, j):
        v, j = v.lower().strip(), j.lower().strip()
        if not v or not j:
            return False
        near = SequenceMatcher(None, v, j).ratio()
        if v == j:
            return True
        inside = re.search(r"\b" + re.escape(j) + r"\b", v)
        return (near >= 0.9 if len(j) <= 8 else True) if inside else near >= 0.8

    want = {v: 1 if any(same(v, j) for j in first) else 2 if any(same(v, j) for j in second) else 3 for v in venues if v is not None}
    got = matching.venue_tiers(spark.createDataFrame([(v,) for v in venues], "venue string"), first, second)
    assert {r.venue: r.tier for r in got.collect()} == want and set(want.values()) == {1, 2, 3}


def test_input_types_and_methods(spark):
    inputs = ["10.1234/ab", "https://doi.org/10.1234/ab", "DOI:10.1234/ab", "W12", "arXiv:2101.00001v2", "PMID:12345", "https://x.org", "A title", ""]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string").select("i", matching.input_type(F.col("s")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == ["doi", "doi", "doi", "openalex", "arxiv", "pmid", "url", "title", "title"]
    titles = spark.createDataFrame([("A Software for x",), ("BLAST: searching",), (None,)], "s string")
    assert [r[0] for r in titles.select(matching.is_methodology(F.col("s"))).collect()] == [True, False, False]


def test_shares_do_not_depend_on_the_order_of_rows(spark):
    import random

    rng = random.Random(5)
    rows = [(a, y, f"c{k}", w / 7) for a in range(60) for y in (2000, 2001) for k, w in enumerate(rng.sample(range(1, 90), 8))]
    want = None
    for _ in range(3):
        rng.shuffle(rows)
        found = trajectory.aligned(spark.createDataFrame(rows, "author_id int, year int, concept string, weight double").repartition(3), 2)
        got = sorted(map(tuple, found.collect()))
        assert want in (None, got)
        want = got
    for a in range(60):
        weights = sorted((w for b, y, _, w in rows if (b, y) == (a, 2000)), reverse=True)
        whole = 0.0
        for w in weights:
            whole += w
        assert sorted(r[4] for r in want if r[0] == a and r[4]) == sorted(w / whole for w in weights)


def test_short_phases_are_merged_without_a_python_group(spark):
    import random

    rng = random.Random(13)
    found = []
    for a in [None, *range(80)]:
        year, n = 1990, rng.randint(1, 7)
        for k in range(n):
            last = year + rng.choice((0, 0, 1, 2, 4))
            found.append((a, k, year, last, rng.randint(1, 9)))
            year = last + rng.randint(1, 2)
    want = []
    for a in [None, *range(80)]:
        out, carried = [], None
        for _, _, first, last, n in sorted(r for r in found if r[0] == a):
            now = (carried[0], last, carried[2] + n) if carried else (first, last, n)
            carried = now if now[1] - now[0] + 1 < 3 else None
            if not carried:
                out.append(now)
        if carried:
            out = [*out[:-1], (out[-1][0], carried[1], out[-1][2] + carried[2])] if out else [carried]
        want += [(a, k, *x) for k, x in enumerate(out)]
    rng.shuffle(found)
    got = trajectory.merge_short_phases(spark.createDataFrame(found, "author_id long, phase int, first_year int, last_year int, papers long").repartition(3))
    assert [f"{x.name} {x.dataType.simpleString()}" for x in got.schema] == ["author_id bigint", "phase int", "first_year int", "last_year int", "papers bigint"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
