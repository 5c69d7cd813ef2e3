"""The topical landscape against the plain rules, and smaller rules beside it."""

import math
import random

from athenor.operators import graph, landscape


def plain_cut(values):
    values = [v for v in values if v > 0]
    if not values:
        return 0.0, "none"
    down, n = sorted(values, reverse=True), len(values)
    mean = sum(values) / n
    level = mean + math.sqrt(sum((v - mean) ** 2 for v in values) / n)
    at, most = 0, 0
    for i in range(1, min(n, 100)):
        if down[i - 1] - down[i] > most:
            at, most = i, down[i - 1] - down[i]
    gap = (down[at], at)
    if n < 3:
        bend = (down[0], 1)
    elif down[0] == down[-1]:
        bend = (down[0], n)
    else:
        at, most = 1, 0
        for i in range(1, min(n - 1, 100)):
            if abs(down[i + 1] - 2 * down[i] + down[i - 1]) > most:
                at, most = i, abs(down[i + 1] - 2 * down[i] + down[i - 1])
        bend = (down[at], at)
    cuts = [(*bend, "elbow"), (*gap, "gap"), (level, sum(v >= level for v in values), "std")]
    good = [c for c in cuts if c[1] >= 20]
    best = min(good, key=lambda c: abs(c[1] - 158)) if good else max(cuts, key=lambda c: c[1])
    return max(best[0], 0.01), best[2]


def test_thresholds_equal_the_plain_rules(spark):
    rng = random.Random(2)
    rules = set()
    for n in (0, 1, 2, 3, 40, 150, 400):
        values = [round(rng.random() ** rng.choice([1, 3]), 3) for _ in range(n)] + [0.0, -1.0]
        got, want = landscape.threshold(spark.createDataFrame([(v,) for v in values], "v double"), "v"), plain_cut(values)
        assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1]
        rules.add(got[1])
    assert len(rules) >= 2 and landscape.threshold(spark.createDataFrame([(0.5,)] * 30, "v double"), "v") == (0.5, "elbow")


def test_landscape_keeps_hubs_apart(spark):
    rng = random.Random(7)
    names = ["tRNA", "Biology", "Deep Learning", "Software", "enzymes", "folding", "gene"]
    papers = [(k, k < 3) for k in range(60)]
    concepts = [(k, n, round(rng.random(), 2), i + 1) for k in range(55) for i, n in enumerate(rng.sample(names, rng.randint(1, 5)))]
    seeds = {n.lower() for k, n, s, _ in concepts if k < 3 and s >= 0.5}
    core = max(1, len(seeds - set(landscape.BROAD_CONCEPTS)))
    want = {}
    for k in {c[0] for c in concepts}:
        own = [(n.lower(), s) for p, n, s, _ in concepts if p == k]
        score = min(1.0, sum(s * (0.2 if n in landscape.BROAD_CONCEPTS else 1) for n, s in own if n in seeds) / core)
        hub = sum(s for n, s in own if n in landscape.METHOD_CONCEPTS) > 1.5 and not any(n in seeds and n not in landscape.BROAD_CONCEPTS for n, _ in own)
        want[k] = (round(score, 9), hub)
    cut, rule = plain_cut([v for v, hub in want.values() if not hub])
    got = landscape.landscape(spark.createDataFrame(papers, "paper_id int, is_seed boolean"), spark.createDataFrame(concepts, "paper_id int, name string, score double, pos int")).collect()
    assert {r.paper_id: (round(r.topical, 9), r.is_hub) for r in got} == want
    assert {r.paper_id for r in got if r.is_topical} == {k for k, (v, hub) in want.items() if not hub and (v >= cut - 1e-12 or k < 3)} and {r.rule for r in got} == {rule}
    first = {k: n for k, n, _, i in concepts if i == 1}
    assert all(r.cluster == (first[r.paper_id] if r.is_topical else None) for r in got)


def test_seed_floor_loosens_only_where_few_are_left(spark):
    rows = [(k, 40, 1990) for k in range(4)] + [(9, 1, 2001), (10, 1, 1980)]
    df = spark.createDataFrame(rows, "paper_id int, citation_count int, year int")
    assert sorted(r.paper_id for r in landscape.loosened_floor(df).collect()) == [0, 1, 2, 3, 9]
    assert sorted(r.paper_id for r in landscape.loosened_floor(df, fewest=4).collect()) == [0, 1, 2, 3]


def test_walks_tell_how_papers_were_found(spark):
    edges = spark.createDataFrame([(1, d, d - 1) for d in range(2, 16)] + [(20, 1, 1), (21, 1, 1)], "src int, dst int, ref_pos int")
    depths = spark.createDataFrame([(1, 2)], "paper int, depth int")
    got = {r.paper: tuple(r)[1:] for r in graph.citation_walk(edges, depths, most_refs=12, most_cites=1).collect()}
    assert len(got) == 13 and got[2] == (1, "backward", 3, "INTRO_HINT_CITES", 2.0) and got[13] == (1, "backward", 3, "CITES", 1.0) and got[20] == (1, "forward", 3, "CITES", 1.0)
    assert {r.edge_type for r in graph.citation_walk(edges, depths, most_refs=12, most_cites=0, intro_only=True).collect()} == {"INTRO_HINT_CITES"}
