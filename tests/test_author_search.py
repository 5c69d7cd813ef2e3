"""Authors by any id and by name, titles inside titles, and the graph's capacity, against plain versions."""

import random

import pytest

from athenor.operators import author_search, capacity, containment
from athenor.params import Params

RECORDS = "author_id int, name string, openalex_id string, s2_id string, orcid string, affiliation string, works int"


def plain_aliases(records):
    groups = [({("author_id", str(r[0]))} | {(k, v) for k, v in zip(("openalex_id", "s2_id", "orcid"), r[2:5], strict=True) if v}, r[0]) for r in records]
    out = {}
    for ids, _ in groups:
        reach, grown = set(ids), True
        while grown:
            grown = False
            for other, _ in groups:
                if reach & other and not other <= reach:
                    reach |= other
                    grown = True
        author = min(a for other, a in groups if reach & other)
        out.update({i: author for i in ids})
    return out


def test_ids_lead_to_one_author_over_any_chain(spark):
    rng = random.Random(6)
    some = lambda prefix, n: rng.choice([f"{prefix}{rng.randrange(n)}", None, ""])
    records = [(k, "n", some("A", 30), some("S", 30), some("0000-", 30), None, 0) for k in range(50)]
    records += [(60, "n", "S1", "1", None, None, 0), (60, "n", "A99", None, None, None, 0)]  # ids of one kind that look like those of another; two rows of one record
    known = author_search.aliases(spark.createDataFrame(records, RECORDS))
    assert {(r.kind, r.id): r.author for r in known.collect()} == plain_aliases(records)
    table = plain_aliases(records)
    lists = [(p, [rng.choice(["A", "S", "", "zz"]) + str(rng.randrange(60)) for _ in range(rng.randint(0, 6))] + [None]) for p in range(40)]
    wanted = {}
    for paper, ids in lists:
        for pos, i in enumerate(ids, 1):
            author = next((table[k, i] for k in author_search.KINDS if (k, i) in table), None)
            if author is not None:
                wanted.setdefault((paper, author), pos)
    got = author_search.papers_of(spark.createDataFrame(lists, "paper int, author_ids array<string>"), known)
    assert {(r.paper, r.author): r.pos for r in got.collect()} == wanted


def test_names_resolve_by_name_affiliation_and_works(spark):
    people = [(1, "Ada B. Lovelace", None, None, None, "University of London", 10), (2, "Ada Lovelace", None, None, None, "Turin", 90), (3, "Alan Lovelace", None, None, None, "London School", 500), (4, "Grace Hopper", None, None, None, None, 3), (5, "Ann Lovelace", None, None, None, None, None), (6, "A. Lovelace", None, None, None, "x", 7), (7, "Amy Lovelace", None, None, None, "Paris", 8), (8, "Abe Lovelace", None, None, None, "Paris", 9), (9, "", None, None, None, "nowhere", 1)]
    authors = spark.createDataFrame(people, RECORDS)
    names = [("Ada Lovelace", None), ("ada lovelace", "london"), ("Ada Lovelace", "Oslo"), ("Grace Hopper", "Navy"), ("Nobody Here", "x"), ("Abel Lovelace", "PARIS"), (None, "x"), ("", None)]
    got = {(r.name, r.affiliation): r.author_id for r in author_search.resolve(spark.createDataFrame(names, "name string, affiliation string"), authors).collect()}
    assert got == {("Ada Lovelace", None): 2, ("ada lovelace", "london"): 1, ("Ada Lovelace", "Oslo"): 2, ("Grace Hopper", "Navy"): 4, ("Nobody Here", "x"): None, ("Abel Lovelace", "PARIS"): 8, (None, "x"): None, ("", None): None}
    five = author_search.candidates(spark.createDataFrame([("Ada Lovelace",)], "name string"), authors).orderBy("rank").collect()
    assert [r.author_id for r in five] == [2, 1, 3, 8, 7]


def test_titles_are_found_inside_longer_ones(spark):
    rng = random.Random(1)
    words = ["deep", "learning", "of", "protein", "a", "x", "structure", "Große", "straße"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)] + [None, "", "deep", "Q", "deep"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12))).title()) for k in range(80)] + [(900, None), (901, "short"), (902, "q")]
    got = containment.contained(spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame(texts, "id int, text string").repartition(3))
    wanted = {(t.lower(), k) for t in titles if t for k, x in texts if x is not None and t.lower() in x.lower()}
    assert wanted and {tuple(r) for r in got.collect()} == wanted and got.count() == len(wanted)
    none = containment.contained(spark.createDataFrame([("",)], "title string"), spark.createDataFrame(texts, "id int, text string"))
    assert none.collect() == []


def test_records_without_a_doi_are_filled_by_title(spark):
    kind = "doi string, title string, year int, venue string, abstract string, concepts array<struct<name:string,score:double>>"
    own = [(None, "Protein folding", None, None, None, [("own", 1.0)]), ("10.1/a", "Protein folding", None, None, None, None), (None, "unknown", 1, None, None, None), (None, None, 2, None, None, None)]
    found = [("10.1/b", "On protein folding in water", 2001, "V", "abs", [("more", 0.5)], 1, 3), ("10.1/c", "A protein folding", 1990, "W", None, None, 2, 9), ("10.1/d", "A protein folding", 1991, "W", None, None, 3, 9)]
    got = containment.enrich_by_title(spark.createDataFrame(own, kind), spark.createDataFrame(found, f"{kind}, id int, citation_count int")).collect()
    assert sorted((r.doi or "", r.title or "", r.year or 0) for r in got) == [("", "", 2), ("", "unknown", 1), ("10.1/a", "Protein folding", 0), ("10.1/c", "Protein folding", 1990)]


def plain_capacity(nodes, edges, p):
    safe = {n[0] for n in nodes if n[3] or n[4] or n[5]}
    left = {n[0]: 0.7 * n[1] - 0.3 * n[2] for n in nodes}
    pairs = {}
    for s, d, w, pin in edges:
        if s != d:
            old = pairs.get((s, d), (0, False))
            pairs[s, d] = (max(old[0], w), old[1] or pin)
    while True:
        kept = sorted(left, key=lambda n: (n not in safe, -left[n], n))[: p.graph_nodes]
        inside = [(s, d) for s, d in pairs if s in kept and d in kept]
        held = lambda e: pairs[e][1] or (e[0] in safe and e[1] in safe)
        strong = sorted(inside, key=lambda e: (not held(e), -pairs[e][0], e))[: p.graph_edges]
        lost = {x for e in inside for x in e} - {x for e in strong for x in e} - safe
        if not lost:
            return set(kept), set(strong)
        left = {n: w for n, w in left.items() if n not in lost}


def test_capacity_is_a_fixed_point_that_loses_nothing_protected(spark):
    rng, p = random.Random(4), Params(graph_nodes=30, graph_edges=35)
    nodes = [(n, round(rng.random(), 3), rng.randrange(3) / 4, n < 3, n == 7, n in (11, 12)) for n in range(90)]
    edges = [(rng.randrange(90), rng.randrange(90), rng.randrange(9), rng.random() < 0.02) for _ in range(900)]
    schema = ("node int, score double, age_hours double, is_seed boolean, is_pinned boolean, is_portal boolean", "src int, dst int, weight int, is_pinned boolean")
    frames = spark.createDataFrame(nodes, schema[0]).repartition(3), spark.createDataFrame(edges, schema[1])
    kept, strong = capacity.within_capacity(*frames, p)
    wanted = plain_capacity(nodes, edges, p)
    assert ({r.node for r in kept.collect()}, {(r.src, r.dst) for r in strong.collect()}) == wanted
    assert len(wanted[0]) <= 30 and len(wanted[1]) <= 35 and {0, 1, 2, 7, 11, 12} <= wanted[0]
    with pytest.raises(ValueError, match="protected nodes"):
        capacity.within_capacity(*frames, Params(graph_nodes=5, graph_edges=35))


def test_titles_are_looked_up_without_moving_the_pieces_of_texts(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(12)
    words = ["Größe", "a", "of", "deep", "learning", "𝔘nit", "graph", "networks", "aaaaaaaaaaaa", "İstanbul"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40))) if i % 9 else None) for i in range(120)]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)] + ["", None, "x", "not there at all"]
    frames = spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame(texts, "id int, text string").repartition(5)
    low = dict(spark.createDataFrame([(t, ) for t in {*titles, *(x for _, x in texts)} if t], "t string").selectExpr("t", "lower(t)").collect())
    want = sorted({(low[t], i) for t in titles if t for i, x in texts if x and low[t] in low[x]})
    found = containment.contained(*frames)
    assert sorted(map(tuple, found.collect())) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(containment, "ASKED", 0)  # the shuffled way gives the same
    assert sorted(map(tuple, containment.contained(*frames).collect())) == want

    monkeypatch.setattr(containment, "CHARACTERS", 11)  # texts cut anywhere lose no window
    known = np.unique([containment._hashes(containment._codes(p), len(p))[0] for p in ("deep", "learning", "a")])
    marks = np.zeros(1 << containment.BITS, bool)
    marks[known >> np.uint64(64 - containment.BITS)] = True
    lines = [low[x] for _, x in texts if x]
    got = {(i, known[p]) for at, piece in containment._places(lines, [1, 4, 8], known, marks) for i, p in zip(at.tolist(), piece.tolist(), strict=True)}
    assert got == {(i, containment._hashes(containment._codes(p), len(p))[0]) for i, x in enumerate(lines) for p in ("deep", "learning", "a") if p in x}


def test_what_is_protected_stays_beyond_the_capacity_if_not_strict(spark):
    rng = random.Random(7)
    nodes = [(n, round(rng.random(), 3), rng.randrange(3) / 4, n % 3 == 0, n == 7, n == 11) for n in range(60)]
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(9), rng.random() < 0.02) for _ in range(700)]
    frames = spark.createDataFrame(nodes, "node int, score double, age_hours double, is_seed boolean, is_pinned boolean, is_portal boolean").repartition(3), spark.createDataFrame(edges, "src int, dst int, weight int, is_pinned boolean")
    safe = {n for n, _, _, *flags in nodes if any(flags)}
    kept, strong = capacity.within_capacity(*frames, Params(graph_nodes=5, graph_edges=3), strict=False)
    assert {r.node for r in kept.collect()} == safe
    assert {(r.src, r.dst) for r in strong.collect()} == {(s, d) for s, d, *_ in edges if s != d and s in safe and d in safe}
    for p in (Params(graph_nodes=40, graph_edges=3), Params(graph_nodes=5, graph_edges=10_000)):
        kept, strong = capacity.within_capacity(*frames, p, strict=False)
        held = [e for e in strong.collect() if e.is_protected]
        wide = Params(graph_nodes=max(p.graph_nodes, len(safe)), graph_edges=max(p.graph_edges, len(held)))
        assert ({r.node for r in kept.collect()}, {(r.src, r.dst) for r in strong.collect()}) == plain_capacity(nodes, edges, wide)
