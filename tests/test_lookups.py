"""Retrieval, guards, classes, checks, directories and monitors on small hand-made tables."""

import json

from athenor.iterative import betweenness, traversal
from athenor.operators import authors, checks, insights, lookups, selection, topics, trajectory
from athenor.sinks import exports
from athenor.sources import providers, text_files
from athenor.streaming import garden


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_author_lookup_and_pages(spark):
    people = spark.createDataFrame([(1, "https://orcid.org/0000-1", None, "s"), (2, None, "A2", None), (3, "0000-3", "A3", "")], "author_id int, orcid string, openalex_id string, s2_id string")
    assert [r.author_id for r in lookups.author_by(people, orcid="0000-1").collect()] == [1]
    assert [r.author_id for r in lookups.author_by(people, openalex_id="A3", orcid="0000-9").collect()] == [3]
    assert lookups.author_by(people).count() == 0
    papers = spark.createDataFrame([(i, 1990 + i, "v") for i in range(8)] + [(8, None, None)], "paper_id int, year int, venue string")
    by = spark.createDataFrame([(i, 7) for i in range(9)] + [(3, 7)], "paper_id int, coauthor_id int")
    assert [r.paper_id for r in lookups.author_works(papers, by, 7, None, None, 3, 4).collect()] == [4, 3, 2]
    assert lookups.count_estimate(papers, papers.year > 1995) == 2
    listed = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, None)], "paper_id int, names array<string>")
    assert [tuple(r) for r in lookups.top_values(listed, "names").collect()] == [("b", 2), ("a", 1)]


def test_guards_and_records(spark):
    df = spark.createDataFrame([(1, "a", "[]", []), (2, None, None, None), (3, " ", '["x"]', ["x"])], "id int, s string, j string, a array<string>")
    got = rows(df.select("id", lookups.is_filled(df.s), lookups.is_filled(df.j, "json"), lookups.is_filled(df.a, "array"), lookups.any_filled(df.s, df.j)))
    assert got == [(1, True, False, False, True), (2, False, False, False, False), (3, False, True, True, True)]
    assert rows(lookups.with_status(df, "a", column="s").select("id")) == [(1,)] and rows(lookups.with_status(df, "a", column="s", exclude=True).select("id")) == [(2,), (3,)]
    schema = "paper_id string, doi string, title string, year int, venue string, authors array<string>, concepts array<struct<name:string,score:double>>, citation_count bigint, is_review boolean, status string, relevance_score double"
    p = spark.createDataFrame([("1", "https://doi.org/10.1/A", "T", 2000, "V", list("abcdefg"), [("c", 0.5)], None, False, "seed", 0.1)], schema)
    assert tuple(lookups.paper_record(p).first())[:2] == ("1", "10.1/a") and lookups.paper_record(p).first().authors == list("abcde")
    e = spark.createDataFrame([("1", "2", "CITES", 1.0, None), ("2", "3", "COAUTHOR", 1.0, 0.5)], "src string, dst string, edge_type string, weight double, confidence double")
    assert lookups.edge_record(e).columns == ["source", "target", "type", "weight", "confidence"]
    nodes = spark.createDataFrame([("1",), ("2",)], "node string")
    assert lookups.induced(e, nodes).count() == 1 == lookups.induced(e, nodes, "CITES").count() and lookups.induced(e, nodes, "COAUTHOR").count() == 0
    assert rows(lookups.neighbourhood(e, nodes)) == [("1",), ("2",), ("3",)]
    people = spark.createDataFrame([("a", "N", None, None, 3, 4, 1, "leader", 0.9, 0.1), ("b", "M", None, ["x"] * 5, 1, 1, 1, "leader", 0.9, None)], "author_id string, name string, orcid string, affiliations array<string>, paper_count bigint, citation_count bigint, h_index int, role string, role_confidence double, centrality double")
    assert [r.author_id for r in lookups.authors_by_role(people, "leader").collect()] == ["a", "b"] and lookups.author_record(people).count() == 2


def test_pool_is_pruned_only_when_full(spark):
    p = spark.createDataFrame([(i, i, i == 0) for i in range(10)], "paper_id int, score int, is_seed boolean")
    assert lookups.prune_when_full(p, "score", 13).count() == 10
    assert sorted(r.paper_id for r in lookups.prune_when_full(p, "score", 10).collect()) == [0, 5, 6, 7, 8, 9]


def test_classes_and_texts(spark):
    df = spark.createDataFrame(
        [("A web server for x", False, 1990, 5_000, "Proc. of Y"), ("Old paper", False, 1990, 1_001, "bioRxiv"), ("On reviews", True, 1990, 9, "J. X"), (None, None, None, None, None)],
        "title string, is_review boolean, year int, n int, venue string",
    )
    assert [tuple(r) for r in df.select(insights.hub_kind(df.title, df.is_review, df.year, df.n), insights.work_type(df.venue), insights.work_type(df.venue, df.is_review)).collect()] == [
        ("methodology", "conference", "conference"), ("foundational", "preprint", "preprint"), ("review", "journal", "review"), ("high_citation", "unknown", "unknown"),
    ]
    t = spark.createDataFrame([("deep learning on x", 0.05, True), ("other", 0.05, True), ("Deep Learning", 0.9, False)], "title string, score double, is_review boolean")
    assert [round(r[0], 6) for r in t.select(insights.phrase_and_review_bonus(t.score, t.title, "deep learning", t.is_review)).collect()] == [0.45, 0.05, 1.0]
    gates = spark.createDataFrame([(None, 0.2, 600), (None, 0.1, 600), ("CITES", 0.0, 0), (None, 0.2, 10)], "gate string, r double, n int")
    assert [r[0] for r in gates.select(insights.bridge_allowance(gates.gate, gates.r, gates.n)).collect()] == ["CITES", None, "CITES", None]
    pairs = spark.createDataFrame([(1, 5, None, 2000, 10, "a"), (1, 6, "10.1/x", None, 0, None), (2, 7, None, None, None, None)], "left_id int, right_id int, doi string, year int, citation_count int, abstract string")
    assert rows(insights.best_title_match(pairs)) == [(1, 6, 3.0), (2, 7, 0.0)]
    row = spark.range(1).select(insights.gap_text(*(insights.F.lit(x) for x in ("a", "b", 1, 2, 3))), insights.trajectory_text(*(insights.F.lit(x) for x in ("focused", 4, 1, 2))), insights.collaborator_text(*(insights.F.lit(x) for x in (3, 1999, 2001)))).first()
    assert tuple(row) == ("a (3 papers) and b (4 papers) meet in 1", "focused career of 4 years, 1 jumps, 2 phases", "active: 3 papers, 1999-2001")


def test_same_author_by_name_where_no_id_contradicts(spark):
    people = spark.createDataFrame(
        [(1, "Ann B. Lee", "o1", None, None), (2, "Ann Lee", None, "A", None), (3, "Ann Lee", "o3", None, None), (4, "Cher", None, None, None), (5, "Cher", None, None, None), (6, "X Y", "o1", None, None)],
        "author_id int, name string, orcid string, openalex_id string, s2_id string",
    )
    assert rows(authors.same_author(people)) == [(2, 1), (6, 1)]


def test_corpus_of_an_author(spark):
    papers = spark.createDataFrame([(1, 9, 2000, "b", 5), (2, 9, 2001, "b", 1), (3, 9, 2002, "a", 0), (4, 8, 2002, None, 0)], "paper_id int, author_id int, year int, venue string, citation_count int")
    concepts = spark.createDataFrame([(1, "x", 0.5, 1), (2, "y", 0.9, 1), (3, "x", 0.6, 6)], "paper_id int, name string, score double, pos int")
    by = spark.createDataFrame([(1, 9), (1, 7), (2, 7)], "paper_id int, coauthor_id int")
    got = {r.author_id: r for r in authors.corpus_stats(papers, concepts, by).collect()}
    assert (got[9].venues, got[9].concepts, got[9].coauthors, got[9].papers) == (["b", "a"], ["y", "x"], [7, 9], 3) and got[8].venues is None
    detail = {r.coauthor_id: r for r in authors.collaborator_detail(papers, by, concepts).collect()}
    assert detail[7].concepts == ["y", "x"] and detail[7].venues == ["b"] and not detail[7].is_lasting and detail[7].is_active


def test_topics_from_three_sources(spark):
    texts = spark.createDataFrame([(1, "neural nets", "the nets learn")], "id int, title string, abstract string")
    concepts = spark.createDataFrame([(1, "Learning", 0.9)], "paper_id int, name string, score double")
    got = rows(topics.topic_sources(concepts, texts))
    assert (1, "learning", 0.9) in got and (1, "neural nets", 0.5) in got and (1, "nets", 0.3) in got and (1, "nets", 0.5) in got


def test_author_gaps_by_brute_force(spark):
    import random

    rng = random.Random(4)
    own = {a: set(rng.choices("abcdefghijkl", k=rng.randint(1, 8))) for a in range(40)}
    met = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.3}
    table = spark.createDataFrame([(a, c) for a, s in own.items() for c in s], "author int, concept string")
    got = rows(topics.author_gaps(table, spark.createDataFrame(sorted(met), "a int, b int"), top=10_000))
    want = sorted(((a, b, len(own[a] & own[b]), len(own[a] & own[b]) / max(len(own[a]), len(own[b]))) for a in own for b in own if a < b and (a, b) not in met), key=str)
    assert got == [w for w in want if w[2] >= 2 and w[3] > 0.3]


def test_shared_concepts_by_brute_force(spark):
    import random

    rng = random.Random(6)
    own = {p: set(rng.choices("abcdefgh", k=rng.randint(1, 6))) for p in range(60)}
    table = spark.createDataFrame([(p, c) for p, s in own.items() for c in s], "paper_id int, name string")
    got = rows(selection._sharing(table, spark.createDataFrame([(p,) for p in range(0, 60, 7)], "paper_id int"), 3))
    assert got == sorted(((s, p) for s in range(0, 60, 7) for p in own if p != s and len(own[s] & own[p]) >= 3), key=str)


def test_betweenness_by_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    edges = {(a, b) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.35} | {(20, 21), (21, 22)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def shortest(s, t):
        paths = [[s]]
        while paths:
            done = [p for p in paths if p[-1] == t]
            if done:
                return done
            paths = [[*p, w] for p in paths for w in near[p[-1]] if w not in p]
        return []

    want = dict.fromkeys(near, 0.0)
    for s, t in itertools.combinations(sorted(near), 2):
        ways = shortest(s, t)
        for p in ways:
            for v in p[1:-1]:
                want[v] += 1 / len(ways)
    df = spark.createDataFrame([*edges, (3, 3)], "src int, dst int")
    got = {r.node: r.betweenness for r in betweenness.betweenness(df, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - x) < 1e-9 for v, x in want.items())
    assert betweenness.betweenness(df.limit(0)).count() == 0


def test_rank_value_by_brute_force(spark):
    values = [((i * 37) % 101) / 4 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for share in (0.0, 0.31, 0.9, 0.999):
        assert trajectory.at_rank(df, "x", share).first()[0] == sorted(values)[int(len(values) * share)]


def expand_by_hand(edges, relevance, seeds, generations, per_paper, least):
    claimed, frontier = {s: (0, None) for s in seeds if s in relevance}, list(seeds)
    for g in range(1, generations + 1):
        found = {}
        for parent in frontier:
            for pos, dst in sorted((pos, dst) for src, dst, pos in edges if src == parent and pos <= per_paper):
                if dst not in claimed and dst in relevance:
                    found[dst] = min(found.get(dst, (parent, pos)), (parent, pos))
        claimed |= {d: (g, parent) for d, (parent, _) in found.items()}
        buckets = {}
        for d, (parent, _) in found.items():
            buckets.setdefault(parent, []).append(relevance[d])
        alive = {parent for parent, r in buckets.items() if sum(r) / len(r) >= least}
        frontier = [d for d, (parent, _) in found.items() if parent in alive]
    return sorted((p, g, parent) for p, (g, parent) in claimed.items())


def test_bucket_generations_by_brute_force(spark):
    import random

    rng = random.Random(9)
    edges = [(src, dst, pos) for src in range(60) for pos, dst in enumerate(rng.sample(range(60), rng.randint(0, 5)), 1)]
    relevance = {p: rng.random() * 0.4 for p in range(60)}
    got = traversal.bucket_generations(spark.createDataFrame(edges, "src int, dst int, ref_pos int"), spark.createDataFrame(list(relevance.items()), "paper int, relevance double"), spark.createDataFrame([(1,), (2,)], "paper int"), 4, 3)
    assert sorted((r.paper, r.generation, r.parent) for r in got.collect()) == expand_by_hand(edges, relevance, [1, 2], 4, 3, 0.15)


def test_checks_of_the_stages(spark):
    def failed(df):
        return sorted((r.key, r.name) for r in df.where("not passed").collect())

    seeds = spark.createDataFrame([("1", "A long enough title", "10.1/A", "10.1/a", 2000, ["x"]), (None, "", None, "10.1/b", 1700, [])], "paper_id string, title string, doi string, sought_doi string, year int, authors array<string>")
    assert [n for _, n in failed(checks.seed_checks(seeds).na.fill("?", ["key"]))] == ["doi_matches", "has_authors", "has_required_fields", "result_exists", "title_length", "year_plausible"]
    people = spark.createDataFrame([(1, "A", 5, 0.9, None), (2, "", 0, 0.4, 0.6)], "author_id int, openalex_id string, paper_count int, similarity double, context_similarity double")
    assert failed(checks.author_checks(people)) == [("2", n) for n in ("context_match", "has_openalex_id", "has_papers", "name_matches", "paper_count_plausible")]
    papers = spark.createDataFrame([(1, 1990), (1, 2000), (2, 1990)], "author_id int, year int")
    phases = spark.createDataFrame([(1, 1991, 1996, ["c"]), (1, 1995, 2000, [])], "author_id int, start_year int, end_year int, concepts array<string>")
    assert failed(checks.trajectory_checks(papers, phases)) == [("1", "phases_have_concepts"), ("1", "phases_non_overlapping"), ("2", "has_phases")]
    found = spark.createDataFrame([("core", 50, True, False, True), ("rare", 1, False, True, False)], "name string, papers int, is_core boolean, is_emerging boolean, is_declining boolean")
    assert failed(checks.topic_checks(found, spark.createDataFrame([(2_000,)], "n int"))) == [("corpus", "core_topics_frequent"), ("corpus", "no_core_declining_overlap")]
    gaps = spark.createDataFrame([("a", "b", 0, 9, 9, 0.5), ("a", "z", 5, 5, 9, 1.5)], "a string, b string, both int, a_only int, b_only int, gap double")
    assert failed(checks.gap_checks(gaps, spark.createDataFrame([("a",), ("b",)], "name string"))) == [("a | z", n) for n in ("concepts_exist", "gap_scores_bounded", "gaps_are_actual_gaps")]
    resolved = spark.createDataFrame([("k", "Organic Chemistry", 0.8, ["J"], [], ["palladium"], ["e"], "tiered", "Palladium work", "organic"), ("l", None, 1.2, [], [], [], [], "deep", "x", "y")], "key string, field string, confidence double, tier1 array<string>, tier2 array<string>, key_concepts array<string>, evidence array<string>, strategy string, title string, query string")
    assert {k for k, _ in failed(checks.field_checks(resolved))} == {"l"} and len(failed(checks.field_checks(resolved))) == 9


def test_directories_and_references(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "One", "doi": "10.1/a"}, {"title": "Two", "doi": "10.1/b"}, {"title": "No doi"}]))
    (tmp_path / "b.csv").write_text("title,doi,year\nAgain,10.1/a,2000\nThree,10.1/c,2001\n")
    (tmp_path / "notes.log").write_text("x")
    got = text_files.read_directory(spark, str(tmp_path))
    assert sorted((r.doi or "", r.title) for r in got.collect()) == [("", "No doi"), ("10.1/a", "One"), ("10.1/b", "Two"), ("10.1/c", "Three")]
    assert text_files.read_directory(spark, str(tmp_path), per_file=1).count() <= 2
    (tmp_path / "x.txt").write_text("TY  - JOUR\nTI  - A title of ris\nER  - \n")
    assert text_files.read_bibliography(spark, str(tmp_path / "x.txt")).count() == 1
    text = "doi:10.1234/self and 10.1234/one.\nReferences\n[1] A. B. (2001). A first known title here. doi 10.1234/one\n[2] C. D. (1999). Another title without any identifier. X\n[3] E. F. (1998). A third title that is long. 10.1234/three\n"
    known = spark.createDataFrame([("10.1234/one", "Known one", 2001)], "doi string, title string, year int")
    found = text_files.references_of(spark.createDataFrame([(1, text)], "id int, text string"), known).collect()
    assert {(r.kind, r.doi) for r in found} == {("doi", "10.1234/one"), ("doi", "10.1234/three"), ("entry", None)} and {r.own_doi for r in found} == {"10.1234/self"}
    assert [r.title for r in found if r.doi == "10.1234/one"] == ["Known one"]


def test_author_and_orcid_records(spark):
    raw = json.dumps({"id": "https://x.org/A1", "orcid": "https://orcid.org/0000-1", "display_name": "N", "works_count": 3, "summary_stats": {"h_index": 2}, "last_known_institutions": [{"display_name": "U"}], "x_concepts": [{"display_name": "c", "score": 0.5}]})
    r = providers.parse_author(spark.createDataFrame([(raw,), ("broken",), (None,)], "raw string"), "raw").collect()
    assert len(r) == 1 and (r[0].openalex_id, r[0].orcid, r[0].affiliations, r[0].paper_count, r[0].h_index, r[0].aliases) == ("A1", "0000-1", ["U"], 3, 2, [])
    raw = json.dumps({"orcid-identifier": {"path": "0000-1"}, "educations": [{"organization": "a", "end_year": 1990}, {"organization": "b", "end_year": 1995}]})
    (r,) = providers.parse_orcid_more(spark.createDataFrame([(raw,)], "raw string"), "raw").collect()
    assert [e.organization for e in r.educations] == ["b", "a"] and r.fundings == []


def test_further_providers(spark):
    s2 = json.dumps({"paperId": "p", "title": "A review", "year": 2001, "externalIds": {"DOI": "10.1/X"}, "authors": [{"authorId": "1", "name": "N"}]})
    (r,) = providers.parse_semantic(spark.createDataFrame([(s2,), ("{}",)], "raw string"), "raw").collect()
    assert (r.s2_id, r.doi, r.authors, r.is_review, r.citation_count) == ("p", "10.1/x", ["N"], True, 0)
    cross = json.dumps({"DOI": "10.1/Y", "title": ["T"], "abstract": "<p>text</p>", "published-print": {"date-parts": [[1999, 1]]}, "author": [{"given": "A", "family": "B"}]})
    (r,) = providers.parse_crossref(spark.createDataFrame([(cross,)], "raw string"), "raw").collect()
    assert (r.doi, r.title, r.year, r.abstract, r.authors) == ("10.1/y", "T", 1999, "text", ["A B"])
    xml = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1998 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"
    (r,) = providers.parse_pubmed(spark.createDataFrame([(xml,)], "raw string"), "raw").collect()
    assert (r.pmid, r.title, r.year, r.venue, r.is_review) == ("7", "T", 1998, "J", False)
    own = spark.createDataFrame([("10.1/y", None, None, None, None, [("own", 1.0)]), (None, "t", 1, None, None, None)], "doi string, title string, year int, venue string, abstract string, concepts array<struct<name:string,score:double>>")
    more = spark.createDataFrame([("10.1/y", "T", 1999, "V", None, [("more", 0.5)])], own.schema)
    got = {r.doi: r for r in providers.enrich(own, more).collect()}
    assert got["10.1/y"].title == "T" and [c.name for c in got["10.1/y"].concepts] == ["own", "more"] and got[None].title == "t"


def test_garden_as_lines(spark):
    one = spark.createDataFrame([(1, "x")], "id int, name string")
    got = {r.part: json.loads(r.value) for r in exports.garden_rows(one, one, one, one).collect()}
    assert set(got) == {"paper", "author", "edge", "trajectory"} and got["edge"] == {"id": 1, "name": "x"}


def test_circuit_breaker_and_observed_duplicates(spark, tmp_path):
    from pyspark.sql import Observation

    calls = [("s", t, t == 200) for t in (1, 2, 3, 4, 5, 6, 30, 100, 120, 200)] + [("fine", 1, True)]
    spark.createDataFrame(calls, "service string, t int, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("service string, t int, ok boolean").parquet(str(tmp_path / "in"))
    q = garden.circuit_breaker(stream, "service", "t", "ok").writeStream.outputMode("update").format("memory").queryName("circuits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("select service, state, failures from circuits")) == [("fine", "closed", 0), ("s", "closed", 0)]
    seen = Observation("o")
    df = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    df.observe(seen, insights.F.count("*").alias("rows")).count()
    assert seen.get["rows"] == 3 and garden.counted_duplicates(df, "id").dropDuplicates(["id"]).count() == 2


def test_author_gaps_over_many_blocks_by_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(topics, "TILE", 8)
    monkeypatch.setattr(topics, "COLUMNS", 3)
    rng = random.Random(8)
    own = {f"n{a:03}": set(rng.choices("abcdefghijkl", k=rng.choice((1, 4, 30)))) for a in range(90)}
    met = {(a, b) for a in own for b in own if a < b and rng.random() < 0.3}
    table = spark.createDataFrame([(a, c) for a, s in own.items() for c in s] + [("n000", None), (None, "a")], "author string, concept string")
    sizes = {a: len(s) + (a == "n000") for a, s in own.items()}
    pairs = [(a, b, len(own[a] & own[b]), len(own[a] & own[b]) / max(sizes[a], sizes[b])) for a in own for b in own if a < b and (a, b) not in met]
    want = sorted((w for w in pairs if w[2] >= 2 and w[3] > 0.3), key=lambda w: (-w[3], -w[2], w[0], w[1]))
    for top in (5, 60, 10_000):
        assert [tuple(r) for r in topics.author_gaps(table, spark.createDataFrame(sorted(met), "a string, b string"), top=top).collect()] == want[:top]


def test_author_gaps_make_no_row_of_a_pair(spark):
    def most(plan):
        kind = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(most, inner)])

    own = spark.range(700).crossJoin(spark.range(30).toDF("c")).toDF("author", "concept")
    found = topics.author_gaps(own, spark.createDataFrame([(0, 1)], "a long, b long"), top=3)
    query = found._jdf.queryExecution()
    rows = query.executedPlan().executeCollectPublic()
    assert len(rows) == 3 and [tuple(r) for r in found.collect()] == [(0, 2, 30, 1.0), (0, 3, 30, 1.0), (0, 4, 30, 1.0)]
    assert most(query.executedPlan()) < 30_000  # of 244,650 pairs that share 30 concepts each


def test_first_pairs_of_blocks_tile_by_tile(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(topics, "TILE", 7)
    monkeypatch.setattr(topics, "COLUMNS", 3)
    rng = random.Random(9)
    own = {a: sorted(rng.sample(range(12), rng.choice((2, 5, 12)))) for a in range(50)}
    met = np.array([(a, b) for a in own for b in own if a < b and rng.random() < 0.2])
    block = lambda some: (np.array(some), np.array([len(own[a]) for a in some]), np.array([len(own[a]) for a in some]), np.array([c for a in some for c in own[a]], np.int32))
    for left, right in ((range(50), range(50)), (range(23), range(23, 50))):
        inside = {(a, b) for a in left for b in right if a < b}
        pairs = [(a, b, len({*own[a]} & {*own[b]}), len({*own[a]} & {*own[b]}) / max(len(own[a]), len(own[b]))) for a, b in inside - set(map(tuple, met.tolist()))]
        want = sorted((w for w in pairs if w[2] >= 2 and w[3] > 0.3), key=lambda w: (-w[3], -w[2], w[0], w[1]))
        some = np.array([m for m in met.tolist() if tuple(m) in inside])
        for top in (1, 4, 30, 5_000):
            assert list(map(tuple, topics._first_pairs(block(list(left)), block(list(right)), some, 2, 0.3, top).tolist())) == want[:top]


def test_shared_concepts_of_long_and_short_sets_by_brute_force(spark):
    import random

    rng = random.Random(16)
    own = {p: set(rng.sample(range(60), rng.choice((3, 5, 6, 9, 20, 45)))) for p in range(150)}
    table = spark.createDataFrame([(p, f"c{c}") for p, s in own.items() for c in s] + [(0, None), (7, None)], "paper_id int, name string").repartition(3)
    seeds = spark.createDataFrame([(p,) for p in range(0, 150, 7)], "paper_id int")
    for least in (1, 2, 4, 5):
        assert sorted(rows(selection._sharing(table, seeds, least))) == [(s, p) for s in range(0, 150, 7) for p in own if p != s and len(own[s] & own[p]) >= least]


def test_common_concepts_alone_bring_no_papers_together(spark):
    own = spark.range(3_000).selectExpr("id as paper_id", "explode(transform(sequence(0, 5), k -> pmod(xxhash64(id, k), 30))) as name")
    found = selection._sharing(own, spark.range(0, 3_000, 10).toDF("paper_id"), 5)
    query = found._jdf.queryExecution()
    query.executedPlan().executeCollectPublic()

    def most(plan):
        kind = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        made = plan.metrics().get("numOutputRows")
        return max([made.get().value() if made.isDefined() else 0, *map(most, inner)])

    assert most(query.executedPlan()) < 60_000  # of 900,000 pairs of a seed and a paper
