"""Whole documents read back by the standard library's readers."""

import json
import xml.etree.ElementTree as ET

from athenor.sinks import documents

PAPERS = "paper_id int, doi string, title string, year int, venue string, authors array<string>, author_ids array<string>, citation_count int, is_review boolean, is_methodology boolean, relevance_score double, bridge_score double, is_seed boolean, is_pinned boolean, cluster int, concepts array<struct<name:string,score:double>>"
EDGES = "src int, dst int, kind string, weight double"
AUTHORS = "author_id int, name string, orcid string, openalex_id string, s2_id string, affiliations array<string>, topic_fit double, centrality double"
DRIFTS = "author_id int, year_from int, year_to int, drift double, is_jump boolean, entering array<string>, exiting array<string>"


def whole(rows):
    return "".join(r.value for r in rows.orderBy("section", "place").collect())


def tables(spark):
    papers = [(k, None, f'A "title" & <b>{k}</b>', 2000 + k if k else None, "v", list("abcdefg"), ["A1", "S2"] if k % 2 else ["A1"], k, False, None, k / 7, 0.0, k == 3, False, k % 2 or None, [(f"c{i}", 1.0) for i in range(7)]) for k in range(12)]
    edges = [(k, k + 1, "cites", 1.0) for k in range(11)]
    authors = [(1, "One", None, "A1", "S2", ["x", "y", "z", "w"], 0.5, 0.25), (2, "Two", "0000", "A9", None, None, None, None)]
    drifts = [(1, 2001, 2003, 0.7, True, list("abcdef"), []), (1, 1999, 2001, 0.3, False, None, None)]
    return [spark.createDataFrame(r, s).repartition(3) for r, s in ((papers, PAPERS), (edges, EDGES), ([(1, "odd", list("abcdefg")), (5, "empty", None)], "cluster int, name string, top_concepts array<string>"), (authors, AUTHORS), (drifts, DRIFTS))]


def test_json_document(spark):
    found = tables(spark)
    gaps = {"bridges": spark.createDataFrame([(1, 7, 0.5)], "place int, paper_id int, score double"), "unexplored": spark.createDataFrame([], "place int, name string")}
    got = json.loads(whole(documents.graph_json(*found, gaps, "two \"gaps\"")))
    assert list(got) == ["meta", "nodes", "edges", "clusters", "authors", "trajectories", "bridges", "unexplored"]
    assert got["meta"] == {"node_count": 12, "seed_count": 1, "edge_count": 11, "author_count": 2, "gap_summary": 'two "gaps"'}
    nodes = {n["id"]: n for n in got["nodes"]}
    assert len(nodes) == 12 and nodes[3]["is_seed"] and nodes[3]["title"] == 'A "title" & <b>3</b>' and nodes[3]["authors"] == list("abcde") and nodes[3]["concepts"] == [f"c{i}" for i in range(5)] and "cluster" not in nodes[2]
    assert sorted((e["source"], e["target"]) for e in got["edges"]) == [(k, k + 1) for k in range(11)]
    assert {c["id"]: (c["size"], c["top_concepts"]) for c in got["clusters"]} == {1: (6, list("abcde")), 5: (0, [])}
    authors = {a["id"]: a for a in got["authors"]}
    assert authors[1]["paper_count"] == 12 and authors[1]["affiliations"] == ["x", "y", "z"] and authors[1]["drift_event_count"] == 2 and authors[2]["paper_count"] == 0 and not authors[2]["trajectory_computed"]
    (path,) = got["trajectories"]
    assert [e["year_from"] for e in path["drift_events"]] == [1999, 2001] and path["drift_events"][1]["entering_concepts"] == list("abcde")
    assert got["bridges"] == [{"paper_id": 7, "score": 0.5}] and got["unexplored"] == []


def test_graphml_document(spark):
    papers, edges, *_ = tables(spark)
    root = ET.fromstring(whole(documents.graphml_document(papers, edges)))
    space = {"g": "http://graphml.graphdrawing.org/xmlns"}
    assert len(root.findall("g:key", space)) == 9
    nodes = {n.get("id"): {d.get("key"): d.text for d in n} for n in root.findall("g:graph/g:node", space)}
    assert len(nodes) == 12 and nodes["3"] == {"title": 'A "title" & <b>3</b>', "year": "2003", "citations": "3", "type": "paper", "relevance": "0.429", "is_seed": "true", "cluster": "1"}
    assert set(nodes["0"]) == {"title", "type", "relevance", "is_seed"}
    links = [(e.get("source"), e.get("target"), {d.get("key"): d.text for d in e}) for e in root.findall("g:graph/g:edge", space)]
    assert len(links) == 11 and links[0][2] == {"edge_type": "cites", "weight": "1.0"}
    assert documents.csv_edges(edges).columns == ["source", "target", "type", "weight"]
