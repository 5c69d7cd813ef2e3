"""Schemas of the scholarly tables."""

from __future__ import annotations

PAPER = (
    "paper_id string, doi string, openalex_id string, s2_id string, pmid string, title string, year int, venue string, "
    "authors array<string>, author_ids array<string>, abstract string, concepts array<struct<name:string,score:double>>, "
    "citation_count bigint, reference_count bigint, is_review boolean, is_oa boolean, is_methodology boolean, status string, "
    "depth int, discovered_from string, discovered_channel string, discovered_at timestamp, relevance_score double, "
    "bridge_score double, priority_score double, materialization_score double"
)
AUTHOR = (
    "author_id string, orcid string, openalex_id string, s2_id string, name string, affiliations array<string>, paper_count bigint, "
    "citation_count bigint, h_index int, centrality double, topic_fit double, drift_magnitude_avg double, novelty_jumps int, "
    "clusters_bridged int, role string, role_confidence double, is_seed boolean"
)
EDGE = "src string, dst string, edge_type string, weight double, confidence double, ref_pos int"
MEMBERSHIP = "cluster_id string, node_id string"
PROFILE = "author_id string, year int, concept string, weight double"
TRAJECTORY_EVENT = "author_id string, year_from int, year_to int, drift double, is_jump boolean, entering array<string>, exiting array<string>"

EDGE_TYPES = ("CITES", "CITED_BY", "INTRO_CITES", "INTRO_HINT_CITES", "COAUTHOR", "AUTHOR_OF", "TRAJECTORY_STEP", "AUTHOR_BRIDGE", "SIMILAR")
