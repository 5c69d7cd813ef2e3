"""Every threshold of the operators, as one frozen object; years are explicit so that results do not change with the clock."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    as_of_year: int = 2002
    # profiles and drift
    works_per_year: int = 20
    concepts_per_paper: int = 5
    concepts_per_profile: int = 10
    min_span: int = 3
    max_gap: int = 2
    drift_event: float = 0.2
    drift_jump: float = 0.55
    concept_change: float = 0.1
    garden_gap: int = 3
    garden_papers: int = 5
    window_years: int = 3
    window_drift: float = 0.4
    window_jump: float = 0.6
    direction_years: int = 5
    direction_ratio: float = 1.5
    # clusters and gaps
    cluster_size: int = 5
    pool_cluster_size: int = 10
    max_clusters: int = 20
    bridge_score: float = 0.3
    pair_papers: int = 5
    pair_ratio: float = 0.1
    # graph relevance
    proximity_alpha: float = 0.9
    proximity_weight: float = 0.45
    multipath_weight: float = 0.20
    coupling_weight: float = 0.15
    portal_weight: float = 0.10
    keyword_weight: float = 0.10
    max_paths: int = 6
    # hubs
    hub_citations: int = 5_000
    mega_citations: int = 50_000
    hub_relevance: float = 0.30
    # references
    intro_share: float = 0.25
    intro_most: int = 20
    # expansion
    max_depth: int = 3
    min_bucket_relevance: float = 0.15
    drift_window: int = 30
    drift_kill: float = 0.10
    graph_nodes: int = 2_000
    graph_edges: int = 8_000


DEFAULT = Params()

#: Concept names too general to count.
GENERIC_CONCEPTS = ("biology", "chemistry", "computer science", "economics", "engineering", "materials science", "mathematics", "medicine", "physics", "psychology")

#: Words left out of titles and terms.
STOP_WORDS = ("a", "an", "and", "by", "for", "from", "in", "of", "on", "the", "to", "with")
