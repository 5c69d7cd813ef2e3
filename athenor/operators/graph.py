"""Local graph measures over edge tables ``(src, dst)``: coupling, support, bridges, reference positions and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.exprs import hub_limits, hub_penalty, hub_type, intro_count, intro_count_plain, multipath, proximity, recency_impact
from athenor.functions.storage import bounded
from athenor.params import DEFAULT, Params


def _overlap_with_seeds(edges: DataFrame, own: str, other: str, seeds: DataFrame, name: str) -> DataFrame:
    """Jaccard of each node's neighbour set and the union of the seeds' sets, for every node with neighbours.

    The seeds' union is one side of a join, and no node's set is gathered: counts suffice.
    """
    pairs = edges.select(F.col(own).alias("node"), F.col(other).alias("near")).distinct()
    union = pairs.join(seeds.select(F.col("node")), "node", "left_semi").select("near").distinct()
    total = union.agg(F.count("*").alias("_all"))
    marked = pairs.join(union.withColumn("_in", F.lit(1)), "near", "left")
    counts = marked.groupBy("node").agg(F.count("*").alias("_own"), F.count("_in").alias("_both"))
    score = F.col("_both") / (F.col("_own") + F.col("_all") - F.col("_both"))
    return counts.crossJoin(F.broadcast(total)).select("node", F.when(F.col("_all") > 0, score).otherwise(0.0).alias(name))  # total is one row


def coupling(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Shared references with the seeds."""
    return _overlap_with_seeds(edges, "src", "dst", seeds, "coupling")


def cocitation(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Shared citing papers with the seeds."""
    return _overlap_with_seeds(edges, "dst", "src", seeds, "cocitation")


def portal_support(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """1 for a review; else citing reviews count 1 and cited reviews a half, over three, 1 at most. nodes(node, is_review)."""
    reviews = nodes.where("is_review").select(F.col("node").alias("review"))
    by = edges.join(reviews, edges.src == F.col("review")).select(F.col("dst").alias("node"), F.lit(1.0).alias("w"))
    of = edges.join(reviews, edges.dst == F.col("review")).select(F.col("src").alias("node"), F.lit(0.5).alias("w"))
    support = by.unionAll(of).groupBy("node").agg(F.sum("w").alias("w"))
    return nodes.join(support, "node", "left").select("node", F.when(F.col("is_review"), 1.0).otherwise(F.least(F.coalesce("w", F.lit(0.0)) / 3, F.lit(1.0))).alias("portal"))


def cluster_links(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(a, b, links) for all pairs a < b of clusters, also those without a link; there are few clusters."""
    a = edges.join(membership.select(F.col("node").alias("src"), F.col("cluster").alias("ca")), "src")
    both = a.join(membership.select(F.col("node").alias("dst"), F.col("cluster").alias("cb")), "dst").where("ca <> cb")
    counts = both.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("links"))
    names = bounded(membership.select("cluster").distinct(), 5_000, "clusters")
    grid = names.select(F.col("cluster").alias("a")).join(names.select(F.col("cluster").alias("b")), F.col("a") < F.col("b"))
    return grid.join(counts, ["a", "b"], "left").fillna(0, ["links"])


def _neighbour_clusters(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, cluster, n): neighbours of each node by cluster, either direction."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()
    return both.join(membership.withColumnRenamed("node", "near"), "near").groupBy("node", "cluster").agg(F.count("*").alias("n"))


def near_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, paths): how many seeds are a node's neighbours, in either direction."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()
    return both.join(seeds.select(F.col("node").alias("near")).distinct(), "near", "left_semi").groupBy("node").agg(F.count("*").alias("paths"))


def bridge_diversity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """1 - largest share of one cluster among a node's neighbours, for nodes that touch two clusters or more."""
    counts = _neighbour_clusters(edges, membership).groupBy("node").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("clusters"))
    return counts.where("clusters >= 2").select("node", "clusters", (1 - F.col("most") / F.col("total")).alias("diversity"))


def bridge_papers(edges: DataFrame, membership: DataFrame, top: int = 10, p: Params = DEFAULT) -> DataFrame:
    """Nodes whose two largest neighbour clusters balance: (c2 / c1) (c1 + c2) / total of at least the threshold."""
    counts = _neighbour_clusters(edges, membership)
    rank = Window.partitionBy("node").orderBy(F.desc("n"), "cluster")
    ranked = counts.withColumn("r", F.row_number().over(rank)).groupBy("node").agg(
        F.sum("n").alias("total"),
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"),
        F.max(F.when(F.col("r") == 2, F.col("n"))).alias("n2"),
        F.max(F.when(F.col("r") == 1, F.col("cluster"))).alias("cluster_a"),
        F.max(F.when(F.col("r") == 2, F.col("cluster"))).alias("cluster_b"),
    )
    score = F.col("n2") / F.col("n1") * (F.col("n1") + F.col("n2")) / F.col("total")
    scored = ranked.where("n2 is not null").withColumn("bridge_score", score).where(F.col("bridge_score") >= p.bridge_score)
    return scored.orderBy(F.desc("bridge_score"), "node").limit(top).select("node", "cluster_a", "cluster_b", "bridge_score")


def relevance(nodes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """nodes(distance, paths, coupling, cocitation, portal, keyword, hub): adds the parts and the weighted score, 1 at most."""
    near = proximity("distance")
    many = multipath(F.coalesce("paths", F.lit(0)))
    pair = F.greatest(F.coalesce("coupling", F.lit(0.0)), F.coalesce("cocitation", F.lit(0.0)))
    total = p.proximity_weight * near + p.multipath_weight * many + p.coupling_weight * pair + p.portal_weight * F.coalesce("portal", F.lit(0.0)) + p.keyword_weight * F.coalesce("keyword", F.lit(0.0))
    return nodes.withColumns({"proximity": near, "multipath": many, "relevance": F.least(total * hub_penalty("hub"), F.lit(1.0))})


def materialization(nodes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Score by which a candidate enters the working graph: relevance parts with bridge potential and recency."""
    pair = F.greatest(F.coalesce("coupling", F.lit(0.0)), F.coalesce("cocitation", F.lit(0.0)))
    total = (
        0.35 * proximity("distance") + 0.20 * multipath(F.coalesce("paths", F.lit(0))) + 0.15 * pair + 0.10 * F.coalesce("portal", F.lit(0.0))
        + 0.10 * F.coalesce("bridge", F.lit(0.0)) + 0.10 * recency_impact("year", "citation_count", p)
    )
    return nodes.withColumn("materialization_score", F.least(total, F.lit(1.0)))


def intro_hints(edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """edges(src, dst, ref_pos, n_refs): leading references with both rules' counts, edge type and weight."""
    k = intro_count("n_refs", p)
    is_intro = F.col("ref_pos") <= k
    return edges.select(
        "src", "dst", "ref_pos", k.alias("intro"), intro_count_plain("n_refs", p).alias("intro_plain"),
        F.when(is_intro, "INTRO_HINT_CITES").otherwise("CITES").alias("edge_type"), F.when(is_intro, 2.0).otherwise(1.0).alias("weight"),
    )


def position_hints(edges: DataFrame) -> DataFrame:
    """Early under a fifth of the list, late over seven tenths."""
    share = (F.col("ref_pos") - 1) / F.col("n_refs")
    return edges.select("src", "dst", "ref_pos", F.when(share < 0.2, "early").when(share > 0.7, "late").otherwise("middle").alias("position"))


def reference_type(same_author: Column, gap_years: Column, citations: Column, position: Column, is_method: Column) -> Column:
    old = (gap_years >= 10) | (citations >= 100)
    return F.when(same_author, "self_cite").when(old & (position == "early"), "foundational").when(is_method | (position == "late"), "methodological").otherwise("regular")


def citation_type(same_author: Column, shared: Column, gap_years: Column, is_review: Column) -> Column:
    return (
        F.when(same_author, "self_cite")
        .when((shared >= 3) & (gap_years <= 3), "extension")
        .when(is_review | (gap_years >= 5), "comparison")
        .when(shared.between(1, 2), "application")
        .otherwise("regular")
    )


def reference_importance(citations: Column, shared: Column, gap_years: Column, position: Column) -> Column:
    """Citations, concepts in common, recency (five years, or ten and more: foundations) and place (early, then late) of a reference."""
    recency = F.when(gap_years <= 5, 0.3).when(gap_years >= 10, 0.2).otherwise(0.0)
    place = F.when(position == "early", 0.2).when(position == "late", 0.1).otherwise(0.0)
    return 0.3 * F.log1p(citations) + 0.2 * shared + recency + place


def citing_relevance(citations: Column, shared: Column, years_after: Column) -> Column:
    """How much a citing paper says about the cited one: its citations, concepts in common, and how soon it came."""
    soon = F.when(years_after <= 2, 0.3).when(years_after <= 5, 0.2).otherwise(0.1)
    return 0.3 * F.log1p(F.coalesce(citations, F.lit(0))) + 0.3 * shared + soon


def citation_walk(edges: DataFrame, depths: DataFrame, most_refs: int = 50, most_cites: int = 30, intro_only: bool = False, p: Params = DEFAULT) -> DataFrame:
    """(paper, found_from, channel, depth, edge_type, weight): what each paper of ``depths`` (paper, depth) leads to, and how it was found.

    Backward the first ``most_refs`` references in list order, of which the introduction's count double (or alone are followed); forward the first ``most_cites``
    citing papers by id. edges(src, dst, ref_pos).
    """
    listed = edges.where(F.col("ref_pos") <= most_refs).withColumn("n_refs", F.count("*").over(Window.partitionBy("src")))
    hinted = intro_hints(listed, p)
    back = depths.join(hinted.where((F.col("edge_type") != "CITES") | F.lit(not intro_only)), F.col("paper") == F.col("src"))
    back = back.select(F.col("dst").alias("paper"), F.col("src").alias("found_from"), F.lit("backward").alias("channel"), (F.col("depth") + 1).alias("depth"), "edge_type", "weight")
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    into = depths.join(edges.select("src", "dst").distinct(), F.col("paper") == F.col("dst")).withColumn("_r", rank).where(F.col("_r") <= most_cites)
    return back.union(into.select("src", F.col("dst"), F.lit("forward"), F.col("depth") + 1, F.lit("CITES"), F.lit(1.0)))


def derived_edges(steps: DataFrame, bridges: DataFrame, coauthors: DataFrame) -> DataFrame:
    """(edge_type, src, dst, author_id, weight): an author's steps from year to year by drift, the clusters that an author bridges, and co-authors by papers.

    steps(author_id, year_from, year_to, drift), bridges(author_id, year_from, year_to, cluster_a, cluster_b), coauthors(a, b, papers).
    """
    at = lambda year: F.concat_ws(":", F.col("author_id").cast("string"), F.col(year).cast("string"))
    walked = steps.select(F.lit("TRAJECTORY_STEP").alias("edge_type"), at("year_from").alias("src"), at("year_to").alias("dst"), F.col("author_id").cast("string").alias("author_id"), F.col("drift").cast("double").alias("weight"))
    across = bridges.groupBy("author_id", "cluster_a", "cluster_b").agg(F.count("*").cast("double").alias("weight"))
    across = across.select(F.lit("AUTHOR_BRIDGE"), F.col("cluster_a").cast("string"), F.col("cluster_b").cast("string"), F.col("author_id").cast("string"), "weight")
    return walked.union(across).union(coauthors.select(F.lit("COAUTHOR"), F.col("a").cast("string"), F.col("b").cast("string"), F.lit(None).cast("string"), F.col("papers").cast("double")))


def hubs(nodes: DataFrame, known: Column | None = None, p: Params = DEFAULT) -> DataFrame:
    """Hub type of each node with its expansion limits and penalty. nodes(citation_count, relevance); ``known`` marks listed mega hubs."""
    kind = hub_type("citation_count", "relevance", known, p)
    return nodes.withColumn("hub", kind).withColumn("limits", hub_limits("hub")).withColumn("penalty", hub_penalty("hub"))


def materialised_edges(pool_edges: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Pool edges with both ends in the graph whose pair is new; the first edge of each pair. edges(src, dst, seq)."""
    inside = pool_edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    new = inside.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
    rank = Window.partitionBy("src", "dst").orderBy("seq")
    return new.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full").fillna(0, ["out_degree", "in_degree"])


def missing_intermediates(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, via): nodes that ``a`` cites and that cite ``b``, for given pairs; a two-hop join."""
    first = pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("via")), "a")
    return first.join(edges.select(F.col("src").alias("via"), F.col("dst").alias("b")), ["via", "b"]).select("a", "b", "via").distinct()


def capped(edges: DataFrame, degree: int) -> DataFrame:
    """At most ``degree`` edges out of each node, strongest first."""
    rank = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= degree).drop("_r")


def cut_to_capacity(nodes: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Best nodes within the graph's capacity, and the strongest edges among them. nodes(node, score, is_protected)."""
    kept = nodes.orderBy(F.desc("is_protected"), F.desc("score"), "node").limit(p.graph_nodes)
    inside = edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    return kept, inside.orderBy(F.desc("weight"), "src", "dst").limit(p.graph_edges)
