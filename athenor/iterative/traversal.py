"""Traversals by frontier joins: each round is a few joins over tables; only whether a frontier is empty reaches the driver."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.params import DEFAULT, Params


def hop_distances(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, distance): undirected hops to the nearest seed, until no node is new or up to ``max_hops``; seeds(node)."""
    both = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct(), "both")
    frontier = seeds.select("node").distinct()
    found = materialize(frontier.withColumn("distance", F.lit(0)), "hops")
    frontier = found.select("node")
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        reached = both.join(frontier, "node").select(F.col("near").alias("node")).distinct()
        new = materialize(reached.join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)), "hops")
        if new.isEmpty():
            break
        found = found.unionAll(new)
        frontier = new.select("node")
    return found


def reachable_seeds(components: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """(node, paths): number of seeds in the node's component, capped. components(node, component)."""
    counts = components.join(seeds, "node", "left_semi").groupBy("component").agg(F.count("*").alias("n"))
    joined = components.join(counts, "component", "left")
    return joined.select("node", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("int").alias("paths"))


def adaptive_depth(size: int, base: int = 10) -> int:
    """Generations for a bucket: five at most for a small one, more for a large one."""
    return min(base, 5) if size < 10 else base if size < 50 else base + size // 50


def bucket_generations(edges: DataFrame, papers: DataFrame, seeds: DataFrame, generations: int = 3, per_paper: int = 20, p: Params = DEFAULT) -> DataFrame:
    """(paper, generation, parent, relevance): papers that each generation claims.

    Every paper of a generation opens a bucket of the papers that it cites, the first ``per_paper`` of the list. A paper belongs to the
    earliest generation, then to the smallest (parent, ref_pos). Buckets with a mean relevance under the threshold are
    not followed further. edges(src, dst, ref_pos), papers(paper, relevance).
    """
    claimed = materialize(seeds.select("paper").distinct().join(papers, "paper").select("paper", F.lit(0).alias("generation"), F.lit(None).cast(papers.schema["paper"].dataType).alias("parent"), "relevance"), "bucket")
    frontier = claimed
    short = materialize(edges.where(F.col("ref_pos") <= per_paper).select("src", "dst", "ref_pos"), "short")
    papers = materialize(papers.select("paper", "relevance"), "papers")
    for generation in range(1, generations + 1):
        reached = frontier.select(F.col("paper").alias("parent")).join(short.withColumnRenamed("src", "parent"), "parent")
        rank = Window.partitionBy("dst").orderBy("parent", "ref_pos")
        first = reached.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(F.col("dst").alias("paper"), "parent")
        new = first.join(claimed.select("paper"), "paper", "left_anti").join(papers, "paper")
        new = materialize(new.select("paper", F.lit(generation).alias("generation"), "parent", "relevance"), "bucket")
        claimed = claimed.unionAll(new)
        alive = new.groupBy("parent").agg(F.avg("relevance").alias("mean")).where(F.col("mean") >= p.min_bucket_relevance).select("parent")
        frontier = new.join(alive, "parent", "left_semi")
        if frontier.isEmpty():
            break
    return claimed


def depth_expansion(edges: DataFrame, papers: DataFrame, seeds: DataFrame, rounds: int = 3, per_round: int = 10, p: Params = DEFAULT) -> DataFrame:
    """(paper, depth): in each round the ``per_round`` most relevant unexpanded papers are followed in both directions.

    The size of a hub decides how many references and citations of it are followed. papers(paper, relevance, citation_count).
    """
    edges = materialize(edges.select("src", "dst", "ref_pos"), "edges")
    papers = materialize(papers.select("paper", "relevance", "citation_count"), "papers")
    known = materialize(seeds.select("paper").distinct().withColumn("depth", F.lit(0)), "depth")
    expanded = None
    for depth in range(1, rounds + 1):
        waiting = known if expanded is None else known.join(expanded, "paper", "left_anti")
        chosen = materialize(waiting.join(papers, "paper").orderBy(F.desc("relevance"), "paper").limit(per_round), "chosen")
        expanded = chosen.select("paper") if expanded is None else expanded.union(chosen.select("paper"))
        mega = F.col("citation_count") >= p.mega_citations
        refs = F.when(mega, 0).when(F.col("citation_count") >= p.hub_citations, 25).otherwise(50)
        cites = F.when(mega, 0).when(F.col("citation_count") >= p.hub_citations, 15).otherwise(30)
        back = chosen.join(edges, F.col("paper") == F.col("src")).where(F.col("ref_pos") <= refs).select(F.col("dst").alias("found"))
        rank = Window.partitionBy("dst").orderBy("src")
        into = chosen.join(edges, F.col("paper") == F.col("dst")).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= cites).select(F.col("src").alias("found"))
        reached = back.union(into).distinct().withColumnRenamed("found", "paper")
        new = materialize(reached.join(known.select("paper"), "paper", "left_anti").withColumn("depth", F.lit(depth)), "depth")
        if new.isEmpty():
            break
        known = known.unionAll(new)
    return known


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by label propagation: each node takes the commonest label around it, of equals the smallest.

    A node counts its own label once, which settles pairs. Labels are shared by joins, never by gathering neighbours.
    """
    both = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).where("node <> near").distinct(), "both")
    labels = both.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "near"), "near").select("node", "label").union(labels.select("node", "label"))
        counts = votes.groupBy("node", "label").agg(F.count("*").alias("n"))
        best = F.max(F.struct(F.col("n"), (-F.col("label")).alias("label"))).alias("best")
        labels = materialize(counts.groupBy("node").agg(best).select("node", (-F.col("best.label")).alias("label")), "labels")
    return labels.withColumnRenamed("label", "community")


def rolling_share(rows: DataFrame, by: list[str], order: list[str], flag: str, window: int = 30) -> DataFrame:
    """Share of ``flag`` over the last ``window`` rows, and whether it calls for a stop (only over a full window)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1), 0)
    seen = F.count("*").over(w)
    share = F.avg(F.col(flag).cast("double")).over(w)
    return rows.withColumn("share", share).withColumn("stop", (seen >= window) & (share < DEFAULT.drift_kill))
