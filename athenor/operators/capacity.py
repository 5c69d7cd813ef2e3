"""The working graph within its capacity: nodes and edges cut together, to a fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.params import DEFAULT, Params


def within_capacity(nodes: DataFrame, edges: DataFrame, p: Params = DEFAULT, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that stay.

    Seeds, pinned nodes and portals never leave, nor do edges that are pinned or join two such nodes; where these alone are over a
    limit, that is an error, or if not ``strict`` they all stay and leave no room for others. Of the other nodes those with the most worth (0.7 score - 0.3 age in hours) stay, of the other edges among
    them the heaviest. A node that the cut of the edges has left without any leaves too and makes room for the next one, and the edges are
    ranked again, until nothing changes; candidates only ever leave, so it ends.

    nodes(node, score, age_hours, is_seed, is_pinned, is_portal), edges(src, dst, weight, is_pinned).
    """
    safe = (F.col("is_seed") | F.col("is_pinned") | F.col("is_portal")).alias("is_protected")
    left = materialize(nodes.select("node", safe, (0.7 * F.col("score") - 0.3 * F.col("age_hours")).alias("worth")), "candidates")
    safe_nodes = left.where("is_protected").count()
    if strict and safe_nodes > p.graph_nodes:
        raise ValueError(f"{safe_nodes} protected nodes, room for {p.graph_nodes}")
    pairs = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.bool_or("is_pinned").alias("is_pinned"))
    pairs = materialize(pairs, "pairs")
    while True:
        best = left.where("not is_protected").orderBy(F.desc("worth"), "node").limit(max(p.graph_nodes - safe_nodes, 0))
        kept = materialize(left.where("is_protected").union(best), "kept")
        ends = [kept.select(F.col("node").alias(x), F.col("is_protected").alias(f"_{x}")) for x in ("src", "dst")]
        inside = pairs.join(ends[0], "src").join(ends[1], "dst").withColumn("is_protected", F.col("is_pinned") | (F.col("_src") & F.col("_dst")))
        inside = materialize(inside.drop("_src", "_dst"), "inside")
        safe_edges = inside.where("is_protected").count()
        if strict and safe_edges > p.graph_edges:
            raise ValueError(f"{safe_edges} protected edges, room for {p.graph_edges}")
        heaviest = inside.where("not is_protected").orderBy(F.desc("weight"), "src", "dst").limit(max(p.graph_edges - safe_edges, 0))
        strongest = materialize(inside.where("is_protected").union(heaviest), "strongest")
        touched = lambda e: e.select(F.col("src").alias("node")).union(e.select("dst"))
        lost = touched(inside).join(touched(strongest), "node", "left_anti").distinct().join(kept.where("not is_protected"), "node", "left_semi")
        lost = materialize(lost, "lost")
        if lost.isEmpty():
            return nodes.join(kept.select("node"), "node", "left_semi"), strongest.select("src", "dst", "weight", "is_protected")
        left = materialize(left.join(lost, "node", "left_anti"), "candidates")
