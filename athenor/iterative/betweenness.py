"""Betweenness of the nodes of a bounded graph, its sources dealt out over the cluster."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.functions.storage import bounded

#: A graph over a vocabulary (topics, venues) has so many edges at most; it goes to every task.
MOST_EDGES = 500_000


def dependencies(near: dict[int, list[int]], source: int) -> dict[int, float]:
    """For every node the share of the shortest ways from ``source`` that pass it."""
    ways, far, before, order, queue = {source: 1.0}, {source: 0}, {source: []}, [], deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in far:
                far[w], ways[w], before[w] = far[v] + 1, 0.0, []
                queue.append(w)
            if far[w] == far[v] + 1:
                ways[w] += ways[v]
                before[w].append(v)
    share = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            share[v] += ways[v] / ways[w] * (1 + share[w])
    del share[source]
    return share


def betweenness(edges: DataFrame, tasks: int = 64) -> DataFrame:
    """(node, betweenness) of edges(src, dst), undirected, pairs counted once, over all edges; a larger graph than MOST_EDGES is refused.

    Every task has the graph and some of the sources; what the sources add to a node is summed by Spark.
    """
    plain = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    plain = bounded(plain, MOST_EDGES, "edges")
    nodes = plain.select(F.col("a").alias("node")).union(plain.select("b")).distinct()
    names = [r.node for r in nodes.orderBy("node").collect()]  # at most twice MOST_EDGES names
    number = {n: i for i, n in enumerate(names)}
    near: dict[int, list[int]] = {i: [] for i in range(len(names))}
    for r in plain.orderBy("a", "b").collect():
        near[number[r.a]].append(number[r.b])
        near[number[r.b]].append(number[r.a])
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, float] = {}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                for v, x in dependencies(shared.value, source).items():
                    total[v] = total.get(v, 0.0) + x / 2
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], names=["i", "share"])

    sums = spark.range(0, len(names), 1, min(tasks, max(1, len(names)))).mapInArrow(run, "i long, share double").groupBy("i").agg(F.sum("share").alias("betweenness"))
    known = spark.createDataFrame(list(enumerate(names)), f"i long, node {edges.schema['src'].dataType.simpleString()}") if names else nodes.select(F.lit(0).cast("long").alias("i"), "node")
    return known.join(sums, "i", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
