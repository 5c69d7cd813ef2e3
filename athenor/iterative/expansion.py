"""Expansion of a citation graph from seeds under budgets: a tree of buckets, and rounds over papers and their authors.

Both keep what the result depends on - who comes first - as data: a frontier is a numbered table, whose calls are budgeted by running sums, and a paper
that several parents reach belongs to the first of them. A generation or round is a fixed number of joins; the driver sees counts, the
last DRIFT_WINDOW relevances and, for the rounds, the queue of at most ``per_round`` papers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from athenor.functions.exprs import hub_type, intro_count
from athenor.functions.ranks import running
from athenor.functions.storage import materialize
from athenor.iterative.traversal import adaptive_depth
from athenor.operators.authors import expansion as works_to_follow
from athenor.operators.selection import expansion_queue
from athenor.params import DEFAULT, Params


@dataclass(frozen=True)
class Budget:
    """How far an expansion may go."""

    calls: int = 2_000
    calls_per_paper: int = 2
    refs: int = 50
    cites: int = 30
    generations: int = 10
    min_relevance: float = 0.15


@dataclass
class Buckets:
    """``papers``: paper, generation, bucket (the paper whose own bucket it is; null in the root), place, relevance. ``buckets``: bucket, parent, generation, size, mean, pruned."""

    papers: DataFrame
    buckets: DataFrame
    stopped: str
    calls: int
    generations: int
    history: list[float] = field(default_factory=list)


def _near(edges: DataFrame, budget: Budget, p: Params) -> DataFrame:
    """(paper, kind, pos, found): the introduction's references in list order, and the first citing papers by id, of every paper."""
    refs = edges.where((F.col("ref_pos") <= intro_count("n_refs", p)) & (F.col("ref_pos") <= budget.refs))
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    cites = edges.select("src", "dst").distinct().withColumn("pos", rank).where(F.col("pos") <= budget.cites)
    return refs.select(F.col("src").alias("paper"), F.lit(0).alias("kind"), F.col("ref_pos").cast("int").alias("pos"), F.col("dst").alias("found")).union(
        cites.select(F.col("dst").alias("paper"), F.lit(1).alias("kind"), F.col("pos").cast("int").alias("pos"), F.col("src").alias("found"))
    )


def _null(kind: DataType, name: str):
    return F.lit(None).cast(kind).alias(name)


def bucket_expansion(edges: DataFrame, papers: DataFrame, seeds: DataFrame, budget: Budget = Budget(), p: Params = DEFAULT) -> Buckets:
    """Every paper opens a bucket of the papers that it reaches first; branches die by low relevance, the whole by four stops.

    The seeds fill the root bucket. Before each generation it is asked whether the calls are used up, whether under ``p.drift_kill`` of the last
    ``p.drift_window`` relevances looked at reach ``budget.min_relevance``, and whether the generations are over, which depend on the root's size.
    A bucket with a mean relevance under ``p.min_bucket_relevance`` is pruned: its papers stay, but are not followed. Papers of the others are followed in
    order while calls are left. What a paper reaches and no paper before it has reached goes to its bucket if relevant enough.

    edges(src, dst, ref_pos, n_refs), papers(paper, relevance), seeds(paper); papers not in ``papers`` are not found by the service.
    """
    kind = papers.schema["paper"].dataType
    near = materialize(_near(edges, budget, p), "near")
    papers = materialize(papers.groupBy("paper").agg(F.max("relevance").alias("relevance")), "papers")
    seen = materialize(seeds.select("paper").where("paper is not null").distinct(), "seen")
    frontier = running(seen, [F.col("paper")], F.lit(1), "at").select("paper", "at", _null(kind, "bucket"))
    calls, generation, history, last, stopped = 0, 0, [], None, None
    found = buckets = None
    while True:
        if generation > 0:
            if calls >= budget.calls:
                stopped = "calls"
            elif len(history) >= p.drift_window and sum(r >= budget.min_relevance for r in history) / len(history) < p.drift_kill:
                stopped = "drift"
            elif generation > last:
                stopped = "generations"
            if stopped:
                break
        allowed = F.lit(True) if generation == 0 else F.lit(calls) + F.col("at") * budget.calls_per_paper < budget.calls
        followed = materialize(frontier.where(allowed), "followed")
        calls += followed.count() * budget.calls_per_paper
        order = F.struct("at", "kind", "pos")
        reached = followed.withColumnRenamed("bucket", "parent").join(near, "paper").select(F.col("paper").alias("bucket"), "parent", order.alias("order"), F.col("found").alias("paper"))
        reached = materialize(reached.join(seen, "paper", "left_anti").join(papers, "paper"), "reached")
        relevant = F.col("relevance") >= budget.min_relevance
        first = reached.where(relevant).groupBy("paper").agg(F.min_by(F.struct("bucket", "parent", "order", "relevance"), "order").alias("f"))
        new = materialize(first.select("paper", "f.*"), "bucket")
        # the looked-at papers in order: those too irrelevant each time, the others once
        looked = reached.where(~relevant).select("order", "relevance").union(new.select("order", "relevance"))
        tail = [r["relevance"] for r in looked.orderBy(F.desc("order")).limit(p.drift_window).collect()][::-1]
        history = (history + tail)[-p.drift_window :]
        if generation == 0:
            new = new.withColumns({"bucket": F.lit(None).cast(kind), "parent": F.lit(None).cast(kind)})
            last = adaptive_depth(new.count(), budget.generations)
        placed = materialize(running(new, [F.col("order")], F.lit(1), "place"), "placed")
        means = placed.groupBy("bucket").agg(F.first("parent").alias("parent"), F.count("*").alias("size"), F.avg("relevance").alias("mean"))
        means = materialize(means.select("bucket", "parent", F.lit(generation).alias("generation"), "size", "mean", (F.col("mean") < p.min_bucket_relevance).alias("pruned")), "buckets")
        rows = placed.select("paper", F.lit(generation).alias("generation"), "bucket", "place", "relevance")
        found, buckets = (rows, means) if found is None else (found.unionAll(rows), buckets.unionAll(means))
        alive = placed.join(means.where("not pruned").select(F.col("bucket").alias("b")), F.col("bucket").eqNullSafe(F.col("b")), "left_semi")
        if alive.isEmpty():
            stopped = "exhausted"
            break
        seen = seen.unionAll(placed.select("paper"))
        frontier = running(alive.select("paper", "bucket", "order"), [F.col("order")], F.lit(1), "at").select("paper", "at", "bucket")
        generation += 1
    return Buckets(found, buckets, stopped, calls, generation, history)


def best_of_buckets(papers: DataFrame, nodes: int) -> DataFrame:
    """The ``nodes`` most relevant papers of all buckets, of equal ones the first found."""
    return papers.orderBy(F.desc("relevance"), "generation", "place").limit(nodes)


@dataclass
class Rounds:
    """``papers``: paper, round (0: seed), channel, found_from. ``nodes``: paper, round of the working graph. ``authors``: author, round, found_from. ``edges``: src, dst, round."""

    papers: DataFrame
    nodes: DataFrame
    authors: DataFrame
    edges: DataFrame
    stopped: str
    calls: int


def authors_to_follow(queue: DataFrame, authorship: DataFrame, known: DataFrame, per_paper: int = 2, mega: int = 500) -> DataFrame:
    """(paper, at, author, pos): the last and the first author of each queued paper, without known ones and those of ``mega`` papers or more.

    An author belongs to the first paper that asks for them. authorship(paper, author, pos from 1, n_authors, author_papers).
    """
    ends = authorship.where((F.col("pos") == F.col("n_authors")) | (F.col("pos") == 1))
    place = F.when(F.col("pos") == F.col("n_authors"), 0).otherwise(1).alias("place")
    asked = queue.join(ends, "paper").where(F.col("author_papers") < mega).select("paper", "at", "author", place).join(known.select("author"), "author", "left_anti")
    asked = asked.where(F.col("place") < per_paper)
    first = asked.groupBy("author").agg(F.min_by(F.struct("paper", "at", "place"), F.struct("at", "place")).alias("f"))
    return first.select("f.paper", "f.at", "author", F.col("f.place").alias("pos"))


def _limits(is_seed, citations, relevance, p: Params):
    """(refs, cites, works) of each queued paper: seeds are always followed, hubs among them less far; mega papers and irrelevant hubs are not."""
    hub = hub_type(citations, relevance, None, p)
    make = lambda *n: F.struct(*(F.lit(v).alias(k) for k, v in zip(("refs", "cites", "works"), n, strict=True)))
    plain = F.when(hub == "none", make(50, 30, 20)).when(hub == "hub", make(25, 15, 10)).otherwise(make(0, 0, 0))
    return F.when(is_seed & (hub != "none"), make(20, 10, 5)).otherwise(plain)


def alternating_expansion(edges: DataFrame, papers: DataFrame, authorship: DataFrame, seeds: DataFrame, rounds: int = 3, per_round: int = 10, calls: int = 2_000, entering: int = 100, least: float = 0.2, mega: int = 500, p: Params = DEFAULT) -> Rounds:
    """Rounds over two kinds of frontier: the queue's papers lead to references, citing papers and authors, and the authors to their works.

    A round follows the ``per_round`` best unexpanded papers of the working graph. Each costs a call for its references, one for its citing papers
    and one for each author; papers are followed in order while calls are left. A paper's second author is followed only if the first
    brought fewer works than the paper's limit. Then the ``entering`` best candidates with a score over ``least`` enter the working graph, and
    every edge that is known by then and has both ends in it is synchronised. An author is followed once.

    edges(src, dst, ref_pos), papers(paper, year, citation_count, relevance, bridge, score), authorship(paper, author, pos, n_authors), seeds(paper).
    """
    kind, author_kind = papers.schema["paper"].dataType, authorship.schema["author"].dataType
    edges = materialize(edges.select("src", "dst", "ref_pos").distinct(), "edges")
    papers = materialize(papers, "papers")
    works = authorship.groupBy("author").agg(F.count("*").alias("author_papers"))
    authorship = materialize(authorship.join(works, "author"), "authorship")
    seeds = materialize(seeds.select("paper").distinct().join(papers.select("paper"), "paper", "left_semi"), "seeds")
    found = seeds.select("paper", F.lit(0).alias("round"), F.lit("seed").alias("channel"), _null(kind, "found_from"))
    nodes, expanded = seeds.select("paper", F.lit(0).alias("round")), seeds.where("false").select("paper")
    authors = authorship.where("false").select("author", F.lit(0).alias("round"), F.lit(None).cast(kind).alias("found_from"))
    known = edges.where("false").select("src", "dst")
    synced = known.withColumn("round", F.lit(0))
    used, stopped, at = 0, None, 0
    for at in range(1, rounds + 1):
        if used >= calls:
            stopped = "calls"
            break
        state = nodes.join(papers, "paper").join(expanded.withColumn("_done", F.lit(True)), "paper", "left").join(seeds.withColumn("_seed", F.lit(True)), "paper", "left")
        state = materialize(state.select(F.col("paper").alias("node"), F.when(F.col("_seed"), 1.0).otherwise(F.col("relevance")).alias("relevance"), "bridge", "year", "citation_count", F.coalesce("_done", F.lit(False)).alias("is_expanded"), F.coalesce("_seed", F.lit(False)).alias("is_seed")), "state")
        queue = expansion_queue(state, synced, min(per_round, calls - used), p)
        order = Window.orderBy(F.desc("priority"), "node")  # over ``per_round`` rows
        queue = queue.withColumn("at", F.row_number().over(order) - 1).join(state.drop("year", "bridge", "is_expanded"), "node")
        queue = queue.select(F.col("node").alias("paper"), "at", _limits(F.col("is_seed"), "citation_count", "relevance", p).alias("most"))
        queue = materialize(queue.coalesce(1), "queue")
        if queue.isEmpty():
            stopped = "exhausted"
            break
        asked = materialize(authors_to_follow(queue.where("most.works > 0"), authorship, authors, mega=mega), "asked")
        follow = works_to_follow(asked.select("author").distinct().join(authorship, "author").join(papers.select("paper", "year", "citation_count"), "paper").select(F.col("author").alias("author_id"), F.col("paper").alias("paper_id"), "year", "citation_count"), p=p)
        follow = materialize(follow.select(F.col("author_id").alias("author"), F.col("paper_id").alias("work"), "slice", "rank"), "works")
        brought = asked.join(follow.groupBy("author").agg(F.count("*").alias("works")), "author", "left").fillna(0, ["works"])
        earlier = F.coalesce(F.sum("works").over(Window.partitionBy("paper").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        brought = brought.withColumn("_earlier", earlier).join(queue.select("paper", F.col("most.works").alias("_most")), "paper").where("_earlier < _most").drop("_earlier", "_most")
        # a call for references and one for citing papers where any are wanted, and one for each author
        cost = queue.join(brought.groupBy("paper").agg(F.count("*").alias("authors")), "paper", "left").fillna(0, ["authors"])
        cost = cost.withColumn("cost", F.when(F.col("most.refs") > 0, 1).otherwise(0) + F.when(F.col("most.cites") > 0, 1).otherwise(0) + F.col("authors"))
        before = F.coalesce(F.sum("cost").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over ``per_round`` rows
        done = materialize(cost.withColumn("before", before).where(F.lit(used) + F.col("before") < calls).coalesce(1), "done")
        used += done.agg(F.sum("cost")).first()[0]
        expanded = expanded.unionAll(done.select("paper"))
        followed = materialize(brought.join(done.select("paper"), "paper", "left_semi"), "followed")
        authors = authors.unionAll(followed.select("author", F.lit(at).alias("round"), F.col("paper").cast(kind).alias("found_from")))
        back = done.join(edges, F.col("paper") == F.col("src")).where(F.col("ref_pos") <= F.col("most.refs")).select("src", "dst", "at", F.lit(0).alias("step"), F.col("ref_pos").cast("long").alias("pos"))
        rank = F.row_number().over(Window.partitionBy("dst").orderBy("src")).cast("long")
        into = edges.join(done.select("paper", "at", "most"), F.col("paper") == F.col("dst")).select("src", "dst", "at", "most").distinct().withColumn("pos", rank)
        into = into.where(F.col("pos") <= F.col("most.cites")).select("src", "dst", "at", F.lit(1).alias("step"), "pos")
        walked = materialize(back.union(into), "walked")
        by_author = followed.join(follow, "author").select(F.col("work").alias("paper"), F.when(F.col("slice") == "recent", "author").otherwise("author_foundational").alias("channel"), F.col("paper").alias("found_from"), F.struct("at", (F.col("pos") + 2).alias("step"), F.when(F.col("slice") == "recent", F.col("rank")).otherwise(F.col("rank") + 1_000).cast("long").alias("pos")).alias("order"))
        ways = walked.select(
            F.when(F.col("step") == 0, F.col("dst")).otherwise(F.col("src")).alias("paper"), F.when(F.col("step") == 0, "reference").otherwise("citation").alias("channel"),
            F.when(F.col("step") == 0, F.col("src")).otherwise(F.col("dst")).alias("found_from"), F.struct("at", "step", "pos").alias("order"),
        ).unionByName(by_author)
        first = ways.join(found.select("paper"), "paper", "left_anti").join(papers.select("paper"), "paper", "left_semi")
        first = first.groupBy("paper").agg(F.min_by(F.struct("channel", "found_from"), "order").alias("f"))
        found = found.unionAll(materialize(first.select("paper", F.lit(at).alias("round"), "f.channel", "f.found_from"), "found"))
        waiting = found.select("paper").join(nodes.select("paper"), "paper", "left_anti").join(papers, "paper")
        best = waiting.orderBy(F.desc("score"), "paper").limit(entering).where(F.col("score") > least)
        nodes = nodes.unionAll(materialize(best.select("paper", F.lit(at).alias("round")), "nodes"))
        known = materialize(known.union(walked.select("src", "dst")).distinct(), "known")
        ends = nodes.select("paper")
        inside = known.join(ends.withColumnRenamed("paper", "src"), "src", "left_semi").join(ends.withColumnRenamed("paper", "dst"), "dst", "left_semi")
        synced = synced.unionAll(materialize(inside.join(synced.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(at).alias("round")), "synced"))
    return Rounds(found, nodes, authors, synced, stopped or ("calls" if used >= calls else "rounds"), used)
