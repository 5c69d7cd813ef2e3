"""What to follow next, what to start from, and summaries of trajectories and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.ranks import running
from athenor.functions.storage import materialize
from athenor.params import DEFAULT, Params

#: Papers with up to so many concepts more than they must share meet over groups of JOINT concepts.
LONGER, JOINT = 10, 3

#: Papers of the same concepts that one task pairs with seeds, about.
ALIKE = 50_000

#: Words that make a concept a method or an organism.
METHOD_FACETS = ("method", "algorithm", "technique", "analysis", "model", "simulation")
ORGANISM_FACETS = ("human", "mouse", "bacteria", "virus", "plant", "yeast", "cell")


def expansion_queue(nodes: DataFrame, edges: DataFrame, limit: int = 10, p: Params = DEFAULT) -> DataFrame:
    """(node, priority): unexpanded nodes by relevance, unexpanded neighbours, bridge potential and age.

    nodes(node, relevance, bridge, year, is_expanded), edges(src, dst).
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()
    fresh = nodes.where("not is_expanded").select(F.col("node").alias("near"))
    frontier = both.join(fresh, "near", "left_semi").groupBy("node").agg(F.count("*").alias("_open"))
    joined = nodes.where("not is_expanded").join(frontier, "node", "left").fillna(0, ["_open"])
    old = F.when(F.lit(p.as_of_year) - F.col("year") > 10, 0.1).otherwise(0.0)
    priority = F.col("relevance") + F.least(F.col("_open") / 10, F.lit(0.3)) + 0.2 * F.col("bridge") - old
    return joined.select("node", priority.alias("priority")).orderBy(F.desc("priority"), "node").limit(limit)


def core_and_frontier(nodes: DataFrame, limit: int, share: float = 0.6) -> DataFrame:
    """The best of the core and, for the rest of the places, the best of the frontier, with ``rank``. nodes(node, score, is_frontier)."""
    core = int(limit * share)
    best = [nodes.where(F.col("is_frontier") == side).orderBy(F.desc("score"), "node").limit(n) for side, n in ((False, core), (True, limit - core))]
    rank = Window.partitionBy("is_frontier").orderBy(F.desc("score"), "node")
    return best[0].unionAll(best[1]).withColumn("rank", F.row_number().over(rank))  # over ``limit`` rows


def select_seeds(candidates: DataFrame, most: int = 20, reviews: int = 3, least_citations: int = 30, few: int = 5, p: Params = DEFAULT) -> DataFrame:
    """Up to three cited reviews among the first reviews, then cited papers, and recent ones if these are few. candidates(paper_id, position, ...)."""
    first = candidates.where("is_review").orderBy("position").limit(reviews).select("paper_id", F.lit(True).alias("_first"))
    cited = F.col("citation_count") >= least_citations
    tier = F.when(F.col("is_review") & F.col("_first") & cited, 1).when(~F.col("is_review") & cited, 2).when(F.col("year") >= p.as_of_year - 1, 3)
    tiered = candidates.join(F.broadcast(first), "paper_id", "left").withColumn("tier", tier).where("tier is not null")  # ``reviews`` rows
    found = tiered.where("tier < 3").limit(few).agg((F.count("*") < few).alias("_few"))
    return tiered.crossJoin(F.broadcast(found)).where("tier < 3 or _few").orderBy("tier", "position").limit(most).select("paper_id", "tier", "position")  # found is one row


def combine_seeds(lists: DataFrame, most: int = 20) -> DataFrame:
    """Seeds of several lists, one for each DOI or else short title, the first of the first list. lists(list, position, doi, title)."""
    key = F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.lower(F.substring("title", 1, 50)))
    rank = Window.partitionBy("key").orderBy("list", "position")
    return lists.withColumn("key", key).withColumn("_r", F.row_number().over(rank)).where("_r = 1").orderBy("list", "position").limit(most).drop("_r")


def _kinds(concepts: DataFrame, seeds: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seed, own), (own, kind, slot), (paper_id, kind, slot): a join of the three gives each seed the papers that have ``least`` concepts in common with it.

    Papers with the same concepts are of one kind, and only kinds are compared; a kind's papers are dealt to slots of about ALIKE. With all concepts in one order,
    rarest first, two kinds with so many in common have JOINT of them (or ``least``) among the first k - least + JOINT of each. Kinds with at most LONGER concepts more than ``least`` meet over every group of JOINT of these, 286 at most; where one of the two has more concepts
    they meet over single ones, the first k - least + 1 of each. What meets is counted on the whole sets.
    """
    own = materialize(concepts.select("paper_id", "name").where("name is not null").distinct(), "own")
    numbers = running(own.groupBy("name").agg(F.count("*").alias("n")), [F.col("n"), F.col("name")], F.lit(1), "number").select("name", "number")
    sets = own.join(numbers, "name").groupBy("paper_id").agg(F.array_sort(F.collect_list("number")).alias("set")).where(F.size("set") >= least)
    sets = materialize(sets, "sets")
    slots = (1 + F.floor(F.count("*") / ALIKE)).cast("int")  # a kind of many papers is dealt out
    kinds = materialize(sets.groupBy("set").agg(slots.alias("slots")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    members = materialize(sets.join(kinds, "set").select("paper_id", "kind", F.pmod(F.xxhash64("paper_id"), F.col("slots")).cast("int").alias("slot")), "members")
    of_seeds = materialize(members.join(seeds.select("paper_id").distinct(), "paper_id", "left_semi").select(F.col("paper_id").alias("seed"), F.col("kind").alias("own")), "seeds")
    asking = materialize(kinds.join(of_seeds.select(F.col("own").alias("kind")).distinct(), "kind", "left_semi").select(F.col("kind").alias("own"), "set"), "asking")
    joint, short = max(min(JOINT, least), 1), F.size("set") <= least + LONGER
    first = lambda n: F.slice("set", F.lit(1), F.size("set") - least + n)
    groups = F.transform(first(joint), lambda x: F.array(x))
    for _ in range(joint - 1):
        groups = F.flatten(F.transform(groups, lambda g: F.transform(F.filter(first(joint), lambda x: x > F.element_at(g, -1)), lambda x: F.concat(g, F.array(x)))))
    hashes = F.transform(groups, lambda g: F.xxhash64(g))  # equal groups have equal ones; what else meets is not counted in the end

    def met(keys: Column, one: Column, other: Column) -> DataFrame:
        return asking.where(one).select("own", F.explode(keys).alias("at")).join(kinds.where(other).select("kind", F.explode(keys).alias("at")), "at").select("own", "kind")

    meet = met(hashes, short, short)
    if not kinds.where(~short).isEmpty():
        meet = meet.union(met(first(1), short, ~short)).union(met(first(1), ~short, F.lit(True)))
    both = meet.distinct().join(asking.withColumnRenamed("set", "theirs"), "own").join(kinds, "kind").where(F.size(F.array_intersect("theirs", "set")) >= least)
    dealt = both.select("own", "kind", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    return of_seeds, materialize(dealt, "dealt"), members


def _sharing(concepts: DataFrame, seeds: DataFrame, least: int) -> DataFrame:
    """(seed, paper_id) that have ``least`` concepts in common."""
    of_seeds, dealt, members = _kinds(concepts, seeds, least)
    return of_seeds.join(dealt, "own").join(members, ["kind", "slot"]).where("seed <> paper_id").select("seed", "paper_id")


def inferred_edges(seeds: DataFrame, papers: DataFrame, authors: DataFrame, concepts: DataFrame, least: int = 3) -> DataFrame:
    """(src, dst, kind) between seeds and papers that share an author, or else ``least`` concepts; the later paper cites.

    Authors are joined as they are, concepts over groups of rare ones. papers(paper_id, year), authors(paper_id, author),
    concepts(paper_id, name).
    """

    def shared(rows: DataFrame, key: str) -> DataFrame:
        own = rows.select("paper_id", key).distinct()
        return own.join(seeds, "paper_id", "left_semi").withColumnRenamed("paper_id", "seed").join(own, key).where("seed <> paper_id").groupBy("seed", "paper_id").agg(F.count("*").alias("n"))

    by_author = materialize(shared(authors, "author").select("seed", "paper_id", F.lit(True).alias("same")), "authors")
    dated = lambda pairs: pairs.join(papers.select("paper_id", "year"), "paper_id")
    years = papers.select(F.col("paper_id").alias("seed"), F.col("year").alias("seed_year"))
    of_seeds, dealt, members = _kinds(concepts, seeds, least)
    by_concept = of_seeds.join(years, "seed").join(dealt, "own").join(dated(members), ["kind", "slot"]).where("seed <> paper_id").join(by_author, ["seed", "paper_id"], "left_anti")
    by_concept = by_concept.select("seed", "paper_id", F.lit(False).alias("same"), "year", "seed_year")
    pairs = dated(by_author).join(years, "seed").select("seed", "paper_id", "same", "year", "seed_year").unionAll(by_concept)
    older = (F.col("year") < F.col("seed_year")) | (~F.col("same") & (F.col("year") == F.col("seed_year")))
    kept = pairs.where(older | (F.col("year") > F.col("seed_year")))
    return kept.select(F.when(older, F.col("seed")).otherwise(F.col("paper_id")).alias("src"), F.when(older, F.col("paper_id")).otherwise(F.col("seed")).alias("dst"), F.when(older, "reference").otherwise("citation").alias("kind"))


def trajectory_type(career_years: Column, drift_per_year: Column, jumps: Column, phases: Column, core: Column) -> Column:
    return (
        F.when(career_years < 5, "early_career")
        .when((core >= 3) & (drift_per_year < 0.1), "focused")
        .when((jumps >= 2) & (phases >= 3), "shifter")
        .when((drift_per_year > 0.2) & (phases >= 3), "explorer")
        .when(drift_per_year.between(0.05, 0.15) & (core >= 2), "bridger")
        .otherwise("steady")
    )


def stability(career_years: Column, drift_per_year: Column, core: Column) -> Column:
    calm = 1 / (1 + 3 * drift_per_year) + F.least(core * 0.1, F.lit(0.3))
    return F.when(career_years == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(calm, F.lit(1.0))))


def trajectory_stats(papers: DataFrame, events: DataFrame, phases: DataFrame, core: DataFrame) -> DataFrame:
    """Career, drift, type and stability of each author."""
    career = papers.groupBy("author_id").agg((F.max("year") - F.min("year") + 1).alias("career_years"))
    drift = events.groupBy("author_id").agg(F.sum("drift").alias("drift_total"), F.count_if("is_jump").alias("jumps"))
    stretches = phases.groupBy("author_id").agg(F.count("*").alias("phases"))
    cores = core.groupBy("author_id").agg(F.count("*").alias("core"))
    joined = career.join(drift, "author_id", "left").join(stretches, "author_id", "left").join(cores, "author_id", "left").fillna(0, ["drift_total", "jumps", "phases", "core"])
    rate = F.col("drift_total") / F.greatest("career_years", F.lit(1))
    kind = trajectory_type(F.col("career_years"), rate, F.col("jumps"), F.col("phases"), F.col("core"))
    return joined.select("author_id", "career_years", "drift_total", rate.alias("drift_per_year"), "jumps", "phases", "core", kind.alias("kind"), stability(F.col("career_years"), rate, F.col("core")).alias("stability"))


def citation_summary(typed: DataFrame, first: int = 10, key: int = 5) -> DataFrame:
    """For each paper: references by type, self-citations, and key references among the most important. typed(src, dst, ref_type, importance)."""
    rank = Window.partitionBy("src").orderBy(F.desc("importance"), "dst", "ref_pos")
    ranked = typed.withColumn("_r", F.row_number().over(rank))
    top = F.struct(F.col("_r"), F.col("dst"))
    chosen = F.array_sort(F.collect_list(F.when((F.col("_r") <= first) & (F.col("ref_type") != "self_cite"), top)))  # ``first`` entries at most
    return ranked.groupBy("src").agg(
        F.count_if(F.col("ref_type") == "foundational").alias("foundational"),
        F.count_if(F.col("ref_type") == "methodological").alias("methodological"),
        F.count_if(F.col("ref_type") == "self_cite").alias("self_cites"),
        F.transform(F.slice(chosen, 1, key), lambda t: t["dst"]).alias("key_references"),
    )


def facet(name: Column) -> Column:
    low = F.lower(name)
    has = lambda words: F.greatest(*(low.contains(w) for w in words))
    return F.when(has(METHOD_FACETS), "method").when(has(ORGANISM_FACETS), "organism").otherwise("domain")


def facets(concepts: DataFrame, by: list[str], top: int = 5) -> DataFrame:
    """First concepts of each facet. concepts(*by, name, pos)."""
    rank = Window.partitionBy(*by, "facet").orderBy("pos", "name")
    return concepts.withColumn("facet", facet(F.col("name"))).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select(*by, "facet", "name", "rank")


def author_confidence(similarity: Column, same_affiliation: Column, has_paper: Column, papers: Column) -> Column:
    """Half for the name, a fifth each for affiliation and paper, a tenth for a long list of works."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return 0.5 * similarity + 0.2 * flag(same_affiliation) + 0.2 * flag(has_paper) + 0.1 * flag(papers > 50)
