"""Authors: corpus statistics, collaborators, expansion and identity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.exprs import collaboration_strength, names_similar, normalize_name
from athenor.params import DEFAULT, Params


def _first(counts: DataFrame, by: list[str], value: str, order: list, top: int, name: str) -> DataFrame:
    """The first ``top`` values of each group as one array; a group gathers no more."""
    rank = Window.partitionBy(*by).orderBy(*order)
    kept = counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def corpus_stats(papers: DataFrame, concepts: DataFrame | None = None, authorship: DataFrame | None = None, venues: int = 5, top_concepts: int = 10, coauthors: int = 20) -> DataFrame:
    """Papers, citations, years and commonest venues of each author; with the tables, strongest concepts (of the first five of each paper) and co-authors."""
    out = papers.groupBy("author_id").agg(
        F.count("*").alias("papers"), F.sum("citation_count").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    places = papers.where("venue is not null").groupBy("author_id", "venue").agg(F.count("*").alias("n"))
    out = out.join(_first(places, ["author_id"], "venue", [F.desc("n"), "venue"], venues, "venues"), "author_id", "left")
    own = papers.select("paper_id", "author_id")
    if concepts is not None:
        weights = own.join(concepts.where("pos <= 5"), "paper_id").groupBy("author_id", "name").agg(F.sum("score").alias("n"))
        out = out.join(_first(weights, ["author_id"], "name", [F.desc("n"), "name"], top_concepts, "concepts"), "author_id", "left")
    if authorship is not None:
        shared = own.join(authorship, "paper_id").groupBy("author_id", "coauthor_id").agg(F.count("*").alias("n"))
        out = out.join(_first(shared, ["author_id"], "coauthor_id", [F.desc("n"), "coauthor_id"], coauthors, "coauthors"), "author_id", "left")
    return out


def collaborator_detail(papers: DataFrame, authorship: DataFrame, concepts: DataFrame, top: int = 20, p: Params = DEFAULT) -> DataFrame:
    """``collaborators`` with the five strongest shared concepts, the three commonest venues, and flags: lasting (five years or more), active (in the last two)."""
    best = collaborators(papers, authorship, top, p)
    pair = ["author_id", "coauthor_id"]
    shared = papers.select("paper_id", "author_id", "venue").join(authorship, "paper_id").join(best.select(*pair), pair, "left_semi")
    names = shared.join(concepts.where("pos <= 5").select("paper_id", "name", "score"), "paper_id").groupBy(*pair, "name").agg(F.sum("score").alias("n"))
    places = shared.where("venue is not null").groupBy(*pair, "venue").agg(F.count("*").alias("n"))
    out = best.join(_first(names, pair, "name", [F.desc("n"), "name"], 5, "concepts"), pair, "left").join(_first(places, pair, "venue", [F.desc("n"), "venue"], 3, "venues"), pair, "left")
    return out.withColumn("is_lasting", F.col("last_year") - F.col("first_year") >= 5).withColumn("is_active", F.col("last_year") >= p.as_of_year - 2)


def collaborators(papers: DataFrame, authorship: DataFrame, top: int = 20, p: Params = DEFAULT) -> DataFrame:
    """The strongest collaborators of each author with shared papers, years and strength."""
    shared = papers.select("paper_id", "author_id", "year").join(authorship, "paper_id")
    pairs = shared.groupBy("author_id", "coauthor_id").agg(F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    rank = Window.partitionBy("author_id").orderBy(F.desc("papers"), F.desc("last_year"), "coauthor_id")
    strength = collaboration_strength("papers", F.col("last_year") - F.col("first_year"), F.lit(p.as_of_year) - F.col("last_year"))
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).withColumn("strength", strength)


def without_self(pairs: DataFrame, own_name: str, other_name: str) -> DataFrame:
    """Leaves out collaborators whose name is the author's own: same last name, same first initial."""
    return pairs.where(~F.coalesce(names_similar(own_name, other_name), F.lit(False)))


def network_stats(papers: DataFrame, authorship: DataFrame) -> DataFrame:
    sizes = authorship.groupBy("paper_id").agg(F.count("*").alias("n"))
    each = papers.select("paper_id", "author_id").join(sizes, "paper_id", "left").fillna(0, ["n"])
    return each.groupBy("author_id").agg(
        F.count("*").alias("papers"), F.count_if(F.col("n") == 1).alias("solo"), F.count_if(F.col("n") > 1).alias("shared"), F.avg("n").alias("authors_per_paper")
    )


def coauthor_pairs(authorship: DataFrame, min_papers: int = 1) -> DataFrame:
    """(a, b, papers) of co-authors a < b; the author list of one paper is short, so its pairs are few."""
    left, right = authorship.withColumnRenamed("coauthor_id", "a"), authorship.withColumnRenamed("coauthor_id", "b")
    return left.join(right, "paper_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("papers")).where(F.col("papers") >= min_papers)


def collaborator_topics(papers: DataFrame, authorship: DataFrame, concepts: DataFrame, top: int = 20) -> DataFrame:
    """(author_id, coauthor_id, concept): primary concepts shared with the author's strongest collaborators."""
    best = collaborators(papers, authorship, top).select("author_id", "coauthor_id")
    shared = papers.select("paper_id", "author_id").join(authorship, "paper_id").join(best, ["author_id", "coauthor_id"])
    return shared.join(concepts.where("pos = 1").select("paper_id", F.col("name").alias("concept")), "paper_id").select("author_id", "coauthor_id", "concept").distinct()


def greedy_clusters(topics: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """For each author: the concept with most collaborators takes them, then the next over the rest, up to ``most`` clusters.

    One author's group holds at most the collaborators that ``collaborator_topics`` keeps times their concepts.
    """

    def cover(rows: pd.DataFrame) -> pd.DataFrame:
        members = {c: set(g["coauthor_id"]) for c, g in rows.groupby("concept")}
        used: set = set()
        out = []
        for concept, who in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            free = sorted(who - used)
            if len(free) >= least and len(out) < most:
                used |= set(free)
                out.append((rows["author_id"].iloc[0], len(out), concept, len(free), free))
        return pd.DataFrame(out, columns=["author_id", "cluster", "concept", "size", "members"])

    kinds = {c: topics.schema[c].dataType.simpleString() for c in ("author_id", "coauthor_id")}
    return topics.groupBy("author_id").applyInPandas(cover, f"author_id {kinds['author_id']}, cluster int, concept string, size int, members array<{kinds['coauthor_id']}>")


def expansion(papers: DataFrame, recent: int = 10, foundational: int = 5, years: int = 5, p: Params = DEFAULT) -> DataFrame:
    """The papers by which an author is followed: the most cited of the last years, and of those before."""
    part = F.when(F.col("year") >= p.as_of_year - years, "recent").otherwise("foundational")
    rank = Window.partitionBy("author_id", "slice").orderBy(F.desc("citation_count"), "paper_id")
    ranked = papers.withColumn("slice", part).withColumn("rank", F.row_number().over(rank))
    return ranked.where(F.col("rank") <= F.when(F.col("slice") == "recent", recent).otherwise(foundational)).select("author_id", "paper_id", "slice", "rank")


def productive(authorship: DataFrame, at_least: int, mega: int) -> DataFrame:
    counts = authorship.groupBy("coauthor_id").agg(F.count("*").alias("papers")).where(F.col("papers") >= at_least)
    return counts.withColumn("is_mega", F.col("papers") >= mega)


def fit_and_centrality(papers: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """Mean relevance of the best papers, and centrality from paper and neighbour counts."""
    rank = Window.partitionBy("author_id").orderBy(F.desc("relevance"), "paper_id")
    best = papers.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top).groupBy("author_id").agg(F.avg("relevance").alias("topic_fit"))
    counts = papers.groupBy("author_id").agg(F.count("*").alias("n"))
    linked = papers.select("author_id", "paper_id").join(edges, F.col("paper_id") == F.col("src")).groupBy("author_id").agg(F.countDistinct("dst").alias("conn"))
    joined = best.join(counts, "author_id").join(linked, "author_id", "left").fillna(0, ["conn"])
    centrality = 0.5 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.5 * F.least(F.col("conn") / 50, F.lit(1.0))
    return joined.select("author_id", "topic_fit", centrality.alias("centrality"))


def same_author(authors: DataFrame) -> DataFrame:
    """(a, b) of author records that share an ORCID, OpenAlex or S2 id, or a normalised name of two words or more where no id contradicts."""
    keys = ("orcid", "openalex_id", "s2_id")
    pairs = None
    for key in keys:
        own = authors.where(F.col(key).isNotNull() & (F.col(key) != "")).select("author_id", key)
        least = own.groupBy(key).agg(F.min("author_id").alias("b"))
        found = own.join(least, key).where("author_id <> b").select(F.col("author_id").alias("a"), "b")
        pairs = found if pairs is None else pairs.unionByName(found)
    plain = authors.withColumn("_name", normalize_name("name")).where(F.col("_name").contains(" "))
    plain = plain.select("author_id", "_name", *(F.nullif(F.col(k), F.lit("")).alias(k) for k in keys))
    first = plain.groupBy("_name").agg(F.min_by(F.struct("author_id", *keys), "author_id").alias("b"))
    named = plain.join(first, "_name").where(F.col("author_id") != F.col("b.author_id"))
    for k in keys:
        named = named.where(F.coalesce(F.col(k) == F.col(f"b.{k}"), F.lit(True)))
    return pairs.unionByName(named.select(F.col("author_id").alias("a"), F.col("b.author_id").alias("b"))).distinct()
