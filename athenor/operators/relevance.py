"""Relevance and rankings: agent scores, topical scores, breakpoints, leaders, tiers, reading lists, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.params import DEFAULT, GENERIC_CONCEPTS, Params


def citation_score(citations: Column | str) -> Column:
    return F.least(F.log1p(F.coalesce(F.col(citations) if isinstance(citations, str) else citations, F.lit(0))) / F.log(F.lit(101.0)), F.lit(1.0))


def recency_score(year: Column | str, p: Params = DEFAULT) -> Column:
    """exp(-age / 10); a half without a year, a fifth for years to come or before 1900."""
    y = F.col(year) if isinstance(year, str) else year
    age = F.lit(p.as_of_year) - y
    return F.when(y.isNull(), 0.5).when((age < 0) | (y < 1900), 0.2).otherwise(F.exp(-0.1 * age))


def quality_score(is_oa: Column, is_review: Column, has_abstract: Column, has_venue: Column) -> Column:
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in (is_oa, is_review, has_abstract, has_venue)]
    return F.least(F.lit(1.0), 0.5 + 0.1 * sum(flags[1:], flags[0]))


def context_weights(concepts: DataFrame, targets: list[str], seeds: DataFrame, query: list[str]) -> DataFrame:
    """(name, weight): two for targets, the seeds' summed scores, one for words of the query; names in lower case."""
    spark = concepts.sparkSession
    rows = [(t.lower(), 2.0) for t in targets] + [(q.lower(), 1.0) for q in query]
    given = spark.createDataFrame(rows or [("", 0.0)], "name string, w double").where("name <> ''")
    own = concepts.join(seeds.select("paper_id"), "paper_id", "left_semi").select(F.lower("name").alias("name"), F.col("score").alias("w"))
    return given.unionAll(own).groupBy("name").agg(F.sum("w").alias("weight"))


def concept_match(concepts: DataFrame, context: DataFrame) -> DataFrame:
    """(paper_id, concept_score): shared context weight over half of all of it, 1 at most."""
    whole = context.agg((F.sum("weight") / 2).alias("_half"))
    hits = concepts.select("paper_id", F.lower("name").alias("name")).distinct().join(context, "name").groupBy("paper_id").agg(F.sum("weight").alias("w"))
    return hits.crossJoin(F.broadcast(whole)).select("paper_id", F.least(F.col("w") / F.col("_half"), F.lit(1.0)).alias("concept_score"))  # one row


def author_match(authorship: DataFrame, wanted: DataFrame) -> DataFrame:
    """(paper_id, author_score): half for each wanted author, 1 at most. wanted(coauthor_id)."""
    return authorship.join(wanted, "coauthor_id", "left_semi").groupBy("paper_id").agg(F.least(F.count("*") / 2, F.lit(1.0)).alias("author_score"))


def agent_relevance(papers: DataFrame, concept: DataFrame, author: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Weighted sum of concept, author, citation, recency and quality scores."""
    joined = papers.join(concept, "paper_id", "left").join(author, "paper_id", "left").fillna(0.0, ["concept_score", "author_score"])
    total = (
        0.35 * F.col("concept_score") + 0.15 * F.col("author_score") + 0.20 * citation_score("citation_count") + 0.15 * recency_score("year", p)
        + 0.15 * quality_score(F.lit(False), F.col("is_seed"), F.lit(True), F.col("venue").isNotNull())
    )
    return joined.withColumn("relevance", total)


def seed_weights(concepts: DataFrame, seeds: DataFrame, how: str = "sum", least: float = 0.5) -> DataFrame:
    """(name, weight, is_core): the seeds' concept scores summed or at most, a tenth for general concepts."""
    own = concepts.where(F.col("score") >= least).join(seeds.select("paper_id"), "paper_id", "left_semi")
    low = F.lower("name")
    value = F.when(low.isin(*GENERIC_CONCEPTS), F.col("score") * 0.1).otherwise(F.col("score"))
    total = F.sum(value) if how == "sum" else F.max(value)
    return own.groupBy(low.alias("name")).agg(total.alias("weight"), (~F.first(low.isin(*GENERIC_CONCEPTS))).alias("is_core"))


def topical_scores(concepts: DataFrame, weights: DataFrame, top: int = 7) -> DataFrame:
    """(paper_id, topical): share-weighted matches with the seeds' concepts over the number of core concepts, 1 at most.

    concepts need ``share``, a score from 0 to 1.
    """
    core = weights.agg(F.greatest(F.count_if("is_core"), F.lit(1)).alias("_core"), F.max("weight").alias("_most"))
    hits = concepts.where(F.col("pos") <= top).select("paper_id", F.lower("name").alias("name"), "share").join(weights, "name")
    worth = F.col("share") * F.when(F.col("is_core"), 1.0).otherwise(0.2) * F.col("weight")
    summed = hits.groupBy("paper_id").agg(F.sum(worth).alias("w"))
    return summed.crossJoin(F.broadcast(core)).select("paper_id", F.least(F.col("w") / F.col("_most") / F.sqrt("_core"), F.lit(1.0)).alias("topical"))  # one row


def breakpoints(values: DataFrame, column: str, by: list[str], key: str, first: int = 100) -> DataFrame:
    """For each group three places to cut a falling list: mean + deviation (population), largest gap and largest bend in the first hundred.

    Only the hundred largest values of a group, and the one behind them, are put in order; the rest is aggregated.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(column), key)
    top = values.withColumn("i", F.row_number().over(w)).where(F.col("i") <= first + 1)
    near = top.withColumn("before", F.lag(column).over(w)).withColumn("after", F.lead(column).over(w)).where(F.col("i") <= first)
    level = values.groupBy(*by).agg((F.avg(column) + F.stddev_pop(column)).alias("level"))
    above = values.join(level, by).groupBy(*by).agg(F.count_if(F.col(column) >= F.col("level")).alias("by_deviation"))
    gap = near.where("before is not null").groupBy(*by).agg(F.max_by(F.col("i") - 1, F.struct(F.round(F.col("before") - F.col(column), 6), -F.col("i"))).cast("bigint").alias("by_gap"))
    bend = F.abs(F.col("before") - 2 * F.col(column) + F.col("after"))
    elbow = near.where("before is not null and after is not null").groupBy(*by).agg(F.max_by("i", F.struct(F.round(bend, 6), -F.col("i"))).cast("bigint").alias("by_elbow"))
    return above.join(gap, by, "left").join(elbow, by, "left")


def pick_breakpoint(found: DataFrame, by: list[str], target: int, least: int) -> DataFrame:
    """Of the three cuts the one of ``least`` or more nearest to ``target``."""
    rows = found.select(*by, F.explode(F.array("by_deviation", "by_gap", "by_elbow")).alias("cut")).where(F.col("cut") >= least)
    return rows.groupBy(*by).agg(F.min_by("cut", F.struct(F.abs(F.col("cut") - target), "cut")).alias("cut"))


def leaders(papers: DataFrame, topical: DataFrame, authorship: DataFrame, least: float, top: int = 50) -> DataFrame:
    """Authors by 2 topical papers + ln(1 + citations) + half the active years; two topical papers at least."""
    marked = papers.join(topical, "paper_id", "left").fillna(0.0, ["topical"])
    each = authorship.join(marked, "paper_id").groupBy("coauthor_id").agg(
        F.count("*").alias("papers"),
        F.count_if(F.col("topical") >= least).alias("topical_papers"),
        F.sum("citation_count").alias("citations"),
        (F.max("year") - F.min("year") + 1).alias("years"),
    )
    worth = 2 * F.col("topical_papers") + F.log1p("citations") + 0.5 * F.col("years")
    return each.where("topical_papers >= 2").withColumn("significance", worth).orderBy(F.desc("significance"), "coauthor_id").limit(top)


def tier_of(name: Column, first: list[str], second: list[str]) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.isin(*[x.lower() for x in first]), 1).when(low.isin(*[x.lower() for x in second]), 2).otherwise(3)


def tiered(papers: DataFrame, first: list[str], second: list[str], position: str, limit: int, strategy: str = "tiered") -> DataFrame:
    """Papers by tier of their venue and then in input order; "tier1_only" keeps the first tier, "ocean" the input order."""
    ranked = papers.withColumn("tier", tier_of(F.col("venue"), first, second))
    if strategy == "tier1_only":
        ranked = ranked.where("tier = 1")
    order = [F.col(position)] if strategy == "ocean" else [F.col("tier"), F.col(position)]
    return ranked.orderBy(*order).limit(limit)


def tiered_fill(papers: DataFrame, first: list[str], second: list[str], position: str, limit: int) -> DataFrame:
    """Like ``tiered``, but the third tier fills up only if the others fill less than half."""
    ranked = papers.withColumn("tier", tier_of(F.col("venue"), first, second))
    filled = ranked.where("tier < 3").limit(limit).agg((F.count("*") * 2 < limit).alias("_open"))
    return ranked.crossJoin(F.broadcast(filled)).where("tier < 3 or _open").drop("_open").orderBy("tier", position).limit(limit)  # filled is one row


def reading_list(papers: DataFrame, topical: DataFrame, limit: int = 50) -> DataFrame:
    """Seeds first, then by topical / (1 + 0.3 depth) + 0.1 ln(1 + citations), over 0.1 only. papers need ``depth``."""
    score = F.coalesce("topical", F.lit(0.0)) / (1 + 0.3 * F.col("depth")) + 0.1 * F.log1p("citation_count")
    scored = papers.join(topical, "paper_id", "left").withColumn("score", score).where(F.col("is_seed") | (F.col("score") > 0.1))
    return scored.orderBy(F.desc("is_seed"), F.desc("score"), "paper_id").limit(limit)


def reading_priority(is_seed: Column, relevance: Column, by_key_author: Column, year: Column, citations: Column, p: Params = DEFAULT) -> Column:
    """Category of a reading item: seed, key_author or highly_relevant, foundational, recent, background."""
    return (
        F.when(is_seed, "seed")
        .when((relevance > 0.6) & by_key_author, "key_author")
        .when(relevance > 0.6, "highly_relevant")
        .when(citation_score(citations) > 0.7, "foundational")
        .when(year >= p.as_of_year - 2, "recent")
        .otherwise("background")
    )


def key_authors(seed_authors: DataFrame, linked_authors: DataFrame, top: int = 20) -> DataFrame:
    """Authors by how often they occur around the seeds, seed authors five more; two at least. Both: (coauthor_id)."""
    votes = linked_authors.select("coauthor_id", F.lit(1).alias("w")).unionAll(seed_authors.select("coauthor_id").distinct().withColumn("w", F.lit(5)))
    return votes.groupBy("coauthor_id").agg(F.sum("w").alias("votes")).where("votes >= 2").orderBy(F.desc("votes"), "coauthor_id").limit(top)


def entropy(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """Shannon entropy of counts in each group over log2 of the number of values; 0 for one value."""
    total = F.sum(n).over(Window.partitionBy(*by))
    share = counts.select(*by, (F.col(n) / total).alias("p"))
    return share.groupBy(*by).agg(F.when(F.count("*") > 1, F.sum(-F.col("p") * F.log2("p")) / F.log2(F.count("*").cast("double"))).otherwise(0.0).alias("entropy"))


def scope_risk(volume: Column, entropy: Column, venue_entropy: Column, specificity: Column) -> tuple[Column, Column]:
    """Risk and band of a topic's scope."""
    size = F.least(F.log10(volume + 1) / 5, F.lit(1.0))
    risk = 0.45 * size + 0.25 * entropy + 0.20 * venue_entropy + 0.10 * (1 - specificity)
    return risk, F.when((volume > 20_000) | (risk > 0.75), "RED").when((volume > 5_000) | (risk > 0.55), "YELLOW").otherwise("GREEN")


def landscape(papers: DataFrame, authorship: DataFrame, by: str, peaks: int = 3) -> DataFrame:
    """Papers, distinct authors and peak years of each part of a field."""
    years = papers.groupBy(by, "year").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "year")
    best = years.withColumn("r", F.row_number().over(w)).where(F.col("r") <= peaks).groupBy(by).agg(F.array_sort(F.collect_list("year")).alias("peak_years"))
    people = papers.join(authorship, "paper_id").groupBy(by).agg(F.countDistinct("coauthor_id").alias("authors"))
    return papers.groupBy(by).agg(F.count("*").alias("papers")).join(people, by, "left").join(best, by, "left")
