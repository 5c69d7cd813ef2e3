"""Classes, guards and short texts about papers, topics and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.params import DEFAULT, Params

#: Words and venues that make a paper a method's.
METHOD_WORDS = ("method", "software", "tool", "package", "algorithm", "database", "platform", "framework", "pipeline", "server", "web server", "online tool", "command-line")

#: Parts of venue names.
CONFERENCE_WORDS = ("conference", "proceedings", "proc.", "symposium", "workshop", "meeting", "congress", "summit", "icml", "neurips", "cvpr", "acl", "emnlp", "iclr", "aaai", "ijcai", "chi", "sigir")
PREPRINT_WORDS = ("arxiv", "biorxiv", "medrxiv", "chemrxiv", "preprint", "ssrn", "research square", "authorea")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    low, hit = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def hub_kind(title: Column, is_review: Column, year: Column, citations: Column) -> Column:
    """What kind of hub: methodology, else review, else foundational (before 2000, over 1000 citations), else high_citation."""
    old = F.coalesce((year < 2000) & (citations > 1_000), F.lit(False))
    return F.when(has_any(title, METHOD_WORDS), "methodology").when(F.coalesce(is_review, F.lit(False)), "review").when(old, "foundational").otherwise("high_citation")


def work_type(venue: Column, is_review: Column | None = None) -> Column:
    """review where it is marked, else by the venue's name: conference, preprint, journal; unknown without a venue."""
    kind = F.when(has_any(venue, CONFERENCE_WORDS), "conference").when(has_any(venue, PREPRINT_WORDS), "preprint").when(F.coalesce(F.trim(venue), F.lit("")) != "", "journal").otherwise("unknown")
    return kind if is_review is None else F.when(F.coalesce(is_review, F.lit(False)), "review").otherwise(kind)


def work_types(papers: DataFrame, by: str, venue: str = "venue") -> DataFrame:
    """(by, work_type, papers, share)."""
    counts = papers.groupBy(by, work_type(F.col(venue)).alias("work_type")).agg(F.count("*").alias("papers"))
    return counts.withColumn("share", F.col("papers") / F.sum("papers").over(Window.partitionBy(by)))


def categorise(topics: DataFrame, total: DataFrame, most: int = 10) -> DataFrame:
    """(category, rank, name): core, emerging, declining and specific topics, the first ``most`` of each by weight.

    A topic is core if it is broad or in over a tenth of the papers. topics(name, papers, weight, kind, trend), total(n) is one row.
    """
    t = topics.crossJoin(F.broadcast(total.select(F.col("n").alias("_n"))))
    of = {
        "core": (F.col("kind") == "broad") | (F.col("papers") > F.col("_n") * 0.1),
        "emerging": F.col("trend").isin("emerging", "new"),
        "declining": F.col("trend") == "declining",
        "specific": F.col("kind") == "specific",
    }
    each = t.select("name", "weight", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in of.items())))).alias("category"))
    rank = Window.partitionBy("category").orderBy(F.desc("weight"), "name")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).select("category", "rank", "name")


def is_related(concept: Column, focus: Column) -> Column:
    """Whether a concept shares a word with one of an array of focus concepts."""
    words = F.split(F.trim(F.lower(concept)), r"\s+")
    return F.exists(focus, lambda f: F.arrays_overlap(words, F.split(F.trim(F.lower(f)), r"\s+")))


def metadata_score(doi: Column, year: Column, citations: Column, abstract: Column) -> Column:
    """How complete a record is: 3 for a DOI, 1 for a year, up to 2 for citations, 1 for an abstract."""
    filled = lambda c: (F.coalesce(c.cast("string"), F.lit("")) != "").cast("int")
    return (3 * filled(doi) + filled(year) + F.least(F.coalesce(citations, F.lit(0)) / 100, F.lit(2.0)) + filled(abstract)).cast("double")


def best_title_match(pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, score): of the records whose titles match, the most complete; of equals the smallest id.

    pairs(left_id, right_id, doi, year, citation_count, abstract), as ``fuzzy_titles`` finds and a join completes them.
    """
    scored = pairs.withColumn("score", metadata_score(F.col("doi"), F.col("year"), F.col("citation_count"), F.col("abstract")))
    rank = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return scored.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("left_id", "right_id", "score")


def phrase_and_review_bonus(score: Column, title: Column, query: str, is_review: Column) -> Column:
    """0.3 more if the title has the whole query, then 0.1 more for a review over 0.1; 1 at most."""
    phrase = F.lower(F.coalesce(title, F.lit(""))).contains(query.lower())
    with_phrase = F.when(phrase, F.least(score + 0.3, F.lit(1.0))).otherwise(score)
    return F.when(F.coalesce(is_review, F.lit(False)) & (with_phrase > 0.1), F.least(with_phrase + 0.1, F.lit(1.0))).otherwise(with_phrase)


# ---- guards that the documents ask for -----------------------------------------------------------------------------


def bridge_allowance(gate: Column, relevance: Column, citations: Column) -> Column:
    """The gate's edge type; a paper of 500 citations and relevance 0.15 that it turns away may stay as CITES."""
    return F.coalesce(gate, F.when((citations >= 500) & (relevance >= 0.15), "CITES"))


def diversity_guard(ranked: DataFrame, by: str, order: list, limit: int, share: float = 0.4) -> DataFrame:
    """The best ``limit`` rows with at most ``share`` of the places for one value of ``by``; null values are one value."""
    own = Window.partitionBy(by).orderBy(*order)
    return ranked.withColumn("_place", F.row_number().over(own)).where(F.col("_place") <= max(1, int(limit * share))).orderBy(*order).limit(limit).drop("_place")


def novelty(concepts: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, novelty): share of a paper's concepts that no earlier year has."""
    dated = concepts.select("paper_id", "name").distinct().join(papers.select("paper_id", "year"), "paper_id")
    first = dated.groupBy("name").agg(F.min("year").alias("first_year"))
    return dated.join(first, "name").groupBy("paper_id").agg(F.avg((F.col("year") == F.col("first_year")).cast("double")).alias("novelty"))


# ---- texts ---------------------------------------------------------------------------------------------------------


def relevance_text(relevance: Column, concept: Column, author: Column, citations: Column) -> Column:
    """Why a paper is relevant, the reasons joined by semicolons."""
    level = F.when(relevance >= 0.6, "highly relevant").when(relevance >= 0.3, "relevant").otherwise("marginal")
    reasons = [F.when(concept > 0.5, "shares the topic's concepts"), F.when(author > 0, "by a wanted author"), F.when(citations >= 100, F.format_string("%d citations", citations.cast("bigint")))]
    return F.concat(level, F.lit(": "), F.coalesce(F.nullif(F.concat_ws("; ", *reasons), F.lit("")), F.lit("no single strong reason")))


def gap_text(a: Column, b: Column, both: Column, a_only: Column, b_only: Column) -> Column:
    return F.format_string("%s (%d papers) and %s (%d papers) meet in %d", a, (a_only + both).cast("bigint"), b, (b_only + both).cast("bigint"), both.cast("bigint"))


def trajectory_text(kind: Column, years: Column, jumps: Column, phases: Column) -> Column:
    return F.format_string("%s career of %d years, %d jumps, %d phases", kind, years.cast("bigint"), jumps.cast("bigint"), phases.cast("bigint"))


def collaborator_text(papers: Column, first_year: Column, last_year: Column, p: Params = DEFAULT) -> Column:
    """Number and years of shared papers, with whether the collaboration goes on."""
    state = F.when(last_year >= p.as_of_year - 2, "active").otherwise("past")
    return F.format_string("%s: %d papers, %d-%d", state, papers.cast("bigint"), first_year.cast("bigint"), last_year.cast("bigint"))
