"""Data-quality checks as one boolean column each, turned into rows, and their weighted confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.params import DEFAULT, Params

#: Weight of a check by its severity.
SEVERITY = {"error": 1.0, "warning": 0.5, "info": 0.1}


def paper_checks(p: Params = DEFAULT) -> dict[str, tuple[Column, str]]:
    """Name -> (passed, severity) for paper rows."""
    year, cites = F.col("year"), F.col("citation_count")
    return {
        "has_id": (F.col("paper_id").isNotNull(), "error"),
        "has_year": (year.isNotNull(), "warning"),
        "year_in_range": (year.between(1800, 2030), "error"),
        "not_in_the_future": (year <= p.as_of_year, "warning"),
        "citations_not_negative": (cites >= 0, "error"),
        "has_venue": (F.col("venue").isNotNull() & (F.col("venue") != ""), "info"),
        "plausible_citations": (cites < 1_000_000, "warning"),
    }


def run_checks(rows: DataFrame, by: list[str], checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(by, name, severity, rows, failed) for each check; a null counts as failed."""
    flags = rows.select(*by, *(F.coalesce(c, F.lit(False)).alias(n) for n, (c, _) in checks.items()))
    sums = flags.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(~F.col(n)).alias(n) for n in checks))
    pairs = ", ".join(f"'{n}', '{s}', `{n}`" for n, (_, s) in checks.items())
    return sums.select(*by, "rows", F.expr(f"stack({len(checks)}, {pairs}) as (name, severity, failed)"))


def confidence(results: DataFrame, by: list[str]) -> DataFrame:
    """Weighted share of passed checks, errors and warnings, and whether no error failed. results(..., severity, failed)."""
    weight = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("severity")]
    ok = F.col("failed") == 0
    return results.groupBy(*by).agg(
        (F.sum(F.when(ok, weight).otherwise(0.0)) / F.sum(weight)).alias("confidence"),
        F.count_if(~ok & (F.col("severity") == "error")).alias("errors"),
        F.count_if(~ok & (F.col("severity") == "warning")).alias("warnings"),
        (F.count_if(~ok & (F.col("severity") == "error")) == 0).alias("passed"),
    )


# ---- checks of the stages' results ---------------------------------------------------------------------------------

STAGE = "agent string, key string, name string, severity string, passed boolean"


def evaluate(rows: DataFrame, key: str, agent: str, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(agent, key, name, severity, passed): one row for each check of each summary row; a null counts as failed."""
    flags = rows.select(F.col(key).cast("string").alias("key"), *(F.coalesce(c, F.lit(False)).alias(n) for n, (c, _) in checks.items()))
    pairs = ", ".join(f"'{n}', '{s}', `{n}`" for n, (_, s) in checks.items())
    return flags.select(F.lit(agent).alias("agent"), "key", F.expr(f"stack({len(checks)}, {pairs}) as (name, severity, passed)"))


def by_check(results: DataFrame) -> DataFrame:
    """(agent, name, severity, rows, failed)."""
    return results.groupBy("agent", "name", "severity").agg(F.count("*").alias("rows"), F.count_if(~F.col("passed")).alias("failed"))


def seed_checks(papers: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """papers(paper_id, title, doi, sought_doi, year, authors): what was found for each seed."""
    filled = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0
    return evaluate(
        papers, "paper_id", "seed_resolver",
        {
            "result_exists": (filled("paper_id"), "error"),
            "has_required_fields": (filled("paper_id") & filled("title"), "error"),
            "doi_matches": (F.col("sought_doi").isNull() | (F.lower("doi") == F.lower("sought_doi")), "error"),
            "year_plausible": (F.col("year").isNull() | F.col("year").between(1800, p.as_of_year + 1), "warning"),
            "has_authors": (F.size("authors") > 0, "warning"),
            "title_length": (F.length("title") >= 10, "info"),
        },
    )


def citation_checks(seeds: DataFrame, edges: DataFrame, papers: DataFrame) -> DataFrame:
    """References and citations of each seed(node): counts, that 0.7 of them are older and newer, no self reference. papers(node, year)."""
    year = papers.select("node", "year")
    own = seeds.select("node").join(year, "node", "left").withColumnRenamed("year", "own_year")
    back = own.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("ref")), "node").join(year.toDF("ref", "y"), "ref", "left")
    refs = back.groupBy("node").agg(F.count("*").alias("refs"), F.count_if(F.col("y") <= F.col("own_year")).alias("older"), F.count_if(F.col("y").isNotNull()).alias("dated"), F.count_if(F.col("ref") == F.col("node")).alias("selves"))
    into = own.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("cite")), "node").join(year.toDF("cite", "y"), "cite", "left")
    cites = into.groupBy("node").agg(F.count_if(F.col("y") >= F.col("own_year")).alias("newer"), F.count_if(F.col("y").isNotNull()).alias("dated_cites"))
    rows = own.join(refs, "node", "left").join(cites, "node", "left").fillna(0, ["refs", "older", "dated", "selves", "newer", "dated_cites"])
    return evaluate(
        rows, "node", "citation_walker",
        {
            "result_exists": (F.col("own_year").isNotNull(), "error"),
            "has_references": (F.col("refs") > 0, "warning"),
            "ref_count_reasonable": (F.col("refs") < 500, "warning"),
            "refs_are_older": ((F.col("dated") == 0) | (F.col("older") >= 0.7 * F.col("dated")), "warning"),
            "cites_are_newer": ((F.col("dated_cites") == 0) | (F.col("newer") >= 0.7 * F.col("dated_cites")), "warning"),
            "no_self_reference": (F.col("selves") == 0, "error"),
        },
    )


def author_checks(found: DataFrame) -> DataFrame:
    """found(author_id, sought_name, name, openalex_id, paper_count, similarity, context_similarity): what a name was resolved to."""
    return evaluate(
        found, "author_id", "author_resolver",
        {
            "result_exists": (F.col("author_id").isNotNull(), "error"),
            "has_openalex_id": (F.length("openalex_id") > 0, "error"),
            "name_matches": (F.col("similarity") >= 0.5, "warning"),
            "has_papers": (F.col("paper_count") > 0, "warning"),
            "context_match": (F.col("context_similarity").isNull() | (F.col("context_similarity") >= 0.7), "warning"),
            "paper_count_plausible": (F.col("paper_count").between(1, 5_000), "info"),
        },
    )


def corpus_checks(papers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each author's fetched papers against the profile: papers(author_id, paper_id, title, year), profiles(author_id, expected)."""
    sums = papers.groupBy("author_id").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("ids"), (F.max("year") - F.min("year")).alias("span"))
    rows = profiles.join(sums, "author_id", "left").fillna(0, ["n", "ids"])
    return evaluate(
        rows, "author_id", "corpus_fetcher",
        {
            "papers_not_empty": (F.col("n") > 0, "error"),
            "no_duplicates": (F.col("n") == F.col("ids"), "warning"),
            "count_matches_profile": ((F.coalesce("expected", F.lit(0)) <= 0) | F.try_divide("n", "expected").between(0.3, 1.5), "warning"),
            "years_span_reasonable": (F.col("span").isNull() | (F.col("span") <= 70), "info"),
        },
    )


def trajectory_checks(papers: DataFrame, phases: DataFrame) -> DataFrame:
    """Phases of each author: papers(author_id, year), phases(author_id, start_year, end_year, concepts)."""
    span = papers.groupBy("author_id").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    after = F.lead("start_year").over(Window.partitionBy("author_id").orderBy("start_year", "end_year"))
    each = phases.withColumn("_next", after)
    sums = each.groupBy("author_id").agg(
        F.count("*").alias("n"), F.min("start_year").alias("a"), F.max("end_year").alias("b"), F.count_if(F.col("end_year") > F.col("_next")).alias("overlaps"), F.count_if(F.size("concepts") > 0).alias("named")
    )
    rows = span.join(sums, "author_id", "left").fillna(0, ["n", "overlaps", "named"])
    none = F.col("n") == 0
    return evaluate(
        rows, "author_id", "trajectory_analyzer",
        {
            "has_phases": (~none, "warning"),
            "phases_cover_range": (none | ((F.col("a") <= F.col("first") + 3) & (F.col("b") >= F.col("last") - 1)), "warning"),
            "phases_non_overlapping": (F.col("overlaps") == 0, "error"),
            "phases_have_concepts": (F.col("named") == F.col("n"), "warning"),
        },
    )


def collaborator_checks(papers: DataFrame, authorship: DataFrame, found: DataFrame) -> DataFrame:
    """Collaborators of each author against the papers: found(author_id, coauthor_id, papers, rank), whose first must be there in half the papers claimed."""
    own = papers.select("author_id", "paper_id")
    written = own.groupBy("author_id").agg(F.countDistinct("paper_id").alias("written"))
    shared = own.join(authorship, "paper_id").groupBy("author_id").agg(F.countDistinct("coauthor_id").alias("people"))
    best = found.groupBy("author_id").agg(F.count("*").alias("n"), F.max("papers").alias("most"), F.count_if(F.col("coauthor_id") == F.col("author_id")).alias("selves"))
    first = found.where("rank = 1").select("author_id", "coauthor_id", F.col("papers").alias("claimed"))
    seen = first.join(own, "author_id").join(authorship, ["paper_id", "coauthor_id"]).groupBy("author_id").agg(F.countDistinct("paper_id").alias("seen"))
    rows = written.join(shared, "author_id", "left").join(best, "author_id", "left").join(first.select("author_id", "claimed"), "author_id", "left").join(seen, "author_id", "left")
    rows = rows.fillna(0, ["people", "n", "most", "selves", "claimed", "seen"])
    return evaluate(
        rows, "author_id", "collaborator_mapper",
        {
            "has_collaborators": ((F.col("people") == 0) | (F.col("n") > 0), "warning"),
            "no_self_collab": (F.col("selves") == 0, "error"),
            "collab_counts_valid": (F.col("most") <= F.col("written"), "warning"),
            "top_collab_verifiable": (F.col("seen") >= 0.5 * F.col("claimed"), "warning"),
        },
    )


def topic_checks(topics: DataFrame, total: DataFrame) -> DataFrame:
    """Topics of one corpus: topics(name, papers, is_core, is_emerging, is_declining), total(n) of one row."""
    sums = topics.agg(
        F.count_if("is_core").alias("core"), F.avg(F.when(F.col("is_core"), F.col("papers"))).alias("mean"), F.count_if(F.col("is_core") & F.col("is_declining")).alias("both"), F.count_if("is_emerging").alias("emerging")
    )
    rows = sums.crossJoin(F.broadcast(total)).withColumn("key", F.lit("corpus"))  # one row each
    return evaluate(
        rows, "key", "topic_extractor",
        {
            "has_topics": (F.col("core") > 0, "warning"),
            "core_topics_frequent": ((F.col("core") == 0) | (F.col("mean") >= 0.03 * F.col("n")), "warning"),
            "no_core_declining_overlap": (F.col("both") == 0, "warning"),
            "has_emerging_topics": (F.lit(True), "info"),
        },
    )


def gap_checks(gaps: DataFrame, concepts: DataFrame) -> DataFrame:
    """Gaps(a, b, both, a_only, b_only, gap) against the concepts(name): both exist, the score is bounded, at most a tenth of the rarer one's papers join them."""
    names = concepts.select("name").distinct()
    known = gaps.join(names.select(F.col("name").alias("a"), F.lit(True).alias("_a")), "a", "left").join(names.select(F.col("name").alias("b"), F.lit(True).alias("_b")), "b", "left")
    rarer = F.least(F.col("a_only"), F.col("b_only")) + F.col("both")
    return evaluate(
        known.withColumn("key", F.concat_ws(" | ", "a", "b")), "key", "gap_detector",
        {
            "concepts_exist": (F.col("_a") & F.col("_b"), "error"),
            "gap_scores_bounded": (F.col("gap").between(0, 1), "error"),
            "gaps_are_actual_gaps": (F.col("both") <= 0.1 * rarer, "warning"),
        },
    )


def relevance_checks(scored: DataFrame) -> DataFrame:
    """scored(paper_id, scored_id, relevance, parts array<double>, is_highly_relevant, explanation)."""
    bounded = lambda c: c.between(0, 1)
    return evaluate(
        scored, "paper_id", "relevance_scorer",
        {
            "scores_bounded": (bounded(F.col("relevance")) & F.forall("parts", bounded), "error"),
            "highly_relevant_justified": (~F.col("is_highly_relevant") | (F.col("relevance") >= 0.6), "warning"),
            "paper_id_matches": (F.col("paper_id") == F.col("scored_id"), "error"),
            "explanation_present": (F.length("explanation") > 0, "warning"),
        },
    )


def field_checks(resolved: DataFrame) -> DataFrame:
    """resolved(key, field, confidence, tier1, tier2, key_concepts, evidence, strategy, title, query)."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    words = F.filter(F.split(low(F.col("field")), r"\s+"), lambda w: w != "")
    return evaluate(
        resolved, "key", "field_resolver",
        {
            "has_primary_field": (F.col("field").isNotNull(), "error"),
            "field_has_name": (F.length("field") > 0, "error"),
            "confidence_bounded": (F.col("confidence").between(0, 1), "error"),
            "has_journal_tiers": (F.size("tier1") > 0, "warning"),
            "has_key_concepts": (F.size("key_concepts") > 0, "warning"),
            "has_evidence": (F.size("evidence") > 0, "warning"),
            "strategy_valid": (F.col("strategy").isin("tiered", "tier1_only", "ocean"), "error"),
            "field_relevant_to_paper": (F.col("title").isNull() | F.exists("key_concepts", lambda c: low(F.col("title")).contains(F.lower(c))), "info"),
            "field_relevant_to_query": (F.col("query").isNull() | F.exists(words, lambda w: low(F.col("query")).contains(w)), "info"),
        },
    )
