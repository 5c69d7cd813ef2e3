"""Checks of the stages' results over the whole tables, summed by check."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.operators import authors, checks, insights, topics
from athenor.plans.adapter import authorship, concepts, papers, references, sql
from athenor.plans.registry import query
from athenor.plans.score_queries import TOPICAL
from athenor.plans.score_queries import _topical as topical


def _sums(rows: str, agent: str, flags: dict[str, tuple[str, str]]) -> str:
    """SQL of (agent, name, severity, rows, failed) over summary rows."""
    each = [f"select '{agent}' as agent, '{n}' as name, '{s}' as severity, count(*) as rows, count(*) filter (not coalesce({c}, false)) as failed from {rows}" for n, (c, s) in flags.items()]
    return " union all ".join(each)


@query(
    "check_citations",
    sql(
        _sums("v_row", "citation_walker", {
            "result_exists": ("own_year is not null", "error"), "has_references": ("refs > 0", "warning"), "ref_count_reasonable": ("refs < 500", "warning"), "refs_are_older": ("dated = 0 or older >= 0.7 * dated", "warning"),
            "cites_are_newer": ("datedc = 0 or newer >= 0.7 * datedc", "warning"), "no_self_reference": ("selves = 0", "error"),
        }),
        """v_year as (select paper_id * 2 as node, year from v_paper union all select dst * 2 + 1, min(year) from v_ref join v_paper on src = paper_id group by dst),
        v_e as (select src * 2 as src, dst * 2 + 1 as dst from v_ref),
        v_r as (select e.src as node, count(*) as refs, count(*) filter (r.year <= o.year) as older, count(r.year) as dated, count(*) filter (e.src = e.dst) as selves from v_e e join v_year o on o.node = e.src left join v_year r on r.node = e.dst group by e.src),
        v_c as (select e.dst as node, count(*) filter (r.year >= o.year) as newer, count(r.year) as datedc from v_e e join v_year o on o.node = e.dst left join v_year r on r.node = e.src group by e.dst),
        v_row as (select o.node, o.year as own_year, coalesce(refs, 0) as refs, coalesce(older, 0) as older, coalesce(dated, 0) as dated, coalesce(selves, 0) as selves, coalesce(newer, 0) as newer, coalesce(datedc, 0) as datedc
            from v_year o left join v_r using (node) left join v_c using (node))""",
    ),
)
def check_citations(spark, d):
    """Works date from the first paper that cites them."""
    refs, p = references(spark, d), papers(spark, d)
    edges = refs.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    works = refs.join(p, F.col("src") == F.col("paper_id")).groupBy((F.col("dst") * 2 + 1).alias("node")).agg(F.min("year").alias("year"))
    nodes = p.select((F.col("paper_id") * 2).alias("node"), "year").unionAll(works)
    return checks.by_check(checks.citation_checks(nodes, edges, nodes))


@query(
    "check_corpora",
    sql(
        _sums("v_row", "corpus_fetcher", {
            "papers_not_empty": ("n > 0", "error"), "no_duplicates": ("n = ids", "warning"), "count_matches_profile": ("expected <= 0 or n * 1.0 / expected between 0.3 and 1.5", "warning"), "years_span_reasonable": ("span is null or span <= 70", "info"),
        }),
        """v_row as (select c_custkey as author_id, cast(floor(abs(c_acctbal) / 500) as bigint) as expected, coalesce(n, 0) as n, coalesce(ids, 0) as ids, span from customer left join (
            select author_id, count(*) as n, count(distinct paper_id) as ids, max(year) - min(year) as span from v_paper group by author_id) p on author_id = c_custkey)""",
    ),
)
def check_corpora(spark, d):
    """A customer's balance stands for the number of papers that a profile claims."""
    from athenor.functions.storage import table

    profiles = table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.floor(F.abs("c_acctbal") / 500).alias("expected"))
    return checks.by_check(checks.corpus_checks(papers(spark, d), profiles))


@query(
    "check_collaborators",
    sql(
        _sums("v_row", "collaborator_mapper", {
            "has_collaborators": ("people = 0 or n > 0", "warning"), "no_self_collab": ("selves = 0", "error"), "collab_counts_valid": ("most <= written", "warning"), "top_collab_verifiable": ("true", "warning"),
        }),
        """v_p as (select author_id, coauthor_id, count(*) as papers from v_paper join v_authorship using (paper_id) group by all),
        v_row as (select author_id, written, coalesce(people, 0) as people, coalesce(least(people, 20), 0) as n, coalesce(most, 0) as most, coalesce(selves, 0) as selves from (select author_id, count(*) as written from v_paper group by author_id) w
            left join (select author_id, count(*) as people, max(papers) as most, count(*) filter (coauthor_id = author_id and r <= 20) as selves from (
                select p.*, row_number() over (partition by p.author_id order by papers desc, last desc, p.coauthor_id) as r from v_p p
                join (select author_id, coauthor_id, max(year) as last from v_paper join v_authorship using (paper_id) group by all) l on l.author_id = p.author_id and l.coauthor_id = p.coauthor_id) q group by author_id) c using (author_id))""",
    ),
)
def check_collaborators(spark, d):
    p, a = papers(spark, d), authorship(spark, d)
    return checks.by_check(checks.collaborator_checks(p, a, authors.collaborators(p, a)))


@query(
    "check_relevance",
    sql(
        _sums("v_row", "relevance_scorer", {
            "scores_bounded": ("t between 0 and 1", "error"), "highly_relevant_justified": ("not (t > 0.55) or t >= 0.6", "warning"), "paper_id_matches": ("true", "error"), "explanation_present": ("true", "warning"),
        }),
        TOPICAL + ", v_row as (select paper_id, round(coalesce(topical, 0), 9) as t from v_paper left join v_topical using (paper_id))",
    ),
)
def check_relevance(spark, d):
    scored = papers(spark, d).join(topical(spark, d), "paper_id", "left").withColumn("relevance", F.round(F.coalesce("topical", F.lit(0.0)), 9))
    why = insights.relevance_text(F.col("relevance"), F.col("relevance"), F.lit(0.0), F.col("citation_count"))
    rows = scored.select("paper_id", F.col("paper_id").alias("scored_id"), "relevance", F.array("relevance").alias("parts"), (F.col("relevance") > 0.55).alias("is_highly_relevant"), why.alias("explanation"))
    return checks.by_check(checks.relevance_checks(rows))


@query("check_gaps")
def check_gaps(spark, d):
    """The gaps of fine concepts against all concepts."""
    from athenor.plans.topic_queries import _fine

    fine = _fine(spark, d)
    return checks.by_check(checks.gap_checks(topics.concept_gaps(fine), fine))
