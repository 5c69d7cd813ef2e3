"""Queries that score and rank papers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from athenor.functions import exprs
from athenor.operators import checks, relevance
from athenor.plans.adapter import authorship, concepts, papers, references, sql
from athenor.plans.registry import query


@query(
    "recency_impact",
    sql("select paper_id, round(0.5 * greatest(0, 1 - (2002 - year) / 10.0) + 0.5 * least(log10(citation_count + 1) / 4, 1), 6) as impact from v_paper"),
)
def recency_impact(spark, d):
    return papers(spark, d).select("paper_id", F.round(exprs.recency_impact("year", "citation_count"), 6).alias("impact"))


@query(
    "agent_relevance",
    sql(
        """select paper_id, round(0.35 * least(coalesce(w, 0) / half, 1) + 0.15 * least(coalesce(m, 0) / 2.0, 1) + 0.20 * least(ln(1 + citation_count) / ln(101), 1)
            + 0.15 * exp(-0.1 * (2002 - year)) + 0.15 * (0.5 + 0.1 * (case when is_seed then 3 else 2 end)), 6) as relevance from v_paper
            left join (select paper_id, sum(weight) as w from (select distinct paper_id, lower(name) as name from v_concept) c join v_context using (name) group by paper_id) a using (paper_id)
            left join (select paper_id, count(*) as m from v_authorship where coauthor_id in (select coauthor_id from v_authorship join v_paper using (paper_id) where is_seed) group by paper_id) b using (paper_id), (select sum(weight) / 2 as half from v_context) h""",
        """v_context as (select name, sum(w) as weight from (select 'small' as name, 2.0 as w union all select 'large', 1.0 union all
            select lower(name), score from v_concept where paper_id in (select paper_id from v_paper where is_seed)) t group by name)""",
    ),
)
def agent_relevance(spark, d):
    p, c, a = papers(spark, d), concepts(spark, d), authorship(spark, d)
    context = relevance.context_weights(c, ["SMALL"], p.where("is_seed"), ["large"])
    wanted = a.join(p.where("is_seed"), "paper_id", "left_semi").select("coauthor_id").distinct()
    scored = relevance.agent_relevance(p, relevance.concept_match(c, context), relevance.author_match(a, wanted))
    return scored.select("paper_id", F.round("relevance", 6).alias("relevance"))


TOPICAL = """v_seedw as (select name, sum(score) as weight, true as is_core from v_concept where paper_id in (select paper_id from v_paper where is_seed) and score >= 0.5 group by name),
v_shared as (select paper_id, name, pos, score / sum(score) over (partition by paper_id) as share from v_concept),
v_topical as (select paper_id, least(sum(share * weight) / (select max(weight) from v_seedw) / sqrt((select greatest(count(*), 1) from v_seedw)), 1.0) as topical
    from v_shared join v_seedw using (name) where pos <= 7 group by paper_id)"""


def _topical(spark, d):
    c = concepts(spark, d).withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("paper_id")))
    weights = relevance.seed_weights(concepts(spark, d), papers(spark, d).where("is_seed"))
    return relevance.topical_scores(c, weights)


@query("topical_score", sql("select paper_id, round(topical, 6) as topical from v_topical", TOPICAL))
def topical_score(spark, d):
    return _topical(spark, d).withColumn("topical", F.round("topical", 6))


@query("seed_weights_max", sql("select lower(name) as name, max(score) as weight, true as is_core from v_concept where paper_id in (select paper_id from v_paper where is_seed) and score >= 0.5 group by 1"))
def seed_weights_max(spark, d):
    return relevance.seed_weights(concepts(spark, d), papers(spark, d).where("is_seed"), "max")


BREAK = """v_rank as (select venue, citation_count as x, row_number() over w as i, lag(citation_count) over w as b, lead(citation_count) over w as a from v_paper
    window w as (partition by venue order by citation_count desc, paper_id)),
v_break as (select venue, count(*) filter (x >= level) as by_deviation, max(g) as by_gap, max(e) as by_elbow from v_rank
    join (select venue, avg(citation_count) + stddev_pop(citation_count) as level from v_paper group by venue) l using (venue)
    left join (select venue, arg_max(i - 1, (b - x, -i)) as g from v_rank where i <= 100 and b is not null group by venue) g using (venue)
    left join (select venue, arg_max(i, (abs(b - 2 * x + a), -i)) as e from v_rank where i <= 100 and b is not null and a is not null group by venue) e using (venue) group by venue)"""


@query("breakpoints", sql("select * from v_break", BREAK))
def breakpoints(spark, d):
    return relevance.breakpoints(papers(spark, d), "citation_count", ["venue"], "paper_id")


@query(
    "breakpoint_selection",
    sql("select venue, arg_min(cut, (abs(cut - 158), cut)) as cut from (select venue, unnest([by_deviation, by_gap, by_elbow]) as cut from v_break) t where cut >= 20 group by venue", BREAK),
)
def breakpoint_selection(spark, d):
    found = relevance.breakpoints(papers(spark, d), "citation_count", ["venue"], "paper_id")
    return relevance.pick_breakpoint(found, ["venue"], 158, 20)


@query(
    "leaders",
    sql(
        """select coauthor_id, papers, topical_papers, citations, years, round(2 * topical_papers + ln(1 + citations) + 0.5 * years, 6) as significance from (
            select coauthor_id, count(*) as papers, count(*) filter (coalesce(topical, 0) >= 0.3) as topical_papers, cast(sum(citation_count) as bigint) as citations, max(year) - min(year) + 1 as years
            from v_authorship join v_paper using (paper_id) left join v_topical using (paper_id) group by coauthor_id) t where topical_papers >= 2
        order by 2 * topical_papers + ln(1 + citations) + 0.5 * years desc, coauthor_id limit 50""",
        TOPICAL,
    ),
)
def leaders(spark, d):
    return relevance.leaders(papers(spark, d), _topical(spark, d), authorship(spark, d), 0.3).withColumn("significance", F.round("significance", 6))


TIERS = "case when lower(venue) in ('1-urgent') then 1 when lower(venue) in ('2-high', '3-medium') then 2 else 3 end"


@query("tier_rank", sql(f"select paper_id, venue, {TIERS} as tier from v_paper order by tier, paper_id limit 4000"))
def tier_rank(spark, d):
    return relevance.tiered(papers(spark, d), ["1-URGENT"], ["2-HIGH", "3-MEDIUM"], "paper_id", 4_000).select("paper_id", "venue", "tier")


@query("tier_fill", sql(f"select paper_id, {TIERS} as tier from v_paper where {TIERS} < 3 or (select least(count(*), 30000) * 2 < 30000 from v_paper where {TIERS} < 3) order by tier, paper_id limit 30000"))
def tier_fill(spark, d):
    return relevance.tiered_fill(papers(spark, d), ["1-URGENT"], ["2-HIGH", "3-MEDIUM"], "paper_id", 30_000).select("paper_id", "tier")


@query(
    "reading_priority",
    sql(
        """select category, count(*) as papers from (select case when is_seed then 'seed' when coalesce(topical, 0) > 0.6 and author_id % 10 = 0 then 'key_author' when coalesce(topical, 0) > 0.6 then 'highly_relevant'
            when least(ln(1 + citation_count) / ln(101), 1) > 0.7 then 'foundational' when year >= 2000 then 'recent' else 'background' end as category from v_paper left join v_topical using (paper_id)) t group by category""",
        TOPICAL,
    ),
)
def reading_priority(spark, d):
    p = papers(spark, d).join(_topical(spark, d), "paper_id", "left")
    kind = relevance.reading_priority(F.col("is_seed"), F.coalesce("topical", F.lit(0.0)), F.col("author_id") % 10 == 0, F.col("year"), F.col("citation_count"))
    return p.groupBy(kind.alias("category")).agg(F.count("*").alias("papers"))


@query(
    "key_authors",
    sql(
        """select coauthor_id, cast(sum(w) as bigint) as votes from (select distinct coauthor_id, 5 as w from v_authorship join v_paper using (paper_id) where is_seed union all
            select coauthor_id, 1 from (select distinct y.src as paper_id from v_ref x join v_ref y on x.dst = y.dst where x.src in (select paper_id from v_paper where is_seed)) n join v_authorship using (paper_id)) t
        group by coauthor_id having sum(w) >= 2 order by votes desc, coauthor_id limit 20"""
    ),
)
def key_authors(spark, d):
    p, a, refs = papers(spark, d), authorship(spark, d), references(spark, d).select("src", "dst")
    seeds = p.where("is_seed").select("paper_id")
    cited = refs.join(seeds, F.col("src") == F.col("paper_id"), "left_semi").select("dst").distinct()
    near = refs.join(cited, "dst", "left_semi").select(F.col("src").alias("paper_id")).distinct()
    return relevance.key_authors(a.join(seeds, "paper_id", "left_semi"), a.join(near, "paper_id", "left_semi"))


@query(
    "entropy_triage",
    sql(
        """select author_id, volume, round(e, 6) as entropy, round(v, 6) as venue_entropy, round(risk, 6) as risk, case when volume > 20000 or risk > 0.75 then 'RED' when volume > 5000 or risk > 0.55 then 'YELLOW' else 'GREEN' end as band from (
            select author_id, volume, e, v, 0.45 * least(log10(volume + 1) / 5, 1) + 0.25 * e + 0.20 * v + 0.10 * 0.5 as risk from
            (select author_id, cast(sum(n) as bigint) as volume, case when count(*) > 1 then sum(-p * log2(p)) / log2(count(*)) else 0 end as e from (
                select author_id, n, n / sum(n) over (partition by author_id) as p from (select author_id, name, cast(sum(score) as bigint) as n from v_paper join v_concept using (paper_id) group by all) x) y group by author_id) a join
            (select author_id, case when count(*) > 1 then sum(-p * log2(p)) / log2(count(*)) else 0 end as v from (
                select author_id, n / sum(n) over (partition by author_id) as p from (select author_id, venue, count(*) as n from v_paper group by all) x) y group by author_id) b using (author_id)) t"""
    ),
)
def entropy_triage(spark, d):
    counts = papers(spark, d).join(concepts(spark, d), "paper_id").groupBy("author_id", "name").agg(F.sum("score").cast("bigint").alias("n"))
    venues = papers(spark, d).groupBy("author_id", "venue").agg(F.count("*").alias("n"))
    joined = (
        counts.groupBy("author_id").agg(F.sum("n").alias("volume")).join(relevance.entropy(counts, ["author_id"], "n"), "author_id")
        .join(relevance.entropy(venues, ["author_id"], "n").withColumnRenamed("entropy", "venue_entropy"), "author_id")
    )
    risk, band = relevance.scope_risk(F.col("volume"), F.col("entropy"), F.col("venue_entropy"), F.lit(0.5))
    return joined.select("author_id", "volume", F.round("entropy", 6).alias("entropy"), F.round("venue_entropy", 6).alias("venue_entropy"), F.round(risk, 6).alias("risk"), band.alias("band"))


@query(
    "landscape",
    sql(
        """select venue, count(*) as papers, max(authors) as authors, max(peak_years) as peak_years from v_paper
            join (select venue, count(distinct coauthor_id) as authors from v_paper join v_authorship using (paper_id) group by venue) a using (venue)
            join (select venue, list_sort(list(year)) as peak_years from (select venue, year, row_number() over (partition by venue order by count(*) desc, year) as r from v_paper group by venue, year) t where r <= 3 group by venue) p using (venue)
            group by venue"""
    ),
)
def landscape(spark, d):
    return relevance.landscape(papers(spark, d), authorship(spark, d), "venue")


def _check_sql(name: str, passed: str, severity: str) -> str:
    return f"select status, count(*) as rows, '{name}' as name, '{severity}' as severity, count(*) filter (not coalesce({passed}, false)) as failed from v_paper group by status"


CHECKS = "v_check as (" + " union all ".join(
    _check_sql(*x)
    for x in (
        ("has_id", "paper_id is not null", "error"), ("has_year", "year is not null", "warning"), ("year_in_range", "year between 1800 and 2030", "error"), ("not_in_the_future", "year <= 2002", "warning"),
        ("citations_not_negative", "citation_count >= 0", "error"), ("has_venue", "venue is not null and venue <> ''", "info"), ("plausible_citations", "citation_count < 1000000", "warning"),
    )
) + ")"


@query("verification", sql("select * from v_check", CHECKS))
def verification(spark, d):
    return checks.run_checks(papers(spark, d), ["status"], checks.paper_checks())


@query(
    "verification_confidence",
    sql(
        """select status, sum(case when failed = 0 then w else 0 end) / sum(w) as confidence, count(*) filter (failed > 0 and severity = 'error') as errors,
            count(*) filter (failed > 0 and severity = 'warning') as warnings, count(*) filter (failed > 0 and severity = 'error') = 0 as passed
        from (select *, case severity when 'error' then 1.0::double when 'warning' then 0.5 else 0.1 end as w from v_check) t group by status""",
        CHECKS,
    ),
)
def verification_confidence(spark, d):
    return checks.confidence(checks.run_checks(papers(spark, d), ["status"], checks.paper_checks()), ["status"])
