"""Queries that choose what to follow and sum up careers and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.operators import graph, selection, trajectory
from athenor.plans.adapter import authorship, concepts, papers, references, sql, works
from athenor.plans.author_queries import PHASES, PROFILE, _aligned
from athenor.plans.graph_queries import CLUSTERS, REFS, _edges, _typed
from athenor.plans.registry import query


@query(
    "expansion_queue",
    sql(
        """select node, round(priority, 6) as priority from (select node, relevance + least(coalesce(n, 0) / 10.0, 0.3) + 0.2 * bridge - case when 2002 - year > 10 then 0.1 else 0 end as priority from v_node
            left join (select b.node, count(*) as n from (select src as node, dst as near from v_edge union select dst, src from v_edge) b join v_node f on f.node = b.near where not f.is_expanded group by b.node) o using (node)
            where not is_expanded) t order by t.priority desc, node limit 200""",
        CLUSTERS
        + """, v_node as (select paper_id * 2 as node, citation_count / 70000.0 as relevance, (paper_id % 7) / 10.0 as bridge, year, paper_id % 3 = 0 as is_expanded from v_paper union all
            select work_id * 2 + 1, size / 50.0, 0.0, 1990 + size % 10, size > 40 from v_work)""",
    ),
)
def expansion_queue(spark, d):
    nodes = papers(spark, d).select((F.col("paper_id") * 2).alias("node"), (F.col("citation_count") / 70000).alias("relevance"), ((F.col("paper_id") % 7) / 10).alias("bridge"), "year", (F.col("paper_id") % 3 == 0).alias("is_expanded"))
    more = works(spark, d).select((F.col("work_id") * 2 + 1).alias("node"), (F.col("size") / 50).alias("relevance"), F.lit(0.0).alias("bridge"), (1990 + F.col("size") % 10).alias("year"), (F.col("size") > 40).alias("is_expanded"))
    return selection.expansion_queue(nodes.unionAll(more), _edges(spark, d), 200).withColumn("priority", F.round("priority", 6))


@query(
    "core_frontier",
    sql("""select paper_id as node, is_frontier, rank from (select paper_id, year > 1998 as is_frontier, cast(row_number() over (partition by year > 1998 order by citation_count desc, paper_id) as integer) as rank from v_paper) t
        where rank <= case when is_frontier then 40 else 60 end"""),
)
def core_frontier(spark, d):
    nodes = papers(spark, d).select(F.col("paper_id").alias("node"), F.col("citation_count").alias("score"), (F.col("year") > 1998).alias("is_frontier"))
    return selection.core_and_frontier(nodes, 100).select("node", "is_frontier", "rank")


@query(
    "seed_selection",
    sql("""select paper_id, cast(tier as integer) as tier, position from (select paper_id, position, case when is_review and r <= 3 and citation_count >= 30000 then 1 when not is_review and citation_count >= 30000 then 2 when year >= 2001 then 3 end as tier
            from (select *, row_number() over (partition by is_review order by position) as r from (select paper_id, paper_id as position, citation_count, year, paper_id % 11 = 0 as is_review from v_paper) x) y) t
        where tier < 3 or (tier = 3 and (select count(*) < 5 from v_paper where citation_count >= 30000)) order by tier, position limit 20"""),
)
def seed_selection(spark, d):
    found = papers(spark, d).select("paper_id", F.col("paper_id").alias("position"), "citation_count", "year", (F.col("paper_id") % 11 == 0).alias("is_review"))
    return selection.select_seeds(found, least_citations=30_000)


@query(
    "seed_combine",
    sql("""select list, position, title from (select *, row_number() over (partition by coalesce(nullif(doi, ''), lower(left(title, 50))) order by list, position) as r from (
            select size % 3 as list, work_id as position, case when size % 4 = 0 then '10.1/' || (work_id % 50) else '' end as doi, title from v_work) x) t where r = 1 order by list, position limit 20"""),
)
def seed_combine(spark, d):
    lists = works(spark, d).select((F.col("size") % 3).alias("list"), F.col("work_id").alias("position"), F.when(F.col("size") % 4 == 0, F.concat(F.lit("10.1/"), (F.col("work_id") % 50).cast("string"))).otherwise("").alias("doi"), "title")
    return selection.combine_seeds(lists).select("list", "position", "title")


@query(
    "inferred_edges",
    sql(
        """select case when older then seed else paper_id end as src, case when older then paper_id else seed end as dst, case when older then 'reference' else 'citation' end as kind from (
            select p.seed, p.paper_id, y.year < s.year or (not same and y.year = s.year) as older, y.year > s.year as newer from (
                select seed, paper_id, true as same from v_au union all select seed, paper_id, false from v_co where n >= 5 and (seed, paper_id) not in (select seed, paper_id from v_au)) p
            join v_paper y on y.paper_id = p.paper_id join v_paper s on s.paper_id = p.seed) t where older or newer""",
        """v_au as (select distinct a.paper_id as seed, b.paper_id from v_paper a join v_paper b on a.author_id = b.author_id and a.paper_id <> b.paper_id where a.is_seed),
        v_co as (select a.paper_id as seed, b.paper_id, count(*) as n from v_concept a join v_concept b on a.name = b.name and a.paper_id <> b.paper_id where a.paper_id in (select paper_id from v_paper where is_seed) group by all)""",
    ),
)
def inferred_edges(spark, d):
    p = papers(spark, d)
    return selection.inferred_edges(p.where("is_seed").select("paper_id"), p, p.select("paper_id", F.col("author_id").alias("author")), concepts(spark, d), 5)


@query(
    "trajectory_stats",
    sql(
        """select author_id, career_years, round(total, 6) as drift_total, jumps, phases, core, case when career_years < 5 then 'early_career' when core >= 3 and rate < 0.1 then 'focused' when jumps >= 2 and phases >= 3 then 'shifter'
            when rate > 0.2 and phases >= 3 then 'explorer' when rate between 0.05 and 0.15 and core >= 2 then 'bridger' else 'steady' end as kind,
            round(greatest(0, least(1 / (1 + 3 * rate) + least(core * 0.1, 0.3), 1)), 6) as stability from (
            select c.author_id, career_years, coalesce(total, 0) as total, coalesce(total, 0) / career_years as rate, coalesce(jumps, 0) as jumps, coalesce(phases, 0) as phases, coalesce(core, 0) as core
            from (select author_id, max(year) - min(year) + 1 as career_years from v_paper group by author_id) c
            left join (select author_id, sum(drift) as total, count(*) filter (drift >= 0.55) as jumps from v_drift where drift > 0.2 group by author_id) d on d.author_id = c.author_id
            left join (select author_id, count(*) as phases from v_phase group by author_id) p on p.author_id = c.author_id
            left join (select author_id, least(count(*), 10) as core from (select author_id, concept, count(distinct year) as years from v_profile group by all) u
                join (select author_id, count(distinct year) as active from v_profile group by author_id) a using (author_id) where years >= 0.5 * active group by author_id) k on k.author_id = c.author_id) t""",
        PROFILE + "," + _aligned(2) + PHASES,
    ),
)
def trajectory_stats(spark, d):
    p, c = papers(spark, d), concepts(spark, d)
    events = trajectory.drift_events(p, c)
    stats = selection.trajectory_stats(p, events, trajectory.phases(p, events), trajectory.core_concepts(trajectory.year_profiles(p, c)))
    return stats.select("author_id", "career_years", F.round("drift_total", 6).alias("drift_total"), "jumps", "phases", "core", "kind", F.round("stability", 6).alias("stability"))


@query(
    "citation_summary",
    sql(
        """select src, count(*) filter (t = 'foundational') as foundational, count(*) filter (t = 'methodological') as methodological, count(*) filter (t = 'self_cite') as self_cites,
            coalesce(list_slice(list(dst order by r) filter (r <= 10 and t <> 'self_cite'), 1, 5), []) as key_references from (
            select src, dst, t, row_number() over (partition by src order by w desc, dst, ref_pos) as r from (
                select src, dst, ref_pos, case when same_author then 'self_cite' when (gap >= 10 or citation_count >= 100) and position = 'early' then 'foundational' when is_method or position = 'late' then 'methodological' else 'regular' end as t,
                round(0.3 * ln(1 + citation_count) + 0.2 * shared + case when gap <= 5 then 0.3 when gap >= 10 then 0.2 else 0 end + case position when 'early' then 0.2 when 'late' then 0.1 else 0 end, 6) as w from v_typed) x) y group by src""",
        REFS,
    ),
)
def citation_summary(spark, d):
    t = _typed(spark, d)
    kind = graph.reference_type(F.col("same_author"), F.col("gap"), F.col("citation_count"), F.col("position"), F.col("is_method"))
    worth = F.round(graph.reference_importance(F.col("citation_count"), F.col("shared"), F.col("gap"), F.col("position")), 6)
    return selection.citation_summary(t.select("src", "dst", "ref_pos", kind.alias("ref_type"), worth.alias("importance")))


@query(
    "facets",
    sql("""select paper_id, facet, name, rank from (select *, cast(row_number() over (partition by paper_id, facet order by pos, name) as integer) as rank from (
            select paper_id, name, pos, case when contains(lower(name), 'model') or contains(lower(name), 'method') then 'method' when contains(lower(name), 'plant') or contains(lower(name), 'cell') then 'organism' else 'domain' end as facet from v_concept) f) t where rank <= 5"""),
)
def facets(spark, d):
    return selection.facets(concepts(spark, d), ["paper_id"])


@query(
    "portal_authors",
    sql("select coauthor_id, count(*) as papers, cast(sum(citation_count) as bigint) as citations from v_authorship join v_paper using (paper_id) where citation_count >= 50000 group by coauthor_id"),
)
def portal_authors(spark, d):
    strong = papers(spark, d).where("citation_count >= 50000")
    return authorship(spark, d).join(strong, "paper_id").groupBy("coauthor_id").agg(F.count("*").alias("papers"), F.sum("citation_count").alias("citations"))


@query("reference_counts", sql("select n_refs, count(distinct src) as papers from v_ref group by n_refs"))
def reference_counts(spark, d):
    return references(spark, d).groupBy("n_refs").agg(F.countDistinct("src").alias("papers"))
