"""Queries over authors: profiles, drift, phases, roles, collaborators."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.operators import authors, trajectory
from athenor.plans.adapter import authorship, concepts, papers, references, sql
from athenor.plans.registry import query

PROFILE = """
v_works as (select paper_id, author_id, year from (select *, row_number() over (partition by author_id, year order by paper_id) as n from v_paper where year is not null) t where n <= 20),
v_profile as (select author_id, year, concept, weight from (select *, row_number() over (partition by author_id, year order by weight desc, concept) as n from (
    select author_id, year, concept, total / sum(total) over (partition by author_id, year) as weight
    from (select author_id, year, name as concept, sum(score) as total from v_works join v_concept using (paper_id) where pos <= 5 group by all) s) w) t where n <= 10),
v_share as (select author_id, year, concept, weight / sum(weight) over (partition by author_id, year) as share from v_profile),
v_year as (select author_id, year, cast(row_number() over (partition by author_id order by year) as integer) as i, count(*) over (partition by author_id) as n
    from (select distinct author_id, year from v_profile) t),
v_long as (select author_id from v_paper group by author_id having max(year) - min(year) >= 3)
"""


def _aligned(gap: int, eligible: str = "v_long") -> str:
    return f"""
v_step as (select author_id, year as year_from, year_to from (select author_id, year, lead(year) over (partition by author_id order by year) as year_to from v_year
    where author_id in (select author_id from {eligible})) t where year_to - year <= {gap}),
v_pair as (select author_id, year_from, year_to, concept, sum(a) as a, sum(b) as b from (
    select s.author_id, year_from, year_to, concept, share as a, 0.0 as b from v_step s join v_share h on h.author_id = s.author_id and h.year = year_from union all
    select s.author_id, year_from, year_to, concept, 0.0, share from v_step s join v_share h on h.author_id = s.author_id and h.year = year_to) t group by all),
v_smooth as (select author_id, year_from, year_to, (a + 1e-10) / (1 + n * 1e-10) as p, (b + 1e-10) / (1 + n * 1e-10) as q
    from (select *, count(*) over (partition by author_id, year_from, year_to) as n from v_pair) t),
v_drift as (select author_id, year_from, year_to, least(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 / 0.693, 1.0) as drift from v_smooth group by all)"""


@query("year_profile", sql("select author_id, year, concept, round(weight, 6) as weight from v_profile", PROFILE))
def year_profile(spark, d):
    return trajectory.year_profiles(papers(spark, d), concepts(spark, d)).withColumn("weight", F.round("weight", 6))


@query("drift_jsd", sql("select author_id, year_from, year_to, round(drift, 6) as drift, drift >= 0.55 as is_jump from v_drift where drift > 0.2", PROFILE + "," + _aligned(2)))
def drift_jsd(spark, d):
    return trajectory.drift_events(papers(spark, d), concepts(spark, d)).withColumn("drift", F.round("drift", 6))


GARDEN = "v_busy as (select author_id from v_paper group by author_id having count(*) >= 5)," + PROFILE + "," + _aligned(3, "v_busy")
GARDEN_SUM = """, v_garden as (select author_id, n - 1 as transitions, coalesce(total, 0) / (n - 1) as drift_avg, coalesce(jumps, 0) as jumps
    from (select distinct author_id, n from v_year where n > 1 and author_id in (select author_id from v_busy)) y
    left join (select author_id, sum(drift) as total, count(*) filter (drift >= 0.55) as jumps from v_drift group by author_id) s using (author_id))"""


@query("garden_drift", sql("select author_id, transitions, round(drift_avg, 6) as drift_avg, jumps from v_garden", GARDEN + GARDEN_SUM))
def garden_drift(spark, d):
    return trajectory.garden_drift(papers(spark, d), concepts(spark, d)).withColumn("drift_avg", F.round("drift_avg", 6))


@query(
    "entering_exiting",
    sql(
        """select author_id, year_from, year_to, direction, concept, round(change, 6) as change, rank from (select *,
            cast(row_number() over (partition by author_id, year_from, year_to, direction order by round(change, 9) desc, concept) as integer) as rank
            from (select author_id, year_from, year_to, case when b > a then 'entering' else 'exiting' end as direction, concept, abs(b - a) as change
                from v_pair where abs(b - a) > 0.1) m) t where rank <= 5""",
        PROFILE + "," + _aligned(2),
    ),
)
def entering_exiting(spark, d):
    return trajectory.concept_changes(papers(spark, d), concepts(spark, d)).withColumn("change", F.round("change", 6))


@query(
    "sliding_cosine",
    sql(
        """select author_id, year, round(drift, 6) as drift, drift >= 0.6 as is_jump from (
            select author_id, around as year, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) as drift from (
                select p.author_id, c.year as around, concept, sum(case when y.i < c.i then weight else 0 end) as a, sum(case when y.i >= c.i then weight else 0 end) as b
                from v_profile p join v_year y on y.author_id = p.author_id and y.year = p.year join v_year c on c.author_id = p.author_id
                where c.n >= 6 and c.i > 3 and c.n - c.i >= 1 and y.i >= c.i - 3 and y.i < c.i + 3 group by all) cells group by all) t
        where drift >= 0.4""",
        PROFILE,
    ),
)
def sliding_cosine(spark, d):
    profiles = trajectory.year_profiles(papers(spark, d), concepts(spark, d))
    return trajectory.sliding_drift(profiles).withColumn("drift", F.round("drift", 6))


PHASES = """, v_jump as (select distinct author_id, year_to as year from v_drift where drift > 0.2 and drift >= 0.55),
v_phase as (select author_id, phase, min(year) as first_year, max(year) as last_year, cast(sum(papers) as bigint) as papers from (
    select author_id, year, papers, cast(sum(jump) over (partition by author_id order by year) as integer) as phase from (
        select y.author_id, y.year, papers, case when j.year is null then 0 else 1 end as jump
        from (select author_id, year, count(*) as papers from v_paper where year is not null group by all) y
        left join v_jump j on j.author_id = y.author_id and j.year = y.year) m) t group by all having sum(papers) >= 5)"""


@query("phases", sql("select * from v_phase", PROFILE + "," + _aligned(2) + PHASES))
def phases(spark, d):
    return trajectory.phases(papers(spark, d), trajectory.drift_events(papers(spark, d), concepts(spark, d)))


@query(
    "phase_details",
    sql(
        """select p.author_id, p.phase, p.first_year, p.last_year, p.papers, citations, concepts, collaborators, top_papers, coalesce(concepts[1], 'unknown') as label,
            lag(p.phase) over w is null as is_formative, lead(p.phase) over w is null as is_current from v_phase p
            join (select author_id, phase, cast(sum(citation_count) as bigint) as citations from v_in group by all) t using (author_id, phase)
            left join (select author_id, phase, list(name order by r) as concepts from (select *, row_number() over (partition by author_id, phase order by n desc, name) as r from
                (select author_id, phase, lower(name) as name, sum(score) as n from v_in join v_concept using (paper_id) where pos <= 7 group by all) a) b where r <= 5 group by all) c using (author_id, phase)
            left join (select author_id, phase, list(coauthor_id order by r) as collaborators from (select *, row_number() over (partition by author_id, phase order by n desc, coauthor_id) as r from
                (select author_id, phase, coauthor_id, count(*) as n from v_in join v_authorship using (paper_id) group by all) a) b where r <= 5 group by all) d using (author_id, phase)
            left join (select author_id, phase, list(paper_id order by r) as top_papers from (select *, row_number() over (partition by author_id, phase order by citation_count desc, paper_id) as r from v_in) b where r <= 3 group by all) e using (author_id, phase)
            window w as (partition by p.author_id order by p.first_year)""",
        PROFILE + "," + _aligned(2) + PHASES + ", v_in as (select p.author_id, phase, paper_id, citation_count from v_phase p join v_paper x on x.author_id = p.author_id and x.year between first_year and last_year)",
    ),
)
def phase_details(spark, d):
    p, c = papers(spark, d), concepts(spark, d)
    return trajectory.phase_details(trajectory.phases(p, trajectory.drift_events(p, c)), p, c, authorship(spark, d))


@query("merge_phases")
def merge_phases(spark, d):
    found = trajectory.phases(papers(spark, d), trajectory.drift_events(papers(spark, d), concepts(spark, d)), 1)
    return trajectory.merge_short_phases(found)


@query(
    "core_concepts",
    sql(
        """select author_id, concept, years, active, rank from (select author_id, concept, years, active,
            cast(row_number() over (partition by author_id order by years desc, concept) as integer) as rank
            from (select author_id, concept, count(distinct year) as years from v_profile group by all) u
            join (select author_id, count(distinct year) as active from v_profile group by all) a using (author_id) where years >= 0.5 * active) t where rank <= 10""",
        PROFILE,
    ),
)
def core_concepts(spark, d):
    return trajectory.core_concepts(trajectory.year_profiles(papers(spark, d), concepts(spark, d)))


@query(
    "direction",
    sql(
        """select author_id, trend, concept, round(change + 1e-10, 6) as change, rank from (select *,
            cast(row_number() over (partition by author_id, trend order by round(change, 9) desc, concept) as integer) as rank from (
            select author_id, case when late > 0 and (late > early * 1.5 or early = 0) then 'emerging' else 'declining' end as trend, concept, abs(late - early) as change
            from (select author_id, concept, late / sum(late) over (partition by author_id) as late, early / sum(early) over (partition by author_id) as early from (
                select p.author_id, concept, sum(case when i > n - 5 then weight else 0 end) as late, sum(case when i <= n - 5 then weight else 0 end) as early
                from v_profile p join v_year y on y.author_id = p.author_id and y.year = p.year where n >= 6 group by all) s) h
            where (late > 0 and (late > early * 1.5 or early = 0)) or (early > 0 and (early > late * 1.5 or late = 0))) m) t where rank <= 5""",
        PROFILE,
    ),
)
def direction(spark, d):
    return trajectory.direction(trajectory.year_profiles(papers(spark, d), concepts(spark, d))).withColumn("change", F.round(F.col("change") + 1e-10, 6))


@query(
    "emerging_by_year",
    sql(
        """select author_id, year, name, papers, rank from (select r.author_id, r.year, r.name, papers,
            cast(row_number() over (partition by r.author_id, r.year order by papers desc, r.name) as integer) as rank from v_count r join v_obs o using (author_id, year)
            where o.i > 2 and not exists (select 1 from v_count e join v_obs eo on eo.author_id = e.author_id and eo.year = e.year
                where e.author_id = r.author_id and e.name = r.name and eo.i < o.i and eo.i >= o.i - 3)) t where rank <= 5""",
        """v_count as (select author_id, year, name, count(*) as papers from v_concept join v_paper using (paper_id) where pos <= 3 group by all),
        v_obs as (select author_id, year, row_number() over (partition by author_id order by year) as i from (select distinct author_id, year from v_count) t)""",
    ),
)
def emerging_by_year(spark, d):
    return trajectory.emerging_by_year(concepts(spark, d), papers(spark, d), ["author_id"])


@query(
    "concept_flow",
    sql(
        """select name, papers, years, early, late, peak_year, case when late > 1.5 * early then 'growing' when late < 0.5 * early then 'declining' else 'stable' end as trend
        from (select name, cast(sum(n) as bigint) as papers, count(*) as years, cast(sum(case when up <= 3 then n else 0 end) as bigint) as early,
            cast(sum(case when down <= 3 then n else 0 end) as bigint) as late, arg_max(year, (n, -year)) as peak_year from (
            select name, year, count(*) as n, row_number() over (partition by name order by year) as up, row_number() over (partition by name order by year desc) as down
            from v_concept join v_paper using (paper_id) group by name, year) t group by name) f where papers >= 5 and years >= 2"""
    ),
)
def concept_flow(spark, d):
    return trajectory.concept_flow(concepts(spark, d), papers(spark, d))


@query(
    "cluster_bridging",
    sql(
        """select author_id, cast(greatest(count(distinct name) - 1, 0) as integer) as clusters_bridged from v_paper join v_concept using (paper_id) where pos = 1 group by author_id"""
    ),
)
def cluster_bridging(spark, d):
    return trajectory.cluster_bridging(papers(spark, d), concepts(spark, d))


ROLES = """, v_author as (select a.author_id, citation_count, centrality, drift_avg, jumps, clusters_bridged from
    (select author_id, cast(sum(citation_count) as bigint) as citation_count from v_paper group by author_id) a
    left join (select author_id, cast(count(distinct dst) as double) as centrality from v_paper join v_ref on src = paper_id group by author_id) c using (author_id)
    left join v_garden using (author_id)
    left join (select author_id, greatest(count(distinct name) - 1, 0) as clusters_bridged from v_paper join v_concept using (paper_id) where pos = 1 group by author_id) b using (author_id)),
v_cut as (select (select citation_count from (select citation_count, row_number() over (order by citation_count) as r from v_author) t, (select count(*) as n from v_author) c where r = floor(n * 0.9) + 1) as cites,
    (select centrality from (select coalesce(centrality, 0) as centrality, row_number() over (order by coalesce(centrality, 0)) as r from v_author) t, (select count(*) as n from v_author) c where r = floor(n * 0.9) + 1) as cent)"""


@query(
    "roles_p90",
    sql(
        """select author_id, role, round(case role when 'disruptor' then least(1.0, d + j * 0.2 + b * 0.1) when 'leader' then least(1.0, ce / greatest(cent, 0.01) * 0.5 + 0.5)
            when 'follower' then 0.6 when 'player' then 0.5 else 0.0 end, 6) as role_confidence from (select *,
            case when d >= 0.4 or j >= 2 or b >= 2 then 'disruptor' when ce >= cent and c >= cites and d < 0.3 then 'leader'
                when c < cites * 0.2 and d < 0.2 then 'follower' when c > 0 or ce > 0 then 'player' else 'unknown' end as role from (
            select author_id, coalesce(citation_count, 0) as c, coalesce(centrality, 0) as ce, coalesce(drift_avg, 0) as d, coalesce(jumps, 0) as j,
                case when coalesce(clusters_bridged, 0) >= 5 then clusters_bridged - 4 else 0 end as b, cites, cent from v_author, v_cut) x) t""",
        GARDEN + GARDEN_SUM + ROLES,
    ),
)
def roles_p90(spark, d):
    p, c = papers(spark, d), concepts(spark, d)
    edges = references(spark, d)
    totals = p.groupBy("author_id").agg(F.sum("citation_count").alias("citation_count"))
    central = p.join(edges, p.paper_id == edges.src).groupBy("author_id").agg(F.countDistinct("dst").cast("double").alias("centrality"))
    both = materialize(totals.join(central, "author_id", "left").fillna(0.0, ["centrality"]), "totals")
    bridged = trajectory.cluster_bridging(p, c).withColumn("clusters_bridged", F.when(F.col("clusters_bridged") >= 5, F.col("clusters_bridged") - 4).otherwise(0))
    joined = both.join(trajectory.garden_drift(p, c), "author_id", "left").join(bridged, "author_id", "left")
    cuts = trajectory.at_ranks({"_cites": both.select("citation_count"), "_cent": both.select("centrality")}, 0.9)  # one row
    rated = trajectory.roles(joined.crossJoin(F.broadcast(cuts)), F.col("_cites"), F.col("_cent"))
    return rated.select("author_id", "role", F.round("role_confidence", 6).alias("role_confidence"))


@query(
    "author_bridges",
    sql(
        """select distinct j.author_id, year_from, year_to, x.cluster as cluster_a, y.cluster as cluster_b from (select * from v_drift where drift >= 0.55) j
            join v_primary x on x.author_id = j.author_id and x.year <= year_from join v_primary y on y.author_id = j.author_id and y.year >= year_to
            where x.cluster <> y.cluster""",
        PROFILE + "," + _aligned(2) + ", v_primary as (select distinct author_id, year, name as cluster from v_paper join v_concept using (paper_id) where pos = 1)",
    ),
)
def author_bridges(spark, d):
    p, c = papers(spark, d), concepts(spark, d)
    return trajectory.author_bridges(p, c, trajectory.drift_events(p, c))


@query(
    "corpus_stats",
    sql(
        """select author_id, count(*) as papers, cast(sum(citation_count) as bigint) as citations, min(year) as first_year, max(year) as last_year,
            any_value(venues) as venues, any_value(concepts) as concepts, any_value(coauthors) as coauthors from v_paper p
            join (select author_id, list(venue order by n desc, venue)[1:5] as venues from (select author_id, venue, count(*) as n from v_paper group by all) t group by author_id) v using (author_id)
            left join (select author_id, list(name order by n desc, name)[1:10] as concepts from (select author_id, name, sum(score) as n from v_paper join v_concept using (paper_id) where pos <= 5 group by all) t group by author_id) c using (author_id)
            left join (select author_id, list(coauthor_id order by n desc, coauthor_id)[1:20] as coauthors from (select author_id, coauthor_id, count(*) as n from v_paper join v_authorship using (paper_id) group by all) t group by author_id) o using (author_id)
            group by author_id"""
    ),
)
def corpus_stats(spark, d):
    return authors.corpus_stats(papers(spark, d), concepts(spark, d), authorship(spark, d))


COLLAB = """v_pairs as (select p.author_id, coauthor_id, p.paper_id, year from v_paper p join v_authorship a on a.paper_id = p.paper_id)"""


@query(
    "collaborators",
    sql(
        """select author_id, coauthor_id, papers, first_year, last_year, round((2 * ln(1 + papers) + ln(1 + last_year - first_year)) * (0.5 + 0.5 / (1 + 0.2 * (2002 - last_year))), 6) as strength, rank
        from (select *, cast(row_number() over (partition by author_id order by papers desc, last_year desc, coauthor_id) as integer) as rank from (
            select author_id, coauthor_id, count(*) as papers, min(year) as first_year, max(year) as last_year from v_pairs group by all) g) t where rank <= 20""",
        COLLAB,
    ),
)
def collaborators(spark, d):
    return authors.collaborators(papers(spark, d), authorship(spark, d)).withColumn("strength", F.round("strength", 6))


@query(
    "network_stats",
    sql(
        """select author_id, count(*) as papers, count(*) filter (n = 1) as solo, count(*) filter (n > 1) as shared, round(avg(n), 6) as authors_per_paper
            from (select author_id, p.paper_id, count(coauthor_id) as n from v_paper p left join v_authorship a on a.paper_id = p.paper_id group by all) t group by author_id"""
    ),
)
def network_stats(spark, d):
    return authors.network_stats(papers(spark, d), authorship(spark, d)).withColumn("authors_per_paper", F.round("authors_per_paper", 6))


@query(
    "coauthor_pairs",
    sql(
        """select a.coauthor_id as a, b.coauthor_id as b, count(*) as papers from v_authorship a join v_authorship b on a.paper_id = b.paper_id and a.coauthor_id < b.coauthor_id
            group by all having count(*) >= 2"""
    ),
)
def coauthor_pairs(spark, d):
    return authors.coauthor_pairs(authorship(spark, d), 2)


@query("greedy_collab_clusters")
def greedy_collab_clusters(spark, d):
    p, c, a = papers(spark, d), concepts(spark, d), authorship(spark, d)
    topics = authors.collaborator_topics(p, a, c)
    return authors.greedy_clusters(topics)


@query(
    "author_expansion",
    sql(
        """select author_id, paper_id, slice, rank from (select author_id, paper_id, slice, cast(row_number() over (partition by author_id, slice order by citation_count desc, paper_id) as integer) as rank
            from (select *, case when year >= 2002 - 5 then 'recent' else 'foundational' end as slice from v_paper) s) t where rank <= case slice when 'recent' then 10 else 5 end"""
    ),
)
def author_expansion(spark, d):
    return authors.expansion(papers(spark, d))


@query(
    "mega_authors",
    sql("select coauthor_id, count(*) as papers, count(*) >= 500 as is_mega from v_authorship group by coauthor_id having count(*) >= 100"),
)
def mega_authors(spark, d):
    return authors.productive(authorship(spark, d), 100, 500)


@query(
    "author_fit",
    sql(
        """select author_id, round(avg(fit), 6) as topic_fit, 0.5 * least(max(n) / 10.0, 1.0) + 0.5 * least(max(conn) / 50.0, 1.0) as centrality from (
            select p.author_id, citation_count / 70000.0 as fit, n, conn, row_number() over (partition by p.author_id order by citation_count desc, paper_id) as r from v_paper p
            join (select author_id, count(*) as n from v_paper group by author_id) a on a.author_id = p.author_id
            left join (select author_id, count(distinct dst) as conn from v_paper join v_ref on src = paper_id group by author_id) c on c.author_id = p.author_id) t where r <= 5 group by author_id"""
        .replace("max(conn)", "coalesce(max(conn), 0)")
    ),
)
def author_fit(spark, d):
    p = papers(spark, d).withColumn("relevance", F.col("citation_count") / 70000.0)
    return authors.fit_and_centrality(p, references(spark, d)).withColumn("topic_fit", F.round("topic_fit", 6))
