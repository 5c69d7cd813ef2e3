"""Queries over the citation graph. Papers and works share one id space: paper 2k, work 2k + 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.functions import exprs
from athenor.functions.storage import materialize, table
from athenor.iterative import betweenness as between
from athenor.iterative import components, traversal
from athenor.operators import graph, insights, relevance, topics
from athenor.plans.adapter import authorship, concepts, papers, references, sql, works
from athenor.plans.registry import query
from athenor.plans.score_queries import TOPICAL
from athenor.plans.score_queries import _topical as topical

SEEDS = "v_seed as (select paper_id from v_paper where is_seed), v_seedref as (select distinct dst from v_ref where src in (select paper_id from v_seed))"


def _seeds(spark, d):
    return papers(spark, d).where("is_seed").select(F.col("paper_id").alias("node"))


@query(
    "bib_coupling",
    sql(
        """select src as node, round(count(*) filter (dst in (select dst from v_seedref)) * 1.0 / (count(*) + (select count(*) from v_seedref)
            - count(*) filter (dst in (select dst from v_seedref))), 6) as coupling from (select distinct src, dst from v_ref) t group by src""",
        SEEDS,
    ),
)
def bib_coupling(spark, d):
    return graph.coupling(references(spark, d), _seeds(spark, d)).withColumn("coupling", F.round("coupling", 6))


@query(
    "co_citation",
    sql(
        """select dst as node, round(count(*) filter (src in (select src from v_citer)) * 1.0 / (count(*) + (select count(*) from v_citer)
            - count(*) filter (src in (select src from v_citer))), 6) as cocitation from (select distinct src, dst from v_ref) t group by dst""",
        "v_citer as (select distinct src from v_ref where dst % 200 = 0)",
    ),
)
def co_citation(spark, d):
    seeds = works(spark, d).where("work_id % 200 = 0").select(F.col("work_id").alias("node"))
    return graph.cocitation(references(spark, d), seeds).withColumn("cocitation", F.round("cocitation", 6))


@query(
    "portal_support",
    sql(
        """select work_id as node, case when size > 45 then 1.0 else least(coalesce(w, 0) / 3, 1.0) end as portal from v_work
            left join (select dst, cast(count(*) as double) as w from v_ref join v_paper on src = paper_id where citation_count >= 50000 group by dst) s on dst = work_id"""
    ),
)
def portal_support(spark, d):
    p, w = papers(spark, d), works(spark, d)
    nodes = w.select((F.col("work_id") * 2 + 1).alias("node"), (F.col("size") > 45).alias("is_review"))
    both = nodes.unionAll(p.select((F.col("paper_id") * 2).alias("node"), (F.col("citation_count") >= 50_000).alias("is_review")))
    edges = references(spark, d).select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    return graph.portal_support(edges, both).where("node % 2 = 1").select(((F.col("node") - 1) / 2).cast("bigint").alias("node"), "portal")


CLUSTERS = """v_member as (select paper_id * 2 as node, name as cluster from v_concept where pos = 1 union all select work_id * 2 + 1, kind from v_work),
v_edge as (select src * 2 as src, dst * 2 + 1 as dst from v_ref)"""


def _membership(spark, d):
    own = concepts(spark, d).where("pos = 1").select((F.col("paper_id") * 2).alias("node"), F.col("name").alias("cluster"))
    return own.unionAll(works(spark, d).select((F.col("work_id") * 2 + 1).alias("node"), F.col("kind").alias("cluster")))


def _edges(spark, d):
    return references(spark, d).select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"), "ref_pos")


@query(
    "cluster_links",
    sql(
        """select x.a, y.b, coalesce(links, 0) as links from (select distinct cluster as a from v_member) x join (select distinct cluster as b from v_member) y on a < b
            left join (select least(m.cluster, n.cluster) as a, greatest(m.cluster, n.cluster) as b, count(*) as links from v_edge e join v_member m on m.node = e.src
                join v_member n on n.node = e.dst where m.cluster <> n.cluster group by all) c on c.a = x.a and c.b = y.b""",
        CLUSTERS,
    ),
)
def cluster_links(spark, d):
    return graph.cluster_links(_edges(spark, d), _membership(spark, d))


NEAR = CLUSTERS + """, v_near as (select t.node, cluster, count(*) as n from (select distinct src as node, dst as near from v_edge union select dst, src from v_edge) t
    join v_member m on m.node = t.near group by all)"""


@query(
    "bridge_diversity",
    sql("select node, count(*) as clusters, round(1 - max(n) / sum(n), 6) as diversity from v_near group by node having count(*) >= 2", NEAR),
)
def bridge_diversity(spark, d):
    return graph.bridge_diversity(_edges(spark, d), _membership(spark, d)).withColumn("diversity", F.round("diversity", 6))


@query(
    "bridge_papers",
    sql(
        """select node, cluster_a, cluster_b, round(s, 6) as bridge_score from (select node, max(cluster) filter (r = 1) as cluster_a, max(cluster) filter (r = 2) as cluster_b,
            max(n) filter (r = 2) / max(n) filter (r = 1) * (max(n) filter (r = 1) + max(n) filter (r = 2)) / sum(n) as s
            from (select *, row_number() over (partition by node order by n desc, cluster) as r from v_near) t group by node) b
        where s >= 0.3 order by s desc, node limit 10""",
        NEAR,
    ),
)
def bridge_papers(spark, d):
    return graph.bridge_papers(_edges(spark, d), _membership(spark, d)).withColumn("bridge_score", F.round("bridge_score", 6))


@query(
    "intro_hint",
    sql(
        """select src, dst, ref_pos, intro, intro_plain, case when ref_pos <= intro then 'INTRO_HINT_CITES' else 'CITES' end as edge_type,
            case when ref_pos <= intro then 2.0::double else 1.0::double end as weight from (select src, dst, ref_pos,
                cast(least(case when n_refs >= 10 then greatest(floor(n_refs * 0.25), 10) else floor(n_refs * 0.25) end, 40, 20) as integer) as intro,
                cast(case when n_refs >= 10 then greatest(least(floor(n_refs * 0.25), 20), 10) else n_refs end as integer) as intro_plain from v_ref) t"""
    ),
)
def intro_hint(spark, d):
    return graph.intro_hints(references(spark, d))


@query(
    "position_hint",
    sql("select src, dst, ref_pos, case when (ref_pos - 1) * 1.0 / n_refs < 0.2 then 'early' when (ref_pos - 1) * 1.0 / n_refs > 0.7 then 'late' else 'middle' end as position from v_ref"),
)
def position_hint(spark, d):
    return graph.position_hints(references(spark, d))


#: A work's year and author are those of the paper that cites it first; fine concepts (brand and type) are shared if they are of the work's kind.
REFS = """v_origin as (select dst as work_id, min(year) as work_year, arg_min(author_id, (year, paper_id)) as work_author from v_ref join v_paper on src = paper_id group by dst),
v_kinds as (select l_orderkey as paper_id, p_type as kind, count(distinct p_brand) as shared from lineitem join part on l_partkey = p_partkey group by all),
v_typed as (select src, dst, ref_pos, year - work_year as gap, citation_count, author_id = work_author as same_author, size > 45 as is_method, coalesce(shared, 0) as shared,
    case when (ref_pos - 1) * 1.0 / n_refs < 0.2 then 'early' when (ref_pos - 1) * 1.0 / n_refs > 0.7 then 'late' else 'middle' end as position
    from v_ref join v_paper p on src = p.paper_id join v_work w on dst = w.work_id join v_origin o on o.work_id = dst left join v_kinds k on k.paper_id = src and k.kind = w.kind)"""


def _typed(spark, d):
    refs, p, w = references(spark, d), papers(spark, d), works(spark, d)
    cited = refs.join(p, F.col("src") == F.col("paper_id"))
    origin = cited.groupBy(F.col("dst").alias("work_id")).agg(F.min("year").alias("work_year"), F.min_by("author_id", F.struct("year", "paper_id")).alias("work_author"))
    kinds = refs.join(w, F.col("dst") == F.col("work_id")).groupBy(F.col("src").alias("paper_id"), "kind").agg(F.countDistinct("brand").alias("shared"))
    joined = graph.position_hints(refs).join(p, F.col("src") == F.col("paper_id")).join(w.join(origin, "work_id"), F.col("dst") == F.col("work_id")).join(kinds, ["paper_id", "kind"], "left")
    return joined.select(
        "src", "dst", "ref_pos", "position", "citation_count", (F.col("year") - F.col("work_year")).alias("gap"), (F.col("author_id") == F.col("work_author")).alias("same_author"),
        (F.col("size") > 45).alias("is_method"), F.coalesce("shared", F.lit(0)).alias("shared"),
    )


@query(
    "ref_types",
    sql(
        """select src, dst, ref_pos, case when same_author then 'self_cite' when (gap >= 10 or citation_count >= 100) and position = 'early' then 'foundational'
            when is_method or position = 'late' then 'methodological' else 'regular' end as ref_type,
            case when same_author then 'self_cite' when shared >= 3 and gap <= 3 then 'extension' when is_method or gap >= 5 then 'comparison'
            when shared between 1 and 2 then 'application' else 'regular' end as cite_type,
            round(0.3 * ln(1 + citation_count) + 0.2 * shared + case when gap <= 5 then 0.3 when gap >= 10 then 0.2 else 0 end
            + case position when 'early' then 0.2 when 'late' then 0.1 else 0 end, 6) as importance from v_typed""",
        REFS,
    ),
)
def ref_types(spark, d):
    t = _typed(spark, d)
    ref = graph.reference_type(F.col("same_author"), F.col("gap"), F.col("citation_count"), F.col("position"), F.col("is_method"))
    cite = graph.citation_type(F.col("same_author"), F.col("shared"), F.col("gap"), F.col("is_method"))
    worth = graph.reference_importance(F.col("citation_count"), F.col("shared"), F.col("gap"), F.col("position"))
    return t.select("src", "dst", "ref_pos", ref.alias("ref_type"), cite.alias("cite_type"), F.round(worth, 6).alias("importance"))


@query(
    "hub_classify",
    sql(
        """select paper_id, hub, case hub when 'mega' then 0 when 'suppressed' then 10 when 'hub' then 25 else 50 end as refs, case hub when 'mega' then 0 when 'suppressed' then 5 when 'hub' then 15 else 30 end as cites,
            case hub when 'mega' then 0 when 'suppressed' then 0 when 'hub' then 10 else 20 end as authors, case hub when 'mega' then 0.1::double when 'suppressed' then 0.3 when 'hub' then 0.7 else 1.0 end as penalty
        from (select paper_id, case when citation_count >= 50000 or paper_id in (select paper_id from v_known) then 'mega' when citation_count >= 5000 and round(coalesce(topical, 0), 9) < 0.3 then 'suppressed'
            when citation_count >= 5000 then 'hub' else 'none' end as hub from v_paper left join v_topical using (paper_id)) t""",
        TOPICAL + ", v_known as (select paper_id from v_paper order by citation_count desc, paper_id limit 5)",
    ),
)
def hub_classify(spark, d):
    p = papers(spark, d)
    known = p.orderBy(F.desc("citation_count"), "paper_id").limit(5).select("paper_id", F.lit(True).alias("known"))  # a list of known hubs
    nodes = p.join(topical(spark, d), "paper_id", "left").withColumn("relevance", F.round(F.coalesce("topical", F.lit(0.0)), 9))
    h = graph.hubs(nodes.join(F.broadcast(known), "paper_id", "left"), F.coalesce("known", F.lit(False)))
    return h.select("paper_id", "hub", "limits.refs", "limits.cites", "limits.authors", "penalty")


@query("degrees", sql("select coalesce(a.src, b.dst) as node, coalesce(o, 0) as out_degree, coalesce(i, 0) as in_degree from (select src, count(*) as o from v_edge group by src) a full join (select dst, count(*) as i from v_edge group by dst) b on a.src = b.dst", CLUSTERS))
def degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query(
    "sync_edges",
    sql(
        """select src, dst, min(ref_pos) as seq from v_ref where src in (select paper_id from v_paper where citation_count >= 30000) and dst in (select work_id from v_work where size <= 25)
            and (src, dst) not in (select src, dst from v_ref where ref_pos > 5) group by src, dst"""
    ),
)
def sync_edges(spark, d):
    refs = _edges(spark, d).withColumnRenamed("ref_pos", "seq")
    nodes = papers(spark, d).where("citation_count >= 30000").select((F.col("paper_id") * 2).alias("node")).unionAll(works(spark, d).where("size <= 25").select((F.col("work_id") * 2 + 1).alias("node")))
    got = graph.materialised_edges(refs, nodes, refs.where("seq > 5"))
    return got.select((F.col("src") / 2).cast("bigint").alias("src"), ((F.col("dst") - 1) / 2).cast("bigint").alias("dst"), "seq")


HOPS = CLUSTERS + """, v_both as (select src as node, dst as near from v_edge union select dst, src from v_edge),
v_seednode as (select paper_id * 2 as node from v_paper where is_seed union all select work_id * 2 + 1 from v_work where work_id % 200 = 0)"""
#: SQL needs a bound on its walk; the frontier of these tables is empty after five hops, Spark's loop has no bound.
WALK = f"""with recursive {sql('', HOPS)[5:]}, v_walk(node, distance) as (select node, 0 from v_seednode union select near, distance + 1 from v_walk join v_both using (node) where distance < 12),
    v_hop as (select node, min(distance) as distance from v_walk group by node)"""


def _seed_nodes(spark, d):
    """Seed papers, and some cited works."""
    own = papers(spark, d).where("is_seed").select((F.col("paper_id") * 2).alias("node"))
    return own.unionAll(works(spark, d).where("work_id % 200 = 0").select((F.col("work_id") * 2 + 1).alias("node")))


@query("bfs_depth", f"{WALK} select node, distance from v_hop")
def bfs_depth(spark, d):
    return traversal.hop_distances(_edges(spark, d), _seed_nodes(spark, d))


def _with_depth(spark, d):
    """Papers and their hops from the seeds, 10 where none leads there."""
    hops = traversal.hop_distances(_edges(spark, d), _seed_nodes(spark, d)).where("node % 2 = 0")
    depth = hops.select((F.col("node") / 2).cast("bigint").alias("paper_id"), F.col("distance").alias("depth"))
    return papers(spark, d).join(depth, "paper_id", "left").fillna(10, ["depth"])


DEPTH = f"{WALK}, {TOPICAL}, v_depth as (select p.*, coalesce(distance, 10) as depth from v_paper p left join v_hop on node = paper_id * 2)"


@query(
    "reading_list",
    f"""{DEPTH} select paper_id, is_seed, round(score, 6) as score from (select paper_id, is_seed, coalesce(topical, 0) / (1 + 0.3 * depth) + 0.1 * ln(1 + citation_count) as score from v_depth left join v_topical using (paper_id)) t
        where is_seed or score > 0.1 order by is_seed desc, t.score desc, paper_id limit 50""",
)
def reading_list(spark, d):
    found = relevance.reading_list(_with_depth(spark, d), topical(spark, d))
    return found.select("paper_id", "is_seed", F.round("score", 6).alias("score"))


@query(
    "priority_g1",
    f"""{DEPTH}, v_dated as (select distinct paper_id, name, year from v_concept join v_paper using (paper_id)),
        v_new as (select paper_id, avg(case when year = first_year then 1.0 else 0.0 end) as novelty from v_dated join (select name, min(year) as first_year from v_dated group by name) f using (name) group by paper_id)
        select paper_id, round((0.4 * coalesce(topical, 0) + 0.15 * coalesce(novelty, 0) + 0.25 * greatest(0, 1 - (2002 - year) / 10.0) + 0.2 * least(log10(citation_count + 1) / 4, 1)) / (1 + 0.3 * depth), 6) as priority
        from v_depth left join v_topical using (paper_id) left join v_new using (paper_id)""",
)
def priority_g1(spark, d):
    """Relevance, novelty and depth come from the topical score, the concepts' first years and the hops."""
    p = _with_depth(spark, d)
    both = p.join(topical(spark, d), "paper_id", "left").join(insights.novelty(concepts(spark, d), p), "paper_id", "left").fillna(0.0, ["topical", "novelty"])
    recency = F.greatest(F.lit(0.0), 1 - (2002 - F.col("year")) / 10)
    return both.select("paper_id", F.round(exprs.priority(F.col("topical"), F.col("novelty"), recency, F.col("citation_count"), F.col("depth")), 6).alias("priority"))


LINKS = """v_pairlink as (select paper_id * 2 as x, coauthor_id * 2 + 1 as y from v_authorship), v_sym as (select x as u, y as v from v_pairlink union select y, x from v_pairlink),
v_comp(node, component) using key (node) as (select u, u from v_sym group by u union
    select v, min(r.component) from v_comp r join v_sym on r.node = u join recurring.v_comp c on c.node = v where r.component < c.component group by v)"""


def _paper_components(spark, d):
    return components.components(authorship(spark, d).select((F.col("paper_id") * 2).alias("a"), (F.col("coauthor_id") * 2 + 1).alias("b")))


@query("components", f"with recursive {sql('', LINKS)[5:]} select node, component from v_comp")
def connected_components(spark, d):
    return _paper_components(spark, d)


@query(
    "reachable_seeds",
    f"""with recursive {sql('', LINKS)[5:]} select node, cast(least(coalesce(n, 0), 6) as integer) as paths from v_comp left join (
        select component, count(*) as n from v_comp where node in (select paper_id * 2 from v_paper where is_seed) group by component) s using (component)""",
)
def reachable_seeds(spark, d):
    return traversal.reachable_seeds(_paper_components(spark, d), papers(spark, d).where("is_seed").select((F.col("paper_id") * 2).alias("node")))


@query("bucket_generations")
def bucket_generations(spark, d):
    edges = _edges(spark, d)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("ref_pos"))
    nodes = papers(spark, d).select((F.col("paper_id") * 2).alias("paper"), (F.col("citation_count") / 70000).alias("relevance"))
    nodes = nodes.unionAll(works(spark, d).select((F.col("work_id") * 2 + 1).alias("paper"), (F.col("size") / 50).alias("relevance")))
    seeds = papers(spark, d).where("is_seed").select((F.col("paper_id") * 2).alias("paper"))
    return traversal.bucket_generations(edges.unionAll(back), nodes, seeds)


@query("depth_expansion")
def depth_expansion(spark, d):
    nodes = papers(spark, d).select((F.col("paper_id") * 2).alias("paper"), (F.col("citation_count") / 70000).alias("relevance"), "citation_count")
    nodes = nodes.unionAll(works(spark, d).select((F.col("work_id") * 2 + 1).alias("paper"), (F.col("size") / 50).alias("relevance"), F.lit(0).cast("bigint").alias("citation_count")))
    seeds = papers(spark, d).where("is_seed").select((F.col("paper_id") * 2).alias("paper"))
    return traversal.depth_expansion(_edges(spark, d), nodes, seeds)


@query("communities")
def communities(spark, d):
    return traversal.label_communities(_edges(spark, d))


@query("betweenness")
def betweenness(spark, d):
    """On the graph of fine concepts (brand and type) that meet in more papers than the average pair."""
    lines = references(spark, d).join(works(spark, d), F.col("dst") == F.col("work_id"))
    named = lines.select(F.col("src").alias("paper_id"), F.concat_ws(" ", "brand", "kind").alias("name"))
    pairs = materialize(topics.topic_pairs(named), "pairs")
    mean = pairs.agg(F.avg("papers").alias("mean"))
    strong = pairs.crossJoin(F.broadcast(mean)).where("papers > mean")  # one row
    return between.betweenness(strong.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumn("betweenness", F.round("betweenness", 6))


@query(
    "rolling_drift",
    sql(
        """select event_id, user_id, round(share, 6) as share, stop from (select event_id, user_id, avg(case when value < 20 then 1.0 else 0.0 end) over w as share,
            count(*) over w >= 30 and avg(case when value < 20 then 1.0 else 0.0 end) over w < 0.10 as stop from events
            window w as (partition by user_id order by ts, event_id rows between 29 preceding and current row)) t"""
    ),
)
def rolling_drift(spark, d):
    events = table(spark, d, "events").withColumn("on_topic", F.coalesce(F.col("value") < 20, F.lit(False)))
    return traversal.rolling_share(events, ["user_id"], ["ts", "event_id"], "on_topic").select("event_id", "user_id", F.round("share", 6).alias("share"), "stop")


PARTS = """v_seed2 as (select node from v_seednode), v_out as (select distinct src as node, dst as near from v_edge), v_in as (select distinct dst as node, src as near from v_edge),
v_outall as (select distinct near from v_out where node in (select node from v_seed2)), v_inall as (select distinct near from v_in where node in (select node from v_seed2)),
v_couple as (select node, count(*) filter (near in (select near from v_outall)) * 1.0 / (count(*) + (select count(*) from v_outall) - count(*) filter (near in (select near from v_outall))) as coupling from v_out group by node),
v_cocite as (select node, count(*) filter (near in (select near from v_inall)) * 1.0 / (count(*) + (select count(*) from v_inall) - count(*) filter (near in (select near from v_inall))) as cocitation from v_in group by node),
v_node as (select paper_id * 2 as node, citation_count >= 50000 as is_review, citation_count as cites, year, venue as title from v_paper
    union all select work_id * 2 + 1, size > 45, coalesce(n, 0), 1995, title from v_work left join (select dst, count(*) as n from v_ref group by dst) c on dst = work_id),
v_support as (select node, sum(w) as w from (select e.dst as node, 1.0 as w from v_edge e join v_node n on n.node = e.src where is_review union all
    select e.src, 0.5 from v_edge e join v_node n on n.node = e.dst where is_review) t group by node),
v_paths as (select node, count(*) as paths from (select distinct b.node, s.node as seed from v_both b join v_seed2 s on s.node = b.near) t group by node),
v_parts as (select n.node, year, cites, distance, least(coalesce(paths, 0), 6) as paths, coupling, cocitation, case when is_review then 1.0 else least(coalesce(w, 0) / 3, 1.0) end as portal,
    (contains(lower(title), 'high') or contains(lower(title), 'steel'))::int * 0.5 + (contains(lower(title), 'urgent') or contains(lower(title), 'brass'))::int * 0.5 as keyword
    from v_node n left join v_hop h on h.node = n.node left join v_paths p on p.node = n.node left join v_couple c on c.node = n.node left join v_cocite o on o.node = n.node left join v_support s on s.node = n.node)"""


def relevance_parts(spark, d):
    """Every paper and work with what graph relevance weighs, all of it from the graph: node, year, cites, distance, paths, coupling, cocitation, portal, keyword."""
    edges, seeds = materialize(_edges(spark, d), "edges"), materialize(_seed_nodes(spark, d), "seeds")
    p, w = papers(spark, d), works(spark, d)
    counts = references(spark, d).groupBy(F.col("dst").alias("work_id")).agg(F.count("*").alias("n"))
    own = p.select((F.col("paper_id") * 2).alias("node"), (F.col("citation_count") >= 50_000).alias("is_review"), F.col("citation_count").alias("cites"), "year", F.col("venue").alias("title"))
    cited = w.join(counts, "work_id", "left").select((F.col("work_id") * 2 + 1).alias("node"), (F.col("size") > 45).alias("is_review"), F.coalesce("n", F.lit(0)).alias("cites"), F.lit(1995).alias("year"), "title")
    nodes = own.unionAll(cited)
    words = [F.greatest(*(exprs.keyword_match(F.col("title"), [x]) for x in pair)) for pair in (("high", "steel"), ("urgent", "brass"))]
    out = nodes.withColumn("keyword", sum(words, F.lit(0.0)) / 2)
    near = graph.near_seeds(edges, seeds)
    for part in (traversal.hop_distances(edges, seeds), near, graph.coupling(edges, seeds), graph.cocitation(edges, seeds), graph.portal_support(edges, nodes)):
        out = out.join(part, "node", "left")
    return out.withColumn("paths", F.coalesce("paths", F.lit(0)))


@query(
    "graph_relevance",
    WALK + ", " + PARTS + """ select node, round(least((0.45 * exp(-0.9 * coalesce(distance, 3)) + 0.20 * least(1.0, ln(1 + paths) / ln(6)) + 0.15 * greatest(coalesce(coupling, 0), coalesce(cocitation, 0))
        + 0.10 * portal + 0.10 * keyword) * case when cites >= 50000 then 0.1 when cites >= 5000 and keyword < 0.3 then 0.3 when cites >= 5000 then 0.7 else 1.0 end, 1.0), 6) as relevance from v_parts""",
)
def graph_relevance(spark, d):
    parts = relevance_parts(spark, d).withColumn("hub", exprs.hub_type("cites", "keyword"))
    return graph.relevance(parts).select("node", F.round("relevance", 6).alias("relevance"))


@query(
    "materialization",
    WALK + ", " + PARTS + """, v_nearc as (select node, cluster, count(*) as n from (select b.node, cluster from v_both b join v_member m on m.node = b.near) t group by all),
        v_div as (select node, 1 - max(n) * 1.0 / sum(n) as diversity from v_nearc group by node having count(*) >= 2)
        select p.node, round(least(0.35 * exp(-0.9 * coalesce(distance, 3)) + 0.20 * least(1.0, ln(1 + paths) / ln(6)) + 0.15 * greatest(coalesce(coupling, 0), coalesce(cocitation, 0)) + 0.10 * portal
            + 0.10 * coalesce(diversity, 0) + 0.10 * (0.5 * greatest(0.0, 1 - (2002 - year) / 10.0) + 0.5 * least(log10(cites + 1) / 4, 1.0)), 1.0), 6) as materialization_score from v_parts p left join v_div v on v.node = p.node""",
)
def materialization(spark, d):
    bridges = graph.bridge_diversity(_edges(spark, d), _membership(spark, d)).select("node", F.col("diversity").alias("bridge"))
    parts = relevance_parts(spark, d).join(bridges, "node", "left").withColumnRenamed("cites", "citation_count")
    return graph.materialization(parts).select("node", F.round("materialization_score", 6).alias("materialization_score"))


@query(
    "citation_walk",
    f"""{WALK}, v_list as (select src, dst, ref_pos, count(*) over (partition by src) as n from (select src * 2 as src, dst * 2 + 1 as dst, ref_pos from v_ref) e where ref_pos <= 4),
        v_hint as (select *, least(case when n >= 10 then greatest(floor(n * 0.25), 10) else floor(n * 0.25) end, 20) as k from v_list),
        v_cites as (select *, row_number() over (partition by dst order by src) as r from (select distinct src, dst from v_edge) d)
        select dst as paper, src as found_from, 'backward' as channel, distance + 1 as depth, case when ref_pos <= k then 'INTRO_HINT_CITES' else 'CITES' end as edge_type, case when ref_pos <= k then 2.0 else 1.0 end::double as weight
        from v_hint join v_hop on node = src union all select src, dst, 'forward', distance + 1, 'CITES', 1.0 from v_cites join v_hop on node = dst where r <= 30""",
)
def citation_walk(spark, d):
    depths = traversal.hop_distances(_edges(spark, d), _seed_nodes(spark, d)).select(F.col("node").alias("paper"), F.col("distance").alias("depth"))
    return graph.citation_walk(_edges(spark, d), depths, most_refs=4)


@query(
    "citing_relevance",
    sql("select src, dst, ref_pos, round(0.3 * ln(1 + citation_count) + 0.3 * shared + case when gap <= 2 then 0.3 when gap <= 5 then 0.2 else 0.1 end, 6) as relevance from v_typed", REFS),
)
def citing_relevance(spark, d):
    return _typed(spark, d).select("src", "dst", "ref_pos", F.round(graph.citing_relevance(F.col("citation_count"), F.col("shared"), F.col("gap")), 6).alias("relevance"))
