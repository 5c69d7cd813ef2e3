"""Queries of plain retrieval, classes and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.functions import exprs
from athenor.operators import authors, graph, insights, lookups, matching, selection, topics
from athenor.plans.adapter import authorship, concepts, papers, references, sql, texts, works
from athenor.plans.graph_queries import CLUSTERS, _edges, _seed_nodes
from athenor.plans.registry import query
from athenor.plans.score_queries import TOPICAL
from athenor.plans.score_queries import _topical as topical


@query("count_estimate", sql("select count(*) as papers from v_paper where year between 1996 and 1999 and citation_count >= 5000"))
def count_estimate(spark, d):
    return papers(spark, d).where("year between 1996 and 1999 and citation_count >= 5000").agg(F.count("*").alias("papers"))


@query("author_works", sql("select paper_id, year, venue from v_paper where year >= 1996 and paper_id in (select paper_id from v_authorship where coauthor_id = 7) order by year desc, paper_id limit 20 offset 20"))
def author_works(spark, d):
    return lookups.author_works(papers(spark, d), authorship(spark, d), 7, 1996, None, 20, 25).select("paper_id", "year", "venue")


@query("top_concepts", sql("select name as value, count(distinct paper_id) as papers from v_concept where pos <= 3 group by name order by papers desc, value limit 5"))
def top_concepts(spark, d):
    return lookups.top_values(concepts(spark, d).where("pos <= 3"), "name", 5)


@query("status_filter", sql("select paper_id, status from v_paper where status <> 'F'"))
def status_filter(spark, d):
    return lookups.with_status(papers(spark, d), "F", exclude=True).select("paper_id", "status")


@query("filled_texts", sql("select id, coalesce(trim(abstract, ' ') <> '', false) as has_abstract, coalesce(trim(title, ' ') <> '', false) or coalesce(trim(venue, ' ') <> '', false) as has_any from v_text"))
def filled_texts(spark, d):
    return texts(spark, d).select("id", lookups.is_filled(F.col("abstract")).alias("has_abstract"), lookups.any_filled(F.col("title"), F.col("venue")).alias("has_any"))


@query("provider_counts", sql("select provider, case when provider = '3-MEDIUM' then -1 else n end as papers from (select venue as provider, count(*) as n from v_paper group by venue) t"))
def provider_counts(spark, d):
    found = papers(spark, d).select(F.col("venue").alias("provider"))
    asked = found.distinct().withColumn("failed", F.col("provider").startswith("3"))
    return lookups.provider_counts(found, asked)


@query("frontier_papers", sql("select dst as node, count(*) as cited from v_edge where dst not in (select src from v_edge) group by dst order by cited desc, node limit 50", CLUSTERS))
def frontier_papers(spark, d):
    nodes = papers(spark, d).select((F.col("paper_id") * 2).alias("node")).unionAll(works(spark, d).select((F.col("work_id") * 2 + 1).alias("node")))
    return lookups.frontier_papers(nodes, _edges(spark, d))


@query("seed_authors", sql("select coauthor_id, count(*) as papers from v_authorship where paper_id in (select paper_id from v_paper where is_seed) group by coauthor_id order by papers desc, coauthor_id limit 50"))
def seed_authors(spark, d):
    return lookups.seed_authors(papers(spark, d), authorship(spark, d))


NEAR = CLUSTERS + """, v_start as (select paper_id * 2 as node from v_paper where is_seed union all select work_id * 2 + 1 from v_work where work_id % 200 = 0),
v_zone as (select node from v_start union select dst from v_edge where src in (select node from v_start) union select src from v_edge where dst in (select node from v_start))"""


@query("neighbourhood", sql("select node from v_zone", NEAR))
def neighbourhood(spark, d):
    return lookups.neighbourhood(_edges(spark, d), _seed_nodes(spark, d))


@query("induced_edges", sql("select src, dst, count(*) as n from v_edge where src in (select node from v_zone) and dst in (select node from v_zone) group by all", NEAR))
def induced_edges(spark, d):
    edges = _edges(spark, d)
    return lookups.induced(edges, lookups.neighbourhood(edges, _seed_nodes(spark, d))).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    "author_edges",
    sql(
        """select coauthor_id, count(*) as edges, count(distinct dst) as works from (select distinct coauthor_id, src, dst from (select paper_id * 2 as paper, coauthor_id from v_authorship) a
            join (select src as node, src, dst from v_edge union all select dst, src, dst from v_edge) e on node = paper) t group by coauthor_id""",
        CLUSTERS,
    ),
)
def author_edges(spark, d):
    own = authorship(spark, d).select((F.col("paper_id") * 2).alias("paper_id"), "coauthor_id")
    return lookups.author_edges(own, _edges(spark, d)).groupBy("coauthor_id").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("works"))


@query(
    "outgoing",
    sql(
        """select src, node, citation_count, rank from (select src, node, citation_count, cast(row_number() over (partition by src order by citation_count desc, node) as integer) as rank from (
            select distinct src, dst as node, n as citation_count from v_ref join (select dst as d, count(*) as n from v_ref group by dst) c on d = dst where src % 100 = 0) t) u where rank <= 20"""
    ),
)
def outgoing(spark, d):
    refs = references(spark, d)
    cited = refs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("citation_count")).withColumn("year", F.lit(1995))
    return lookups.outgoing(refs, cited, F.col("src") % 100 == 0).select("src", "node", "citation_count", "rank")


@query("trajectory_authors", sql("select coauthor_id, count(*) as papers from v_authorship group by coauthor_id having count(*) >= 3 order by papers desc, coauthor_id limit 30"))
def trajectory_authors(spark, d):
    return lookups.trajectory_authors(authorship(spark, d))


@query("prune_when_full", sql("select paper_id from (select *, (select count(*) from v_paper) as total from v_paper) t order by is_seed desc, citation_count desc, paper_id limit 600"))
def prune_when_full(spark, d):
    return lookups.prune_when_full(papers(spark, d), "citation_count", 1_000).select("paper_id")


WORD = " or ".join(f"contains(lower(title), '{w}')" for w in insights.METHOD_WORDS)


@query("hub_kinds", sql(f"select id, case when {WORD} then 'methodology' when is_review then 'review' else 'high_citation' end as kind from (select id, coalesce(title, '') as title, is_review from v_text) t"))
def hub_kinds(spark, d):
    t = texts(spark, d)
    return t.select("id", insights.hub_kind(F.col("title"), F.col("is_review"), F.lit(None).cast("int"), F.lit(0)).alias("kind"))


VENUE = {name: " or ".join(f"contains(lower(coalesce(venue, '')), '{w}')" for w in words) for name, words in (("c", insights.CONFERENCE_WORDS), ("p", insights.PREPRINT_WORDS))}


@query(
    "work_types",
    sql(
        f"""select author_id, work_type, count(*) as papers, round(count(*) * 1.0 / sum(count(*)) over (partition by author_id), 6) as share from (
            select author_id, case when {VENUE['c']} then 'conference' when {VENUE['p']} then 'preprint' when coalesce(trim(venue), '') <> '' then 'journal' else 'unknown' end as work_type from v_paper) t group by author_id, work_type"""
    ),
)
def work_types(spark, d):
    return insights.work_types(papers(spark, d), "author_id").withColumn("share", F.round("share", 6))


@query(
    "topic_categories",
    sql(
        """select category, cast(row_number() over (partition by category order by weight desc, name) as integer) as rank, name from (
            select name, weight, unnest(list_concat(case when papers > total * 0.1 then ['core'] else [] end, case when trend in ('emerging', 'new') then ['emerging'] else [] end,
                case when trend = 'declining' then ['declining'] else [] end, case when papers < total * 0.05 then ['specific'] else [] end)) as category from (
                select e.name, papers, round(weight, 4) as weight, (select count(*) from v_paper) as total, case when early = 0 then 'new' when late * 1.0 / greatest(l, 1) > early * 1.0 / greatest(e, 1) + 0.2 then 'emerging'
                    when late * 1.0 / greatest(l, 1) < early * 1.0 / greatest(e, 1) - 0.2 then 'declining' else 'stable' end as trend
                from (select name, count(distinct paper_id) as papers, sum(score * (ln(1 + citation_count) + 1)) as weight from v_concept join v_paper using (paper_id) group by name having count(distinct paper_id) >= 3) e
                join (select name, count(distinct paper_id) filter (year <= mid) as early, count(distinct paper_id) filter (year > mid) as late from v_concept join v_paper using (paper_id), v_mid group by name) t on t.name = e.name,
                (select count(*) filter (year <= mid) as e, count(*) filter (year > mid) as l from v_paper, v_mid) s) x) y qualify rank <= 10""",
        "v_mid as (select floor((min(year) + max(year)) / 2.0) as mid from v_paper)",
    ),
)
def topic_categories(spark, d):
    c, p = concepts(spark, d), papers(spark, d)
    found = topics.extract(c, p).join(topics.trends(c, p).select("name", "trend"), "name").withColumn("weight", F.round("weight", 4))
    return insights.categorise(found, p.agg(F.count("*").alias("n")))


@query(
    "related_concepts",
    sql(
        """select name, len(list_filter(focus, lambda f: list_has_any(string_split(lower(name), ' '), string_split(lower(f), ' ')))) > 0 as is_related
            from (select distinct p_brand || ' ' || p_type as name from part) t, (select list(name) as focus from (select name from v_concept group by name order by sum(score) desc, name limit 2) u) f"""
    ),
)
def related_concepts(spark, d):
    best = concepts(spark, d).groupBy("name").agg(F.sum("score").alias("s")).orderBy(F.desc("s"), "name").limit(2).agg(F.collect_list("name").alias("focus"))  # two names
    names = works(spark, d).select(F.concat_ws(" ", "brand", "kind").alias("name")).distinct()
    return names.crossJoin(F.broadcast(best)).select("name", insights.is_related(F.col("name"), F.col("focus")).alias("is_related"))


@query(
    "novelty",
    sql("select paper_id, round(avg(case when year = first_year then 1.0 else 0.0 end), 6) as novelty from v_fine2 join (select name, min(year) as first_year from v_fine2 group by name) f using (name) group by paper_id",
        "v_fine2 as (select distinct l_orderkey as paper_id, p_brand || ' ' || p_type || ' ' || p_size as name, year from lineitem join part on l_partkey = p_partkey join v_paper on paper_id = l_orderkey)"),
)
def novelty(spark, d):
    lines = references(spark, d).join(works(spark, d), F.col("dst") == F.col("work_id"))
    return insights.novelty(lines.select(F.col("src").alias("paper_id"), F.concat_ws(" ", "brand", "kind", "size").alias("name")), papers(spark, d)).withColumn("novelty", F.round("novelty", 6))


@query(
    "diversity_guard",
    sql("select paper_id, venue from (select *, row_number() over (partition by venue order by citation_count desc, paper_id) as r from v_paper) t where r <= 30 order by citation_count desc, paper_id limit 100"),
)
def diversity_guard(spark, d):
    return insights.diversity_guard(papers(spark, d), "venue", [F.desc("citation_count"), F.col("paper_id")], 100, 0.3).select("paper_id", "venue")


@query(
    "relevance_gate",
    sql(
        """select src, dst, ref_pos, coalesce(gate, case when citation_count >= 500 and t >= 0.15 then 'CITES' end) as edge_type, gate is null as turned_away from (select *,
            case when citation_count >= 50000 and t < 0.3 then case when t >= 0.15 then 'CITES' end when ref_pos <= intro and t >= 0.20 then 'INTRO_HINT_CITES' when ref_pos > intro and t >= 0.15 then 'CITES' end as gate from (
            select src, dst, ref_pos, citation_count, round(coalesce(topical, 0), 9) as t, least(case when n_refs >= 10 then greatest(floor(n_refs * 0.25), 10) else floor(n_refs * 0.25) end, 20) as intro
            from v_ref join v_paper on src = paper_id left join v_topical using (paper_id)) x) y""",
        TOPICAL,
    ),
)
def relevance_gate(spark, d):
    refs = graph.intro_hints(references(spark, d)).join(papers(spark, d), F.col("src") == F.col("paper_id")).join(topical(spark, d), "paper_id", "left")
    score = F.round(F.coalesce("topical", F.lit(0.0)), 9)
    gate = exprs.relevance_gate(score, F.col("ref_pos") <= F.col("intro"), F.col("citation_count"))
    return refs.select("src", "dst", "ref_pos", insights.bridge_allowance(gate, score, F.col("citation_count")).alias("edge_type"), gate.isNull().alias("turned_away"))


@query(
    "missing_intermediates",
    sql(
        """select distinct p.a, p.b, e.dst as via from (select x.src as a, y.dst as b from v_pub x join v_pub y on x.dst = y.src where x.src % 100 = 0 and x.src <> y.dst) p join v_pub e on e.src = p.a join v_pub f on f.src = e.dst and f.dst = p.b""",
        "v_pub as (select distinct p.author_id as src, coauthor_id + 100000000 as dst from v_paper p join v_authorship using (paper_id) union select coauthor_id + 100000000, c_nationkey + 200000000 from v_authorship join v_paper using (paper_id) join customer on c_custkey = author_id)",
    ),
)
def missing_intermediates(spark, d):
    """Lead authors, their co-authors, and the countries that these work with; from every hundredth lead author."""
    from athenor.functions.storage import table

    both = papers(spark, d).join(authorship(spark, d), "paper_id").join(table(spark, d, "customer"), F.col("author_id") == F.col("c_custkey"))
    far = (F.col("coauthor_id") + 100_000_000).alias("mid")
    edges = both.select(F.col("author_id").alias("src"), far.alias("dst")).union(both.select(far.alias("src"), (F.col("c_nationkey") + 200_000_000).cast("bigint").alias("dst"))).distinct()
    start = edges.where("src % 100 = 0 and src < 100000000").select(F.col("src").alias("a"), F.col("dst").alias("m"))
    pairs = start.join(edges.select(F.col("src").alias("m"), F.col("dst").alias("b")), "m").where("a <> b").select("a", "b").distinct()
    return graph.missing_intermediates(edges, pairs)


@query(
    "capped_edges",
    sql("select src, dst, weight from (select *, row_number() over (partition by src order by weight desc, dst) as r from (select author_id as src, dst, count(*) as weight from v_ref join v_paper on src = paper_id group by all) t) u where r <= 20"),
)
def capped_edges(spark, d):
    refs = references(spark, d).join(papers(spark, d), F.col("src") == F.col("paper_id"))
    return graph.capped(refs.groupBy(F.col("author_id").alias("src"), "dst").agg(F.count("*").alias("weight")), 20)


@query(
    "cut_to_capacity",
    sql(
        """select src, dst, weight from (select paper_id * 2 as src, dst * 2 + 1 as dst, weight from (select src as paper_id, dst, count(*) as weight from v_ref group by all) e) g
            where src in (select node from v_best) and dst in (select node from v_best) order by weight desc, src, dst limit 8000""",
        """v_best as (select node from (select paper_id * 2 as node, is_seed as p, citation_count / 70000.0 as score from v_paper union all select work_id * 2 + 1, false, size / 50.0 from v_work) n order by p desc, score desc, node limit 2000)""",
    ),
)
def cut_to_capacity(spark, d):
    nodes = papers(spark, d).select((F.col("paper_id") * 2).alias("node"), (F.col("citation_count") / 70_000).alias("score"), F.col("is_seed").alias("is_protected"))
    nodes = nodes.unionAll(works(spark, d).select((F.col("work_id") * 2 + 1).alias("node"), (F.col("size") / 50).alias("score"), F.lit(False).alias("is_protected")))
    edges = _edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return graph.cut_to_capacity(nodes, edges)[1].select("src", "dst", "weight")


def _people(spark, d):
    """Customers as author records; those of one nation and balance sign share an ORCID-like key where the key is a tenth."""
    from athenor.functions.storage import table

    c = table(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 10 == 0, F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), key.alias("orcid"), F.lit(None).cast("string").alias("openalex_id"), F.lit("").alias("s2_id"), "c_nationkey")


@query(
    "same_author",
    sql(
        """select c.c_custkey as a, b from customer c join (select c_nationkey, c_mktsegment, min(c_custkey) as b from customer where c_custkey % 10 = 0 group by all) m
            on c.c_nationkey = m.c_nationkey and c.c_mktsegment = m.c_mktsegment where c.c_custkey % 10 = 0 and c.c_custkey <> b"""
    ),
)
def same_author(spark, d):
    return authors.same_author(_people(spark, d))


@query(
    "author_confidence",
    sql(
        """select author_id, round(0.5 * case when n > 0 then 1.0 else 0.0 end + 0.2 * (nation < 12)::int + 0.2 * (n > 0)::int + 0.1 * (n > 10)::int, 6)::double as confidence
            from (select c_custkey as author_id, c_nationkey as nation, coalesce(n, 0) as n from customer left join (select author_id, count(*) as n from v_paper group by author_id) p on author_id = c_custkey) t"""
    ),
)
def author_confidence(spark, d):
    counts = papers(spark, d).groupBy("author_id").agg(F.count("*").alias("n"))
    joined = _people(spark, d).join(counts, "author_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = selection.author_confidence((F.col("n") > 0).cast("double"), F.col("c_nationkey") < 12, F.col("n") > 0, F.col("n") * 5)
    return joined.select("author_id", F.round(score, 6).alias("confidence"))


@query(
    "without_self",
    sql(
        """select distinct s.s_suppkey as a, t.s_suppkey as b from v_authorship x join v_authorship y using (paper_id) join supplier s on s.s_suppkey = x.coauthor_id join supplier t on t.s_suppkey = y.coauthor_id
            where x.coauthor_id <= y.coauthor_id and not (list_last(string_split(lower(s.s_name), ' ')) = list_last(string_split(lower(t.s_name), ' ')) and left(lower(s.s_name), 1) = left(lower(t.s_name), 1))"""
    ),
)
def without_self(spark, d):
    """The suppliers that stand together in some order, each with itself too, which the names show."""
    from athenor.functions.storage import table

    listed = authorship(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("coauthor_id"), F.col("s_name").alias("name")), "coauthor_id")
    left = listed.select("paper_id", F.col("coauthor_id").alias("a"), F.col("name").alias("own"))
    right = listed.select("paper_id", F.col("coauthor_id").alias("b"), F.col("name").alias("other"))
    pairs = left.join(right, "paper_id").where("a <= b").select("a", "b", "own", "other").distinct()
    return authors.without_self(pairs, "own", "other").select("a", "b")


FIELDS = [("metals", ["copper", "steel", "brass"], ["nickel", "tin"], ["plated"]), ("colours", ["red", "blue", "green"], ["azure"], [])]


@query(
    "resolve_fields",
    sql(
        """select work_id, case when score > 0.1 then field else 'ocean' end as field, round(score, 6)::double as score, case when score >= 0.5 then 'balanced' when score > 0.1 then 'broad' else 'ocean' end as strategy from (select work_id, field, score, row_number() over (partition by work_id order by score desc, field desc) as r from (
            select work_id, field, 0.4 * len(list_filter(k, lambda t: contains(lower(title), t))) / greatest(len(k), 1) + 0.1 * len(list_filter(i, lambda t: contains(lower(title), t))) / greatest(len(i), 1)
                - 0.15 * len(list_filter(x, lambda t: contains(lower(title), t))) as score
            from (select work_id, title || ' ' || kind as title from v_work) w, (values ('metals', ['copper', 'steel', 'brass'], ['nickel', 'tin'], ['plated']), ('colours', ['red', 'blue', 'green'], ['azure'], cast([] as varchar[]))) f(field, k, i, x)) s) t where r = 1"""
    ),
)
def resolve_fields(spark, d):
    fields = spark.createDataFrame(FIELDS, "field string, key_concepts array<string>, include_terms array<string>, exclude_terms array<string>")
    named = works(spark, d).select("work_id", F.concat_ws(" ", "title", "kind").alias("text"))
    return matching.resolve_fields(named, fields, "text", "work_id").withColumn("score", F.round("score", 6))


@query(
    "explanations",
    sql(
        """select paper_id, case when t >= 0.6 then 'highly relevant' when t >= 0.3 then 'relevant' else 'marginal' end || ': ' || case when t > 0.5 and citation_count >= 100 then 'shares the topic''s concepts; ' || citation_count || ' citations'
            when t > 0.5 then 'shares the topic''s concepts' when citation_count >= 100 then citation_count || ' citations' else 'no single strong reason' end as why
            from (select paper_id, citation_count, round(coalesce(topical, 0), 9) as t from v_paper left join v_topical using (paper_id)) x""",
        TOPICAL,
    ),
)
def explanations(spark, d):
    joined = papers(spark, d).join(topical(spark, d), "paper_id", "left").withColumn("t", F.round(F.coalesce("topical", F.lit(0.0)), 9))
    return joined.select("paper_id", insights.relevance_text(F.col("t"), F.col("t"), F.lit(0.0), F.col("citation_count")).alias("why"))


@query(
    "collaborator_detail",
    sql(
        """select author_id, coauthor_id, papers, concepts, venues, last_year - first_year >= 5 as is_lasting, last_year >= 2000 as is_active from (
            select *, row_number() over (partition by author_id order by papers desc, last_year desc, coauthor_id) as rank from (
                select author_id, coauthor_id, count(*) as papers, min(year) as first_year, max(year) as last_year from v_with group by all) g qualify rank <= 5) b
            left join (select author_id, coauthor_id, list(name order by n desc, name)[1:5] as concepts from (select author_id, coauthor_id, name, sum(score) as n from v_with join v_concept using (paper_id) where pos <= 5 group by all) c group by all) c using (author_id, coauthor_id)
            left join (select author_id, coauthor_id, list(venue order by n desc, venue)[1:3] as venues from (select author_id, coauthor_id, venue, count(*) as n from v_with group by all) c group by all) v using (author_id, coauthor_id)""",
        "v_with as (select p.*, coauthor_id from v_paper p join v_authorship using (paper_id))",
    ),
)
def collaborator_detail(spark, d):
    found = authors.collaborator_detail(papers(spark, d), authorship(spark, d), concepts(spark, d), 5)
    return found.select("author_id", "coauthor_id", "papers", "concepts", "venues", "is_lasting", "is_active")
