"""Queries that expand, cut and resolve: budgets, communities, capacities, authors by any id or name, titles inside titles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from athenor.functions.storage import table
from athenor.iterative import communities, expansion
from athenor.operators import author_search, authors, capacity, containment, graph, landscape, trajectory
from athenor.plans.adapter import authorship, concepts, papers, references, sql, works
from athenor.plans.author_queries import PROFILE, _aligned
from athenor.plans.graph_queries import _edges
from athenor.plans.registry import query


def _scored(spark, d):
    """Papers and works as nodes (even and odd numbers) with relevance from citations or size and price."""
    own = papers(spark, d).select((F.col("paper_id") * 2).alias("paper"), "year", "citation_count", (F.col("citation_count") / 70000).alias("relevance"), "is_seed", F.col("author_id"))
    more = works(spark, d).select((F.col("work_id") * 2 + 1).alias("paper"), (1990 + F.col("size") % 10).cast("int").alias("year"), F.floor("price").cast("bigint").alias("citation_count"), (F.col("size") / 50).alias("relevance"), F.lit(False).alias("is_seed"), F.lit(None).cast("bigint").alias("author_id"))
    return own.unionAll(more)


def _listed(spark, d):
    return references(spark, d).select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"), "ref_pos", "n_refs")


@query("bucket_expansion")
def bucket_expansion(spark, d):
    """No SQL (order and budgets decide); held against the plain loop in tests/test_expansion.py."""
    nodes = _scored(spark, d)
    seeds = nodes.where("paper % 200 = 0").select("paper")  # papers whose id is divisible by 100
    found = expansion.bucket_expansion(_listed(spark, d), nodes.select("paper", "relevance"), seeds)
    return found.papers.withColumns({"stopped": F.lit(found.stopped), "calls": F.lit(found.calls)})


@query("alternating_expansion")
def alternating_expansion(spark, d):
    """No SQL; held against the plain loop in tests/test_expansion.py. Lead author first, then the suppliers of the lines."""
    nodes = _scored(spark, d).withColumns({"bridge": F.col("relevance") / 2, "score": F.col("relevance")})
    lead = nodes.where("author_id is not null").select("paper", (F.col("author_id") * 2).alias("author"), F.lit(0).alias("at"))
    lines = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("paper"), (F.col("l_suppkey") * 2 + 1).alias("author")).agg(F.min("l_linenumber").alias("at"))
    w = Window.partitionBy("paper")
    people = lead.unionByName(lines).withColumns({"pos": F.row_number().over(w.orderBy("at", "author")), "n_authors": F.count("*").over(w)}).drop("at")
    found = expansion.alternating_expansion(_listed(spark, d), nodes.drop("is_seed", "author_id"), people, nodes.where("paper % 200 = 0").select("paper"))
    return found.papers.join(found.nodes.select("paper", F.col("round").alias("entered")), "paper", "left").withColumns({"stopped": F.lit(found.stopped), "calls": F.lit(found.calls)})


@query("modularity_communities")
def modularity_communities(spark, d):
    """No SQL; held against the sequential method in tests/test_communities.py."""
    return communities.modularity_communities(_edges(spark, d), threshold=1e-2)[0]


@query("graph_within_capacity")
def graph_within_capacity(spark, d):
    """No SQL (a fixed point); held against the plain loop in tests/test_author_search.py. Seeds grow with the table, so where they fill the graph they all stay, alone."""
    nodes = _scored(spark, d).select(F.col("paper").alias("node"), F.col("relevance").alias("score"), ((2002 - F.col("year")) / 8760).alias("age_hours"), "is_seed", F.lit(False).alias("is_pinned"), (F.col("citation_count") >= 68_000).alias("is_portal"))
    edges = _edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("is_pinned", F.lit(False))
    return capacity.within_capacity(nodes, edges, strict=False)[1]


SUPPLIERS = """v_listed as (select paper, author, row_number() over (partition by paper order by line, id) as pos from
    (select l_orderkey as paper, l_linenumber as line, case when l_returnflag = 'R' then s_name else s_suppkey::varchar end as id, s_suppkey as author from lineitem join supplier on l_suppkey = s_suppkey) t)"""


@query("authors_by_any_id", sql("select paper, author, cast(dense_rank() over (partition by paper order by least_pos) as integer) as place from (select paper, author, min(pos) as least_pos from v_listed group by paper, author) t", SUPPLIERS))
def authors_by_any_id(spark, d):
    """Suppliers as authors: some lines name them by number, returned ones by name."""
    suppliers = table(spark, d, "supplier")
    records = suppliers.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("openalex_id"), F.lit("").alias("s2_id"), F.lit(None).cast("string").alias("orcid"))
    lines = table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.when(F.col("l_returnflag") == "R", F.col("s_name")).otherwise(F.col("s_suppkey").cast("string"))
    lists = lines.groupBy(F.col("l_orderkey").alias("paper")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", name.alias("id")))), lambda x: x["id"]).alias("author_ids"))
    found = author_search.papers_of(lists, author_search.aliases(records))
    return found.select("paper", "author", F.dense_rank().over(Window.partitionBy("paper").orderBy("pos")).alias("place"))


@query(
    "resolve_names",
    """with a as (select p_partkey as author_id, lower(p_name) as plain, p_brand as affiliation, p_retailprice as works, split_part(lower(p_name), ' ', -1) as last, substr(lower(p_name), 1, 1) as initial from part),
        s as (select *, row_number() over (partition by plain order by works desc, author_id) as r from a), b as (select *, row_number() over (partition by last, initial order by works desc, author_id) as r from a),
        n as (select distinct plain, last, initial from a),
        c as (select plain, author_id, min(far) as far, any_value(affiliation) as place, any_value(works) as works from
            (select n.plain, s.author_id, 0 as far, s.affiliation, s.works from n join s on s.plain = n.plain where s.r <= 5 union all
             select n.plain, b.author_id, 1, b.affiliation, b.works from n join b on b.last = n.last and b.initial = n.initial where b.r <= 5) t group by plain, author_id),
        k as (select *, row_number() over (partition by plain order by far, works desc, author_id) as r from c qualify r <= 5),
        q as (select distinct p_name as name, p_brand as affiliation, lower(p_name) as plain from part)
        select name, q.affiliation, coalesce(min_by(author_id, r) filter (contains(lower(place), lower(q.affiliation))), min_by(author_id, r)) as author_id from q join k using (plain) group by name, q.affiliation""",
)
def resolve_names(spark, d):
    """Part names as author names, brands as affiliations, prices as works."""
    p = table(spark, d, "part")
    known = p.select(F.col("p_partkey").alias("author_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("affiliation"), F.col("p_retailprice").alias("works"))
    return author_search.resolve(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("affiliation")).distinct(), known)


@query(
    "title_containment",
    """with t as (select distinct lower(split_part(text, '.', 1)) as title from benchmark where split_part(text, '.', 1) <> '')
        select title, doc_id as id from t join documents on contains(lower(text), title)""",
)
def title_containment(spark, d):
    """First sentences of the benchmark as titles; the documents that contain them."""
    titles = table(spark, d, "benchmark").select(F.split_part("text", F.lit("."), F.lit(1)).alias("title"))
    return containment.contained(titles, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    "year_summaries",
    sql(
        """select author_id, year, count(*) as works, list_slice(list_filter(list(first_venue order by n), lambda x: x is not null), 1, 5) as venues, cast(sum(citation_count) as bigint) as citations, round(coalesce(avg(case when citation_count > 3000 then citation_count / 70000.0 end), 0), 6) as relevance
            from (select *, case when n = min(n) over (partition by author_id, year, venue) then venue end as first_venue from (select *, row_number() over (partition by author_id, year order by paper_id) as n from v_paper qualify n <= 20) a) t group by author_id, year"""
    ),
)
def year_summaries(spark, d):
    relevance = F.when(F.col("citation_count") > 3_000, F.col("citation_count") / 70_000).otherwise(0.0)
    return landscape.year_summaries(papers(spark, d).withColumn("relevance", relevance)).withColumn("relevance", F.round("relevance", 6))


@query("topical_landscape")
def topical_landscape(spark, d):
    """No SQL (the threshold's rule is picked by counts); held against the plain rules in tests/test_landscape.py."""
    share = F.col("score") / F.sum("score").over(Window.partitionBy("paper_id"))
    return landscape.landscape(papers(spark, d), concepts(spark, d).withColumn("score", share), methods=("promo", "small"), broad=("economy",)).withColumn("topical", F.round("topical", 6))


@query(
    "derived_edges",
    sql(
        """select 'COAUTHOR' as edge_type, a::varchar as src, b::varchar as dst, null::varchar as author_id, papers::double as weight from
            (select x.coauthor_id as a, y.coauthor_id as b, count(*) as papers from v_authorship x join v_authorship y using (paper_id) where x.coauthor_id < y.coauthor_id group by all having count(*) >= 2) c
            union all select 'TRAJECTORY_STEP', author_id || ':' || year_from, author_id || ':' || year_to, author_id::varchar, round(drift, 6) from v_drift where drift > 0.2
            union all select 'AUTHOR_BRIDGE', cluster_a, cluster_b, author_id::varchar, count(*)::double from (select distinct j.author_id, year_from, year_to, x.cluster as cluster_a, y.cluster as cluster_b
                from (select * from v_drift where drift >= 0.55 and drift > 0.2) j join v_primary x on x.author_id = j.author_id and x.year <= year_from join v_primary y on y.author_id = j.author_id and y.year >= year_to where x.cluster <> y.cluster) b group by all""",
        PROFILE + "," + _aligned(2) + ", v_primary as (select distinct author_id, year, name as cluster from v_paper join v_concept using (paper_id) where pos = 1)",
    ),
)
def derived_edges(spark, d):
    p, c = papers(spark, d), concepts(spark, d)
    events = trajectory.drift_events(p, c)
    return graph.derived_edges(events.withColumn("drift", F.round("drift", 6)), trajectory.author_bridges(p, c, events), authors.coauthor_pairs(authorship(spark, d), 2))
