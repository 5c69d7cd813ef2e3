"""Queries over topics and gaps. Brands of the parts serve as a finer vocabulary of concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.operators import authors, graph, topics
from athenor.plans.adapter import authorship, concepts, papers, sql, texts
from athenor.plans.registry import query

FINE = """v_fine as (select paper_id, name, score, row_number() over (partition by paper_id order by score desc, name) as pos from (
    select l_orderkey as paper_id, p_brand || ' ' || p_type as name, sum(l_quantity) as score from lineitem join part on l_partkey = p_partkey group by all) t),
v_tpair as (select x.name as a, y.name as b, count(*) as papers from v_fine x join v_fine y on x.paper_id = y.paper_id and x.name < y.name group by all),
v_size as (select name, count(distinct paper_id) as n from v_fine group by name)"""


def _fine(spark, d):
    from athenor.functions.storage import table

    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("l_orderkey").alias("paper_id"), F.concat_ws(" ", "p_brand", "p_type").alias("name")).agg(F.sum("l_quantity").alias("score"))


@query(
    "topic_extract",
    sql(
        """select name, papers, round(weight, 2) as weight, case when papers * 1.0 / (select count(*) from v_paper) > 0.30 then 'broad' when papers * 1.0 / (select count(*) from v_paper) < 0.05 then 'specific' else 'medium' end as kind
            from (select name, count(distinct paper_id) as papers, sum(score * (ln(1 + citation_count) + 1)) as weight from v_fine join v_paper using (paper_id) group by name) t
            where papers >= 3 and weight >= 2 order by t.weight desc, name limit 50""",
        FINE,
    ),
)
def topic_extract(spark, d):
    return topics.extract(_fine(spark, d), papers(spark, d)).withColumn("weight", F.round("weight", 2))


@query(
    "topic_trend",
    sql(
        """select author_id, name, early, late, round(early_share, 6) as early_share, round(late_share, 6) as late_share,
            case when early = 0 then 'new' when late_share > early_share + 0.2 then 'emerging' when late_share < early_share - 0.2 then 'declining' else 'stable' end as trend from (
            select c.author_id, name, early, late, early * 1.0 / greatest(e, 1) as early_share, late * 1.0 / greatest(l, 1) as late_share from (
                select author_id, name, count(*) filter (year <= mid) as early, count(*) filter (year > mid) as late
                from v_dated join (select distinct paper_id, name from v_concept) using (paper_id) group by all) c
            join (select author_id, count(*) filter (year <= mid) as e, count(*) filter (year > mid) as l from v_dated group by author_id) s on s.author_id = c.author_id) t""",
        "v_dated as (select paper_id, p.author_id, year, mid from v_paper p join (select author_id, floor((min(year) + max(year)) / 2.0) as mid from v_paper group by author_id) m on m.author_id = p.author_id)",
    ),
)
def topic_trend(spark, d):
    return topics.trends(concepts(spark, d), papers(spark, d), "author_id").withColumns({c: F.round(c, 6) for c in ("early_share", "late_share")})


@query("topic_pairs", sql("select * from v_tpair where papers >= 2", FINE))
def topic_pairs(spark, d):
    return topics.topic_pairs(_fine(spark, d), 2)


SIMILAR = FINE + """, v_nb as (select a as x, b as y from v_tpair union all select b, a from v_tpair), v_k as (select x, count(*) as k from v_nb group by x),
v_sim as (select g.a, g.b, case when ka + kb - 2 * linked - both_n > 0 then both_n * 1.0 / (ka + kb - 2 * linked - both_n) else 0 end as similarity from (
    select p.x as a, q.x as b, p.k as ka, q.k as kb from v_k p join v_k q on p.x < q.x) g
    join lateral (select coalesce((select n from v_common c where c.a = g.a and c.b = g.b), 0) as both_n, case when exists (select 1 from v_tpair t where t.a = g.a and t.b = g.b) then 1 else 0 end as linked) l on true)"""
SIMILAR = SIMILAR.replace("v_sim as", "v_common as (select m.x as a, n.x as b, count(*) as n from v_nb m join v_nb n on m.y = n.y and m.x < n.x where m.y <> m.x and m.y <> n.x group by all), v_sim as", 1)


@query("concept_similarity", sql("select a, b, round(similarity, 6) as similarity from v_sim", SIMILAR))
def concept_similarity(spark, d):
    return topics.concept_similarity(_fine(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(
    "concept_gaps",
    sql(
        """select a, b, both_n as both, na - both_n as a_only, nb - both_n as b_only, round(ratio, 6) as ratio, round(similarity, 6) as similarity, round(gap, 6) as gap from (
            select *, least(1.0, ln(1 + sqrt(na * nb)) / 5 * (1 - similarity)) as gap from (
                select x.name as a, y.name as b, x.n as na, y.n as nb, coalesce(t.papers, 0) as both_n, coalesce(t.papers, 0) * 1.0 / least(x.n, y.n) as ratio, coalesce(s.similarity, 0) as similarity
                from v_size x join v_size y on x.name < y.name and x.n >= 5 and y.n >= 5 left join v_tpair t on t.a = x.name and t.b = y.name left join v_sim s on s.a = x.name and s.b = y.name) g
            where ratio <= 0.1 order by round(least(1.0, ln(1 + sqrt(na * nb)) / 5 * (1 - similarity)), 9) desc, a, b limit 50) h""",
        SIMILAR,
    ),
)
def concept_gaps(spark, d):
    found = topics.concept_gaps(_fine(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("ratio", "similarity", "gap")})


@query(
    "method_gaps",
    sql(
        """select method, domain, nm, nd, joint, round(least(1.0, ln(1 + sqrt(nm * nd)) / 10) / (1 + joint), 6) as score from (
            select x.name as method, y.name as domain, x.n as nm, y.n as nd, coalesce(t.papers, 0) as joint from v_size x cross join v_size y
            left join (select a, b, papers from v_tpair union all select b, a, papers from v_tpair) t on t.a = x.name and t.b = y.name
            where x.name like '%SMALL' and y.name like '%LARGE' and x.n >= 5 and y.n >= 5 and x.name <> y.name) g where joint <= 1""",
        FINE,
    ),
)
def method_gaps(spark, d):
    return topics.class_gaps(_fine(spark, d), F.col("name").endswith("SMALL"), F.col("name").endswith("LARGE"), 1, 5).withColumn("score", F.round("score", 6))


@query(
    "author_gaps",
    sql(
        """select a, b, shared, round(overlap, 6) as overlap from (select p.a, p.b, shared, shared * 1.0 / greatest(x.k, y.k) as overlap from (
            select m.author as a, n.author as b, count(*) as shared from v_own m join v_own n on m.concept = n.concept and m.author < n.author group by all having count(*) >= 2) p
            join v_ksize x on x.author = p.a join v_ksize y on y.author = p.b
            where (p.a, p.b) not in (select s.coauthor_id, t.coauthor_id from v_authorship s join v_authorship t on s.paper_id = t.paper_id where s.coauthor_id < t.coauthor_id group by all having count(*) >= 20)) t
        where overlap > 0.3 order by t.overlap desc, shared desc, a, b limit 50""",
        FINE
        + """, v_own as (select distinct coauthor_id as author, name as concept from v_authorship join v_fine using (paper_id) where pos <= 5),
        v_ksize as (select author, count(*) as k from v_own group by author)""",
    ),
)
def author_gaps(spark, d):
    from pyspark.sql import Window

    first = Window.partitionBy("paper_id").orderBy(F.desc("score"), "name")
    best = _fine(spark, d).withColumn("pos", F.row_number().over(first)).where("pos <= 5")
    own = authorship(spark, d).join(best, "paper_id").select(F.col("coauthor_id").alias("author"), F.col("name").alias("concept"))
    return topics.author_gaps(own, authors.coauthor_pairs(authorship(spark, d), 20)).withColumn("overlap", F.round("overlap", 6))


@query(
    "pair_bridges",
    sql(
        """select x.paper_id, count(*) as pairs from (select * from v_tpair where papers between 2 and 4) t join v_fine x on x.name = t.a join v_fine y on y.name = t.b and y.paper_id = x.paper_id
            group by x.paper_id order by pairs desc, x.paper_id limit 20""",
        FINE,
    ),
)
def pair_bridges(spark, d):
    fine = _fine(spark, d)
    return topics.pair_bridges(fine, topics.topic_pairs(fine).where("papers between 2 and 4"))


@query(
    "nascent_pairs",
    sql("select a, b, papers, round(sqrt(x.n * y.n) / (papers + 1), 6) as potential from v_tpair join v_size x on x.name = a join v_size y on y.name = b where papers between 2 and 4 and x.n >= 10 and y.n >= 10", FINE),
)
def nascent_pairs(spark, d):
    return topics.nascent_pairs(_fine(spark, d)).withColumn("potential", F.round("potential", 6))


@query(
    "unexplored",
    sql(
        """select name, count(*) as candidates, min(paper_id) as first_id from (select paper_id from v_paper where not is_seed order by citation_count desc, paper_id limit 500) c
            join (select paper_id, name from v_fine where pos = 1) p using (paper_id)
            where name not in (select name from v_fine join v_paper using (paper_id) where pos = 1 and is_seed) group by name having count(*) >= 3 order by candidates desc, name limit 5""",
        FINE,
    ),
)
def unexplored(spark, d):
    from pyspark.sql import Window

    first = Window.partitionBy("paper_id").orderBy(F.desc("score"), "name")
    primary = _fine(spark, d).withColumn("pos", F.row_number().over(first)).where("pos = 1").select("paper_id", "name")
    p = papers(spark, d)
    return topics.unexplored(primary, p.where("not is_seed"), p.where("is_seed"))


INTER = """v_cluster as (select distinct m.name as cluster, c.name from v_concept m join v_concept c using (paper_id) join v_paper p using (paper_id) where m.pos = 1 and c.pos <= 3 and p.is_seed),
v_cand as (select paper_id, name from v_concept where pos <= 5 and paper_id in (select paper_id from v_paper where not is_seed)),
v_hit as (select paper_id, cluster, count(*) as n from v_cand join v_cluster using (name) group by all),
v_inter as (select a, b, paper_id, overlap, cast(rank as integer) as rank from (select x.cluster as a, y.cluster as b, x.paper_id, x.n + y.n as overlap,
    row_number() over (partition by x.cluster, y.cluster order by x.n + y.n desc, x.paper_id) as rank from v_hit x join v_hit y on x.paper_id = y.paper_id and x.cluster < y.cluster) t where rank <= 10)"""


def _intermediates(spark, d):
    c, p = concepts(spark, d), papers(spark, d)
    seeds = p.where("is_seed").select("paper_id")
    named = c.where("pos = 1").select("paper_id", F.col("name").alias("cluster")).join(seeds, "paper_id", "left_semi")
    of = named.join(c.where("pos <= 3"), "paper_id").select("cluster", "name")
    others = p.where("not is_seed").select("paper_id")
    return topics.intermediates(of, c.where("pos <= 5").join(others, "paper_id", "left_semi").select("paper_id", "name"))


@query("intermediates", sql("select * from v_inter", INTER))
def intermediates(spark, d):
    return _intermediates(spark, d)


LINKS = INTER + """, v_mem as (select paper_id, name as cluster from v_concept join v_paper using (paper_id) where pos = 1 and is_seed),
v_share as (select distinct x.paper_id as p, y.paper_id as q, x.cluster as c1, y.cluster as c2 from v_mem x join v_ref r on r.src = x.paper_id join v_ref s on s.dst = r.dst join v_mem y on y.paper_id = s.src where x.paper_id < y.paper_id),
v_clink as (select a.c as a, b.c as b, (select count(*) from v_share where (c1 = a.c and c2 = b.c) or (c1 = b.c and c2 = a.c)) as links
    from (select distinct cluster as c from v_mem) a join (select distinct cluster as c from v_mem) b on a.c < b.c)"""


@query(
    "missing_links",
    sql(
        """select l.a, l.b, links, candidates, best, case when links = 0 then 'cluster_gap' else 'weak_link' end as kind, case when links = 0 then 0.7::double else 0.5::double end as confidence
            from v_clink l join (select a, b, count(*) as candidates, arg_min(paper_id, rank) as best from v_inter group by a, b) i on i.a = l.a and i.b = l.b
            where links < 3 and (links = 0 or candidates > links) order by confidence desc, l.a, l.b limit 20""",
        LINKS,
    ),
)
def missing_links(spark, d):
    from athenor.plans.adapter import references

    c, p, refs = concepts(spark, d), papers(spark, d), references(spark, d)
    seeds = p.where("is_seed").select("paper_id")
    members = c.where("pos = 1").join(seeds, "paper_id", "left_semi").select(F.col("paper_id").alias("node"), F.col("name").alias("cluster"))
    own = refs.join(seeds, F.col("src") == F.col("paper_id"), "left_semi").select("src", "dst").distinct()
    shared = own.toDF("src", "w").join(own.toDF("dst", "w"), "w").where("src < dst").select("src", "dst").distinct()
    return topics.missing_links(graph.cluster_links(shared, members), _intermediates(spark, d))


@query(
    "text_terms",
    sql(
        """select term, count(*) as documents from (select distinct id, unnest(list_concat(w, list_filter(list_transform(range(1, least(len(w), 11)), lambda i: w[i] || ' ' || w[i + 1]), lambda p: length(p) > 5))) as term
            from (select id, list_filter(regexp_extract_all(lower(abstract), '([\\p{L}\\p{N}_]+)', 1), lambda w: length(w) > 2 and w not in ('a','an','and','by','for','from','in','of','on','the','to','with')) as w from v_text) t) u
        group by term having count(*) >= 20"""
    ),
)
def text_terms(spark, d):
    return topics.text_terms(texts(spark, d), "abstract").groupBy("term").agg(F.count("*").alias("documents")).where("documents >= 20")


@query(
    "generic_filter",
    sql("select name, count(*) as papers from v_concept where lower(name) not in ('biology','chemistry','computer science','economics','engineering','materials science','mathematics','medicine','physics','psychology','small') and length(name) >= 3 group by name"),
)
def generic_filter(spark, d):
    return topics.without_generic(concepts(spark, d), extra=("small",)).groupBy("name").agg(F.count("*").alias("papers"))
