"""Queries over the candidate pool: search, statistics, deduplication, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.functions import exprs
from athenor.functions.storage import table
from athenor.operators import pool
from athenor.plans.adapter import concepts, papers, references, sql, texts, works
from athenor.plans.registry import query


@query(
    "pool_search",
    sql(
        """select paper_id, year, venue, status, citation_count from v_paper
        where (venue ilike '%high%' or status ilike '%high%') and citation_count >= 5000 and year >= 1996 and year <= 2000
        order by citation_count desc, paper_id limit 200"""
    ),
)
def pool_search(spark, d):
    found = pool.search(papers(spark, d), "high", ["venue", "status"], 200, 5_000, 1996, 2000)
    return found.select("paper_id", "year", "venue", "status", "citation_count")


@query(
    "pool_stats",
    sql(
        """select status, count(*) as papers, min(year) as first_year, max(year) as last_year, cast(sum(citation_count) as bigint) as citations,
        count(*) filter (is_seed) as seeds from v_paper group by status"""
    ),
)
def pool_stats(spark, d):
    return pool.stats(papers(spark, d), "status")


@query("primary_clusters", sql("select name, count(*) as size from v_concept where pos = 1 group by name having count(*) >= 10"))
def primary_clusters(spark, d):
    return pool.primary_clusters(concepts(spark, d), 10)


@query(
    "connections",
    sql(
        """select dst, paper_id, year, citation_count, rank from (select dst, paper_id, year, citation_count,
            cast(row_number() over (partition by dst order by citation_count desc, paper_id) as integer) as rank
            from (select distinct src, dst from v_ref where dst % 100 = 0) r join v_paper on src = paper_id) t where rank <= 20"""
    ),
)
def connections(spark, d):
    return pool.connections(references(spark, d), papers(spark, d), F.col("dst") % 100 == 0)


@query("top_candidates", sql("select paper_id, year, citation_count from v_paper order by citation_count desc, paper_id limit 100"))
def top_candidates(spark, d):
    return pool.top(papers(spark, d), "citation_count", 100).select("paper_id", "year", "citation_count")


@query("prune", sql("select paper_id, is_seed, citation_count from v_paper order by is_seed desc, citation_count desc, paper_id limit 500"))
def prune(spark, d):
    return pool.keep_best(papers(spark, d), "citation_count", 500).select("paper_id", "is_seed", "citation_count")


@query(
    "dedupe_title_year",
    sql(
        """select id, venue, n from (select id, venue, length(abstract) as n, row_number() over (partition by lower(left(title, 50)), venue
            order by length(abstract) desc, id) as r from v_text where title is not null) t where r = 1"""
    ),
)
def dedupe_title_year(spark, d):
    rows = texts(spark, d).where("title is not null").select("id", "venue", F.length("abstract").cast("bigint").alias("n"), F.lower(F.substring("title", 1, 50)).alias("short"))
    return pool.dedupe(rows, [F.col("short"), F.col("venue")], [F.desc("n"), F.col("id")]).select("id", "venue", "n")


def _records(spark, d):
    w = works(spark, d)
    doi = F.when(F.col("size") % 3 == 0, F.concat(F.lit("10.1/"), F.col("size").cast("string")))
    return w.select(
        F.col("work_id").alias("record_id"), F.col("title"), F.concat_ws(" ", "brand", "kind").alias("group_key"), doi.alias("doi"),
        F.floor("price").cast("bigint").alias("citation_count"), (F.col("size") > 40).alias("is_review"), (F.col("size") % 5).alias("depth"),
    )


@query(
    "merge_two",
    sql(
        """select brand || ' ' || kind as key, arg_max(title, (length(title), -work_id)) as title,
            arg_min('10.1/' || size, work_id) filter (size % 3 = 0) as doi, max(cast(floor(price) as bigint)) as citation_count,
            bool_or(size > 40) as is_review, min(size % 5) as depth, count(*) as records from v_work group by 1"""
    ),
)
def merge_two(spark, d):
    return pool.merge(_records(spark, d), F.col("group_key"))


@query(
    "title_hash_dupes",
    sql(
        """select hash, count(*) as records, min(work_id) as first_id, max(work_id) as last_id from (
            select work_id, array_to_string(list_sort(list_filter(string_split_regex(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+'),
                lambda w: w <> '' and w not in ('a','an','and','by','for','from','in','of','on','the','to','with'))[1:10]), ' ') as hash from v_work) t
        where hash <> '' group by hash having count(*) > 1"""
    ),
)
def title_hash_dupes(spark, d):
    return pool.title_duplicates(works(spark, d), "title", "work_id")


@query(
    "canonical_id",
    sql(
        """select work_id, case when size % 4 = 0 then 'doi:10.1/' || work_id when size % 4 = 1 then 'openalex:W' || work_id
            when size % 4 = 2 then 's2:' || work_id else 'internal:' || work_id end as canonical_id from v_work"""
    ),
)
def canonical_id(spark, d):
    w = works(spark, d)
    text, kind = F.col("work_id").cast("string"), F.col("size") % 4
    doi = F.when(kind == 0, F.concat(F.lit(" https://doi.org/10.1/"), text)).otherwise(F.lit(""))
    oa, s2 = F.when(kind == 1, F.concat(F.lit("W"), text)), F.when(kind == 2, text)
    return w.select("work_id", exprs.canonical_id(doi, oa, s2, F.lit(None).cast("string"), text).alias("canonical_id"))


@query(
    "match_existing",
    sql(
        """select n.work_id, coalesce(a.m, b.m) as match_id from v_work n
            left join (select brand, size, kind, min(work_id) as m from v_work where work_id % 2 = 0 group by all) a using (brand, size, kind)
            left join (select title, min(work_id) as m from v_work where work_id % 2 = 0 group by all) b using (title)
            where n.work_id % 2 = 1"""
    ),
)
def match_existing(spark, d):
    w = works(spark, d).withColumn("exact", F.concat_ws("|", "brand", "size", "kind"))
    known = w.where("work_id % 2 = 0").withColumnRenamed("work_id", "known_id")
    return pool.match_existing(w.where("work_id % 2 = 1"), known, ["exact", "title"]).select("work_id", "match_id")


@query(
    "insert_missing",
    sql("select distinct l_partkey as work_id from lineitem where l_partkey not in (select work_id from v_work where size <= 25)"),
)
def insert_missing(spark, d):
    new = table(spark, d, "lineitem").select(F.col("l_partkey").alias("work_id"))
    return pool.upsert_missing(new, works(spark, d).where("size <= 25"), "work_id")


@query(
    "first_filled",
    sql(
        """select work_id, price, 'first' as origin from v_work where size <= 20 union all
            select work_id, price, 'second' from v_work where size >= 10 and work_id not in (select work_id from v_work where size <= 20)"""
    ),
)
def first_filled(spark, d):
    w = works(spark, d)
    first = w.where("size <= 20").select("work_id", "price", F.lit("first").alias("origin"))
    return pool.first_filled(first, w.where("size >= 10").select("work_id", "price", F.lit("second").alias("origin")), "work_id")


@query(
    "evict",
    sql(
        """select event_id, is_protected, round(0.7 * value - 0.3 * (epoch(timestamp '2024-02-01') - epoch(date_trunc('second', ts))) / 3600, 6) as worth from (
            select event_id, ts, coalesce(value, 0) as value, event_id % 100 = 0 as is_protected from events) t
            order by is_protected desc, 0.7 * value - 0.3 * (epoch(timestamp '2024-02-01') - epoch(date_trunc('second', ts))) / 3600 desc, event_id limit 300"""
    ),
)
def evict(spark, d):
    nodes = table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.coalesce("value", F.lit(0.0)).alias("score"), F.col("ts").alias("added_at"), (F.col("event_id") % 100 == 0).alias("is_protected"))
    kept = pool.evict(nodes, 300, F.lit("2024-02-01").cast("timestamp"))
    return kept.select(F.col("node_id").alias("event_id"), "is_protected", F.round("worth", 6).alias("worth"))
