"""The candidate pool: search, statistics, deduplication and merging of paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.exprs import title_hash


def search(papers: DataFrame, query: str, text: list[str], limit: int = 20, min_citations: int = 0, year_from: int | None = None, year_to: int | None = None, key: str = "paper_id") -> DataFrame:
    """Rows whose text columns contain ``query`` in any case, within optional ranges, most cited first."""
    hit = F.lit(False)
    for c in text:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    found = papers.where(hit)
    if min_citations:
        found = found.where(F.col("citation_count") >= min_citations)
    if year_from is not None:
        found = found.where(F.col("year") >= year_from)
    if year_to is not None:
        found = found.where(F.col("year") <= year_to)
    return found.orderBy(F.col("citation_count").desc_nulls_last(), key).limit(limit)


def stats(papers: DataFrame, by: str) -> DataFrame:
    """Counts, year range and total citations by one column."""
    return papers.groupBy(by).agg(
        F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("citation_count").alias("citations"), F.count_if("is_seed").alias("seeds")
    )


def primary_clusters(concepts: DataFrame, min_size: int) -> DataFrame:
    """Papers grouped by their first concept, groups of ``min_size`` or more."""
    return concepts.where("pos = 1").groupBy("name").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)


def connections(edges: DataFrame, papers: DataFrame, ids: Column, top: int = 20) -> DataFrame:
    """The ``top`` most cited citing papers of each target that ``ids`` selects."""
    rank = Window.partitionBy("dst").orderBy(F.desc("citation_count"), "paper_id")
    joined = edges.where(ids).select("src", "dst").distinct().join(papers, F.col("src") == F.col("paper_id"))
    return joined.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("dst", "paper_id", "year", "citation_count", "rank")


def top(papers: DataFrame, by: str, limit: int, key: str = "paper_id") -> DataFrame:
    return papers.orderBy(F.col(by).desc_nulls_last(), key).limit(limit)


def keep_best(papers: DataFrame, by: str, keep: int, key: str = "paper_id") -> DataFrame:
    """Prune: the ``keep`` best rows stay, others go; protected rows (``is_seed``) rank first."""
    return papers.orderBy(F.desc("is_seed"), F.col(by).desc_nulls_last(), key).limit(keep)


def dedupe(records: DataFrame, keys: list[Column], best: list[Column]) -> DataFrame:
    """One row for each key, the first by ``best``; rows whose key has a null all stay."""
    known = F.lit(True)
    for k in keys:
        known = known & k.isNotNull()
    rank = Window.partitionBy(*keys).orderBy(*best)
    return records.where(known).withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank").unionByName(records.where(~known))


def merge(records: DataFrame, key: Column) -> DataFrame:
    """One record for each key: longest title, first non-null id by record order, most citations, flags or-ed, least depth."""
    longest = F.struct(F.length("title").alias("n"), -F.col("record_id"))
    return records.groupBy(key.alias("key")).agg(
        F.max_by("title", longest).alias("title"),
        F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("record_id"))).alias("doi"),
        F.max("citation_count").alias("citation_count"),
        F.bool_or("is_review").alias("is_review"),
        F.min("depth").alias("depth"),
        F.count("*").alias("records"),
    )


def title_duplicates(records: DataFrame, title: str, key: str) -> DataFrame:
    """Groups of two or more records with one title hash."""
    return (
        records.select(title_hash(title).alias("hash"), key)
        .where("hash <> ''")
        .groupBy("hash")
        .agg(F.count("*").alias("records"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
        .where("records > 1")
    )


def match_existing(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """For each new record the least known record that agrees in the first possible key of ``keys``; null if none does."""
    out = new
    for i, k in enumerate(keys):
        found = known.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min("known_id").alias(f"_m{i}"))
        out = out.join(found, out[k] == F.col("_k"), "left").drop("_k")
    return out.withColumn("match_id", F.coalesce(*(F.col(f"_m{i}") for i in range(len(keys))))).drop(*(f"_m{i}" for i in range(len(keys))))


def upsert_missing(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Insert if absent: rows of ``new`` whose key is not known, one for each key."""
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def first_filled(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first``, and of ``second`` what ``first`` lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def evict(nodes: DataFrame, capacity: int, as_of: Column) -> DataFrame:
    """The working graph within its capacity: protected nodes, then by 0.7 score - 0.3 age in hours."""
    age = (as_of.cast("long") - F.col("added_at").cast("timestamp").cast("long")) / 3600
    return nodes.withColumn("worth", 0.7 * F.col("score") - 0.3 * age).orderBy(F.desc("is_protected"), F.desc("worth"), "node_id").limit(capacity)
