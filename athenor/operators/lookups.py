"""Plain retrieval: counts, key lookups, pages, group counts, guards, projections and lists by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.exprs import normalize_doi


def count_estimate(papers: DataFrame, condition: Column) -> int:
    """How many papers a search would find; only the number reaches the driver."""
    return papers.where(condition).count()


def author_by(authors: DataFrame, author_id: str | None = None, orcid: str | None = None, openalex_id: str | None = None, s2_id: str | None = None) -> DataFrame:
    """The authors that one of the given ids names; an ORCID may carry its resolver."""
    hit = F.lit(False)
    for name, value in (("author_id", author_id), ("openalex_id", openalex_id), ("s2_id", s2_id)):
        if value is not None:
            hit = hit | F.coalesce(F.col(name).cast("string") == str(value), F.lit(False))
    if orcid is not None:
        bare = F.regexp_replace("orcid", r"^https?://orcid\.org/", "")
        hit = hit | F.coalesce(bare == orcid.rsplit("/", 1)[-1], F.lit(False))
    return authors.where(hit)


def author_works(papers: DataFrame, authorship: DataFrame, author: object, year_from: int | None = None, year_to: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an author's papers, newest first; ``offset`` is rounded down to whole pages, as services number pages."""
    own = authorship.where(F.col("coauthor_id") == F.lit(author)).select("paper_id").distinct()
    found = papers.join(own, "paper_id", "left_semi")
    if year_from is not None:
        found = found.where(F.col("year") >= year_from)
    if year_to is not None:
        found = found.where(F.col("year") <= year_to)
    return found.orderBy(F.col("year").desc_nulls_last(), "paper_id").offset(offset // limit * limit).limit(limit)


def top_values(rows: DataFrame, column: str, top: int = 20, key: str = "paper_id") -> DataFrame:
    """(value, papers): the commonest values of a column, arrays by their elements, each counted once for a paper."""
    value = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    each = rows.select(key, value.alias("value")).where("value is not null").distinct()
    return each.groupBy("value").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "value").limit(top)


def provider_counts(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(provider, papers) for every provider asked, -1 for one that failed. found(provider), asked(provider, failed)."""
    counts = found.groupBy("provider").agg(F.count("*").alias("n"))
    return asked.join(counts, "provider", "left").select("provider", F.when(F.col("failed"), F.lit(-1)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("papers"))


# ---- guards and projections ----------------------------------------------------------------------------------------


def with_status(rows: DataFrame, *wanted: str, column: str = "status", exclude: bool = False) -> DataFrame:
    """Rows of these states, or with ``exclude`` of all others; a null state is none of them."""
    hit = F.coalesce(F.col(column).isin(*wanted), F.lit(False))
    return rows.where(~hit if exclude else hit)


def is_filled(column: Column, kind: str = "text") -> Column:
    """Not null and not empty: a text, a list in JSON ("[]" is empty) or an array."""
    if kind == "array":
        return column.isNotNull() & (F.size(column) > 0)
    bare = F.trim(column.cast("string"))
    return column.isNotNull() & ~bare.isin("", "[]", "{}", "null") if kind == "json" else column.isNotNull() & (bare != "")


def any_filled(*columns: Column) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | is_filled(c)
    return hit


def paper_record(papers: DataFrame, authors: int = 5, concepts: int = 5) -> DataFrame:
    """What is shown of a paper: ids, title, year, venue, first authors and concepts, counts and scores."""
    return papers.select(
        F.col("paper_id").alias("id"), normalize_doi("doi").alias("doi"), "title", "year", "venue", F.slice("authors", 1, authors).alias("authors"),
        F.transform(F.slice("concepts", 1, concepts), lambda c: c["name"]).alias("concepts"), F.coalesce("citation_count", F.lit(0)).alias("citations"), "is_review", "status", "relevance_score",
    )


def author_record(authors: DataFrame, affiliations: int = 3) -> DataFrame:
    return authors.select(F.col("author_id").alias("id"), "name", "orcid", F.slice("affiliations", 1, affiliations).alias("affiliations"), F.col("paper_count").alias("papers"), F.col("citation_count").alias("citations"), "h_index", "role")


def edge_record(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type"), "weight", "confidence")


# ---- lists and views -----------------------------------------------------------------------------------------------


def authors_by_role(authors: DataFrame, role: str, limit: int = 50) -> DataFrame:
    """Surest first, then most central, then by id."""
    return authors.where(F.col("role") == role).orderBy(F.desc("role_confidence"), F.desc_nulls_last("centrality"), "author_id").limit(limit)


def frontier_papers(papers: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Cited works without a reference list of their own, most cited within the graph first: (node, cited)."""
    cited = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("cited"))
    return papers.select("node").join(cited, "node").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").orderBy(F.desc("cited"), "node").limit(limit)


def seed_authors(papers: DataFrame, authorship: DataFrame, limit: int = 50) -> DataFrame:
    """(coauthor_id, papers): authors of seeds by the number of seeds."""
    seeds = authorship.join(papers.where("is_seed").select("paper_id"), "paper_id", "left_semi")
    return seeds.groupBy("coauthor_id").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "coauthor_id").limit(limit)


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds and everything one edge away."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    near = both.join(seeds.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
    return seeds.select("node").union(near).distinct()


def induced(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges with both ends among ``nodes(node)``, of one type if wanted."""
    some = edges if kind is None else edges.where(F.col("edge_type") == kind)
    return some.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def author_edges(authorship: DataFrame, edges: DataFrame) -> DataFrame:
    """(coauthor_id, src, dst): edges that an author's papers are the source or the target of, each once.

    The "or" of the two keys is a union of two joins.
    """
    out = authorship.join(edges.select("src", "dst"), F.col("paper_id") == F.col("src")).select("coauthor_id", "src", "dst")
    into = authorship.join(edges.select("src", "dst"), F.col("paper_id") == F.col("dst")).select("coauthor_id", "src", "dst")
    return out.union(into).distinct()


def outgoing(edges: DataFrame, papers: DataFrame, ids: Column, top: int = 20) -> DataFrame:
    """The ``top`` most cited papers that each source which ``ids`` selects cites. papers(node, year, citation_count)."""
    rank = Window.partitionBy("src").orderBy(F.desc("citation_count"), "node")
    joined = edges.where(ids).select("src", "dst").distinct().join(papers, F.col("dst") == F.col("node"))
    return joined.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("src", "node", "year", "citation_count", "rank")


def trajectory_authors(authorship: DataFrame, least: int = 3, top: int = 30) -> DataFrame:
    """(coauthor_id, papers): authors present enough for a trajectory; with 2 and 10 those of the author layer."""
    counts = authorship.select("paper_id", "coauthor_id").distinct().groupBy("coauthor_id").agg(F.count("*").alias("papers"))
    return counts.where(F.col("papers") >= least).orderBy(F.desc("papers"), "coauthor_id").limit(top)


def prune_when_full(papers: DataFrame, by: str, capacity: int, trigger: float = 0.8, keep: float = 0.6, key: str = "paper_id") -> DataFrame:
    """The pool as it is while it is under ``trigger`` of its capacity, else its best ``keep`` of the capacity, protected rows first."""
    if papers.count() <= trigger * capacity:
        return papers
    return papers.orderBy(F.desc("is_seed"), F.col(by).desc_nulls_last(), key).limit(int(keep * capacity))
