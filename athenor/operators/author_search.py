"""Authors under any of several ids, and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.exprs import normalize_name
from athenor.iterative.components import components

#: In the order in which an id that several services know is read.
KINDS = ("openalex_id", "s2_id", "author_id")


def aliases(authors: DataFrame, kinds: tuple[str, ...] = ("author_id", "openalex_id", "s2_id", "orcid")) -> DataFrame:
    """(kind, id, author): every id of every record, and the least author_id among all records that ids connect, directly or over others.

    Records and ids are the two sides of a graph whose components are the people. Empty ids are no ids; ids of different kinds are different.
    """
    ids = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.nullif(F.col(k).cast("string"), F.lit("")).alias("id")) for k in kinds))).alias("i")
    held = authors.select(F.col("author_id").alias("record"), ids).select("record", "i.*").where("id is not null").distinct()
    node = lambda kind, value: F.concat(kind, F.lit(":"), value)
    links = held.where("kind <> 'author_id'").select(node(F.lit("author_id"), F.col("record").cast("string")).alias("a"), node(F.col("kind"), F.col("id")).alias("b"))
    parts = components(links).withColumnRenamed("component", "part")
    named = held.join(parts, node(F.lit("author_id"), F.col("record").cast("string")) == F.col("node"), "left").withColumn("part", F.coalesce("part", node(F.lit("author_id"), F.col("record").cast("string"))))
    least = named.groupBy("part").agg(F.min("record").alias("author"))
    return named.join(least, "part").groupBy("kind", "id").agg(F.min("author").alias("author"))


def papers_of(papers: DataFrame, known: DataFrame) -> DataFrame:
    """(paper, author, pos): the authors of ``papers`` (paper, author_ids in order), each id read as the first kind of KINDS that knows it.

    An author who stands under several ids in one paper counts once, at the first place. Ids that no record has go.
    """
    listed = papers.select("paper", F.posexplode("author_ids").alias("pos", "id")).where("id is not null")
    order = F.element_at(F.create_map(*(x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n)))), F.col("kind"))
    best = known.where(F.col("kind").isin(*KINDS)).groupBy("id").agg(F.min_by("author", order).alias("author"))
    return listed.withColumn("id", F.col("id").cast("string")).join(best, "id").groupBy("paper", "author").agg((F.min("pos") + 1).alias("pos"))


def _block(name) -> list:
    words = F.split(name, " ")
    return [F.element_at(words, -1).alias("last"), F.substring(F.element_at(words, 1), 1, 1).alias("initial")]


def candidates(names: DataFrame, authors: DataFrame, top: int = 5) -> DataFrame:
    """(plain, author_id, affiliation, works, rank): the ``top`` authors for each normalised name of ``names``.

    First those of the very name, then those with its last name and first initial, both by works and id. Each name and each such block gives its
    ``top`` by itself, so that no block is paired with itself. authors(author_id, name, affiliation, works).
    """
    own = authors.withColumn("plain", normalize_name("name")).where("plain <> ''").select("author_id", "plain", "affiliation", "works")
    order = [F.desc_nulls_last("works"), F.col("author_id")]
    wanted = names.select(normalize_name("name").alias("plain")).where("plain <> ''").distinct()
    same = own.withColumn("_r", F.row_number().over(Window.partitionBy("plain").orderBy(*order))).where(F.col("_r") <= top).drop("_r")
    block = own.select("*", *_block(F.col("plain")))
    block = block.withColumn("_r", F.row_number().over(Window.partitionBy("last", "initial").orderBy(*order))).where(F.col("_r") <= top).drop("_r", "plain")
    exact = wanted.join(same, "plain").withColumn("far", F.lit(0))
    near = wanted.select("plain", *_block(F.col("plain"))).join(block, ["last", "initial"]).select("plain", "author_id", "affiliation", "works", F.lit(1).alias("far"))
    found = exact.unionByName(near).groupBy("plain", "author_id").agg(F.min("far").alias("far"), F.first("affiliation").alias("affiliation"), F.first("works").alias("works"))
    rank = Window.partitionBy("plain").orderBy("far", *order)  # at most twice ``top`` rows for each name
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).drop("far")


def resolve(names: DataFrame, authors: DataFrame, top: int = 5) -> DataFrame:
    """``names`` (name, affiliation) with author_id: a single candidate, else the first whose affiliation contains the one asked for, else the first; null if none."""
    rows = names.withColumn("plain", normalize_name("name"))
    found = candidates(names, authors, top).withColumnRenamed("affiliation", "place")
    listed = found.groupBy("plain").agg(F.sort_array(F.collect_list(F.struct("rank", "author_id", "place"))).alias("c"))  # at most ``top`` of them
    asked = F.lower(F.nullif(F.col("affiliation"), F.lit("")))
    there = F.filter("c", lambda x: F.coalesce(F.contains(F.lower(x["place"]), asked), F.lit(False)))
    chosen = F.when(F.size("c") == 1, F.col("c")[0]["author_id"]).otherwise(F.coalesce(F.get(there, 0)["author_id"], F.get("c", 0)["author_id"]))
    return rows.join(listed, "plain", "left").select("name", "affiliation", chosen.alias("author_id"))
