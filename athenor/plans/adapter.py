"""The driver's star schema in the roles of a bibliography.

Orders are papers (customer: lead author, priority: venue, price: impact), suppliers of an order its co-authors, part types
with their quantities its concepts, and its lines in order the reference list, which cites parts. ``VIEWS`` says the same
in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from athenor.functions.storage import table


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, author_id, year, venue, status, citation_count, is_seed."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("paper_id"),
        F.col("o_custkey").alias("author_id"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("venue"),
        F.col("o_orderstatus").alias("status"),
        F.floor(F.col("o_totalprice") / 8).cast("bigint").alias("citation_count"),
        (F.col("o_orderkey") % 1000 == 0).alias("is_seed"),
    )


def concepts(spark: SparkSession, sf_dir: str, column: str = "p_type") -> DataFrame:
    """paper_id, name, score, pos: concepts of each paper, strongest first."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    summed = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("l_orderkey").alias("paper_id"), F.col(column).alias("name"))
        .agg(F.sum("l_quantity").alias("score"))
    )
    order = Window.partitionBy("paper_id").orderBy(F.desc("score"), "name")
    return summed.withColumn("pos", F.row_number().over(order))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, ref_pos, n_refs: reference lists in order."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.select(
        F.col("l_orderkey").alias("src"),
        F.col("l_partkey").alias("dst"),
        F.row_number().over(order).alias("ref_pos"),
        F.count("*").over(Window.partitionBy("l_orderkey")).alias("n_refs"),
    )


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, coauthor_id."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("coauthor_id")).distinct()


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cited works: work_id, title, brand, kind, size, price."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("work_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (first 60 characters), abstract, venue, is_review (labelled quality 1)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("venue"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_review"),
    )


VIEWS = """
v_paper as (select o_orderkey as paper_id, o_custkey as author_id, cast(year(o_orderdate) as integer) as year, o_orderpriority as venue,
    o_orderstatus as status, cast(floor(o_totalprice / 8) as bigint) as citation_count, o_orderkey % 1000 = 0 as is_seed from orders),
v_concept as (select paper_id, name, score, cast(row_number() over (partition by paper_id order by score desc, name) as integer) as pos
    from (select l_orderkey as paper_id, p_type as name, sum(l_quantity) as score from lineitem join part on l_partkey = p_partkey group by all) t),
v_ref as (select l_orderkey as src, l_partkey as dst,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as integer) as ref_pos,
    count(*) over (partition by l_orderkey) as n_refs from lineitem),
v_authorship as (select distinct l_orderkey as paper_id, l_suppkey as coauthor_id from lineitem),
v_work as (select p_partkey as work_id, p_name as title, p_brand as brand, p_type as kind, p_size as size, p_retailprice as price from part),
v_text as (select doc_id as id, substr(text, 1, 60) as title, text as abstract, source as venue, coalesce(quality = 1, false) as is_review
    from documents left join labels using (doc_id))
"""


def sql(body: str, extra: str = "") -> str:
    """``body`` over the views, and over further CTEs."""
    return f"with {VIEWS}{', ' + extra if extra else ''} {body}"
