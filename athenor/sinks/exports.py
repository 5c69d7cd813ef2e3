"""Graphs as text: rows are built by Spark and written in parallel; only headers stand outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line for each node and edge."""
    return nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value")).union(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edges.columns)).alias("value")))


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): head 0, nodes 1, edges 2, foot 3; sort by part when one file is needed. nodes(node, label), edges(src, dst, weight)."""
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, value string")
    text = lambda c: escape_xml(F.coalesce(F.col(c).cast("string"), F.lit("")))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), text("node"), F.lit('"><data key="label">'), text("label"), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('"><data key="weight">'), text("weight"), F.lit("</data></edge>")).alias("value"))
    return ends.union(n).union(e)


def gexf_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value) like ``graphml_rows``, in GEXF."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><gexf version="1.3"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")], "part int, value string")
    text = lambda c: escape_xml(F.coalesce(F.col(c).cast("string"), F.lit("")))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), text("node"), F.lit('" label="'), text("label"), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(3).alias("part"), F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('" weight="'), text("weight"), F.lit('"/>')).alias("value"))
    return ends.union(n).union(e)


def dot_rows(edges: DataFrame) -> DataFrame:
    """Edge lines of a DOT graph."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(quote("src"), F.lit(" -> "), quote("dst"), F.lit(";")).alias("value"))


def cytoscape_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One element in JSON for each node and edge."""
    n = nodes.select(F.to_json(F.struct(F.struct(F.col("node").cast("string").alias("id"), F.col("label")).alias("data"))).alias("value"))
    e = edges.select(F.to_json(F.struct(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.col("weight")).alias("data"))).alias("value"))
    return n.union(e)


def csv_nodes(papers: DataFrame) -> DataFrame:
    """Flat columns: three concepts and three authors joined, relevance with three places."""
    return papers.select(
        "paper_id", "title", "year", "venue", "citation_count",
        F.array_join(F.slice(F.transform("concepts", lambda c: c["name"]), 1, 3), "; ").alias("concepts"),
        F.array_join(F.slice("authors", 1, 3), "; ").alias("authors"),
        F.format_string("%.3f", F.coalesce("relevance_score", F.lit(0.0))).alias("relevance"),
    )


def flourish(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point table with square-root sizes, and link table with both ends' labels. nodes(node, label, citation_count)."""
    points = nodes.select("node", "label", F.sqrt(F.col("citation_count").cast("double")).alias("size"))
    labels = nodes.select("node", "label")
    links = edges.join(labels.toDF("src", "source_label"), "src").join(labels.toDF("dst", "target_label"), "dst")
    return points, links.select("source_label", "target_label", "weight")


def bibtex_rows(papers: DataFrame) -> DataFrame:
    """One BibTeX entry for each paper; the cite key is the first author's last name and the year."""
    last = F.regexp_replace(F.element_at(F.split(F.coalesce(F.get("authors", 0), F.lit("anon")), r"\s+"), -1), r"[^\p{L}]", "")
    field = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f",\n  {name} = {{"), c, F.lit("}")))
    body = F.concat_ws("", field("title", F.col("title")), field("author", F.array_join("authors", " and ")), field("journal", F.col("venue")), field("year", F.col("year").cast("string")), field("doi", F.col("doi")))
    return papers.select(F.concat(F.lit("@article{"), F.lower(last), F.coalesce(F.col("year").cast("string"), F.lit("")), body, F.lit("\n}")).alias("value"))


def era(year: Column) -> Column:
    return F.when(year >= 2020, "2020s").when(year >= 2010, "2010s").when(year >= 2000, "2000s").otherwise("earlier")


def garden_rows(papers: DataFrame, authors: DataFrame, edges: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(part, value): the whole store as JSON lines, each with its part (paper, author, edge, trajectory) and all its columns."""
    parts = {"paper": papers, "author": authors, "edge": edges, "trajectory": trajectories}
    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias("value")) for name, df in parts.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
