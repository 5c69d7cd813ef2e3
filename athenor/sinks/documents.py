"""Whole graphs as one document: every row is built by Spark, and the rows in order are the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athenor.sinks.exports import escape_xml

#: Fixed values of the format: attribute, its type, and what it belongs to.
GRAPHML_KEYS = (
    ("title", "string", "node"), ("year", "int", "node"), ("citations", "int", "node"), ("type", "string", "node"), ("relevance", "double", "node"),
    ("is_seed", "boolean", "node"), ("cluster", "string", "node"), ("edge_type", "string", "edge"), ("weight", "double", "edge"),
)


def json_document(meta: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(section, place, value): a JSON object with ``meta`` (one row) and one array for each section, which has a unique ``place`` besides its columns.

    Sorted by section and place and put together, the values are the document. Only the least place of each section is looked up, for the comma.
    """
    spark = meta.sparkSession
    first = meta.select(F.lit(0).alias("section"), F.lit("").alias("place"), F.concat(F.lit('{"meta":'), F.to_json(F.struct(*meta.columns))).alias("value"))
    out = first
    for n, (name, rows) in enumerate(sections.items(), 1):
        place = F.col("place").cast("string")
        columns = [c for c in rows.columns if c != "place"]
        least = rows.agg(F.min(place).alias("_least"))
        body = F.to_json(F.struct(*(f"`{c}`" for c in columns)))
        held = rows.join(F.broadcast(least), F.lit(True), "left")  # one row
        comma = F.when(place == F.col("_least"), "").otherwise(",")
        out = out.union(spark.createDataFrame([(2 * n - 1, "", f',"{name}":[')], "section int, place string, value string"))
        out = out.union(held.select(F.lit(2 * n - 1), F.concat(F.lit(" "), place), F.concat(comma, body)))
        out = out.union(spark.createDataFrame([(2 * n, "", "]")], "section int, place string, value string"))
    return out.union(spark.createDataFrame([(2 * len(sections) + 1, "", "}")], "section int, place string, value string"))


def _some(c: Column | str, n: int, kind: str = "array<string>") -> Column:
    return F.slice(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(kind)), 1, n)


def graph_json(
    papers: DataFrame, edges: DataFrame, clusters: DataFrame, authors: DataFrame, drifts: DataFrame, gaps: dict[str, DataFrame] | None = None, summary: str = ""
) -> DataFrame:
    """The working graph with its clusters, authors, their trajectories and, if given, the gaps (bridges, missing_links, unexplored).

    papers(paper_id, doi, title, year, venue, authors, author_ids, citation_count, is_review, is_methodology, relevance_score, bridge_score, is_seed, is_pinned, cluster,
    concepts of name and score), edges(src, dst, kind, weight), clusters(cluster, name, top_concepts), authors(author_id, name, orcid, openalex_id, s2_id,
    affiliations, topic_fit, centrality), drifts(author_id, year_from, year_to, drift, is_jump, entering, exiting); gaps have a unique ``place``.
    """
    nodes = papers.select(
        F.col("paper_id").alias("place"), F.col("paper_id").alias("id"), "doi", "title", "year", "venue", _some("authors", 5).alias("authors"), "citation_count", "is_review", "is_methodology", "relevance_score",
        "bridge_score", "is_seed", "is_pinned", "cluster", _some(F.transform("concepts", lambda c: c["name"]), 5).alias("concepts"),
    )
    links = edges.select(F.to_json(F.struct("src", "dst")).alias("place"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"), "weight")
    sizes = papers.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"))
    groups = clusters.join(sizes, "cluster", "left").select(F.col("cluster").alias("place"), F.col("cluster").alias("id"), "name", F.coalesce("size", F.lit(0)).alias("size"), _some("top_concepts", 5).alias("top_concepts"))
    ids = papers.select("paper_id", F.explode("author_ids").alias("id")).distinct()
    own = authors.select("author_id", F.explode(F.array_distinct(F.array("openalex_id", "s2_id"))).alias("id")).where("id is not null")
    counts = own.join(ids, "id").groupBy("author_id").agg(F.countDistinct("paper_id").alias("paper_count"))
    events = F.sort_array(F.collect_list(F.struct("year_from", "year_to", F.col("drift").alias("drift_magnitude"), F.col("is_jump").alias("is_novelty_jump"), _some("entering", 5).alias("entering_concepts"), _some("exiting", 5).alias("exiting_concepts"))))
    paths = drifts.groupBy("author_id").agg(events.alias("drift_events"))  # a career has few years
    people = authors.join(counts, "author_id", "left").join(paths, "author_id", "left")
    listed = people.select(
        F.col("author_id").alias("place"), F.col("author_id").alias("id"), "name", "orcid", "openalex_id", _some("affiliations", 3).alias("affiliations"), "topic_fit", "centrality",
        F.coalesce("paper_count", F.lit(0)).alias("paper_count"), F.col("drift_events").isNotNull().alias("trajectory_computed"), F.when(F.col("drift_events").isNull(), 0).otherwise(F.size("drift_events")).alias("drift_event_count"),
    )
    walked = people.where("drift_events is not null").select(F.col("author_id").alias("place"), "author_id", F.col("name").alias("author_name"), "drift_events")
    ends = papers.agg(F.count("*").alias("node_count"), F.count_if("is_seed").alias("seed_count")).join(edges.agg(F.count("*").alias("edge_count")), F.lit(True))  # single rows
    meta = ends.join(authors.agg(F.count("*").alias("author_count")), F.lit(True)).withColumn("gap_summary", F.lit(summary))
    return json_document(meta, {"nodes": nodes, "edges": links, "clusters": groups, "authors": listed, "trajectories": walked, **(gaps or {})})


def graphml_document(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, place, value) of a GraphML file with all node and edge attributes; empty ones are left out. Columns as in ``graph_json``."""
    spark = papers.sparkSession
    keys = "".join(f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{kind}"/>' for k, kind, of in GRAPHML_KEYS)
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph id="citation_network" edgedefault="directed">'
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "section int, place string, value string")
    text = lambda c: escape_xml(c.cast("string"))
    data = lambda k, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f'<data key="{k}">'), text(c), F.lit("</data>"))).otherwise("")
    shown = [
        data("title", F.coalesce("title", F.lit(""))), data("year", F.col("year")), data("citations", F.when(F.col("citation_count") > 0, F.col("citation_count"))), data("type", F.lit("paper")),
        data("relevance", F.format_string("%.3f", F.coalesce(F.col("relevance_score").cast("double"), F.lit(0.0)))), data("is_seed", F.coalesce("is_seed", F.lit(False))), data("cluster", F.col("cluster")),
    ]
    nodes = papers.select(F.lit(1), F.col("paper_id").cast("string"), F.concat(F.lit('<node id="'), text(F.col("paper_id")), F.lit('">'), *shown, F.lit("</node>")))
    links = edges.select(F.lit(2), F.to_json(F.struct("src", "dst")), F.concat(F.lit('<edge source="'), text(F.col("src")), F.lit('" target="'), text(F.col("dst")), F.lit('">'), data("edge_type", F.col("kind")), data("weight", F.col("weight")), F.lit("</edge>")))
    return ends.union(nodes).union(links)


def csv_edges(edges: DataFrame) -> DataFrame:
    """source, target, type, weight."""
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"), "weight")
