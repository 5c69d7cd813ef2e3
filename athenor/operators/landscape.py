"""The topical landscape end to end: scores against the seeds' concepts, methodology hubs apart, a natural threshold, clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.functions.storage import materialize

#: Concepts of methods, and concepts too broad to count in full.
METHOD_CONCEPTS = (
    "algorithm", "alphabet", "artificial intelligence", "bioinformatics", "cluster analysis", "computational biology", "computer science", "data analysis", "database", "deep learning",
    "encoding (memory)", "inference", "language model", "machine learning", "neural network", "protein structure prediction", "sequence alignment", "software", "source code", "statistics", "web server",
)
BROAD_CONCEPTS = ("biochemistry", "biology", "cell biology", "chemistry", "gene", "genetics", "medicine", "molecular biology", "protein", "sequence (biology)")
FIRST, FEWEST, TARGET, LEAST = 100, 20, 158, 0.01


def scored(concepts: DataFrame, seeds: DataFrame, methods: tuple[str, ...] = METHOD_CONCEPTS, broad: tuple[str, ...] = BROAD_CONCEPTS) -> DataFrame:
    """(paper_id, topical, is_hub, cluster) of each paper with concepts.

    Concepts that a seed has count with their score, broad ones a fifth of it, over the number of the seeds' other concepts, 1 at most. A hub has a weight of
    methods over 1.5 and shares no specific concept with a seed. concepts(paper_id, name, score, pos), seeds(paper_id).
    """
    low = concepts.select("paper_id", F.lower("name").alias("name"), "score", "pos", F.col("name").alias("own"))
    asked = low.join(seeds.select("paper_id"), "paper_id", "left_semi").where(F.col("score") >= 0.5).select("name").distinct()
    core = asked.agg(F.greatest(F.count_if(~F.col("name").isin(*broad)), F.lit(1)).alias("_core"))
    marked = low.join(asked.withColumn("_hit", F.lit(True)), "name", "left")
    hit, wide = F.coalesce("_hit", F.lit(False)), F.col("name").isin(*broad)
    each = marked.groupBy("paper_id").agg(
        F.sum(F.when(hit, F.col("score") * F.when(wide, 0.2).otherwise(1.0)).otherwise(0.0)).alias("weight"),
        F.sum(F.when(F.col("name").isin(*methods), F.col("score")).otherwise(0.0)).alias("method"),
        F.bool_or(hit & ~wide).alias("specific"),
        F.min_by("own", "pos").alias("cluster"),
    )
    return each.crossJoin(F.broadcast(core)).select("paper_id", F.least(F.col("weight") / F.col("_core"), F.lit(1.0)).alias("topical"), ((F.col("method") > 1.5) & ~F.col("specific")).alias("is_hub"), "cluster")  # one row


def threshold(values: DataFrame, column: str) -> tuple[float, str]:
    """Where to cut a falling list, and by which rule: bend, gap or deviation, of those that keep FEWEST or more the one nearest to TARGET, else what keeps most.

    Bend and gap look at the first FIRST values only, as their rule says, so these come to the driver; the rest is one aggregate.
    """
    values = values.where(F.col(column) > 0)
    n, mean, deviation, high, low = values.agg(F.count("*"), F.avg(column), F.stddev_pop(column), F.max(column), F.min(column)).first()
    if not n:
        return 0.0, "none"
    top = [r[0] for r in values.select(column).orderBy(F.desc(column)).limit(FIRST + 1).collect()]
    level = mean + deviation
    if n < 3:
        bend = (top[0], 1)
    elif high == low:
        bend = (high, n)
    else:
        curves = [abs(top[i + 1] - 2 * top[i] + top[i - 1]) for i in range(1, min(n - 1, FIRST))]
        at = 1 + max(range(len(curves)), key=lambda i: (curves[i], -i)) if max(curves) > 0 else 1
        bend = (top[at], at)
    gaps = [top[i - 1] - top[i] for i in range(1, min(n, FIRST))]
    at = 1 + max(range(len(gaps)), key=lambda i: (gaps[i], -i)) if gaps and max(gaps) > 0 else 0
    cuts = [(*bend, "elbow"), (top[at], at, "gap"), (level, values.where(F.col(column) >= level).count(), "std")]
    enough = [c for c in cuts if c[1] >= FEWEST]
    best = min(enough, key=lambda c: abs(c[1] - TARGET)) if enough else max(cuts, key=lambda c: c[1])
    return max(float(best[0]), LEAST), best[2]


def landscape(papers: DataFrame, concepts: DataFrame, methods: tuple[str, ...] = METHOD_CONCEPTS, broad: tuple[str, ...] = BROAD_CONCEPTS) -> DataFrame:
    """(paper_id, topical, is_hub, is_topical, cluster, cluster_size, threshold, rule) of each paper with concepts.

    Seeds and papers from the threshold on are topical and are clustered by their first concept; hubs stand apart. papers(paper_id, is_seed).
    """
    found = materialize(scored(concepts, papers.where("is_seed"), methods, broad).join(papers.select("paper_id", "is_seed"), "paper_id"), "scored")
    cut, rule = threshold(found.where("not is_hub"), "topical")
    kept = ~F.col("is_hub") & ((F.col("topical") >= cut) | F.col("is_seed"))
    marked = found.withColumn("is_topical", kept)
    sizes = marked.where("is_topical").groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    out = marked.join(sizes, "cluster", "left").select("paper_id", "topical", "is_hub", "is_topical", F.when(F.col("is_topical"), F.col("cluster")).alias("cluster"), F.when(F.col("is_topical"), F.col("cluster_size")).alias("cluster_size"))
    return out.withColumns({"threshold": F.lit(cut), "rule": F.lit(rule)})


def year_summaries(papers: DataFrame, works: int = 20, venues: int = 5) -> DataFrame:
    """author_id, year, works, venues (distinct, in the works' order), citations, relevance (mean of the positive ones) over the first ``works`` of each year."""
    from pyspark.sql import Window

    order = Window.partitionBy("author_id", "year").orderBy("paper_id")
    own = papers.where("year is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= works)
    first = F.transform(F.sort_array(F.collect_list(F.when(F.col("venue") != "", F.struct("_n", "venue")))), lambda x: x["venue"])  # ``works`` of them at most
    positive = F.when(F.col("relevance") > 0, F.col("relevance"))
    return own.groupBy("author_id", "year").agg(F.count("*").alias("works"), F.slice(F.array_distinct(first), 1, venues).alias("venues"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("citations"), F.coalesce(F.avg(positive), F.lit(0.0)).alias("relevance"))


def loosened_floor(papers: DataFrame, floor: int = 30, recent: int = 5, fewest: int = 5, as_of_year: int = 2002) -> DataFrame:
    """Papers of ``floor`` citations or more; if these are under ``fewest``, those of the last ``recent`` years too, whatever their citations."""
    good = F.col("citation_count") >= floor
    if papers.where(good).limit(fewest).count() >= fewest:
        return papers.where(good)
    return papers.where(good | (F.col("year") >= as_of_year - recent))
