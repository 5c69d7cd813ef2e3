"""Topic profiles of authors by year, their drift, phases and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.params import DEFAULT, Params


def year_profiles(papers: DataFrame, concepts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """author_id, year, concept, weight: shares of the year's concept scores, the strongest only."""
    rank = Window.partitionBy("author_id", "year").orderBy("paper_id")
    works = papers.where(F.col("year").isNotNull()).withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= p.works_per_year)
    summed = (
        works.select("author_id", "year", "paper_id")
        .join(concepts.where(F.col("pos") <= p.concepts_per_paper), "paper_id")
        .groupBy("author_id", "year", F.col("name").alias("concept"))
        .agg(F.sum("score").alias("total"))
    )
    year = Window.partitionBy("author_id", "year")
    shares = summed.withColumn("weight", F.col("total") / F.sum("total").over(year))
    best = year.orderBy(F.desc("weight"), "concept")
    return shares.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= p.concepts_per_profile).select("author_id", "year", "concept", "weight")


def _transitions(profiles: DataFrame, max_gap: int) -> DataFrame:
    """(author_id, year_from, year_to) of neighbouring observed years."""
    years = profiles.select("author_id", "year").distinct()
    after = F.lead("year").over(Window.partitionBy("author_id").orderBy("year"))
    return years.select("author_id", F.col("year").alias("year_from"), after.alias("year_to")).where(F.col("year_to") - F.col("year_from") <= max_gap)


def aligned(profiles: DataFrame, max_gap: int) -> DataFrame:
    """Both years' renormalised weights for every concept of a transition: author_id, year_from, year_to, concept, a, b.

    A row stands in the transition to its author's next observed year and in the one from the year before. A year's weights are added from
    the largest down, so that the last bit of a share does not depend on how the rows lie.
    """
    whole = F.sum("weight").over(Window.partitionBy("author_id", "year").orderBy(F.desc("weight"), "concept").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shares = profiles.select("author_id", "year", "concept", (F.col("weight") / whole).alias("share"))
    order = Window.partitionBy("author_id").orderBy("year")
    years = profiles.select("author_id", "year").distinct().withColumns({"_next": F.lead("year").over(order), "_last": F.lag("year").over(order)})
    zero = F.lit(0.0)
    steps = F.explode(F.array(F.struct(F.col("year").alias("year_from"), F.col("_next").alias("year_to"), F.col("share").alias("a"), zero.alias("b")), F.struct(F.col("_last").alias("year_from"), F.col("year").alias("year_to"), zero.alias("a"), F.col("share").alias("b"))))
    both = shares.join(years, ["author_id", "year"]).select("author_id", "concept", steps.alias("s")).select("author_id", "concept", "s.*").where(F.col("year_to") - F.col("year_from") <= max_gap)
    return both.groupBy("author_id", "year_from", "year_to", "concept").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _divergence(pairs: DataFrame) -> DataFrame:
    """Smoothed Jensen-Shannon divergence over 0.693, 1 at most, for each transition."""
    eps = 1e-10
    n = F.count("*").over(Window.partitionBy("author_id", "year_from", "year_to"))
    smooth = pairs.select("*", ((F.col("a") + eps) / (1 + n * eps)).alias("p"), ((F.col("b") + eps) / (1 + n * eps)).alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    part = F.col("p") * F.log(F.col("p") / middle) + F.col("q") * F.log(F.col("q") / middle)
    return smooth.groupBy("author_id", "year_from", "year_to").agg(F.least(F.sum(part / 2) / 0.693, F.lit(1.0)).alias("drift"))


def _long_enough(papers: DataFrame, p: Params) -> DataFrame:
    return papers.groupBy("author_id").agg(F.max("year").alias("_last"), F.min("year").alias("_first")).where(F.col("_last") - F.col("_first") >= p.min_span).select("author_id")


def drift_events(papers: DataFrame, concepts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """author_id, year_from, year_to, drift, is_jump: transitions that drift by more than the event threshold."""
    eligible = papers.join(_long_enough(papers, p), "author_id", "left_semi")
    drift = _divergence(aligned(year_profiles(eligible, concepts, p), p.max_gap))
    return drift.where(F.col("drift") > p.drift_event).withColumn("is_jump", F.col("drift") >= p.drift_jump)


def garden_drift(papers: DataFrame, concepts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """author_id, transitions, drift_avg, jumps: mean over all observed transitions, wide ones counting 0."""
    busy = papers.groupBy("author_id").count().where(F.col("count") >= p.garden_papers).select("author_id")
    profiles = year_profiles(papers.join(busy, "author_id", "left_semi"), concepts, p)
    drift = _divergence(aligned(profiles, p.garden_gap))
    years = profiles.select("author_id", "year").distinct().groupBy("author_id").agg((F.count("*") - 1).alias("transitions")).where("transitions > 0")
    sums = drift.groupBy("author_id").agg(F.sum("drift").alias("total"), F.count_if(F.col("drift") >= p.drift_jump).alias("jumps"))
    joined = years.join(sums, "author_id", "left")
    return joined.select("author_id", "transitions", (F.coalesce("total", F.lit(0.0)) / F.col("transitions")).alias("drift_avg"), F.coalesce("jumps", F.lit(0)).alias("jumps"))


def concept_changes(papers: DataFrame, concepts: DataFrame, p: Params = DEFAULT, top: int = 5) -> DataFrame:
    """author_id, year_from, year_to, direction, concept, change, rank: strongest entering and exiting concepts."""
    eligible = papers.join(_long_enough(papers, p), "author_id", "left_semi")
    pairs = aligned(year_profiles(eligible, concepts, p), p.max_gap)
    change = F.col("b") - F.col("a")
    moved = pairs.where(F.abs(change) > p.concept_change).select(
        "author_id", "year_from", "year_to", F.when(change > 0, "entering").otherwise("exiting").alias("direction"), "concept", F.abs(change).alias("change")
    )
    rank = Window.partitionBy("author_id", "year_from", "year_to", "direction").orderBy(F.desc(F.round("change", 9)), "concept")
    return moved.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def _year_ranks(profiles: DataFrame) -> DataFrame:
    years = profiles.select("author_id", "year").distinct()
    return years.withColumn("i", F.row_number().over(Window.partitionBy("author_id").orderBy("year"))).withColumn("n", F.count("*").over(Window.partitionBy("author_id")))


def sliding_drift(profiles: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """author_id, year, drift, is_jump: cosine distance of the window_years observed years before a year and those from it on."""
    w = p.window_years
    ranks = _year_ranks(profiles).where(F.col("n") >= 2 * w)
    rows = profiles.join(ranks, ["author_id", "year"])
    centres = ranks.where((F.col("i") > w) & (F.col("n") - F.col("i") >= 1)).select("author_id", F.col("year").alias("at"), F.col("i").alias("c"))
    near = rows.join(centres, "author_id").where((F.col("i") >= F.col("c") - w) & (F.col("i") < F.col("c") + w))
    cells = near.groupBy("author_id", "at", "concept").agg(
        F.sum(F.when(F.col("i") < F.col("c"), F.col("weight")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("i") >= F.col("c"), F.col("weight")).otherwise(0.0)).alias("b")
    )
    cosine = F.sum(F.col("a") * F.col("b")) / (F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))
    drift = cells.groupBy("author_id", F.col("at").alias("year")).agg((1 - cosine).alias("drift")).where(F.col("drift") >= p.window_drift)
    return drift.withColumn("is_jump", F.col("drift") >= p.window_jump)


def phases(papers: DataFrame, events: DataFrame, min_papers: int = 5) -> DataFrame:
    """author_id, phase, first_year, last_year, papers: stretches of years between jumps."""
    jumps = events.where("is_jump").select("author_id", F.col("year_to").alias("year"), F.lit(1).alias("jump")).distinct()
    years = papers.where(F.col("year").isNotNull()).groupBy("author_id", "year").agg(F.count("*").alias("papers"))
    marked = years.join(jumps, ["author_id", "year"], "left").fillna(0, ["jump"])
    running = Window.partitionBy("author_id").orderBy("year")
    numbered = marked.withColumn("phase", F.sum("jump").over(running).cast("int"))
    return (
        numbered.groupBy("author_id", "phase")
        .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("papers").alias("papers"))
        .where(F.col("papers") >= min_papers)
    )


def phase_details(found: DataFrame, papers: DataFrame, concepts: DataFrame, authorship: DataFrame, per_paper: int = 7, top: int = 5, works: int = 3) -> DataFrame:
    """``found`` phases with what they were about: concepts by summed score, collaborators by papers, works and citations.

    Only the first ``per_paper`` concepts of a paper count; of equal ones the name, or the least id, comes first. ``label`` is the leading
    concept; an author's first phase is formative, the last one current.
    """
    span = found.select("author_id", "phase", "first_year", "last_year")
    own = papers.join(span, "author_id").where(F.col("year").between(F.col("first_year"), F.col("last_year"))).select("author_id", "phase", "paper_id", "citation_count")
    by = ["author_id", "phase"]

    def first(counts: DataFrame, value: str, order: list, n: int, name: str) -> DataFrame:
        ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
        return ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))

    named = own.join(concepts.where(F.col("pos") <= per_paper), "paper_id").groupBy(*by, F.lower("name").alias("name")).agg(F.sum("score").alias("n"))
    people = own.join(authorship.distinct(), "paper_id").groupBy(*by, "coauthor_id").agg(F.count("*").alias("n"))
    totals = own.groupBy(*by).agg(F.sum(F.coalesce("citation_count", F.lit(0))).alias("citations"))
    out = found.join(totals, by).join(first(named, "name", [F.desc("n"), "name"], top, "concepts"), by, "left")
    out = out.join(first(people, "coauthor_id", [F.desc("n"), "coauthor_id"], top, "collaborators"), by, "left")
    out = out.join(first(own, "paper_id", [F.desc_nulls_last("citation_count"), "paper_id"], works, "top_papers"), by, "left")
    order = Window.partitionBy("author_id").orderBy("first_year")
    marks = {"label": F.coalesce(F.get("concepts", 0), F.lit("unknown")), "is_formative": F.lag("phase").over(order).isNull(), "is_current": F.lead("phase").over(order).isNull()}
    return out.withColumns(marks)


def merge_short_phases(found: DataFrame, min_years: int = 3) -> DataFrame:
    """Phases under ``min_years`` go into the next one, the last into the one before; an author's phases are one short array."""
    kind = "struct<first_year:int,last_year:int,papers:bigint>"
    joined = lambda a, b: F.struct(a["first_year"].alias("first_year"), b["last_year"].alias("last_year"), (a["papers"] + b["papers"]).alias("papers"))
    state = lambda out, carried: F.struct(out.alias("out"), carried.alias("carried"))

    def step(s: Column, r: Column) -> Column:
        now = F.when(s["carried"].isNull(), r).otherwise(joined(s["carried"], r))
        is_short = now["last_year"] - now["first_year"] + 1 < min_years
        return state(F.when(is_short, s["out"]).otherwise(F.concat(s["out"], F.array(now))), F.when(is_short, now))

    def finish(s: Column) -> Column:
        before = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        ends = F.when(F.size(s["out"]) > 0, joined(F.element_at(s["out"], -1), s["carried"])).otherwise(s["carried"])
        return F.when(s["carried"].isNull(), s["out"]).otherwise(F.concat(before, F.array(ends)))

    each = F.struct(F.col("first_year").cast("int").alias("first_year"), F.col("last_year").cast("int").alias("last_year"), F.col("papers").cast("bigint").alias("papers"))
    listed = found.groupBy("author_id").agg(F.array_sort(F.collect_list(each)).alias("rows"))
    empty = state(F.array().cast(f"array<{kind}>"), F.lit(None).cast(kind))
    merged = listed.select("author_id", F.posexplode(F.aggregate("rows", empty, step, finish)).alias("phase", "m"))
    return merged.select("author_id", "phase", "m.first_year", "m.last_year", "m.papers")


def core_concepts(profiles: DataFrame, share: float = 0.5, top: int = 10) -> DataFrame:
    """author_id, concept, years: concepts of at least ``share`` of an author's active years."""
    active = profiles.groupBy("author_id").agg(F.countDistinct("year").alias("active"))
    used = profiles.groupBy("author_id", "concept").agg(F.countDistinct("year").alias("years"))
    core = used.join(active, "author_id").where(F.col("years") >= share * F.col("active"))
    rank = Window.partitionBy("author_id").orderBy(F.desc("years"), "concept")
    return core.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("author_id", "concept", "years", "active", "rank")


def direction(profiles: DataFrame, p: Params = DEFAULT, top: int = 5) -> DataFrame:
    """author_id, trend, concept, change: concepts that grew or fell between the last observed years and those before."""
    n = p.direction_years
    ranks = _year_ranks(profiles).where(F.col("n") >= n + 1)
    rows = profiles.join(ranks, ["author_id", "year"]).withColumn("late", F.col("i") > F.col("n") - n)
    total = rows.groupBy("author_id", "concept").agg(
        F.sum(F.when(F.col("late"), F.col("weight")).otherwise(0.0)).alias("late"), F.sum(F.when(~F.col("late"), F.col("weight")).otherwise(0.0)).alias("early")
    )
    whole = Window.partitionBy("author_id")
    shares = total.select("author_id", "concept", (F.col("late") / F.sum("late").over(whole)).alias("late"), (F.col("early") / F.sum("early").over(whole)).alias("early"))
    late, early, ratio = F.col("late"), F.col("early"), p.direction_ratio
    grew = (late > 0) & ((late > early * ratio) | (early == 0))
    fell = (early > 0) & ((early > late * ratio) | (late == 0))
    moved = shares.where(grew | fell).select("author_id", F.when(grew, "emerging").otherwise("declining").alias("trend"), "concept", F.abs(late - early).alias("change"))
    rank = Window.partitionBy("author_id", "trend").orderBy(F.desc(F.round("change", 9)), "concept")
    return moved.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def emerging_by_year(concepts: DataFrame, papers: DataFrame, by: list[str], top: int = 5) -> DataFrame:
    """Concepts of a year (first three of each paper) that none of the three observed years before had, from the third year on."""
    counts = concepts.where("pos <= 3").join(papers.select("paper_id", "year", *by), "paper_id").groupBy(*by, "year", "name").agg(F.count("*").alias("papers"))
    years = counts.select(*by, "year").distinct().withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("year")))
    rows = counts.join(years, [*by, "year"])
    before = rows.select(*by, "name", F.col("i").alias("j"))
    late = rows.where("i > 2")
    seen = late.join(before, [*by, "name"]).where("j < i and j >= i - 3").select(*by, "year", "name").distinct()
    new = late.join(seen, [*by, "year", "name"], "left_anti")
    rank = Window.partitionBy(*by, "year").orderBy(F.desc("papers"), "name")
    return new.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select(*by, "year", "name", "papers", "rank")


def concept_flow(concepts: DataFrame, papers: DataFrame, min_papers: int = 5, min_years: int = 2) -> DataFrame:
    """Papers of each concept by year, its peak, and whether its last three observed years exceed its first three."""
    yearly = concepts.join(papers.select("paper_id", "year"), "paper_id").groupBy("name", "year").agg(F.count("*").alias("n"))
    span = Window.partitionBy("name")
    ranked = yearly.withColumn("up", F.row_number().over(span.orderBy("year"))).withColumn("down", F.row_number().over(span.orderBy(F.desc("year"))))
    flow = ranked.groupBy("name").agg(
        F.sum("n").alias("papers"),
        F.count("*").alias("years"),
        F.sum(F.when(F.col("up") <= 3, F.col("n")).otherwise(0)).alias("early"),
        F.sum(F.when(F.col("down") <= 3, F.col("n")).otherwise(0)).alias("late"),
        F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"),
    )
    trend = F.when(F.col("late") > 1.5 * F.col("early"), "growing").when(F.col("late") < 0.5 * F.col("early"), "declining").otherwise("stable")
    return flow.where((F.col("papers") >= min_papers) & (F.col("years") >= min_years)).withColumn("trend", trend)


def cluster_bridging(papers: DataFrame, concepts: DataFrame, author: str = "author_id") -> DataFrame:
    """author_id, clusters_bridged: distinct primary concepts less one."""
    primary = concepts.where("pos = 1").select("paper_id", "name")
    found = papers.join(primary, "paper_id").groupBy(author).agg(F.countDistinct("name").alias("n"))
    return found.select(author, F.greatest(F.col("n") - 1, F.lit(0)).cast("int").alias("clusters_bridged"))


def at_ranks(columns: dict[str, DataFrame], share: float) -> DataFrame:
    """For each name and table of one column: the value (as a double) at place floor(share * n) from 0 of its ascending list; one row. Not an interpolated percentile.

    Distinct values of all lists are dealt out by ranges in one pass; the sums of the ranges tell which one has the place, and only that one is counted through.
    """
    stacked = None
    for n, values in enumerate(columns.values()):
        one = values.select(F.lit(n).alias("which"), F.col(values.columns[0]).cast("double").alias("value"))
        stacked = one if stacked is None else stacked.union(one)
    counted = stacked.groupBy("which", "value").agg(F.count("*").alias("k"))
    ranged = materialize(counted.repartitionByRange("which", "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("which", "part").agg(F.sum("k").alias("n"))  # one row for each list and partition
    of_list = Window.partitionBy("which")
    ends = sums.select("which", "part", F.sum("n").over(of_list.orderBy("part")).alias("upto"), F.floor(F.sum("n").over(of_list) * share).alias("place"))
    found = ends.where("upto > place").groupBy("which").agg(F.min_by(F.struct("part", "upto", "place"), "part").alias("f")).select("which", "f.*")
    inside = ranged.join(F.broadcast(found), ["which", "part"])  # one row for each list
    of_part = Window.partitionBy("which", "part")
    below = F.col("upto") - F.sum("k").over(of_part) + F.sum("k").over(of_part.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("_below", below).where(F.col("_below") > F.col("place"))
    return reached.agg(*(F.min(F.when(F.col("which") == n, F.col("value"))).alias(name) for n, name in enumerate(columns)))


def at_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """``at_ranks`` of one column, in its own type."""
    return at_ranks({column: values.select(column)}, share).select(F.col(column).cast(values.schema[column].dataType).alias(column))


def roles(authors: DataFrame, citation_p90: Column, centrality_p90: Column) -> DataFrame:
    """Disruptor, leader, follower, player or unknown, with a confidence."""
    cites, cent, drift, jumps, bridges = (F.coalesce(F.col(c), F.lit(0)) for c in ("citation_count", "centrality", "drift_avg", "jumps", "clusters_bridged"))
    disruptor = (drift >= 0.4) | (jumps >= 2) | (bridges >= 2)
    leader = (cent >= centrality_p90) & (cites >= citation_p90) & (drift < 0.3)
    follower = (cites < citation_p90 * 0.2) & (drift < 0.2)
    player = (cites > 0) | (cent > 0)
    role = F.when(disruptor, "disruptor").when(leader, "leader").when(follower, "follower").when(player, "player").otherwise("unknown")
    confidence = (
        F.when(disruptor, F.least(F.lit(1.0), drift + jumps * 0.2 + bridges * 0.1))
        .when(leader, F.least(F.lit(1.0), cent / F.greatest(centrality_p90, F.lit(0.01)) * 0.5 + 0.5))
        .when(follower, 0.6)
        .when(player, 0.5)
        .otherwise(0.0)
    )
    return authors.withColumn("role", role).withColumn("role_confidence", confidence)


def author_bridges(papers: DataFrame, concepts: DataFrame, events: DataFrame) -> DataFrame:
    """author_id, year_from, year_to, cluster_a, cluster_b: primary concepts before a jump against others after it."""
    primary = papers.join(concepts.where("pos = 1").select("paper_id", F.col("name").alias("cluster")), "paper_id").select("author_id", "year", "cluster").distinct()
    jumps = events.where("is_jump").select("author_id", "year_from", "year_to")
    before = jumps.join(primary, "author_id").where(F.col("year") <= F.col("year_from")).select("author_id", "year_from", "year_to", F.col("cluster").alias("cluster_a")).distinct()
    after = jumps.join(primary, "author_id").where(F.col("year") >= F.col("year_to")).select("author_id", "year_from", "year_to", F.col("cluster").alias("cluster_b")).distinct()
    return before.join(after, ["author_id", "year_from", "year_to"]).where("cluster_a <> cluster_b")
