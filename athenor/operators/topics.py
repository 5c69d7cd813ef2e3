"""Topics and gaps: extraction, trends, co-occurrence, unexplored pairs and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.exprs import gap_score, tokens
from athenor.functions.ranks import running
from athenor.functions.storage import bounded, materialize
from athenor.params import DEFAULT, GENERIC_CONCEPTS, STOP_WORDS, Params


#: Concept names that may all be paired with each other: some ten million pairs.
MOST_NAMES = 5_000

#: Authors and concepts of a block that one task compares with another; of these, TILE by TILE authors over COLUMNS concepts at a time.
BLOCK, ENTRIES, TILE, COLUMNS = 8_192, 2_000_000, 1_024, 4_096


def without_generic(concepts: DataFrame, name: str = "name", extra: tuple[str, ...] = ()) -> DataFrame:
    """Leaves out general and very short concept names."""
    low = F.lower(F.col(name))
    return concepts.where(~low.isin(*GENERIC_CONCEPTS, *extra) & (F.length(name) >= 3))


def text_terms(texts: DataFrame, column: str) -> DataFrame:
    """(id, term): words of three letters or more that are no stop words, and the first ten pairs of neighbours."""
    words = F.filter(tokens(column), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    kept = texts.select("id", words.alias("w"))
    first = F.slice("w", 1, 11)
    pairs = F.when(F.size("w") >= 2, F.zip_with(F.slice(first, F.lit(1), F.size(first) - 1), F.slice("w", 2, 10), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    both = F.concat("w", F.filter(pairs, lambda p: F.length(p) > 5))
    return kept.select("id", F.explode(F.array_distinct(both)).alias("term"))


def topic_sources(concepts: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, name, score): concepts by their scores, title terms at 0.5 and abstract terms at 0.3. texts(id, title, abstract)."""
    named = concepts.select("paper_id", F.lower("name").alias("name"), "score")
    titles, abstracts = text_terms(texts, "title"), text_terms(texts, "abstract")
    return named.unionAll(titles.select("id", "term", F.lit(0.5))).unionAll(abstracts.select("id", "term", F.lit(0.3)))


def extract(concepts: DataFrame, papers: DataFrame, min_papers: int = 3, min_weight: float = 2.0, top: int = 50) -> DataFrame:
    """Topics by weight: score times ln(1 + citations) + 1, over distinct papers, with how specific they are. ``topic_sources`` joins three sources."""
    joined = concepts.join(papers.select("paper_id", "citation_count"), "paper_id")
    total = papers.agg(F.count("*").alias("_all"))
    weight = F.col("score") * (F.log1p("citation_count") + 1)
    grouped = joined.groupBy("name").agg(F.countDistinct("paper_id").alias("papers"), F.sum(weight).alias("weight"))
    kept = grouped.where((F.col("papers") >= min_papers) & (F.col("weight") >= min_weight)).crossJoin(F.broadcast(total))  # one row
    share = F.col("papers") / F.col("_all")
    kind = F.when(share > 0.30, "broad").when(share < 0.05, "specific").otherwise("medium")
    return kept.withColumn("kind", kind).orderBy(F.desc("weight"), "name").limit(top).select("name", "papers", "weight", "kind")


def trends(concepts: DataFrame, papers: DataFrame, by: str | None = None) -> DataFrame:
    """Early and late share of each topic around the middle year, and its trend."""
    keys = [by] if by else []
    p = papers.where(F.col("year").isNotNull())
    middle = F.floor((F.min("year") + F.max("year")) / 2)
    bounds = p.groupBy(*keys).agg(middle.alias("_mid"))
    dated = p.join(bounds, keys) if keys else p.crossJoin(F.broadcast(bounds))  # without keys one row
    sides = dated.groupBy(*keys).agg(F.count_if(F.col("year") <= F.col("_mid")).alias("_e"), F.count_if(F.col("year") > F.col("_mid")).alias("_l"))
    used = concepts.select("paper_id", "name").distinct().join(dated.select("paper_id", "year", "_mid", *keys), "paper_id")
    counts = used.groupBy(*keys, "name").agg(F.count_if(F.col("year") <= F.col("_mid")).alias("early"), F.count_if(F.col("year") > F.col("_mid")).alias("late"))
    both = counts.join(sides, keys) if keys else counts.crossJoin(F.broadcast(sides))
    early, late = F.col("early") / F.greatest("_e", F.lit(1)), F.col("late") / F.greatest("_l", F.lit(1))
    trend = F.when(F.col("early") == 0, "new").when(late > early + 0.2, "emerging").when(late < early - 0.2, "declining").otherwise("stable")
    return both.select(*keys, "name", "early", "late", early.alias("early_share"), late.alias("late_share"), trend.alias("trend"))


def topic_pairs(concepts: DataFrame, min_papers: int = 1) -> DataFrame:
    """(a, b, papers) of concepts a < b of one paper; a paper has few concepts, so its pairs are few."""
    own = concepts.select("paper_id", "name").distinct()
    left, right = own.withColumnRenamed("name", "a"), own.withColumnRenamed("name", "b")
    return left.join(right, "paper_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("papers")).where(F.col("papers") >= min_papers)


def _sizes(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("name").agg(F.countDistinct("paper_id").alias("n"))


def _near_bits(pairs: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """(i, bits): for each concept number one bit for each of the ``n`` concepts, set for those beside it."""
    a, b = (numbers.select(F.col("name").alias(x), F.col("i").alias(y)) for x, y in (("a", "i"), ("b", "j")))
    known = pairs.join(a, "a").join(b, "b").select("i", "j")
    listed = known.union(known.select("j", "i")).groupBy("i").agg(F.collect_set("j").alias("near"))  # n numbers at most

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.zeros((len(batch), n), bool)
            for row, near in zip(bits, batch["near"], strict=True):
                row[near] = True
            yield pd.DataFrame({"i": batch["i"], "bits": [r.tobytes() for r in np.packbits(bits, axis=1)]})

    return listed.mapInPandas(pack, "i int, bits binary")


def _similar(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of ``wanted`` (name), whose concepts occur in ``pairs`` (a, b).

    Each concept is a row of bits, one for each concept beside it, so the whole is a product of a matrix of at most MOST_NAMES rows and columns with
    itself: every task counts the common bits of some rows with all later ones. Rows reach the tasks as a broadcast of MOST_NAMES^2 bits at most.
    """
    names = bounded(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct(), MOST_NAMES, "concepts")
    numbers = materialize(names.coalesce(1).select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("i")), "numbers")  # over MOST_NAMES rows at most
    rows = numbers.join(wanted.select("name"), "name", "left_semi")
    listed = numbers.select("i", "name").orderBy("i").collect()
    matrix = np.zeros((len(listed), -(-len(listed) // 8)), np.uint8)
    for r in _near_bits(pairs, numbers, len(listed)).collect():
        matrix[r.i] = np.frombuffer(r.bits, np.uint8)
    spark = pairs.sparkSession
    packed = spark.sparkContext.broadcast((matrix, np.sort(np.array([r.i for r in rows.select("i").collect()], np.int64)), [r.name for r in listed]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, some, names = packed.value
        ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)
        sizes = ones[matrix].sum(1)
        for batch in batches:
            for i in batch["i"].tolist():
                later = some[some > i]
                if not len(later):
                    continue
                both = ones[matrix[later] & matrix[i]].sum(1)
                beside = (matrix[later, i // 8] >> (7 - i % 8)) & 1
                union = sizes[i] + sizes[later] - 2 * beside.astype(np.int64) - both
                yield pd.DataFrame({"a": names[i], "b": [names[j] for j in later.tolist()], "similarity": np.where(union > 0, both / np.maximum(union, 1), 0.0)})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("i").repartition(width, "i").mapInPandas(count, "a string, b string, similarity double")


def concept_similarity(concepts: DataFrame) -> DataFrame:
    """(a, b, similarity): Jaccard of the sets of concepts that occur with each, without the two themselves."""
    pairs = materialize(topic_pairs(concepts).select("a", "b"), "pairs")
    return _similar(pairs, pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct())


def concept_gaps(concepts: DataFrame, top: int = 50, p: Params = DEFAULT) -> DataFrame:
    """Concept pairs that few papers join although many have one: papers with both, only a, only b, ratio and gap score.

    The grid of pairs is over the concepts of ``p.pair_papers`` papers or more, of which a vocabulary has few.
    """
    sizes = bounded(_sizes(concepts).where(F.col("n") >= p.pair_papers), MOST_NAMES, "frequent concepts")
    pairs = materialize(topic_pairs(concepts), "pairs")
    grid = sizes.toDF("a", "na").join(sizes.toDF("b", "nb"), F.col("a") < F.col("b"))
    joined = grid.join(pairs, ["a", "b"], "left").fillna(0, ["papers"]).join(_similar(pairs.select("a", "b"), sizes), ["a", "b"], "left").fillna(0.0, ["similarity"])
    ratio = F.col("papers") / F.least("na", "nb")
    out = joined.withColumn("ratio", ratio).where(F.col("ratio") <= p.pair_ratio).withColumn("gap", gap_score("na", "nb", "similarity"))
    return out.orderBy(F.desc("gap"), "a", "b").limit(top).select("a", "b", F.col("papers").alias("both"), (F.col("na") - F.col("papers")).alias("a_only"), (F.col("nb") - F.col("papers")).alias("b_only"), "ratio", "similarity", "gap")


def class_gaps(concepts: DataFrame, first: Column, second: Column, most_joint: int, least: int) -> DataFrame:
    """Pairs of a concept of one class (methods) and one of another (domains), both frequent, that hardly meet."""
    sizes = bounded(_sizes(concepts).where(F.col("n") >= least), MOST_NAMES, "frequent concepts")
    grid = sizes.where(first).toDF("method", "nm").crossJoin(sizes.where(second).toDF("domain", "nd"))  # frequent concept names only
    pairs = topic_pairs(concepts)
    both = pairs.union(pairs.select("b", "a", "papers")).toDF("method", "domain", "joint")
    score = F.least(F.lit(1.0), F.log1p(F.sqrt(F.col("nm") * F.col("nd"))) / 10) / (1 + F.col("joint"))
    return grid.where("method <> domain").join(both, ["method", "domain"], "left").fillna(0, ["joint"]).where(F.col("joint") <= most_joint).withColumn("score", score)


def _blocks(sets: DataFrame) -> DataFrame:
    """(block, a, k, m, c) of sets(block, i, k, c): arrays of a block's authors, their sizes, how many concepts follow for each, and these concepts."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        a, first, m = np.unique(rows["i"].to_numpy(np.int64), return_index=True, return_counts=True)
        parts = {"a": a, "k": rows["k"].to_numpy(np.int64)[first], "m": m.astype(np.int64), "c": rows["c"].to_numpy(np.int32)}
        return pd.DataFrame({"block": rows["block"].iloc[:1].tolist(), **{x: [v.tobytes()] for x, v in parts.items()}})

    return sets.groupBy("block").applyInPandas(pack, "block int, a binary, k binary, m binary, c binary")


def _first(at: np.ndarray, by: list[np.ndarray], top: int) -> np.ndarray:
    """The first ``top`` of the rising places ``at`` by the falling values ``by``, then by place."""
    chosen = []
    for values in by:
        if len(at) <= top:
            break
        v = values[at]
        least = np.partition(v, len(v) - top)[len(v) - top]
        chosen.append(at[v > least])
        at, top = at[v == least], top - len(chosen[-1])
    return np.concatenate([*chosen, at[:top]])


def _first_pairs(left: tuple, right: tuple, met: np.ndarray, shared: int, overlap: float, top: int) -> np.ndarray:
    """Rows (a, b, shared, overlap): the first ``top`` pairs a < b of two blocks by falling overlap and shared, then a and b, without those of ``met`` (a, b).

    TILE authors of one block meet TILE of the other in a product of matrices over the concepts that both tiles have.
    """

    def tiles(a: np.ndarray, k: np.ndarray, m: np.ndarray, c: np.ndarray) -> list[tuple]:
        ends = np.concatenate([[0], np.cumsum(m)])
        return [(a[x : x + TILE], k[x : x + TILE], m[x : x + TILE], c[ends[x] : ends[min(x + TILE, len(a))]]) for x in range(0, len(a), TILE)]

    def matrix(m: np.ndarray, c: np.ndarray, names: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, c), len(names) - 1)
        here = names[at] == c
        out = np.zeros((len(m), len(names)), np.float32)
        out[np.repeat(np.arange(len(m)), m)[here], at[here]] = 1
        return out

    best = np.zeros((0, 4))
    met = met[np.argsort(met[:, 0], kind="stable")]
    for a, ka, ma, ca in tiles(*left):
        known, near = np.unique(ca), met[np.searchsorted(met[:, 0], a[0]) : np.searchsorted(met[:, 0], a[-1], "right")]
        for b, kb, mb, cb in tiles(*right):
            if b[-1] <= a[0]:
                continue
            both, names = np.zeros((len(a), len(b)), np.float32), np.intersect1d(known, cb)
            for x in range(0, len(names), COLUMNS):
                both += matrix(ma, ca, names[x : x + COLUMNS]) @ matrix(mb, cb, names[x : x + COLUMNS]).T
            part = both / np.maximum(ka[:, None], kb[None, :]).astype(np.float64)
            good = (both >= shared) & (part > overlap)
            if len(best) == top:  # only what can come before the last one so far
                last, _, n, r = best[-1]
                good &= (part > r) | ((part == r) & ((both >= n) if a[0] <= last else (both > n)))
            if b[0] <= a[-1]:
                good &= b[None, :] > a[:, None]
            out = near[(near[:, 1] >= b[0]) & (near[:, 1] <= b[-1])]
            good[np.searchsorted(a, out[:, 0]), np.searchsorted(b, out[:, 1])] = False
            at = _first(np.flatnonzero(good), [part.ravel(), both.ravel()], top)
            if len(at):
                x, y = np.divmod(at, len(b))
                rows = np.concatenate([best, np.stack([a[x], b[y], both.ravel()[at], part.ravel()[at]], axis=1)])
                best = rows[np.lexsort((rows[:, 1], rows[:, 0], -rows[:, 2], -rows[:, 3]))][:top]
    return best


def author_gaps(author_concepts: DataFrame, coauthors: DataFrame, shared: int = 2, overlap: float = 0.3, top: int = 50) -> DataFrame:
    """Authors a < b that never wrote together but share concepts: author_concepts(author, concept), coauthors(a, b).

    Every author may meet every other one, so all pairs are compared, but none is a row before it is among the first: authors are numbered in order and cut into
    blocks, each pair of blocks is one group, and a group gives its first ``top`` pairs. The work is the square of the authors, the shuffle
    the concepts once for each block.
    """
    own = materialize(author_concepts.distinct(), "own")
    sizes = own.where("author is not null").groupBy("author").agg(F.count("*").alias("k"))
    sizes = materialize(running(sizes, [F.col("author")], F.lit(1), "i").select("author", "k", "i"), "sizes")
    width = min(BLOCK, max(TILE // 4, -(-sizes.count() // 12)))  # at least 78 pairs of blocks where there are authors enough
    weight = F.greatest(F.col("k"), F.lit(-(-ENTRIES // width)))  # so many authors in a block at most, with about ENTRIES concepts at most
    placed = running(sizes, [F.col("i")], weight, "upto").withColumn("block", F.floor(F.col("upto") / ENTRIES).cast("int"))
    placed = materialize(placed.select("author", "k", "i", "block"), "placed")
    names = running(own.select("concept").where("concept is not null").distinct(), [F.col("concept")], F.lit(1), "c").select("concept", "c")
    blocks = materialize(_blocks(own.join(placed, "author").join(names, "concept").select("block", "i", "k", "c")), "blocks")
    last = blocks.agg(F.max("block")).first()[0] or 0
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q"))))
    sides = blocks.select(pair.alias("t"), "block", "a", "k", "m", "c").select("t.*", "block", "a", "k", "m", "c")
    ends = [placed.select(F.col("author").alias(x), F.col("i").alias(f"i{x}"), F.col("block").alias(y)) for x, y in (("a", "p"), ("b", "q"))]
    met = coauthors.select("a", "b").join(ends[0], "a").join(ends[1], "b").select("p", "q", "ia", "ib").distinct()

    def compare(both: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        parts = [[np.frombuffer(r[x], np.int32 if x == "c" else np.int64) for x in ("a", "k", "m", "c")] for r in both.sort_values("block").to_dict("records")]
        whole = len(parts) and (len(parts) == 2 or both["p"].iloc[0] == both["q"].iloc[0])
        rows = _first_pairs(parts[0], parts[-1], met[["ia", "ib"]].to_numpy(np.int64).reshape(-1, 2), shared, overlap, top) if whole else np.zeros((0, 4))
        return pd.DataFrame(rows, columns=["ia", "ib", "shared", "overlap"]).astype({x: np.int64 for x in ("ia", "ib", "shared")})

    found = sides.groupBy("p", "q").cogroup(met.groupBy("p", "q")).applyInPandas(compare, "ia long, ib long, shared long, overlap double")
    found = materialize(found.orderBy(F.desc("overlap"), F.desc("shared"), "ia", "ib").limit(top), "first")  # so few rows
    named = F.broadcast(found).join(ends[0].drop("p"), "ia").join(ends[1].drop("q"), "ib")
    return named.orderBy(F.desc("overlap"), F.desc("shared"), "a", "b").select("a", "b", "shared", "overlap")


def pair_bridges(concepts: DataFrame, pairs: DataFrame, top: int = 20) -> DataFrame:
    """Papers that have both concepts of most of the given pairs(a, b)."""
    own = concepts.select("paper_id", "name").distinct()
    hits = pairs.select("a", "b").join(own.withColumnRenamed("name", "a"), "a").join(own.withColumnRenamed("name", "b"), ["paper_id", "b"])
    return hits.groupBy("paper_id").agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "paper_id").limit(top)


def nascent_pairs(concepts: DataFrame, least: int = 10, low: int = 2, high: int = 4) -> DataFrame:
    """Pairs of frequent concepts that few papers already join: sqrt(na nb) / (n + 1)."""
    sizes = _sizes(concepts).where(F.col("n") >= least)
    pairs = topic_pairs(concepts).where(F.col("papers").between(low, high))
    out = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return out.select("a", "b", "papers", (F.sqrt(F.col("na") * F.col("nb")) / (F.col("papers") + 1)).alias("potential"))


def unexplored(primary: DataFrame, candidates: DataFrame, graph: DataFrame, limit: int = 500, least: int = 3, top: int = 5) -> DataFrame:
    """Primary concepts of the best candidates that no paper of the graph has. primary(paper_id, name)."""
    best = candidates.orderBy(F.desc("citation_count"), "paper_id").limit(limit)
    known = graph.join(primary, "paper_id").select("name").distinct()
    counts = best.join(primary, "paper_id").groupBy("name").agg(F.count("*").alias("candidates"), F.min("paper_id").alias("first_id")).where(F.col("candidates") >= least)
    return counts.join(known, "name", "left_anti").orderBy(F.desc("candidates"), "name").limit(top)


def intermediates(cluster_concepts: DataFrame, candidates: DataFrame, top: int = 10) -> DataFrame:
    """For cluster pairs a < b the candidates whose concepts meet both: cluster_concepts(cluster, name), candidates(paper_id, name)."""
    hits = candidates.distinct().join(cluster_concepts.distinct(), "name").groupBy("paper_id", "cluster").agg(F.count("*").alias("n"))
    both = hits.toDF("paper_id", "a", "n1").join(hits.toDF("paper_id", "b", "n2"), "paper_id").where("a < b").withColumn("overlap", F.col("n1") + F.col("n2"))
    rank = Window.partitionBy("a", "b").orderBy(F.desc("overlap"), "paper_id")
    return both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("a", "b", "paper_id", "overlap", "rank")


def missing_links(links: DataFrame, found: DataFrame, top: int = 20) -> DataFrame:
    """Cluster pairs without a link (cluster_gap) or with under three and more intermediates than links (weak_link)."""
    counts = found.groupBy("a", "b").agg(F.count("*").alias("candidates"), F.min_by("paper_id", "rank").alias("best"))
    out = links.where("links < 3").join(counts, ["a", "b"]).where("links = 0 or candidates > links")
    kind = F.when(F.col("links") == 0, "cluster_gap").otherwise("weak_link")
    return out.select("a", "b", "links", "candidates", "best", kind.alias("kind"), F.when(F.col("links") == 0, 0.7).otherwise(0.5).alias("confidence")).orderBy(F.desc("confidence"), "a", "b").limit(top)


def topic_clusters(pairs: DataFrame, sizes: DataFrame, most: int = 5, least: int = 2) -> list[tuple[str, list[str]]]:
    """Greedy clusters over the twenty largest topics: each takes its free related topics. A report over at most twenty rows."""
    leaders = [r.name for r in sizes.orderBy(F.desc("n"), "name").limit(20).collect()]
    inside = pairs.where(F.col("a").isin(leaders) & F.col("b").isin(leaders)).collect()  # at most 190 rows
    near: dict[str, set[str]] = {}
    for r in inside:
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    used: set[str] = set()
    out = []
    for name in leaders:
        free = sorted(near.get(name, set()) - used - {name})
        if name not in used and len(free) >= least and len(out) < most:
            out.append((name, free))
            used |= {name, *free}
    return out
