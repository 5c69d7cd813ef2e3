"""Divergence of each source's words from its language and from the language's other sources.

A document's bytes are lower-cased and blanked by one ``bytes.translate`` and split; a Counter of each document gives its terms'
frequencies, which are summed inside the task before they move. A language keeps the terms that MIN_DOCUMENTS of its documents
have. Smoothed shares are exact whole numbers of a billion parts, made by Spark's decimals; differences are exact 64-bit numbers.

Sums over all kept terms are sparse: a term that neither of two sources has adds the same for every such term. So only terms that a source has
go into the pair sums, in matrices of terms by sources: the sources of a language in blocks, every pair of blocks a matrix of its own, the
terms dealt to many tasks. A hot language or source is thus split by its terms, and its counts are summed before they move.

Null text, lang and source count as empty; a text without letters adds its group and nothing else. Repeated rows count as documents of
their own; doc_id and further columns are not looked at, whatever their names. An empty table gives no rows; equal values are ranked
by the item's bytes. Terms have any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.llm.common import parts

MIN_DOCUMENTS, TOP, BILLION = 10, 10, 1_000_000_000
#: Entries and bytes of terms that a task sums before it hands them on; sources to a block; terms to a matrix; tasks of one pair of blocks.
ENTRIES, HELD, BLOCK, ROWS, BUCKETS = 200_000, 8 << 20, 64, 2_048, 64
#: A-Z become lower case; all other ASCII but a-z becomes a blank; the bytes of other characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def frequencies(text: str) -> Counter[bytes]:
    """How often each term stands in the text."""
    return Counter(text.encode("utf-8", "replace").translate(TABLE).split())


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: summed in the task as far as they fit; each group also has an empty term, which counts its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        entries = size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                n, seen = np.array(list(terms.values()), np.int64).reshape(-1, 2).T
                same = [pa.array([v], pa.string()).take(pa.array(np.zeros(len(n), np.int64))) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(list(terms), pa.binary()), pa.array(n), pa.array(seen)], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in (p for b in batches for p in parts(b, 2)):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                got = frequencies(text)
                got[b""] = 1
                for term, n in got.items():
                    if (was := terms.get(term)) is None:
                        terms[term] = [n, 1]
                        size += len(term)
                    else:
                        was[0] += n
                        was[1] += 1
                entries += len(terms) - before
                if entries > ENTRIES or size > HELD:
                    yield from flushed()
                    entries = size = 0
        yield from flushed()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = plain.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(a billion * (n + 2) / (total + 2 * terms)), exactly."""
    top = F.lit(BILLION).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exactly: both are at most a billion and one."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by lang, blocks and term: for each two sources, the sum over the terms here, and how many terms these are.

    ``p`` of the rows without a term is what a source of the block has for every term that it lacks.
    """
    names = ["lang", "a", "b", "value", "terms"]
    at, absent = None, np.zeros((2, BLOCK), np.int64)
    sums, terms = np.zeros((BLOCK, BLOCK), np.int64), 0
    last, matrix, filled = None, np.zeros((ROWS, 2, BLOCK), np.int64), 0

    def add() -> None:
        nonlocal terms, filled
        here = np.where(matrix[:filled] == 0, absent, matrix[:filled])
        left, right = here[:, 0], here[:, int(at[1] != at[2])]
        for i in np.flatnonzero(absent[0]):
            p, q = left[:, i : i + 1], right
            sums[i] += ((p - q) ** 2 // np.maximum(p + q, 1)).sum(0)
        terms += filled
        matrix[:filled] = 0
        filled = 0

    def done() -> pa.RecordBatch:
        add()
        lang, x, y = at
        i, j = (g.ravel() for g in np.meshgrid(np.flatnonzero(absent[0]), np.flatnonzero(absent[int(x != y)]), indexing="ij"))
        columns = [pa.array([lang] * len(i), pa.string()), pa.array(x * BLOCK + i), pa.array(y * BLOCK + j), pa.array(sums[i, j]), pa.array(np.full(len(i), terms, np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for lang, x, y, term, side, place, p in zip(*(batch.column(c).to_pylist() for c in ("lang", "x", "y", "term", "side", "place", "p")), strict=True):
            if at != (lang, x, y):
                if at is not None:
                    yield done()
                at, last, terms = (lang, x, y), None, 0
                absent[:], sums[:] = 0, 0
            if term is None:
                absent[side, place] = p
                continue
            if term != last:
                if filled == ROWS:
                    add()
                last, filled = term, filled + 1
            matrix[filled - 1, side, place] = p
    if at is not None:
        yield done()


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language.

    ``shares``: lang, term, block, place, blocks, p of the terms that a source has; ``groups``: lang, source, number, terms, none and the same
    places, one row a source. A term is dealt to one of BUCKETS tasks, and a source's absent share goes to all of them.
    """
    columns = ["lang", "term", "bucket", "block", "place", "blocks", "p"]
    buckets = F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket")
    terms = shares.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).select(*columns)
    absent = groups.select("lang", F.lit(None).cast("binary").alias("term"), buckets, "block", "place", "blocks", F.col("none").alias("p"))
    sent = terms.union(absent).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "bucket", "term", (F.col("block") > F.col("other")).cast("int").alias("side"), "place", "p")
    dealt = sent.repartition("lang", "x", "y", "bucket").sortWithinPartitions("lang", "x", "y", F.col("term").asc_nulls_first())
    found = dealt.select("lang", "x", "y", "term", "side", "place", "p").mapInArrow(_pair_sums, "lang string, a long, b long, value long, terms long")
    summed = materialize(found.where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("seen")), "sums")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    mirrored = summed.where(block("a") < block("b")).select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "seen")
    left = groups.select("lang", F.col("number").cast("long").alias("a"), "source", "terms", F.col("none").alias("p"))
    right = groups.select("lang", F.col("number").cast("long").alias("b"), F.col("source").alias("item"), F.col("none").alias("q"))
    found = summed.union(mirrored).join(left, ["lang", "a"]).join(right, ["lang", "b"])
    value = F.col("value") + difference(F.col("p"), F.col("q")) * (F.col("terms") - F.col("seen"))
    return found.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` has all other sources of the language, ``term`` the TOP terms that a source has more of."""
    counts = materialize(counted(docs), "terms")
    terms = counts.where(F.octet_length("term") > 0)
    common = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCUMENTS).drop("docs")
    common = materialize(common, "common")
    kept = materialize(terms.join(common, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = common.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number")
    sources = materialize(counts.where(F.octet_length("term") == 0).select("lang", "source", number), "sources")
    blocks = sources.groupBy("lang").agg((F.floor(F.max("number") / BLOCK) + 1).cast("int").alias("blocks"))
    groups = sources.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").join(blocks, "lang").na.fill(0, ["total", "terms", "lang_total"])
    some = F.greatest("terms", F.lit(1))  # without a kept term nothing is multiplied with a share
    place = {"block": F.floor(F.col("number") / BLOCK).cast("int"), "place": (F.col("number") % BLOCK).cast("int"), "none": share(F.lit(0), F.col("total"), some)}
    groups = materialize(groups.withColumns(place), "groups")
    p, q = share(F.col("n"), F.col("total"), some), share(F.col("lang_n"), F.col("lang_total"), some)
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "block", "place", "blocks", p.alias("p"), q.alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    higher = shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    best = higher.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    each = pairs(shares, groups).withColumn("rank", F.row_number().over(order))
    return each.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
