"""Titles that stand inside longer titles: an asymmetric join by the rarest piece.

A text contains a title only if it contains each of its pieces of GRAM characters, so one piece is enough to find it by: the one that the
fewest texts have. Titles shorter than that are their own piece. Up to ASKED different pieces, every task gets them all and looks all
windows of its texts up by rolling hashes, once to count and once to find, and no text moves; beyond that pieces are joined over a shuffle.
Equal titles are joined once, and what meets is confirmed on the whole strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athenor.functions.storage import materialize

GRAM, ASKED = 8, 250_000
CHARACTERS, BITS, FACTOR = 1_000_000, 22, np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` characters; equal runs have equal ones."""
    n = max(len(codes) - size + 1, 0)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = out * FACTOR + codes[j : j + n]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _places(texts: list[str], sizes: list[int], known: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, piece) by number, where one of the sorted hashes ``known`` stands in a text; about CHARACTERS characters at a time. A few may be there by chance."""

    def looked_up(part: list[str], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        codes, owner = _codes("".join(part)), np.repeat(of, [len(t) for t in part])
        at, piece = [], []
        for size in sizes:
            h = _hashes(codes, size)
            x = np.flatnonzero(marks[h >> np.uint64(64 - BITS)])
            x = x[owner[x] == owner[x + size - 1]]
            p = np.minimum(np.searchsorted(known, h[x]), len(known) - 1)
            here = known[p] == h[x]
            at.append(owner[x[here]])
            piece.append(p[here])
        both = np.unique(np.concatenate(at) * len(known) + np.concatenate(piece))
        return np.divmod(both, len(known))

    part, of, room = [], [], CHARACTERS
    for i, text in enumerate(texts):
        for x in range(0, len(text), CHARACTERS):
            part.append(text[x : x + CHARACTERS + GRAM - 1])
            of.append(i)
            room -= len(part[-1])
            if room <= 0:
                yield looked_up(part, of)
                part, of, room = [], [], CHARACTERS
    if part:
        yield looked_up(part, of)


def _looked_up(asked: DataFrame, long: DataFrame) -> DataFrame:
    """``contained`` for few titles: asked(title, size, piece), long(id, text)."""
    rows = asked.select("title", "size", "piece").collect()  # ASKED of them at most
    hashes = np.array([_hashes(_codes(r.piece), r["size"])[0] for r in rows], np.uint64)
    sizes = sorted({r["size"] for r in rows})
    context = long.sparkSession.sparkContext

    def shared(known: np.ndarray, titles: list[list[str]] | None = None):
        marks = np.zeros(1 << BITS, bool)
        marks[known >> np.uint64(64 - BITS)] = True
        return context.broadcast((known, marks, titles))

    every = shared(np.unique(hashes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks, _ = every.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, piece in _places(batch.column("text").to_pylist(), sizes, known, marks):
                total += np.bincount(piece, minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": some, "n": total[some]}, pa.schema([("piece", pa.int64()), ("n", pa.int64())]))

    counts = np.zeros(len(every.value[0]), np.int64)
    for r in long.select("text").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[r.piece] = r.n
    rarest: dict[str, tuple[int, np.uint64]] = {}
    for r, h, n in zip(rows, hashes, counts[np.searchsorted(every.value[0], hashes)].tolist(), strict=True):
        rarest[r.title] = min(rarest.get(r.title, (n, h)), (n, h))
    wanted: dict[np.uint64, list[str]] = {}
    for title, (n, h) in rarest.items():
        if n:  # without it no text has the title
            wanted.setdefault(h, []).append(title)
    if not wanted:
        return asked.join(long, F.lit(False)).select("title", "id")
    chosen = shared(np.array(sorted(wanted), np.uint64), [wanted[h] for h in sorted(wanted)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks, titles = chosen.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            met = {(t, i) for at, piece in _places(texts, sizes, known, marks) for i, p in zip(at.tolist(), piece.tolist(), strict=True) for t in titles[p] if t in texts[i]}
            found = sorted(met)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), batch.column("id").take(pa.array([i for _, i in found], pa.int64()))], ["title", "id"])

    return long.mapInArrow(find, f"title string, id {long.schema['id'].dataType.simpleString()}")


def _pieces(text: Column, size: Column) -> Column:
    """All distinct pieces of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """(title, id) for each distinct lower-case title of ``titles`` (title) and each of ``texts`` (id, text) that contains it, in any case.

    Null and empty titles are contained in nothing.
    """
    short = titles.select(F.lower("title").alias("title")).where("title <> ''").distinct()
    short = materialize(short.withColumn("size", F.least(F.length("title"), F.lit(GRAM))), "titles")
    sizes = [r[0] for r in short.select("size").distinct().collect()]  # GRAM different ones at most
    asked = materialize(short.select("title", "size", F.explode(_pieces(F.col("title"), F.col("size"))).alias("piece")), "asked")
    long = texts.select("id", F.lower("text").alias("text")).where("text is not null")
    if 0 < asked.count() <= ASKED:
        return _looked_up(asked, long)
    cut = [long.select("id", F.explode(_pieces(F.col("text"), F.lit(s))).alias("piece")) for s in sizes]
    if not cut:
        return short.join(long, F.lit(False)).select("title", "id")
    held = cut[0]
    for more in cut[1:]:
        held = held.union(more)
    held = materialize(held.join(asked.select("piece").distinct(), "piece", "left_semi"), "pieces")
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "piece", "left").fillna(0, ["n"]).groupBy("title").agg(F.min(F.struct("n", "piece")).alias("r"))
    meet = rarest.where("r.n > 0").select("title", F.col("r.piece").alias("piece")).join(held, "piece").select("title", "id")
    return meet.join(long, "id").where(F.contains("text", F.col("title"))).select("title", "id")


def best_by_title(records: DataFrame, found: DataFrame) -> DataFrame:
    """(title, id): for each lower-case title the record of ``found`` (id, title, citation_count) that contains it: the shortest, then the most cited, then the least id."""
    hits = contained(records, found.select("id", F.col("title").alias("text"))).join(found.select("id", F.length("title").alias("n"), "citation_count"), "id")
    return hits.groupBy("title").agg(F.min_by("id", F.struct("n", -F.coalesce("citation_count", F.lit(0)), "id")).alias("id"))


def enrich_by_title(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records without a DOI, filled from the record whose title contains theirs; own values and concepts stand first, records without a match stay.

    records and found have doi, title, year, venue, abstract, concepts; found has id and citation_count too.
    """
    best = best_by_title(records.where("doi is null"), found).select(F.col("title").alias("_title"), F.col("id").alias("_id"))
    joined = records.alias("r").join(best, F.col("r.doi").isNull() & (F.lower("r.title") == F.col("_title")), "left").join(found.alias("f"), F.col("f.id") == F.col("_id"), "left")
    same = [F.coalesce(f"r.{c}", f"f.{c}").alias(c) for c in ("doi", "title", "year", "venue", "abstract")]
    own, more = (F.coalesce(F.col(f"{x}.concepts"), F.array().cast("array<struct<name:string,score:double>>")) for x in ("r", "f"))
    return joined.select(*same, F.concat(own, more).alias("concepts"))
