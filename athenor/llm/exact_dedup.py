"""Exact duplicates by distributed MSD radix partitioning of the texts' bytes.

A text is its byte length (first digit) and then its bytes. Level by level the rows are split by the next digits: the
length with 32 bytes over all rows, of which singletons leave at once without moving their texts; then the rows still
open are merged inside each map task; then groups that are still large, in rows or in bytes, are split by eight times as many
bytes, until all are small or their texts have ended. Ended groups are equal and only summed, with sums combined before they move; each
small group is split to the end, byte strings against byte strings, in one task. No digest decides: ``text_sha256`` is only reported.

Texts are compared after each run of ``[\\x20\\x09-\\x0D]`` became one space; null counts as empty. The row with the
smallest doc_id stays, of repeated rows with one doc_id the first; null ids stay only if a group has no other. Row
numbers are made in one scan only; where a later step needs them too, they are written with the rows, under a name that no column
has. Other columns are kept as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.llm.common import whole_text

FIRST_DIGITS, LARGE_GROUP, LARGE_BYTES, BROADCAST_GROUPS, BROADCAST_IDS, BLOCK_BYTES = 32, 64, 32 << 20, 50_000, 500_000, 16 << 20
ROW = "_athenor_row"
OPEN = "row long, doc_id long, rep long, text_sha256 string, norm binary, n long, first_id long, first_row long"


def radix_classes(texts: list[bytes], members: list[int], at: int = 0, stride: int = 16) -> list[list[int]]:
    """Classes of equal texts among ``members``, which agree in their first ``at`` bytes; each level takes more bytes."""
    done, todo = [], [(members, at, stride)]
    while todo:
        group, at, stride = todo.pop()
        if len(group) == 1:
            done.append(group)
            continue
        split: dict[bytes, list[int]] = {}
        for i in group:
            split.setdefault(texts[i][at : at + stride], []).append(i)
        for digits, part in split.items():
            if len(digits) < stride:  # the texts have ended
                done.append(part)
            else:
                todo.append((part, at + stride, stride * 4))
    return done


def _least(items: Iterator[tuple]) -> tuple:
    """The smallest (id, row), null ids last."""
    return min(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _merge_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed rows pass; of open rows with one text in a block of BLOCK_BYTES the first stands for all and keeps the text."""

    def merged(rows: list[dict]) -> pa.RecordBatch:
        texts = [r["norm"] for r in rows]
        for part in radix_classes(texts, list(range(len(rows)))):
            head = rows[part[0]]
            first_id, first_row = _least((rows[i]["doc_id"], rows[i]["row"]) for i in part)
            for i in part:
                rows[i] |= {"rep": head["row"], "norm": None}
            head |= {"norm": texts[part[0]], "n": len(part), "first_id": first_id, "first_row": first_row}
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("text_sha256", pa.string()), ("norm", pa.binary()), ("n", pa.int64()), ("first_id", pa.int64()), ("first_row", pa.int64())])
    held, size = [], 0
    for batch in batches:
        is_open = batch.column("norm").is_valid()
        closed = batch.filter(pa.compute.invert(is_open))
        if closed.num_rows:
            empty = {name: pa.nulls(closed.num_rows, schema.field(name).type) for name in ("rep", "norm", "n", "first_id", "first_row")}
            yield pa.RecordBatch.from_arrays([closed.column(c) if c not in empty else empty[c] for c in schema.names], schema=schema)
        for row in batch.filter(is_open).to_pylist():
            held.append(row | {"rep": None, "n": None, "first_id": None, "first_row": None})
            size += len(row["norm"]) + 200
            if size > BLOCK_BYTES:
                yield merged(held)
                held, size = [], 0
    if held:
        yield merged(held)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group: (rep, keep_id, keep_row, group_size) for each."""

    def classes(rows: list[dict]) -> Iterator[tuple]:
        texts = [r["norm"] for r in rows]
        for part in radix_classes(texts, list(range(len(rows)))):
            keep_id, keep_row = _least((rows[i]["first_id"], rows[i]["first_row"]) for i in part)
            size = sum(rows[i]["n"] for i in part)
            for i in part:
                yield rows[i]["rep"], keep_id, keep_row, size

    held, key = [], None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (now := (row["size"], row["digits"])) != key:
                out += classes(held)
                held, key = [], now
            held.append(row)
        if out:
            yield _columns(out)
    if held:
        yield _columns(list(classes(held)))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["rep", "keep_id", "keep_row", "group_size"])


def _split_large(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds ``size`` and ``digits``: rows of small groups, and rows of large ones whose digits are their whole texts.

    Each round splits what is still large by eight times as many bytes, and takes up no row of a group that is done.
    """
    key, take, small = ["size", "digits"], FIRST_DIGITS, []
    rest = reps.withColumn("size", F.octet_length("norm")).withColumn("digits", F.expr(f"substring(norm, 1, {take})"))
    ended = rest.limit(0)
    while True:
        large = rest.groupBy(*key).agg(F.count("*").alias("rows")).where((F.col("rows") > LARGE_GROUP) | ((F.col("rows") > 1) & (F.col("rows") * F.col("size") > LARGE_BYTES)))
        large = materialize(large.select(*key), "large")
        groups = large.count()
        if not groups:
            break
        if groups <= BROADCAST_GROUPS and groups * take <= LARGE_BYTES:
            large = F.broadcast(large)
        small.append(rest.join(large, key, "left_anti"))
        found = materialize(rest.join(large, key, "left_semi"), "split")
        ended = ended.unionByName(found.where(F.col("size") <= take))
        take *= 8
        rest = found.where(F.col("size") > take // 8).withColumn("digits", F.expr(f"substring(norm, 1, {take})"))
    for part in small:
        rest = rest.unionByName(part)
    return rest, ended


def _resolved(reps: DataFrame) -> DataFrame:
    """rep, keep_id, keep_row, group_size: groups whose digits are their whole texts are equal and only summed; small ones are split on."""
    rest, whole = _split_large(reps)
    least = F.min(F.struct(F.col("first_id").isNull(), "first_id", "first_row")).alias("best")
    sums = materialize(whole.groupBy("size", "digits").agg(least, F.sum("n").alias("group_size")), "ended")
    if (sums.agg(F.sum("size")).first()[0] or 0) <= LARGE_BYTES:
        sums = F.broadcast(sums)
    ended = whole.select("rep", "size", "digits").join(sums, ["size", "digits"])
    split = (
        rest.select("rep", "n", "first_id", "first_row", "norm", "size", "digits")
        .repartition("size", "digits")
        .sortWithinPartitions("size", "digits")
        .mapInArrow(_resolve, "rep long, keep_id long, keep_row long, group_size long")
    )
    return split.unionByName(ended.select("rep", F.col("best.first_id").alias("keep_id"), F.col("best.first_row").alias("keep_row"), "group_size"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written once with a number for each row in a last column, so that all later scans agree however they are split."""
    name, taken = ROW, {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def find_copies(docs: DataFrame, number: str | None = None) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 for each row; ``row`` is the column ``number``, without one any unique number."""
    row = F.monotonically_increasing_id() if number is None else F.col(number)
    texts = whole_text(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "row", "doc_id")
    texts = texts.select("row", "doc_id", F.encode(F.regexp_replace("text", r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "), "UTF-8").alias("norm"))
    texts = texts.select("*", F.octet_length("norm").alias("size"), F.substring("norm", 1, FIRST_DIGITS).alias("digits"))
    groups = texts.groupBy("size", "digits").count().where("count > 1").select("size", "digits", F.lit(True).alias("open"))
    groups = materialize(groups, "groups")
    if groups.count() <= BROADCAST_GROUPS:  # at most 44 bytes each
        groups = F.broadcast(groups)
    marked = texts.join(groups, ["size", "digits"], "left").select("row", "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("open"), F.col("norm")).alias("norm"))
    rows = materialize(marked.mapInArrow(_merge_in_task, OPEN), "open")
    resolved = _resolved(rows.where("norm is not null").select("rep", "n", "first_id", "first_row", "norm"))
    joined = rows.select("row", "doc_id", "rep", "text_sha256").join(resolved, "rep", "left")
    alone = F.col("rep").isNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    return find_copies(docs).drop("row")


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The ``numbered`` rows whose number is not in ``dropped(row)``, broadcast only up to BROADCAST_IDS; the number goes."""
    *columns, number = docs.columns
    dropped = materialize(dropped.select(F.col("row").alias(number)), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, number, "left_anti").select(*(f"`{c}`" for c in columns))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay."""
    docs = numbered(docs)
    return without_rows(docs, find_copies(docs, docs.columns[-1]).where(~F.col("kept")))
