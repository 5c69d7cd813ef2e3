"""What several corpus operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Memos of words keep none longer than this, so that a bound on their number bounds their bytes too; longer ones are worked out each time.
WORD = 48


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def whole_text(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``text`` with null read as the empty text; all other columns go."""
    return df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, max_chars: int) -> DataFrame:
    """At most ``rows`` labelled (text, y) rows for fitting.

    Rows come in the order of a hash of their id, from ids whose crc32 modulo ``modulus`` is not ``held``; of texts over
    ``max_chars`` characters none is taken, so the sample is bounded in bytes too. Scoring never uses this bound.
    """
    picked = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_of_id() % modulus != held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = whole_text(docs, "doc_id").where(F.length("text") <= max_chars)
    # picked has at most ``rows`` rows of two numbers, so its broadcast is bounded
    return texts.join(F.broadcast(picked), "doc_id").select("text", "y").orderBy(F.xxhash64("text"), "y").limit(rows)


def fit_in_task(sample: DataFrame, fit: Callable[[list[str], np.ndarray], Any]) -> Any:
    """``fit(texts, y)`` of a bounded ``labelled_sample``, run in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(y, np.int64)))], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(found[0])) if found else fit([], np.zeros(0, np.int64))


def parts(batch: pa.RecordBatch, column: str | int = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that only one slice at a time becomes Python strings."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    which = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def filter_rows(docs: DataFrame, keep: Callable[[], Callable[[list[str]], Any]]) -> DataFrame:
    """The rows of ``docs``, all columns, that ``keep()(texts)`` marks, a slice at a time; null texts are given as empty ones.

    ``keep`` is called once in each task. Columns go by their place, so that names with dots or quotes do no harm.
    """
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = keep()
        for batch in (p for b in batches for p in parts(b, at)):
            yield batch.filter(pa.array(marks([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
