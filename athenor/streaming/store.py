"""A growing store of records that is merged on read.

Keys are hashed into a fixed number of buckets, which are the folders of the store's files. A batch is one delta: its own records, merged among
themselves, in the buckets that they fall into, so that it writes in proportion to its own size. A batch that is run again replaces its own
delta and changes nothing else. Compaction merges the deltas into a new base, of those buckets only that have deltas.

``log`` says which deltas and bases are complete; a write that failed half-way is not in it and is never read. Readers see, for each bucket, its last
complete base and the later deltas. One stream (or one job at a time) writes to a store.

Merging (``Rules``): values that are filled stay, the largest of some columns wins, and the columns that tell how a record was found come from
the row of least depth, of equal depths from the earliest. Within one batch rows are ordered by ``sequence`` and then by a hash of the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

LOG = "kind string, number long, buckets array<int>"
NUMBER, BUCKET = "_number", "_bucket"


@dataclass(frozen=True)
class Rules:
    """How records with one key become one."""

    key: str
    largest: tuple[str, ...] = ("citation_count",)
    depth: str | None = None
    found: tuple[str, ...] = ()
    sequence: str | None = None

    def merge(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """One row for each key of ``rows``, which have a batch number; null keys go. The number becomes the key's first."""
        rest = [c for c in columns if c != self.key]
        later = [F.col(self.sequence)] if self.sequence else []
        order = F.struct(F.col(NUMBER), *later, F.xxhash64(*columns))
        near = F.struct(F.col(self.depth), order) if self.depth else None

        def one(c: str) -> Column:
            if c in self.largest:
                return F.max(c)
            if c == self.depth:
                return F.min(c)
            if c in self.found and near is not None:  # rows without a depth count only among themselves
                deep = F.col(self.depth).isNotNull()
                return F.when(F.count(self.depth) > 0, F.min_by(c, F.when(deep, near))).otherwise(F.min_by(c, F.when(F.col(c).isNotNull(), order)))
            return F.min_by(c, F.when(F.col(c).isNotNull(), order))

        merged = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*(one(c).alias(c) for c in rest), F.min(NUMBER).alias(NUMBER))
        return merged.select(*columns, NUMBER)


class Store:
    """Records of ``schema`` below ``path``, of which ``rules.key`` is the key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, rules: Rules, buckets: int = 64) -> None:
        self.spark, self.path, self.rules, self.buckets = spark, path.rstrip("/"), rules, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _log(self) -> list:
        """The entries of the log: one for each batch and each compaction since the log was last rewritten."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _done(self, kind: str, number: int, buckets: list[int]) -> None:
        self.spark.createDataFrame([(kind, number, buckets)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, rows: DataFrame, kind: str, number: int) -> list[int]:
        """Rows in their buckets, one file for each; the buckets that got any."""
        folder = f"{self.path}/{kind}/at={number}"
        rows.withColumn(BUCKET, self._bucket(F.col(self.rules.key))).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        try:
            return sorted(r[0] for r in self.spark.read.parquet(folder).select(BUCKET).distinct().collect())
        except AnalysisException:  # no row, no file, no schema
            return []

    def _rows(self, kind: str) -> DataFrame:
        layout = StructType([*self.schema.fields]).add(NUMBER, LongType()).add("at", LongType()).add(BUCKET, IntegerType())
        return self.spark.read.schema(layout).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")

    def append(self, batch: DataFrame, number: int) -> None:
        """Adds batch ``number``; run again, it takes its own place."""
        rows = self.rules.merge(batch.select(*self.columns).withColumn(NUMBER, F.lit(number).cast("long")), self.columns)
        self._done("delta", number, self._write(rows, "delta", number))

    def _bases(self, log: list) -> dict[int, int]:
        """The last base of each bucket; -1 where there is none."""
        held = dict.fromkeys(range(self.buckets), -1)
        for entry in log:
            if entry.kind == "base":
                for b in entry.buckets:
                    held[b] = max(held[b], entry.number)
        return held

    def _visible(self, log: list, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the last bases and of the later deltas, both chosen by folder, so that no other file is read."""
        base = self._bases(log)
        wanted = range(self.buckets) if buckets is None else buckets
        since = F.element_at(F.array(*(F.lit(base[b]).cast("long") for b in range(self.buckets))), F.col(BUCKET) + 1)
        complete = [e.number for e in log if e.kind == "delta"]
        parts = []
        if any(n >= 0 for n in base.values()):
            parts.append(self._rows("base").where((F.col("at") == since) & F.col(BUCKET).isin(*wanted)))
        if open_ := sorted({n for n in complete if n > min(base[b] for b in wanted)} if wanted else []):
            parts.append(self._rows("delta").where(F.col("at").isin(*open_) & (F.col("at") > since) & F.col(BUCKET).isin(*wanted)))
        if not parts:
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add(NUMBER, LongType()))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.select(*self.columns, NUMBER)

    def read(self) -> DataFrame:
        """All records, one for each key."""
        return self.rules.merge(self._visible(self._log()), self.columns).select(*self.columns)

    def lookup(self, keys: list) -> DataFrame:
        """The records of a few keys; only the folders of their buckets are read."""
        kind = self.schema[self.rules.key].dataType
        found = self.spark.createDataFrame([(k,) for k in keys], StructType().add("k", kind)).select(self._bucket(F.col("k"))).distinct().collect()
        rows = self._visible(self._log(), [r[0] for r in found]).where(F.col(self.rules.key).isin(*keys))
        return self.rules.merge(rows, self.columns).select(*self.columns)

    def compact(self) -> list[int]:
        """Merges deltas into the bases of the buckets that have some; these buckets."""
        log = self._log()
        base = self._bases(log)
        deltas = [e for e in log if e.kind == "delta"]
        touched = sorted({b for e in deltas for b in e.buckets if e.number > base[b]})
        if touched:
            upto = max(e.number for e in deltas)
            self._write(self.rules.merge(self._visible(log, touched), self.columns), "base", upto)
            self._done("base", upto, touched)
        return touched


def grow(stream: DataFrame, store: Store, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Adds each micro-batch to the store, and compacts it now and then."""

    def add(batch: DataFrame, number: int) -> None:
        store.append(batch, number)
        if (number + 1) % compact_every == 0:
            store.compact()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
