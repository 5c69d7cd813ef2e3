"""A growing store of papers as a stream: new records are merged batch by batch, and a monitor watches for drift off topic."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from athenor.params import DEFAULT


def merge_records(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One record for each key: known values stay where they are filled, citations take the larger number."""
    both = known.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in known.columns if c != key]
    first = [F.max(c).alias(c) if c == "citation_count" else F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in rest]
    return both.groupBy(key).agg(*first).select(known.columns)


def grow(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Writes each batch's merged store as a new generation below ``path``; a batch that is run again gives the same generation."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            merged = batch.dropDuplicates([key])
        else:
            merged = merge_records(spark.read.parquet(f"{path}/generation={number - 1}"), batch, key)
        merged.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_only(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Insert if absent: the first record of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counted_duplicates(batch: DataFrame, key: str, name: str = "pool") -> DataFrame:
    """``batch`` with the metrics rows and filled keys under ``name``, which a listener or an Observation reads; with distinct keys after it their difference is the duplicates."""
    return batch.observe(name, F.count("*").alias("rows"), F.count(key).alias("keys"))


def circuit_breaker(stream: DataFrame, by: str, sequence: str, succeeded: str, failures: int = 5, pause: int = 60) -> DataFrame:
    """(by, state, failures, opened_at) after each batch of calls(by, sequence in seconds, succeeded).

    ``failures`` in a row open the circuit; ``pause`` seconds later the next call is a trial: its success closes the circuit, its
    failure opens it again. The state of a service is three numbers.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, run, opened = state.get if state.exists else ("closed", 0, 0)
        calls = sorted(call for rows in batches for call in zip(rows[sequence].tolist(), rows[succeeded].tolist(), strict=True))
        for at, fine in calls:
            if kind == "open":
                if at - opened < pause:
                    continue  # such a call is not made
                kind = "half_open"
            if fine:
                kind, run = "closed", 0
            else:
                run += 1
                if kind == "half_open" or run >= failures:
                    kind, opened = "open", int(at)
        state.update((kind, run, opened))
        yield pd.DataFrame({by: [key[0]], "state": [kind], "failures": [run], "opened_at": [opened]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).applyInPandasWithState(watch, f"{by} {kind}, state string, failures bigint, opened_at bigint", "state string, failures bigint, opened_at bigint", "update", GroupStateTimeout.NoTimeout)


def drift_monitor(stream: DataFrame, by: str, sequence: str, relevance: str, window: int = DEFAULT.drift_window, least: float = DEFAULT.min_bucket_relevance, kill: float = DEFAULT.drift_kill) -> DataFrame:
    """(by, seen, share, stop) after each batch: share of the last ``window`` records at or over ``least``; the state is that window."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(sequence)
        last = (last + [float(x) for x in rows[relevance].fillna(0.0)])[-window:]
        seen += len(rows)
        state.update((seen, last))
        share = sum(x >= least for x in last) / len(last)
        yield pd.DataFrame({by: [key[0]], "seen": [seen], "share": [share], "stop": [len(last) >= window and share < kill]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).applyInPandasWithState(watch, f"{by} {kind}, seen bigint, share double, stop boolean", "seen bigint, last array<double>", "update", GroupStateTimeout.NoTimeout)
