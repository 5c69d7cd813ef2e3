"""The store that is merged on read, and the keyed table, against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from athenor.sinks import keyed
from athenor.streaming.store import Rules, Store, grow

SCHEMA = "id string, doi string, citation_count long, depth int, found_from string, n long"
RULES = Rules("id", largest=("citation_count",), depth="depth", found=("found_from",), sequence="n")


def made(rng, n, start):
    maybe = lambda v: rng.choice([v, None])
    return [(f"p{rng.randrange(40)}", maybe(f"10.1/{rng.randrange(9)}"), maybe(rng.randrange(100)), maybe(rng.randrange(4)), maybe(f"f{rng.randrange(9)}"), start + i) for i in range(n)] + [(None, "x", 1, 0, "f", start)]


def plain(batches):
    out = {}
    for batch in batches:
        for key, doi, cites, depth, found, n in sorted((r for r in batch if r[0] is not None), key=lambda r: r[5]):
            old = out.setdefault(key, [doi, cites, depth, found, n])
            if old[0] is None:
                old[0] = doi
            if cites is not None and (old[1] is None or cites > old[1]):
                old[1] = cites
            if depth is not None and (old[2] is None or depth < old[2]):
                old[2], old[3] = depth, found
            elif old[2] is None and old[3] is None:
                old[3] = found
    return sorted((k, *v) for k, v in out.items())


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_store_equals_a_full_merge_whatever_is_compacted(spark, tmp_path):
    rng = random.Random(2)
    batches = [made(rng, n, 1000 * k) for k, n in enumerate((30, 5, 0, 60, 3, 8))]
    store = Store(spark, str(tmp_path / "s"), SCHEMA, RULES, buckets=8)
    assert store.read().collect() == []
    for k, batch in enumerate(batches):
        store.append(spark.createDataFrame(batch, SCHEMA).repartition(3), k)
        assert rows(store.read()) == plain(batches[: k + 1])
        if k in (1, 3):
            assert store.compact()
            assert rows(store.read()) == plain(batches[: k + 1])
    assert store.compact() and store.compact() == []
    assert rows(store.read()) == plain(batches)
    wanted = ["p1", "p7", "nobody"]
    assert rows(store.lookup(wanted)) == [r for r in plain(batches) if r[0] in wanted]


def test_a_batch_run_again_takes_its_own_place(spark, tmp_path):
    rng = random.Random(4)
    batches = [made(rng, 20, 1000 * k) for k in range(3)]
    store = Store(spark, str(tmp_path / "s"), SCHEMA, RULES, buckets=4)
    for k in (0, 1, 1, 2, 2):
        store.append(spark.createDataFrame(batches[k], SCHEMA).repartition(1 + k), k)
    assert rows(store.read()) == plain(batches)


def test_a_batch_writes_only_its_own_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, RULES, buckets=8)
    store.append(spark.range(5_000).select(F.concat(F.lit("q"), "id").alias("id"), F.lit(None).cast("string").alias("doi"), F.col("id").alias("citation_count"), F.lit(1).alias("depth"), F.lit("f").alias("found_from"), F.col("id").alias("n")), 0)
    store.compact()
    before = files(tmp_path / "s")
    store.append(spark.createDataFrame([("q7", "10.1/x", 1, 0, "g", 1)], SCHEMA), 1)
    after = files(tmp_path / "s")
    assert {f: t for f, t in after.items() if f in before} == before
    new = [f for f in after if f not in before]
    assert len(new) == 2 and sum(os.path.getsize(f) for f in new) < 10_000  # one delta, one line of the log
    assert rows(store.lookup(["q7"])) == [("q7", "10.1/x", 7, 0, "g", 7)]
    touched = store.compact()
    assert len(touched) == 1 and {f: t for f, t in files(tmp_path / "s").items() if f in before} == before


def test_a_lookup_reads_the_folders_of_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, RULES, buckets=8)
    store.append(spark.createDataFrame(made(random.Random(1), 200, 0), SCHEMA), 0)
    store.compact()
    read = {f.rsplit("_bucket=", 1)[1].split("/")[0] for f in store._visible(store._log(), [3]).inputFiles()}
    assert read <= {str(b) for b in range(8)}
    plan = store._visible(store._log(), [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_what_a_failed_batch_left_is_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, RULES, buckets=2)
    first = made(random.Random(3), 10, 0)
    store.append(spark.createDataFrame(first, SCHEMA), 0)
    store._write(RULES.merge(spark.createDataFrame(made(random.Random(5), 10, 9_000), SCHEMA).withColumn("_number", F.lit(1)), store.columns), "delta", 1)  # written, but the driver died before the log
    assert rows(store.read()) == plain([first])


def test_a_stream_grows_the_store(spark, tmp_path):
    rng = random.Random(8)
    batches = [made(rng, 15, 1000 * k) for k in range(5)]
    store = Store(spark, str(tmp_path / "s"), SCHEMA, RULES, buckets=4)
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        grow(stream, store, str(tmp_path / "cp"), compact_every=2).awaitTermination()
        assert rows(store.read()) == plain(batches[: k + 1])
    assert {e.kind for e in store._log()} == {"delta", "base"}


def test_keyed_table_inserts_and_replaces(spark, tmp_path):
    path, schema = str(tmp_path / "k"), "id int, depth int, how string"
    assert keyed.read(spark, path, "id") is None
    state = {}
    commits = [("insert", [(1, 2, "a"), (1, 1, "b"), (2, None, "c"), (None, 0, "n")]), ("insert", [(1, 0, "late"), (3, 1, "d")]), ("replace", [(2, 5, "e"), (2, 4, "f")]), ("insert", [(2, 0, "no"), (4, 0, "g")]), ("replace", [(4, None, "h")])]
    for kind, new in commits:
        keyed.append(spark.createDataFrame(new, schema).repartition(2), path, kind)
        best = {}
        for r in sorted((r for r in new if r[0] is not None), key=lambda r: (r[1] is None, r[1] or 0)):
            best.setdefault(r[0], r)
        state = {**state, **best} if kind == "replace" else {**best, **state}
        assert rows(keyed.read(spark, path, "id", "depth").fillna(-1)) == sorted((a, -1 if b is None else b, c) for a, b, c in state.values())
    assert [m["rows"] for m in keyed._manifests(path)] == [4, 2, 2, 2, 1]


def test_failed_tasks_leave_no_rows(spark, tmp_path):
    path = str(tmp_path / "k")
    keyed.append(spark.createDataFrame([(1, "a")], "id int, v string"), path, "insert")
    broken = spark.range(100, numPartitions=4).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise("b").alias("v"))
    with pytest.raises(Exception, match="stop"):
        keyed.append(broken, path, "replace")
    assert rows(keyed.read(spark, path, "id")) == [(1, "a")] and len(keyed._manifests(path)) == 1
    keyed.append(spark.createDataFrame([(1, "c")], "id int, v string"), path, "replace")
    assert rows(keyed.read(spark, path, "id")) == [(1, "c")]
    with pytest.raises(Exception, match="appended"):
        spark.createDataFrame([(1, "c")], "id int, v string").write.format("keyed").option("path", path).mode("overwrite").save()
