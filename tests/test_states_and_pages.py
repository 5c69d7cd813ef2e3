"""Timers and states that come and go; pages, cursors and offsets of a service."""

import datetime
import json
import os

import pytest

from athenor.sources.paged import PagedSource
from athenor.streaming import keyed_state
from tests.service import FOLDER


@pytest.fixture
def rocks(spark):
    keyed_state.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def batches(spark, folder, files, schema):
    """A stream that reads one file in each micro-batch, in order, with a watermark of no delay."""
    for k, rows in enumerate(files):
        made = spark.createDataFrame([(key, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), v) for key, t, v in rows], schema)
        made.coalesce(1).write.parquet(str(folder / f"{k}"))
        os.makedirs(folder / "all", exist_ok=True)
        (part,) = (folder / f"{k}").glob("*.parquet")
        os.rename(part, folder / "all" / f"{k}.parquet")
        os.utime(folder / "all" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "all")).withWatermark("t", "0 seconds")


def run(spark, df, folder, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def test_circuits_open_half_open_close_and_are_forgotten(rocks, tmp_path):
    files = [
        [("s", t, False) for t in (0, 1, 2)] + [("fine", 0, True)],  # s opens at 2
        [("s", 5, True), ("other", 5, True)],  # not made: open
        [("other", 40, True)],  # the watermark passes 2 + 30 for the next batch,
        [("other", 41, True)],  # in which the timer half opens
        [("s", 45, False)],  # the trial fails: open again
        [("other", 60, True)],
        [("s", 90, True)],  # after the pause: half open by the call, closed by its success
        [("other", 1000, True)],  # s and fine have been silent for 500 seconds
        [("other", 1001, True)],
    ]
    stream = batches(rocks, tmp_path, files, "service string, t timestamp, ok boolean")
    got = run(rocks, keyed_state.circuit_breaker(stream, "service", "t", "ok", failures=3, pause=30, forget=500), tmp_path, "circuits")
    base = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp())
    states = [(r.at - base, r.state, r.failures) for r in got if r.service == "s"]
    assert [s[1] for s in states] == ["open", "half_open", "open", "half_open", "closed", "forgotten"]
    assert states[0] == (2, "open", 3) and states[1][0] == 32 and states[2] == (45, "open", 4) and states[4] == (90, "closed", 0) and states[5][0] == 590
    assert [r.state for r in got if r.service == "fine"] == ["forgotten"]


def test_drift_is_watched_over_a_window_and_forgotten(rocks, tmp_path):
    files = [[("a", t, 0.9) for t in range(3)], [("a", 10 + t, 0.0) for t in range(4)], [("b", 700, None)], [("b", 2000, 0.5)]]
    stream = batches(rocks, tmp_path, files, "topic string, t timestamp, r double")
    got = run(rocks, keyed_state.drift_monitor(stream, "topic", "t", "r", window=5, least=0.15, kill=0.3, forget=600), tmp_path, "drifts")
    a = [(r.seen, r.share, r.stop) for r in got if r.topic == "a"]
    assert a == [(3, 1.0, False), (7, 0.2, True), (0, None, False)]
    assert [r.seen for r in got if r.topic == "b"] == [1, 2]  # its timer stood at 1300, the watermark at 700


WORKS = [{"id": f"W{k}", "title": ("Graph learning " if k % 2 else "Cell biology ") + str(k), "year": 1995 + k % 8, "cited": (k * 37) % 101} for k in range(60)]


@pytest.fixture
def service(spark):
    os.makedirs(FOLDER, exist_ok=True)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)

    def put(works):
        with open(f"{FOLDER}/works.json", "w") as file:
            json.dump(works, file)
        open(f"{FOLDER}/requests", "w").close()

    put(WORKS)
    return put


def requests():
    with open(f"{FOLDER}/requests") as file:
        return [json.loads(line) for line in file]


def options(spark, **more):
    r = spark.read.format("paged").option("client", "tests.service:client")
    for k, v in more.items():
        r = r.option(k, v)
    return r


def test_search_is_sorted_and_limited_by_the_service(spark, service):
    df = options(spark, search="graph", sort="cited_by_count:desc", limit="12", per_page="5").load()
    wanted = [w["id"] for w in sorted((w for w in WORKS if w["id"][1:] and int(w["id"][1:]) % 2), key=lambda w: -w["cited"])[:12]]
    assert sorted(r.id for r in df.collect()) == sorted(wanted)
    pages = [r for r in requests() if r["per_page"] == 5]
    assert sorted(r["page"] for r in pages) == [1, 2, 3] and all(r["search"] == "graph" and r["sort"] == "cited_by_count:desc" for r in pages)
    first = sorted(map(tuple, df.collect()))
    assert first == sorted(map(tuple, df.collect()))


def test_filters_go_along_and_cursors_are_followed_by_year(spark, service):
    df = options(spark, years="1990-2010", per_page="3").load().where("year >= 1996 and year <= 1998 and citation_count > 10")
    assert {r.id for r in df.collect()} == {w["id"] for w in WORKS if 1996 <= w["year"] <= 1998 and w["cited"] > 10}
    sent = requests()
    assert {(r["year_min"], r["year_max"]) for r in sent} == {(y, y) for y in (1996, 1997, 1998)}
    assert [r["cursor"] for r in sent if r["year_min"] == 1996] == ["*", "3", "6"]
    got = options(spark, per_page="50").load().where("id = 'W7'").collect()
    assert [r.id for r in got] == ["W7"]
    assert options(spark, search="nothing of this kind").load().collect() == []


def test_new_works_stream_in_by_offset(spark, service, tmp_path):
    service(WORKS[:7])
    seen = []
    for n in (7, 7, 25):
        service(WORKS[:n])
        q = spark.readStream.format("paged").option("client", "tests.service:client").option("per_page", "4").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert seen == sorted(w["id"] for w in WORKS[:n])
