"""Exact and near duplicates against brute force."""

import collections
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from athenor.llm import exact_dedup, near_dedup
from athenor.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import clashing, empty, hard, written
from tests.oracle import both


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i is None, i or 0, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


def check_exact(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    want = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_on_hard_rows(spark, tmp_path):
    docs = written(spark, hard(spark), tmp_path)
    check_exact(docs)
    kept = exact_dedup.keep_first_copies(docs)
    assert clashing(kept.collect())
    assert kept.columns == docs.columns and kept.count() == len(set(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()))


def test_exact_on_no_rows(spark, tmp_path):
    docs = written(spark, empty(spark), tmp_path)
    assert exact_dedup.exact_dedup(docs).count() == 0 == exact_dedup.keep_first_copies(docs).count()


def test_exact_splits_large_groups_by_more_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", 3)
    monkeypatch.setattr(exact_dedup, "LARGE_BYTES", 1_000)
    monkeypatch.setattr(exact_dedup, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", 0)
    texts = ["same start of all texts, over thirty-two bytes " + f"{i % 9:02d}" + " and more" * 40 + f"{i % 7}" for i in range(200)] + ["copy"] * 100
    docs = written(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), tmp_path)
    check_exact(docs)
    assert exact_dedup.keep_first_copies(docs).count() == len(set(texts))


def test_exact_query_equals_sql(spark):
    left, right = both(spark, "/root/testdata/sf0.001", QUERIES["op8_exact_dedup"], ORACLES["op8_exact_dedup"])
    assert left == right


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=30))
def test_radix_classes_are_the_classes_of_equality(texts):
    data = [t.encode() for t in texts]
    got = sorted(sorted(c) for c in exact_dedup.radix_classes(data, list(range(len(data))), stride=2))
    want = collections.defaultdict(list)
    for i, t in enumerate(data):
        want[t].append(i)
    assert got == sorted(want.values())


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both_ = len(sets[a] & sets[b])
            if both_ and 100 * both_ >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def edited(seed=3, n=120):
    """Copies of a few texts with more and more words changed, so that links stand on both sides of the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3_000)]
    out = []
    for base in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(n // 6):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def as_rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_near_against_brute_force(spark, tmp_path):
    rows = list(enumerate(edited()))
    docs = written(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tmp_path)
    got = near_dedup.near_dedup(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute_near(rows))
    kept = near_dedup.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_near(rows)})


def test_near_in_blocks_and_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(near_dedup, "HUB_KEYS", 1_000)  # no hubs: all links come from the buckets
    rows = list(enumerate(edited(5, 60)))
    docs = written(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect()) == sorted(brute_near(rows))


def test_near_on_hard_rows(spark, tmp_path):
    docs = written(spark, hard(spark), tmp_path)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i is None, i or 0, n, c) for i, n, c in brute_near(rows)), key=str)
    assert as_rows(near_dedup.near_dedup(docs)) == want
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and clashing(kept.collect())
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_near_on_no_rows(spark, tmp_path):
    docs = written(spark, empty(spark), tmp_path)
    assert near_dedup.near_dedup(docs).count() == 0 == near_dedup.keep_one_of_each(docs).count()


def test_every_signature_within_the_distance_shares_a_key():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 1 << 16, near_dedup.MINIMA).astype("<u2")
        b = a.copy()
        b[rng.permutation(near_dedup.MINIMA)[: near_dedup.DISTANCE]] ^= 1
        rest = bytes((near_dedup.FINE - near_dedup.MINIMA) // 2)
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes() + rest, b.tobytes() + rest], pa.binary())], names=["id", "signature"])
        keys = next(iter(near_dedup._keys([batch]))).to_pydict()
        own = [{k for k, i in zip(keys["key"], keys["id"], strict=True) if i == x} for x in (1, 2)]
        assert own[0] & own[1]


def test_rows_that_come_in_another_order_at_every_read(spark):
    def turn(batches):
        import os
        import random

        for batch in batches:
            yield batch.take(random.Random(os.urandom(8)).sample(range(batch.num_rows), batch.num_rows))

    texts = edited(seed=5)
    rows = list(enumerate([*texts, *texts[:30]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(turn, "doc_id long, text string")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert sorted(r.doc_id for r in exact_dedup.keep_first_copies(docs).collect()) == sorted(first.values())
    want = {i: c for i, _, c in brute_near(rows)}
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()} == want
    assert sorted(r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()) == sorted(set(want.values()))
