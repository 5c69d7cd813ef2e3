"""Near-duplicates by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

A document's set is its distinct word 5-shingles (the whole sequence as one with fewer words). Its signature is 64 b-bit
minima (b = 16); their Hamming distance counts the minima that differ. The signature is split into 16 chunks of 4 minima.
If two signatures differ in at most 31 places, then by pigeonhole some chunk has at most one error; so each signature is filed under
every chunk with each one of its minima left out, and all pairs within distance 31 meet under some key. Two sets of Jaccard
similarity 0.75 are further apart with probability below 2e-5, less above it. Pairs that meet must also be within distance
162 over 512 minima (448 more, of 4 bits), which such sets exceed with probability below 2e-5.

No bucket is expanded into pairs. First each signature is compared with one hub, a member of its buckets that shares keys with many:
confirmed links join almost all copies. Then only buckets that still hold more than one component are compared,
in blocks of bounded size, and of each pair of different components only the bucket of its first common key hands it on, if the
sizes and the exact distances to a common hub (Jaccard distance is a metric) leave a link possible.

Shingles are 64-bit hashes; sets with one 128-bit sum of hashes and one size count as equal. Null or blank texts have no
set and link with nothing. Repeated rows and equal sets fall into one class; null ids never name a component. Other columns are kept as
they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.iterative.components import components
from athenor.llm.common import WORD, whole_text
from athenor.llm.exact_dedup import BROADCAST_IDS, numbered, without_rows

WORDS, MINIMA, CHUNK = 5, 64, 4
CHUNKS = MINIMA // CHUNK
DISTANCE = 2 * CHUNKS - 1
FINE, FINE_DISTANCE = 512, 162
SIMILAR = 75
HUB_KEYS, BLOCK, MEMO, PAIRS = 8, 1_024, 150_000, 64
SIGNED = "row long, doc_id long, n_shingles long, high long, low long, signature binary"

_rng = np.random.default_rng(20_240_501)
_POSITION = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**32, FINE, dtype=np.uint32)
_FACTOR = _rng.integers(0, 2**31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class WordHash(dict):
    """64-bit hash of a word; words met before are kept up to a bound in number and in length."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO and len(word) <= WORD:
            self[word] = value
        return value


def shingles(text: str, words: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    got = text.encode("utf-8", "replace").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, got), np.uint64, len(got))
    n = max(len(w) - WORDS + 1, 1)
    code = np.zeros(n, np.uint64) + np.uint64(min(len(w), WORDS))
    for k in range(min(WORDS, len(w))):
        code += w[k : k + n] * _POSITION[k]
    return np.unique(_mix(code))


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """MINIMA 16-bit and FINE - MINIMA 4-bit minima of each non-empty set."""
    flat = np.concatenate(sets).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least, work = np.empty((len(sets), FINE), np.uint32), np.empty_like(flat)
    for k in range(FINE):
        np.bitwise_xor(flat, _SALT[k], out=work)
        np.multiply(work, _FACTOR[k], out=work)
        least[:, k] = np.minimum.reduceat(work, starts)
    coarse, fine = least[:, :MINIMA].astype("<u2"), (least[:, MINIMA:] & np.uint32(15)).astype(np.uint8)
    fine = fine[:, 0::2] << 4 | fine[:, 1::2]
    return [a.tobytes() + b.tobytes() for a, b in zip(coarse, fine, strict=True)]


def minima(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each signature."""
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    return np.ascontiguousarray(raw[:, : 2 * MINIMA]).view("<u2"), raw[:, 2 * MINIMA :]


def sign(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, the set's 128-bit sum and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            texts, done = batch.column(2), 0
            while done < len(texts):
                sets, size, start = [], 0, done
                while done < len(texts) and size < 400_000:
                    sets.append(shingles(texts[done].as_py(), words))
                    size += len(sets[-1])
                    done += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                high, low = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                data: list[bytes | None] = [None] * len(sets)
                if full:
                    some = [sets[i] for i in full]
                    flat, starts = np.concatenate(some), np.cumsum([0] + [len(s) for s in some[:-1]])
                    high[full] = np.add.reduceat(_mix(flat, 11), starts).view(np.int64)
                    low[full] = np.add.reduceat(_mix(flat, 23), starts).view(np.int64)
                    for i, s in zip(full, signatures(some), strict=True):
                        data[i] = s
                part = batch.slice(start, done - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(high), pa.array(low), pa.array(data, pa.binary())],
                    names=["row", "doc_id", "n_shingles", "high", "low", "signature"],
                )

    return _rows(docs).mapInArrow(run, SIGNED)


def _rows(docs: DataFrame) -> DataFrame:
    return whole_text(docs.select(F.col(docs.columns[-1]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "row", "doc_id")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for every chunk with each one of its minima left out; further columns repeat."""
    for batch in batches:
        s = minima(batch.column("signature").to_pylist())[0].reshape(-1, CHUNKS, CHUNK).astype(np.int64)
        keys = []
        for out in range(CHUNK):
            code = np.arange(CHUNKS)[None, :] * CHUNK + out
            for k in range(CHUNK):
                if k != out:
                    code = code << 16 | s[:, :, k]
            keys.append(code)
        keys = np.concatenate(keys, axis=1)
        rest = [c for c in batch.schema.names if c != "signature"]
        at = pa.array(np.repeat(np.arange(len(s)), keys.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(batch.column(c).take(at) for c in rest)], names=["key", *rest])


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(key, id, n) for the keys that n > 1 classes have."""
    keyed = classes.select("id", "signature").mapInArrow(_keys, "key long, id long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(counts, "key")


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each class with the one hub that it shares most keys with, if HUB_KEYS or more.

    A key's hub is its member that meets most classes over all its keys, which of edited copies is the least edited one.
    """
    met = shared.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = shared.join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("id"))).alias("best"))
    hubs = hubs.select("key", (-F.col("best.id")).alias("hub"))
    tries = shared.join(hubs, "key").where("id <> hub").groupBy("id", "hub").count().where(F.col("count") >= HUB_KEYS)
    best = tries.groupBy("id").agg(F.min(F.struct(-F.col("count"), F.col("hub").alias("hub"))).alias("best"))
    return best.select(F.col("id").alias("a"), F.col("best.hub").alias("b"))


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and block pair; pairs of different components that may be links, each compared vector-wise."""
    names = ["key", "first", "second", "block", "id", "component", "n_shingles", "hub", "apart"]

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        key, first, second, block, node, comp, size, hub, apart = (t.column(c).to_numpy() for c in names)
        coarse, fine = minima(t.column("signature").to_pylist())
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        end = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
        found, at, d = [], np.arange(len(key)), 1
        while len(at := at[at + d < end[at]]):
            for a in np.array_split(at, len(at) // 100_000 + 1):
                b = a + d
                ok = (comp[a] != comp[b]) & ((first[a] == second[a]) | (block[a] != block[b]))
                ok &= 100 * np.minimum(size[a], size[b]) >= SIMILAR * np.maximum(size[a], size[b])
                ok &= (hub[a] != node[b]) & (hub[b] != node[a])  # these were compared exactly
                ok &= (hub[a] != hub[b]) | (hub[a] < 0) | (np.abs(apart[a] - apart[b]) <= 1 - SIMILAR / 100 + 1e-9)
                a, b = a[ok], b[ok]
                differ = coarse[a] != coarse[b]
                ok = differ.sum(1) <= DISTANCE
                a, b, differ = a[ok], b[ok], differ[ok]
                halves = fine[a] ^ fine[b]
                ok = differ.sum(1) + np.count_nonzero(halves & 15, axis=1) + np.count_nonzero(halves >> 4, axis=1) <= FINE_DISTANCE
                a, b, differ = a[ok], b[ok], differ[ok].reshape(-1, CHUNKS, CHUNK)
                errors = differ.sum(2)
                chunk = (errors <= 1).argmax(1)  # the pair's first common key
                out = differ[np.arange(len(a)), chunk].argmax(1)
                ok = key[a] >> 16 * (CHUNK - 1) == chunk * CHUNK + out
                found.append(np.stack([node[a[ok]], node[b[ok]]], 1))
            d += 1
        both = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch])
        k = [t.column(c).to_numpy() for c in names[:3]]
        change = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut and (out := pairs(t.slice(0, cut))) is not None:
            yield out
        held = t.slice(cut).combine_chunks().to_batches()
    if held and (out := pairs(pa.Table.from_batches(held))) is not None:
        yield out


def _cross_pairs(classes: DataFrame, shared: DataFrame, parts: DataFrame, tried: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components that share a key and may be links, each once."""
    known = tried.select(F.col("a").alias("id"), F.col("b").alias("hub"), "apart")
    told = classes.select("id", "n_shingles", "signature").join(parts, "id", "left").join(known, "id", "left")
    told = told.select("id", "n_shingles", "signature", F.coalesce("component", "id").alias("component"), F.coalesce("hub", F.lit(-1)).alias("hub"), F.coalesce("apart", F.lit(0.0)).alias("apart"))
    told = materialize(told, "told")
    keyed = shared.join(told.select("id", "component"), "id")
    mixed = keyed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y")
    mixed = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = shared.select("key", "id").join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "id").join(told, "id")
    return (
        rows.select("key", "first", "second", "block", "id", "component", "n_shingles", "hub", "apart", "signature")
        .repartition("key", "first", "second")
        .sortWithinPartitions("key", "first", "second")
        .mapInArrow(_close_pairs, "a long, b long")
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: the text of b (a is null), then those paired with it. Their Jaccard distance, and whether 100 * intersection >= 75 * union."""
    words, hub = WordHash(), np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for b, a, text in zip(*(batch.column(c) for c in ("b", "a", "text")), strict=True):
            own = shingles(text.as_py(), words)
            if not a.is_valid:
                hub = own
                continue
            union = len(np.union1d(own, hub))
            both = len(own) + len(hub) - union
            out.append((a.as_py(), b.as_py(), 1 - both / union, 100 * both >= SIMILAR * union))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["a", "b", "apart", "linked"])


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, apart, linked) for ``pairs(a, b)`` of row numbers, by the full sets of both texts.

    Only texts in some pair move, and the text of b goes along once for PAIRS of its pairs.
    """
    needed = materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "row"), "needed")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = _rows(docs).drop("doc_id").join(needed, "row", "left_semi")
    large = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("blocks")).where("blocks > 1")
    large = materialize(large, "large")
    if large.count() <= BROADCAST_IDS:
        large = F.broadcast(large)
    blocks = F.coalesce("blocks", F.lit(1))
    hubs = pairs.select("b").distinct().join(large, "b", "left").join(texts.withColumnRenamed("row", "b"), "b")
    hubs = hubs.select("b", F.explode(F.sequence(F.lit(1), blocks)).alias("block"), F.lit(None).cast("long").alias("a"), "text")
    members = pairs.join(large, "b", "left").select("b", (F.pmod(F.xxhash64("a"), blocks).cast("int") + 1).alias("block"), "a")
    members = members.join(texts.withColumnRenamed("row", "a"), "a").select("b", "block", "a", "text")
    dealt = hubs.union(members).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(_compare, "a long, b long, apart double, linked boolean")


def find_groups(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, group (null for an empty set): rows of one group are linked, directly or over others.

    ``docs`` is a ``numbered`` table and ``row`` its number, the last column.
    """
    signed = materialize(sign(docs), "signed")
    grouped = signed.where("n_shingles > 0").groupBy("n_shingles", "high", "low").agg(F.min("row").alias("id"), F.min("signature").alias("signature"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = materialize(grouped.repartition(width, "id"), "classes")
    shared = materialize(_shared_keys(classes), "shared")
    tried = materialize(compared(materialize(_hub_pairs(shared), "pairs"), docs), "tried")
    links = tried.where("linked").select("a", "b")
    parts = components(links).withColumnRenamed("node", "id")
    rest = materialize(_cross_pairs(classes, shared, parts, tried), "pairs")
    more = materialize(compared(rest, docs), "tried").where("linked").select("a", "b")
    if not more.isEmpty():
        parts = components(links.union(more)).withColumnRenamed("node", "id")
    named = classes.drop("signature").join(parts, "id", "left").select("n_shingles", "high", "low", F.coalesce("component", "id").alias("group"))
    return signed.select("row", "doc_id", "n_shingles", "high", "low").join(named, ["n_shingles", "high", "low"], "left").select("row", "doc_id", "n_shingles", "group")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = materialize(find_groups(numbered(docs.select("doc_id", "text"))), "groups")
    least = materialize(rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "least")  # so that the join can be split
    joined = rows.join(least, "group", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group: the smallest doc_id's, then the first."""
    docs = numbered(docs)
    rows = materialize(find_groups(docs).where("group is not null").select("row", "doc_id", "group"), "groups")
    best = rows.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    best = materialize(best.where("n > 1").select("group", F.col("best.row").alias("stays")), "best")
    dropped = rows.join(best, "group").where("row <> stays")
    return without_rows(docs, dropped)
