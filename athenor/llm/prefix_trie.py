"""Prefix trie of conversations: double arrays, one for each shard of prefixes, with the shared upper nodes merged in Spark.

A turn is the first 16 bytes of the SHA-256 of its role and text; texts themselves never move. Conversations are cut into segments
of STEP turns, so that a very long one is many small rows; a segment's ``before`` names all turns before it. Equal segments after equal turns
are counted and become one row, which is what a large group of copies shrinks to. These rows are sorted over the whole cluster, and
every stretch of about SHARD turns is one shard: its turns get dense ids, BASE and CHECK arrays are packed over them, and walking all
sequences through the arrays gives the shard's nodes, their members and the sums over their subtrees.

Only nodes on the path of a shard's first or last sequence can have members in other shards, and only those on the path of a sequence that
goes on in a next segment have subtrees elsewhere. These are merged over all shards, and their subtree sums are gathered by pointer doubling:
round k adds the sums of the nodes 2^k below, so the rounds grow with the logarithm of the longest conversation. All others are whole in their shard.

Order: turn with nulls first, then the SHA-256 of role and text; repeated rows are turns of their own. Null role and text count as empty, rows
with a null conv_id belong to no conversation and are left out, further columns are not looked at, whatever their names. An empty table
has no members and gives no node, not even a root. Texts of any length are hashed and counted whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.storage import materialize

STEP, SHARD, IDS, TRIES, WIDTH = 64, 50_000, 4_096, 32, 16
GROUP, HEAD = 20, 4
ROOT = bytes(WIDTH)
NODES = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, words long, n_children long, n_leaves long, saved_tokens long, shared boolean"


def _short(of: Column) -> Column:
    """The first WIDTH bytes of a SHA-256."""
    return F.substring(F.unhex(F.sha2(of, 256)), 1, WIDTH)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; their place among the conversation's rows of this partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        new = np.append(True, ids[1:] != ids[:-1])
        starts = np.flatnonzero(new)
        place = np.arange(len(ids)) - starts[np.cumsum(new) - 1]
        if ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(place)], names=["conv_id", "key", "words", "part", "place"])


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, words) for each turn, pos from 0; and (conv_id, n_turns). A conversation of any size is sorted by many tasks."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _short(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "words")
    placed = materialize(placed.mapInArrow(_number, "conv_id long, key binary, words long, part int, place long"), "turns")
    each = materialize(placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "counts")
    sizes = materialize(each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.count("*").alias("parts")), "conversations")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = each.join(sizes.where("parts > 1").select("conv_id"), "conv_id").select("conv_id", "part", before.alias("before"))
    # one conversation at most goes on over each border between two partitions, so spans has at most two rows for each partition
    turns = placed.join(F.broadcast(spans), ["conv_id", "part"], "left")
    return turns.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words"), sizes.select("conv_id", "n_turns")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Segments of each conversation c that begins with the first crc32(c) % HEAD turns of conversation c - c % GROUP and goes on with its own later ones."""
    turns, sizes = ordered(conversations)
    head, h = F.col("conv_id") - F.col("conv_id") % GROUP, F.crc32(F.col("conv_id").cast("string")) % HEAD
    ids = sizes.select("conv_id", "n_turns", head.alias("head"), h.alias("h"))
    ids = ids.join(sizes.select(F.col("conv_id").alias("head"), F.col("n_turns").alias("of_head")), "head", "left")
    taken = F.least("h", F.coalesce("of_head", F.lit(0)))
    ids = materialize(ids.select("conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n")), "rebuilt")
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD - 1)).withColumnRenamed("conv_id", "head")
    first = heads.join(ids, "head").where("pos < h").select("conv_id", "n", "pos", "key", "words")
    own = turns.join(ids, "conv_id").where("pos >= h").select("conv_id", "n", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "key", "words")
    return segments(first.union(own), ids.select("conv_id", "n"))


def segments(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, n, segment, path (the turns' keys), words, before, after for ``turns`` (conv_id, n, pos, key, words) and the ``sizes`` (conv_id, n) of all.

    ``after`` names the turns up to the end of a full segment and is the next one's ``before``.
    """
    cut = turns.groupBy("conv_id", "n", F.floor(F.col("pos") / STEP).cast("long").alias("segment")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("t"))
    path = F.unhex(F.array_join(F.transform("t.key", F.hex), ""))
    cut = cut.select("conv_id", "n", "segment", path.alias("path"), F.col("t.words").alias("words"))
    none = sizes.where("n = 0").select("conv_id", "n", F.lit(0).cast("long").alias("segment"), F.lit(b"").alias("path"), F.array().cast("array<long>").alias("words"))
    cut = materialize(cut.union(none), "segments")
    full = cut.where(F.octet_length("path") == STEP * WIDTH)
    up_to = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)  # one row of three numbers for STEP turns
    sums = [F.sum(F.xxhash64(F.lit(k), "segment", "path").cast("decimal(38,0)")).over(up_to).cast("string") for k in (1, 2)]
    after = materialize(full.select("conv_id", "segment", _short(F.concat_ws("|", F.col("segment").cast("string"), *sums)).alias("after")), "prefixes")
    before = after.select("conv_id", (F.col("segment") + 1).alias("segment"), F.col("after").alias("before"))
    found = cut.join(after, ["conv_id", "segment"], "left").join(before, ["conv_id", "segment"], "left")
    return materialize(found.withColumn("before", F.coalesce("before", F.lit(ROOT))), "paths")


class DoubleArray:
    """The child of state s by symbol a is the slot BASE[s] + a, if CHECK there is s. The root is slot 0; symbols count from 1."""

    def __init__(self) -> None:
        self.base, self.check, self.free, self.top, self.wide = [0], [0], [1], 0, 1  # free: a later slot to look at, the slot itself if it is free

    def _grow(self, slot: int) -> None:
        if slot >= len(self.check):
            more = max(slot + 1 - len(self.check), len(self.check) // 2)
            self.free += range(len(self.free), len(self.free) + more)
            self.base += [0] * more
            self.check += [-1] * more

    def _next_free(self, slot: int) -> int:
        free = self.free
        while True:
            self._grow(slot)
            if free[slot] == slot:
                return slot
            after = free[slot]
            self._grow(after)
            free[slot] = free[after]  # halves the way for the next search
            slot = after

    def _fitting(self, symbols: list[int], least: int, most: int) -> int:
        """A base for these symbols: the first free slots that fit, then those from the last wide state on, then behind all in use."""
        for slot in (least + 1, max(least + 1, self.wide)):
            for _ in range(TRIES if len(symbols) > 1 else 1):
                slot = self._next_free(slot)
                self._grow(slot - least + most)
                if all(self.free[slot - least + a] == slot - least + a for a in symbols):
                    return slot - least
                slot += 1
        self.wide = max(self.top, least) + 1
        self._grow(self.wide - least + most)
        return self.wide - least

    def put(self, state: int, symbols: list[int]) -> None:
        least, most = min(symbols), max(symbols)
        at = self._fitting(symbols, least, most)
        self.base[state], self.top = at, max(self.top, at + most)
        for a in symbols:
            self.check[at + a] = state
            self.free[at + a] = at + a + 1


def _shard(rows: list[tuple], first: bool, last: bool) -> pa.RecordBatch:
    """Nodes of sorted distinct sequences after one prefix; ``first`` and ``last``: their paths may go on in the shard before or behind."""
    segment, before = rows[0][:2]
    paths, n, least, words, after, more = ([r[k] for r in rows] for k in range(2, 8))
    sizes = np.array([len(p) // WIDTH for p in paths])
    dense: dict[bytes, int] = {}
    symbols = np.zeros((len(rows), max(1, sizes.max())), np.int64)
    symbols[np.arange(symbols.shape[1]) < sizes[:, None]] = [dense.setdefault(p[k : k + WIDTH], len(dense) + 1) for p in paths for k in range(0, len(p), WIDTH)]
    trie, state, walked = DoubleArray(), np.zeros(len(rows), np.int64), []
    for d in range(int(sizes.max())):
        at = np.flatnonzero(sizes > d)
        s, a = state[at], symbols[at, d]
        new = at[np.append(True, (s[1:] != s[:-1]) | (a[1:] != a[:-1]))]
        owner, symbol = state[new], symbols[new, d].tolist()
        edges = [*np.flatnonzero(np.append(True, owner[1:] != owner[:-1])).tolist(), len(owner)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            trie.put(int(owner[x]), symbol[x:y])
        state[at] = np.array(trie.base)[s] + a
        walked.append((at, new))
    check, base = np.array(trie.check), np.array(trie.base)
    size, n, least, more = len(check), np.array(n), np.array(least), np.array(more)
    members, smallest, own = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    children, leaves, saved, shared = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    keys, shared[0], state = {0: before}, True, np.zeros(len(rows), np.int64)
    ends = more.copy()
    ends[0] |= first
    ends[-1] |= last
    if segment == 0:
        members[0], smallest[0] = n.sum(), least.min()
    levels = []
    for d, (at, new) in enumerate(walked):  # all sequences through the arrays at once
        state[at] = base[state[at]] + symbols[at, d]
        here, nodes = state[at], state[new]
        np.add.at(members, here, n[at])
        np.minimum.at(smallest, here, least[at])
        own[nodes] = [words[i][d] for i in new.tolist()]
        shared[here[ends[at]]] = True
        for i, node in zip(new.tolist(), nodes.tolist(), strict=True):
            keys[node] = after[i] if d == STEP - 1 else hashlib.sha256(before + paths[i][: WIDTH * (d + 1)]).digest()[:WIDTH]
        levels.append(nodes)
    for nodes in reversed(levels):
        inner = nodes[~shared[nodes]]
        leaves[inner] += children[inner] == 0
        saved[inner] += (members[inner] - 1) * own[inner]
        for total, value in ((children, 1), (leaves, leaves[inner]), (saved, saved[inner])):
            np.add.at(total, check[inner], value)
    depth = np.concatenate([[0], *(np.full(len(x), d + 1) for d, x in enumerate(levels))]) + segment * STEP
    nodes = np.concatenate([[0], *levels]).astype(np.int64)
    up = check[nodes]
    top = nodes == 0
    parents = [None if t else keys[u] for t, u in zip(top.tolist(), up.tolist(), strict=True)]
    columns = [pa.array([keys[x] for x in nodes.tolist()], pa.binary()), pa.array(parents, pa.binary()), pa.array(depth), pa.array(smallest[nodes], mask=members[nodes] == 0), pa.array(smallest[up], mask=shared[up] | top)]
    columns += [*(pa.array(x[nodes]) for x in (members, own, children, leaves, saved)), pa.array(shared[nodes])]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODES.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch], turns: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment, before and path; a shard ends with its prefix or at so many turns."""
    rows, size, first = [], 0, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (row[:2] != rows[0][:2] or size >= turns):
                same = row[:2] == rows[0][:2]
                yield _shard(rows, first, same)
                rows, size, first = [], 0, same
            rows.append(row)
            size += len(row[2]) // WIDTH + 1
    if rows:
        yield _shard(rows, first, True)


def _merged(made: DataFrame) -> DataFrame:
    """The nodes that several shards know of, with their sums over all of them; still without what stands below them."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = materialize(made.where("shared").groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *sums), "shared")
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    return materialize(
        nodes.join(below, "key", "left").select(
            "key", "parent", "depth", "conv_id", "n_convs", children.alias("n_children"),
            (F.col("n_leaves") + (children == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        "shared",
    )


def _gathered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens summed over their subtrees among themselves: after round k over all less than 2^k below."""
    now = nodes.select("key", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        climbing = now.where("up is not null")
        more = climbing.groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        sums = now.join(more, "key", "left").select("key", "up", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        higher = sums.join(above, "up", "left").select("key", F.col("next").alias("up"), "n_leaves", "saved_tokens")
        now = materialize(higher, "gathered")
    return nodes.drop("n_leaves", "saved_tokens").join(now.drop("up"), "key")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and ids; one SHA-256 runs over the ids of each node as they come."""
    last, running = None, hashlib.sha256()
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != last:
                if last is not None:
                    done.append((last, running.hexdigest()))
                last, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])


def ending(paths: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes at which conversations end. Ids are joined in runs of at most IDS before they meet at their node."""
    size = F.octet_length("path") / WIDTH
    last = paths.where(F.col("segment") * STEP + size == F.col("n"))
    key = F.when(F.col("n") == 0, F.lit(ROOT)).when(F.col("after").isNotNull(), F.col("after")).otherwise(_short(F.concat("before", "path")))
    runs = last.select(key.alias("key"), "conv_id", F.floor(F.col("conv_id") / IDS).alias("run")).groupBy("key", "run").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("key", "run", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(_digest, "key binary, ends_sha256 string")


def nodes(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of ``paths``."""
    goes_on = F.col("n") > (F.col("segment") + 1) * STEP
    same = paths.groupBy("segment", "before", "path").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), F.first("after").alias("after"), F.max(goes_on).alias("more")
    )
    order = ["segment", "before", "path"]
    made = same.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_shards, turns=shard), NODES)
    made = materialize(made, "nodes")
    merged = materialize(_gathered(_merged(made)), "merged")
    columns = ["key", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = made.where("not shared").select(*columns)
    hanging = inner.where("parent_conv_id is null").drop("parent_conv_id").unionByName(merged)
    above = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = inner.where("parent_conv_id is not null").unionByName(hanging.join(above, "parent", "left"))
    found = found.join(ending(paths), "key", "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
