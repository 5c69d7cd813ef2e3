"""A gated recurrent language model with a class-factored softmax.

Words are everything between ASCII white space, A-Z lower-cased, and every document closes with one end token. The network
predicts the VOCABULARY most frequent words, the end, and for other words one of OTHERS kinds by their last two bytes; such a
word has its kind's probability times its add-one share in that kind. The softmax first names one of CLASSES classes (the end with
all kinds, then words of neighbouring frequency), then the member of the class.

Counts and truncated backpropagation cover all words of all training documents: a document is cut into consecutive pieces of
PIECE words, and every piece is trained on once, in windows of WINDOW words that carry the state on inside the piece. Pieces are dealt
by a hash of id, text and place to one of ROUNDS rounds and to shards of about SHARD_WORDS words, whose number follows from the corpus
alone; after each round Spark averages the shards' weights. So neither the cores nor the files' splits change the model. Scoring
carries the state over all windows of a whole document.

Null texts count as empty and consist of the end alone; repeated rows give repeated results, equal texts equal scores; null ids
stay. Without training rows the weights stay as they were drawn and every count is 0; an empty table gives an empty result. Columns besides
doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.llm.common import crc_of_id, parts, whole_text

CLASSES, MEMBERS, WIDTH, STATE = 32, 32, 12, 16
OTHERS = MEMBERS - 1
VOCABULARY = (CLASSES - 1) * MEMBERS
END = 0
HEAD, HEAD_BYTES, LONG_HEAD, LONG_BYTES, BLOCK_BYTES, HELD_BYTES = 300_000, 64, 2_000, 4_096, 12 << 20, 64 << 20
WINDOW, PIECE, ROUNDS, SHARD_WORDS, RATE = 24, 960, 3, 2_000_000, 0.02
LEAST_STREAMS, MOST_STREAMS, SCORE_STREAMS = 32, 512, 1_024
FIXED = float(1 << 40)
LN10 = float(np.log(10.0))


def kind_of(word: bytes) -> int:
    """Id of the kind of a word outside the network's."""
    return 1 + zlib.crc32(word[-2:]) % OTHERS


@cache
def _kinds() -> np.ndarray:
    """``kind_of`` of words by their last two bytes, as 256 times one and the other; words of one byte stand behind."""
    pairs = (bytes([a, b]) for a in range(256) for b in range(256))
    return np.fromiter(map(kind_of, chain(pairs, (bytes([a]) for a in range(256)))), np.int16, 257 * 256)


def kinds_of(words: pa.BinaryArray) -> np.ndarray:
    """``kind_of`` of each word."""
    if not len(words):
        return np.zeros(0, np.int16)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last = data[edges[1:] - 1].astype(np.int32)
    pair = data[np.maximum(edges[1:] - 2, 0)].astype(np.int32) * 256 + last
    return _kinds()[np.where(np.diff(edges) > 1, pair, 65_536 + last)]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def words_in(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """``words_of`` of all texts in one row, and how many each text has."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
    flat, edges = split.flatten(), split.offsets.to_numpy()
    real = pa.compute.greater(pa.compute.binary_length(flat), 0)  # white space at a text's ends leaves empty strings
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real).cast(pa.binary()), np.diff(before[edges - edges[0]])


# ---- corpus counts -------------------------------------------------------------------------------------------------


def word_counts(training: DataFrame, most: int = 500_000) -> DataFrame:
    """(word, n) over all rows; tasks add up their counts and hand them on whenever they hold more than ``most`` words or HELD_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, 0  # sums and new counts, their words, those in the last sum

        def added() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in (p for b in batches for p in parts(b, most=BLOCK_BYTES)):
            found = words_in(batch.column(0))[0].value_counts()
            held.append(pa.RecordBatch.from_arrays(found.flatten(), names=["word", "n"]))
            size += len(found)
            heavy = sum(b.nbytes for b in held) > HELD_BYTES
            if size > whole + most or heavy:
                table = added()
                held, size, whole = table.to_batches(), len(table), len(table)
                if size > most or heavy:
                    yield from held
                    held, size, whole = [], 0, 0
        if held:
            yield from added().to_batches()

    return whole_text(training).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    head: dict[bytes, int]  # the HEAD most frequent words, the network's first
    documents: int
    tokens: int  # with one end for each document
    distinct: int
    others: list[int]  # tokens of each kind outside the network's words
    masses: list[float]  # log10 of each kind's tokens, distinct words and one unseen word together


# ---- the network ---------------------------------------------------------------------------------------------------


def shapes() -> dict[str, tuple[int, ...]]:
    """The output layers' last input is always 1, so that their last row is the bias."""
    return {"emb": (CLASSES * MEMBERS, WIDTH), "wx": (WIDTH, 3 * STATE), "wh": (3, STATE, STATE), "b": (3 * STATE,), "wc": (STATE + 1, CLASSES), "ww": (CLASSES, STATE + 1, MEMBERS)}


WEIGHTS = sum(int(np.prod(s)) for s in shapes().values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The named weights as parts of one vector."""
    out, at = {}, 0
    for k, shape in shapes().items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(share: np.ndarray, seed: int = 3) -> np.ndarray:
    """Random weights whose output is the given share of each of the ids."""
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.15, WEIGHTS).astype(np.float32)
    p = views(flat)
    share = np.maximum(share, 1e-9).reshape(CLASSES, MEMBERS)
    p["b"][:] = 0
    p["wc"] *= 0.3
    p["ww"] *= 0.3
    p["wc"][-1] = np.log(share.sum(1) / share.sum())
    p["ww"][:, -1] = np.log(share / share.sum(1, keepdims=True))
    return flat


class Space(threading.local):
    """Memory that one window after the other uses; fresh arrays of this size would cost page faults in every window."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, np.float32)
        return self.held[name][:n].reshape(shape)


space = Space()


def _inputs(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What each id adds to the reset gate, the update gate and the candidate; the gates' signs are turned for exp."""
    x = p["emb"] @ p["wx"] + p["b"]
    return [np.ascontiguousarray(part) for part in (-x[:, :STATE], -x[:, STATE : 2 * STATE], x[:, 2 * STATE :])]


class Recurrence:
    """The states of one window (time, streams); at time t the first ``live[t]`` streams go on. Used up before the next one begins."""

    def __init__(self, p: dict[str, np.ndarray], inputs: list[np.ndarray], seen: np.ndarray, live: np.ndarray, h: np.ndarray) -> None:
        steps, streams = seen.shape
        self.live, self.start = live, h
        at = seen.ravel()
        self.ar, self.az, self.n = (np.take(x, at, axis=0, out=space(k, at.size, STATE), mode="clip").reshape(steps, streams, STATE) for k, x in zip("rzn", inputs, strict=True))
        self.inner, self.states = space("inner", steps, streams, STATE), space("states", steps, streams, STATE)
        self.clear(self.inner, self.states)
        reset, update, candidate = -p["wh"][0], -p["wh"][1], p["wh"][2].copy()
        one = np.float32(1)
        with np.errstate(over="ignore"):
            for t, k in enumerate(live.tolist()):
                h = h[:k]
                r, z, n, inner, new = self.ar[t, :k], self.az[t, :k], self.n[t, :k], self.inner[t, :k], self.states[t, :k]
                for gate, weight in ((r, reset), (z, update)):
                    np.matmul(h, weight, out=new)
                    gate += new
                    np.exp(gate, out=gate)
                    gate += one
                    np.reciprocal(gate, out=gate)
                np.matmul(h, candidate, out=inner)
                np.multiply(r, inner, out=new)
                n += new
                np.tanh(n, out=n)
                np.subtract(h, n, out=new)
                new *= z
                new += n
                h = new

    def clear(self, *arrays: np.ndarray) -> None:
        """Zero behind the ends of the streams."""
        for t in range(int(np.searchsorted(-self.live, -self.ar.shape[1], side="right")), len(self.live)):
            for x in arrays:
                x[t, self.live[t] :] = 0

    def carried(self) -> np.ndarray:
        """The last state of every stream."""
        out = np.empty_like(self.states[0])
        ends = np.append(self.live, 0)
        for t in range(len(self.live)):
            out[ends[t + 1] : ends[t]] = self.states[t, ends[t + 1] : ends[t]]
        return out

    def back(self, p: dict[str, np.ndarray], d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the loss's gradient by each state: that by each step's reset gate, update gate, product and candidate (4, steps, STATE), and by ``wh``."""
        r, z, n, inner = self.ar, self.az, self.n, self.inner
        steps, streams, _ = d_states.shape
        before = space("before", steps, streams, STATE)
        before[0], before[1:] = self.start[:streams], self.states[:-1]
        # all four are the state's gradient times a factor: by the reset gate, the update gate, the product inside, the candidate
        by = space("by", 4, steps, streams, STATE)
        np.subtract(before, n, out=by[1])
        by[1] *= z
        np.subtract(1, z, out=by[2])
        by[1] *= by[2]
        np.multiply(n, n, out=by[3])
        np.subtract(1, by[3], out=by[3])
        by[3] *= by[2]
        np.subtract(1, r, out=by[0])
        np.multiply(by[3], r, out=by[2])
        by[0] *= by[2]
        by[0] *= inner
        self.clear(before, *by)
        weights = np.ascontiguousarray(p["wh"].transpose(0, 2, 1))
        dh = np.zeros((streams, STATE), np.float32)
        for t in range(steps - 1, -1, -1):
            k = int(self.live[t])
            d = dh[:k]
            d += d_states[t, :k]
            g = by[:, t, :k]
            g *= d
            d *= z[t, :k]
            for part in np.matmul(g[:3], weights, out=space("product", 3, k, STATE)):
                d += part
        rows = by.reshape(4, -1, STATE)
        return rows, np.matmul(before.reshape(-1, STATE).T, rows[:3])


def _exp_rows(x: np.ndarray, most: float) -> np.ndarray:
    """exp of each row up to a factor; only logits that could overflow are first lowered by the row's largest."""
    if most > 80:
        x -= x.max(1, keepdims=True)
    return np.exp(x, out=x)


class Output:
    """Class and member probabilities of targets behind states (n, STATE + 1). Used up before the next one begins."""

    def __init__(self, p: dict[str, np.ndarray], states: np.ndarray, target: np.ndarray) -> None:
        n = len(target)
        group = (target // MEMBERS).astype(np.int16)
        self.order = np.argsort(group, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=CLASSES))]).tolist()
        self.runs = [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        self.states, self.sorted = states, np.take(states, self.order, axis=0, out=space("sorted", n, STATE + 1), mode="clip")
        self.rows, self.group, self.member = np.arange(n), group, (target % MEMBERS)[self.order]
        ones = np.ones(max(CLASSES, MEMBERS), np.float32)
        # states are within -1 and 1, so a column's absolute sum bounds its logits
        self.classes = _exp_rows(np.matmul(states, p["wc"], out=space("classes", n, CLASSES)), np.abs(p["wc"]).sum(0).max(initial=0))
        self.class_sums = self.classes @ ones[:CLASSES]
        members = space("members", n, MEMBERS)
        for c, a, b in self.runs:
            np.matmul(self.sorted[a:b], p["ww"][c], out=members[a:b])
        self.members = _exp_rows(members, np.abs(p["ww"]).sum(1).max(initial=0))
        self.member_sums = self.members @ ones[:MEMBERS]

    def logs(self) -> np.ndarray:
        """Natural log of the probability of each target."""
        out = np.log(self.classes[self.rows, self.group] / self.class_sums + 1e-30)
        out[self.order] += np.log(self.members[self.rows, self.member] / self.member_sums + 1e-30)
        return out

    def back(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> np.ndarray:
        """Adds the mean loss's gradients to ``g``; gives that by the states."""
        n = len(self.rows)
        share = np.float32(1 / max(1, n))
        for x, sums, want in ((self.classes, self.class_sums, self.group), (self.members, self.member_sums, self.member)):
            x *= (share / sums)[:, None]
            x[self.rows, want] -= share
        np.matmul(self.states.T, self.classes, out=g["wc"])
        inner = space("inner gradient", n, STATE)
        for c, a, b in self.runs:
            np.matmul(self.sorted[a:b].T, self.members[a:b], out=g["ww"][c])
            np.matmul(self.members[a:b], p["ww"][c, :STATE].T, out=inner[a:b])
        out = np.matmul(self.classes, p["wc"][:STATE].T, out=space("state gradient", n, STATE))
        out[self.order] += inner
        return out


def _with_one(states: np.ndarray) -> np.ndarray:
    out = space("with one", len(states), STATE + 1)
    out[:, :STATE] = states
    out[:, STATE] = 1
    return out


def _taken(x: np.ndarray, at: np.ndarray | None) -> np.ndarray:
    """The states (n, STATE) of the given steps of all streams; without steps, all."""
    flat = x.reshape(-1, STATE)
    return flat if at is None else flat[at]


def _real(live: np.ndarray, streams: int) -> np.ndarray | None:
    """Which of (time, streams) are in a sequence; None: all."""
    return None if live[-1] == streams else np.flatnonzero(np.arange(streams) < live[:, None])


def gradient(flat: np.ndarray, seen: np.ndarray, target: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the mean loss of one window (time, streams), cut at its beginning; every stream's state behind it; the loss."""
    whole = np.zeros_like(flat)
    p, g = views(flat), views(whole)
    run = Recurrence(p, _inputs(p), seen, live, h)
    real = _real(live, seen.shape[1])
    output = Output(p, _with_one(_taken(run.states, real)), target.ravel() if real is None else target.ravel()[real])
    loss = -float(output.logs().mean())
    d_states = output.back(p, g)
    if real is not None:
        by_real, d_states = d_states, space("by all", seen.size, STATE)
        d_states[:] = 0
        d_states[real] = by_real
    by, g["wh"][:] = run.back(p, d_states.reshape(run.states.shape))
    ids, ones = seen.ravel(), np.ones(seen.size, np.float32)  # steps behind a stream's end add zeros
    seen_emb = np.take(p["emb"], ids, axis=0, out=space("seen", seen.size, WIDTH), mode="clip").T
    by_emb = np.zeros((WIDTH, seen.size), np.float32)
    for at, part in zip(range(0, 3 * STATE, STATE), (by[0], by[1], by[3]), strict=True):
        of = slice(at, at + STATE)
        by_emb += p["wx"][:, of] @ part.T
        np.matmul(seen_emb, part, out=g["wx"][:, of])
        np.matmul(ones, part, out=g["b"][of])
    for i, row in enumerate(by_emb):
        g["emb"][:, i] = np.bincount(ids, row, minlength=CLASSES * MEMBERS)
    return whole, run.carried(), loss


def _window(sequences: list[np.ndarray], at: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of up to WINDOW + 1 times from ``at``, streams), and how many streams predict at each time; the longest stand first."""
    live = np.searchsorted(-sizes, -np.arange(at, min(at + WINDOW, int(sizes[0]))), side="left")
    streams = int(live[0])
    ids = np.full((streams, len(live) + 1), END, np.int64)
    ends = np.minimum(sizes[:streams] - at, len(live)) + 1
    ids[np.arange(len(live) + 1) < ends[:, None]] = np.concatenate([s[at : at + e] for s, e in zip(sequences, ends.tolist())])
    return np.ascontiguousarray(ids.T), live


def train_pieces(flat: np.ndarray, pieces: list[np.ndarray], rate: float) -> np.ndarray:
    """Adam over all windows of all pieces, each once; batches of pieces of like length grow from LEAST_STREAMS to MOST_STREAMS.

    Windows of one piece follow each other with the state carried on.
    """
    flat = flat.copy()
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
    sizes = np.array([len(s) - 1 for s in pieces])  # each id but the leading one is predicted once
    longest_first = np.argsort(-sizes, kind="stable")
    cuts, streams = [0], LEAST_STREAMS
    while cuts[-1] < len(pieces):
        cuts.append(cuts[-1] + streams)
        if len(cuts) % 2:
            streams = min(2 * streams, MOST_STREAMS)
    # every batch takes like lengths, small batches come from all over the lengths first
    ranks = np.random.default_rng(5).permutation(len(cuts) - 1)
    spans = np.concatenate([[0], np.cumsum([min(cuts[i + 1], len(pieces)) - cuts[i] for i in ranks])])
    place = {int(i): (int(a), int(b)) for i, a, b in zip(ranks, spans[:-1], spans[1:], strict=True)}
    for i in range(len(cuts) - 1):
        a, b = place[i]
        part = [pieces[j] for j in longest_first[a:b]]
        own = sizes[longest_first[a:b]]
        h = np.zeros((len(part), STATE), np.float32)
        for w in range(0, int(own[0]), WINDOW):
            ids, live = _window(part, w, own)
            g, h, _ = gradient(flat, ids[:-1], ids[1:], live, h[: live[0]])
            t += 1
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            flat -= np.float32(rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)) * m / (np.sqrt(v) + np.float32(1e-7))
    return flat


def score_ids(flat: np.ndarray, documents: list[np.ndarray], streams: int = SCORE_STREAMS) -> np.ndarray:
    """log10 probability of each whole sequence of ids, which begins behind an end; documents of like length go side by side."""
    p = views(flat)
    inputs = _inputs(p)
    out, order = np.zeros(len(documents)), sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    for a in range(0, len(order), streams):
        part = order[a : a + streams]
        sequences = [np.append(END, documents[i]) for i in part]
        sizes = np.array([len(documents[i]) for i in part])
        h, sums = np.zeros((len(part), STATE), np.float32), np.zeros(len(part))
        for w in range(0, int(sizes[0]), WINDOW):
            ids, live = _window(sequences, w, sizes)
            run = Recurrence(p, inputs, ids[:-1], live, h[: live[0]])
            h = run.carried()
            real = _real(live, ids.shape[1])
            target = ids[1:].ravel()
            logs = Output(p, _with_one(_taken(run.states, real)), target if real is None else target[real]).logs()
            places = np.tile(np.arange(live[0]), len(live))
            sums[: live[0]] += np.bincount(places if real is None else places[real], logs, minlength=live[0])
        out[part] = sums / LN10
    return out


# ---- jobs ----------------------------------------------------------------------------------------------------------


class Words:
    """The words of the head as tables: a word's place, and log10 of its count and one."""

    def __init__(self, head: dict[bytes, int]) -> None:
        self.head = pa.array(list(head), pa.binary())
        self.share = np.log10(np.array(list(head.values()), np.float64) + 1)

    def read(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head (-1: elsewhere) and id for the network of each word."""
        place = pa.compute.fill_null(pa.compute.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False)
        return place, np.where((place >= 0) & (place < VOCABULARY), place + MEMBERS, kinds_of(words)).astype(np.int16)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows of all batches in blocks of about BLOCK_BYTES of a text column."""
    held, size = [], 0
    for batch in (p for b in batches for p in parts(b, column, BLOCK_BYTES)):
        held.append(batch)
        size += batch.column(column).nbytes
        if size > BLOCK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _pieces(training: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """(deal, piece): for every document consecutive runs of up to PIECE ids, each behind the id before it; END closes the last.

    ``deal`` is a hash of id, text and place in the document, so that pieces of long documents and of copies spread evenly.
    """
    shared = training.sparkSession.sparkContext.broadcast(Words({w: 1 for w, _ in zip(head, range(VOCABULARY))}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in (p for b in batches for p in parts(b)):
            split, counts = words_in(batch.column(1))
            stream = np.full(int(counts.sum()) + 2 * len(counts), END, np.int16)  # every document between two ends
            stream[np.arange(counts.sum()) + 2 * np.repeat(np.arange(len(counts)), counts) + 1] = words.read(split)[1]
            owners, places, turns, sizes, out, at = [], [], [], [], [], 0
            for doc_id, text, n in zip(batch.column(0).to_pylist(), pa.compute.ascii_lower(batch.column(1)).cast(pa.binary()), counts.tolist(), strict=True):
                cuts = range(0, n + 1, PIECE)
                owners += [doc_id] * len(cuts)
                places += [zlib.crc32(text.as_buffer())] * len(cuts)
                turns += range(len(cuts))
                for cut in cuts:
                    out.append(stream[at + cut : at + min(cut + PIECE, n + 1) + 1])
                    sizes.append(len(out[-1]))
                at += n + 2
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(places, pa.int64()), pa.array(turns, pa.int64()), lists], names=["doc_id", "place", "turn", "piece"])

    source = whole_text(training.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    cut = source.mapInArrow(run, "doc_id long, place long, turn long, piece array<short>")
    return cut.select(F.xxhash64("doc_id", "place", "turn").alias("deal"), "piece")


def train(training: DataFrame, counts: Counts) -> np.ndarray:
    """Rounds of local training with averaged weights; each round has its own pieces, in shards of about SHARD_WORDS words."""
    spark = training.sparkSession
    share = np.zeros(CLASSES * MEMBERS)
    share[END] = counts.documents
    share[1:MEMBERS] = counts.others
    first = list(counts.head.values())[:VOCABULARY]
    share[MEMBERS : MEMBERS + len(first)] = first
    flat = start(share / max(1, share.sum()))
    if not counts.documents:
        return flat
    shards = max(1, counts.tokens // (ROUNDS * SHARD_WORDS))
    dealt = _pieces(training, counts.head).select("deal", F.pmod("deal", F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.shiftright("deal", 8), F.lit(shards)).alias("shard"), "piece")
    dealt = materialize(dealt, "pieces")
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(flat)
        rate = RATE / 2**turn

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            def trained(pieces: list[np.ndarray]) -> pa.RecordBatch:
                new = train_pieces(shared.value, pieces, rate).astype(np.float64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(new))), pa.array(np.rint(new * FIXED).astype(np.int64))], names=["i", "weight"])

            held, now = [], None
            for batch in batches:
                for shard, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if held and shard != now:
                        yield trained(held)
                        held = []
                    now = shard
                    held.append(piece.values.to_numpy())
            if held:
                yield trained(held)

        own = dealt.where(F.col("round") == turn).repartition(min(4 * shards, 100_000), "shard").sortWithinPartitions("shard", "deal", "piece")
        means = own.select("shard", "piece").mapInArrow(run, "i long, weight long").groupBy("i").agg(F.sum(F.col("weight").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
        rows = means.select("i", (F.col("s").cast("double") / F.col("n")).alias("w")).orderBy("i").collect()  # one for each weight
        if rows:
            flat = (np.array([r.w for r in rows]) / FIXED).astype(np.float32)
    return flat


SCORED = "row long, doc_id long, n_tokens long, other_mass double, n_known long, frequent double, frequent_other double, rest array<binary>, network double"


def _score_rows(docs: DataFrame, counts: Counts, flat: np.ndarray) -> DataFrame:
    """For each row: id, token counts, the network's sum, sums of log10(c + 1) over known frequent words, and the rest of the words."""
    shared = docs.sparkSession.sparkContext.broadcast((Words(counts.head), counts.masses, counts.documents, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, masses, documents, flat = shared.value
        end = float(np.log10(documents + 1))
        mass_of = np.zeros(CLASSES * MEMBERS)
        mass_of[1:MEMBERS] = masses
        names = [c.split()[0] for c in SCORED.split(", ")]
        for rows in _blocks(batches, 2):
            texts = rows.column(2).dictionary_encode()  # equal texts are scored once
            split, sizes = words_in(texts.dictionary)
            place, ids = words.read(split)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            share = np.where(place >= 0, words.share[place], 0.0) if len(words.share) else np.zeros(len(place))
            other = (ids < MEMBERS) & (place >= 0)

            def sums(weights: np.ndarray, doc=doc, n=len(sizes)) -> np.ndarray:
                return np.bincount(doc, weights, minlength=n).astype(np.float64)  # without any word bincount gives integers

            outside = np.bincount(doc[place < 0], minlength=len(sizes))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            network = score_ids(flat, [np.append(ids[a:b], np.int16(END)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            each = [
                pa.array(sizes + 1, pa.int64()), pa.array(sums(mass_of[ids])), pa.array(sizes - outside + (documents > 0), pa.int64()), pa.array(sums(share) + end), pa.array(sums(share * other)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(outside)]).astype(np.int32)), split.filter(pa.array(place < 0))), pa.array(network),
            ]
            cols = [rows.column(0), rows.column(1), *(c.take(texts.indices) for c in each)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    source = whole_text(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id").cast("long")), "row", "doc_id")
    return source.mapInArrow(run, SCORED)


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, as many whole classes of counts as have at most ``most`` words together.

    A class is one count, of large counts a 64th of a doubling; so only a histogram of some thousand classes is collected, and no
    task sorts words.
    """
    level = F.when(F.col("n") < 4_096, F.col("n")).otherwise(F.lit(4_096) + F.floor(F.log2("n") * 64)).cast("long")
    total, least = 0, None
    for r in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        least = r.level
    return table.where(F.lit(False) if least is None else level >= least)


def count_corpus(training: DataFrame) -> tuple[DataFrame, Counts]:
    """All word counts as a table, and their totals with the head.

    That are up to HEAD of the most frequent words of up to HEAD_BYTES bytes, and up to LONG_HEAD longer ones of up to LONG_BYTES.
    """
    table = materialize(word_counts(training), "words")
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    documents = training.count()
    size = F.octet_length("word")
    head = _most_frequent(table.where(size <= HEAD_BYTES), HEAD)
    more = _most_frequent(table.where((size > HEAD_BYTES) & (size <= LONG_BYTES)), LONG_HEAD)
    rows = head.union(more).toArrow()  # bounded in rows and in bytes
    words = dict(sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0])))
    tokens, distinct = [0] * OTHERS, [0] * OTHERS
    kind = F.crc32(F.expr("substring(word, -2, 2)")) % OTHERS
    for r in table.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # OTHERS rows
        tokens[r.kind], distinct[r.kind] = r.n, r.v
    for w, n in list(words.items())[:VOCABULARY]:
        tokens[kind_of(w) - 1] -= n
        distinct[kind_of(w) - 1] -= 1
    masses = [float(np.log10(n + v + 1)) for n, v in zip(tokens, distinct, strict=True)]
    return table, Counts(words, documents, int(totals.n) + documents, int(totals.v) + (documents > 0), tokens, masses)


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row and whole text."""
    table, counts = count_corpus(training)
    rows = materialize(_score_rows(docs, counts, train(training, counts)), "scored")
    # words that are not in the head: their counts come by a join, not by a broadcast
    rest = rows.select("row", F.explode("rest").alias("word"))
    found = rest.join(table, "word").groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare"))
    joined = rows.drop("rest").join(found, "row", "left").fillna(0, ["more_known", "rare"])
    known_mass = float(np.log10(counts.tokens + counts.distinct + 1))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("frequent") + F.col("rare") - F.col("n_tokens") * known_mass).alias("base_score"),
        (F.col("network") + F.col("frequent_other") + F.col("rare") - F.col("other_mass")).alias("score"),
    )


def language_model(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on rows whose crc32 modulo 7 is not 2."""
    held_out = crc_of_id() % 7 == 2
    scored = score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
