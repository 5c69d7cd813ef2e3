"""Quality by supervised subword embeddings.

Every word has a learned vector, every hashed character n-gram and hashed word pair one too; a document is the mean of
all of them, a softmax over the two classes follows, and numpy stochastic gradient descent trains both layers. After
training the softmax is folded into the vectors: each feature keeps the one number by which it moves the log odds.

Null texts count as empty; an empty text scores by the bias alone. Repeated rows give repeated results; null ids stay. Of several labels of
one id the greatest counts. Texts of any length are scored whole. Without labels of both kinds every text scores 0.5; an empty table gives no
rows. Other columns are kept by ``keep_good`` and not looked at by ``quality``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.llm.common import WORD, crc_of_id, filter_rows, fit_in_task, labelled_sample, parts, whole_text

SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 15_000
BUCKETS, DIM, MEMO = 1 << 17, 8, 150_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def word_features(words: list[bytes], grams: tuple[int, ...] = (3, 4)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' features (the word itself and its character n-grams, with word ends marked), the word that
    each belongs to, and a hash for each word. Padded byte matrix, no loop over words; long words count whole."""
    sizes = np.array([len(w) for w in words], np.int64) + 2
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(flat)) - starts[owner]
    powers = _mix(within.astype(np.uint64) + np.uint64(77))
    whole = _mix(np.add.reduceat(_mix(flat + np.uint64(1)) * powers, starts)) if len(words) else np.zeros(0, np.uint64)
    buckets, owners = [whole & np.uint64(BUCKETS - 1)], [np.arange(len(words))]
    for n in grams:
        code = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + flat[k : k + len(code)] + np.uint64(1)
        at = np.flatnonzero(within[: len(code)] + n <= sizes[owner[: len(code)]])
        buckets.append(_mix(code[at] + np.uint64(n << 50)) & np.uint64(BUCKETS - 1))
        owners.append(owner[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), whole


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; all words that stand twice in a row share one bucket."""
    first, second = hashes[:-1], hashes[1:]
    return (_mix(np.where(first == second, np.uint64(1), first * np.uint64(31) + second)) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class QualityModel:
    moves: np.ndarray  # BUCKETS numbers: words, character n-grams and word pairs
    bias: float

    def __post_init__(self) -> None:
        self.memo: dict[bytes, int] = {}  # place of a word met before in the three arrays
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of moves, number of features and hash for each word; words met before are kept up to a bound in number and in length."""
        memo = self.memo
        new = sorted({w for w in words if w not in memo}, key=lambda w: len(w) > WORD)
        held = len(memo)
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            buckets, owner, whole = word_features(part)
            memo.update(zip(part, range(len(memo), len(memo) + len(part)), strict=True))
            self.sums = np.append(self.sums, np.bincount(owner, self.moves[buckets], minlength=len(part)))
            self.counts = np.append(self.counts, np.bincount(owner, minlength=len(part)))
            self.hashes = np.append(self.hashes, whole)
        at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        out = self.sums[at], self.counts[at], self.hashes[at]
        short = sum(len(w) <= WORD for w in new) if len(memo) <= MEMO else 0
        if short < len(new):
            for w in new[short:]:
                del memo[w]
            held += short
            self.sums, self.counts, self.hashes = self.sums[:held].copy(), self.counts[:held].copy(), self.hashes[:held].copy()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each whole text; texts go through in blocks of bounded size, long ones in parts."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        held, held_doc, size = [], [], 0
        last: tuple[int, np.ndarray] | None = None  # text and hash of the last word before a flush, for the pair across it

        def flush() -> None:
            nonlocal last
            if not held:
                return
            words = [w for part in held for w in part]
            doc = np.repeat(np.array(held_doc), [len(p) for p in held])
            s, n, h = self.words(words)
            total[:] += np.bincount(doc, s, minlength=len(texts))
            count[:] += np.bincount(doc, n, minlength=len(texts))
            same = doc[1:] == doc[:-1]
            pairs = self.moves[pair_buckets(h)] * same
            total[:] += np.bincount(doc[1:], pairs, minlength=len(texts))
            count[:] += np.bincount(doc[1:], same, minlength=len(texts))
            if len(doc):
                if last and last[0] == doc[0]:
                    total[doc[0]] += self.moves[pair_buckets(np.append(last[1], h[:1]))].sum()
                    count[doc[0]] += 1
                last = int(doc[-1]), h[-1:]

        for d, text in enumerate(texts):
            words = text.encode("utf-8", "replace").split()
            for at in range(0, len(words), 100_000):
                if size > 200_000:
                    flush()
                    held, held_doc, size = [], [], 0
                held.append(words[at : at + 100_000])
                held_doc.append(d)
                size += len(held[-1])
        flush()
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -40, 40)))


def fit(texts: list[str], y: np.ndarray, updates: int = 36_000, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Mini-batch stochastic gradient descent; gradients reach only the vectors of a batch's features."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for text in texts:
        words = text.encode("utf-8", "replace").split()
        if not words:
            rows.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        unique, inverse = np.unique(np.array(words, dtype=object), return_inverse=True)
        buckets, owner, whole = word_features(unique.tolist())
        weight = np.bincount(inverse, minlength=len(unique))[owner].astype(np.float32)
        pairs = pair_buckets(whole[inverse])
        buckets, weight = np.concatenate([buckets, pairs]), np.concatenate([weight, np.ones(len(pairs), np.float32)])
        keep, place = np.unique(buckets, return_inverse=True)
        weight = np.bincount(place, weight)
        rows.append((keep.astype(np.int32), (weight / weight.sum()).astype(np.float32)))
    epochs = max(1, min(100, updates // max(1, len(rows))))  # a small sample is seen more often
    for epoch in range(epochs if len(set(np.asarray(y).tolist())) > 1 else 0):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(len(rows)):
            at, weight = rows[i]  # the features of one document are distinct
            if not len(at):
                continue
            mean = weight @ vectors[at]
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = soft @ p
            soft -= step * np.outer(mean, p)
            bias -= np.float32(0.1) * step * p
            vectors[at] -= step * np.outer(weight, back)
    difference = soft[:, 1] - soft[:, 0]
    return QualityModel((vectors @ difference).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> QualityModel:
    """Fit on at most ``rows`` labelled texts of at most ``max_chars`` characters."""
    return fit_in_task(labelled_sample(docs, labels, "quality", modulus, held, rows, max_chars), fit)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score for every row and whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            scores = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return filter_rows(docs, lambda: lambda texts: shared.value.scores(texts) >= threshold)
