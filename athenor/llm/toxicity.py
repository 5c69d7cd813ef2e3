"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence has probability ``sigmoid(bias + sum of the weights of its distinct words and of their first five bytes)``;
a document is toxic with the noisy-or ``1 - prod(1 - p)`` of its sentences. Only document labels train the weights; the sentence probabilities then locate
the offending sentences.

Null texts count as empty; an empty text has one empty sentence. Repeated rows give repeated results; null ids stay. Of several labels of one
id the greatest counts. Texts of any length are scored whole. Without labels of both kinds every text has the bias' score; an empty table gives
no rows. Other columns are kept by ``keep_clean`` and not looked at by ``toxicity``, whatever their names.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.llm.common import WORD, crc_of_id, filter_rows, fit_in_task, labelled_sample, parts, whole_text

SAMPLE_ROWS, SAMPLE_CHARS, VOCABULARY = 8_000, 60_000, 4_096
SCORED = "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"

#: ASCII sentence ends become line ends, other ASCII but letters and digits become spaces; lengths stay.
_CLASSES = bytes(10 if c in b".!?\n" else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(words: set[bytes]) -> set[bytes]:
    """The words, and the stem of each longer word: its first five bytes, marked."""
    return words | {b"^" + w[:5] for w in words if len(w) > 5}


class WordWeights(dict):
    """Weight of a word with its stem; words met before are kept up to a bound."""

    def __init__(self, weights: dict[bytes, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        weight = self.weights.get(word, 0.0)
        if len(word) > 5:
            weight += self.weights.get(b"^" + word[:5], 0.0)
        if len(self) < 100_000 and len(word) <= WORD:
            self[word] = weight
        return weight


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float


def sentences(text: str) -> list[bytes]:
    """Sentences of the whole text as bytes; each byte keeps its place, so lengths give offsets in UTF-8."""
    return text.encode("utf-8", "replace").lower().translate(_CLASSES).split(b"\n")


def fit(texts: list[str], y: np.ndarray, vocabulary: int = VOCABULARY, steps: int = 180, rate: float = 0.12, decay: float = 2e-5) -> ToxicityModel:
    """Full-batch Adam on the noisy-or likelihood of the document labels."""
    if not len(texts):
        return ToxicityModel({}, -8.0)
    seen, toxic = Counter(), Counter()
    for text, label in zip(texts, y, strict=True):
        found = features({w for s in sentences(text) for w in s.split()})
        seen.update(found)
        if label:
            toxic.update(found)
    n, base = len(texts), float(np.mean(y))
    spread = {w: (toxic[w] - c * base) / (c * base * (1 - base) + 1) ** 0.5 for w, c in seen.items() if c >= 4}
    chosen = sorted(spread, key=lambda w: (-abs(spread[w]), w))[:vocabulary]
    index = {w: i for i, w in enumerate(chosen)}

    doc_of, sent_of, word_of = array("l"), array("l"), array("l")
    for d, text in enumerate(texts):
        for sentence in sentences(text):
            ids = sorted(index[w] for w in features(set(sentence.split())) if w in index)
            word_of.extend(ids)
            sent_of.extend([len(doc_of)] * len(ids))
            doc_of.append(d)
    s, doc_of, sent_of, word_of = len(doc_of), np.array(doc_of), np.array(sent_of, int), np.array(word_of, int)
    w, b = np.zeros(len(chosen)), -6.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(sent_of, w[word_of], minlength=s)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        total = np.bincount(doc_of, np.logaddexp(0, z), minlength=n)
        slope = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-6), 1.0)
        dz = slope[doc_of] * p / n
        g = np.append(np.bincount(word_of, dz[sent_of], minlength=len(chosen)) + decay * w, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return ToxicityModel({x: float(w[i]) for x, i in index.items() if w[i]}, float(b))


def score_text(bias: float, weights: WordWeights, text: str) -> tuple[float, int, list[dict]]:
    """Noisy-or score, number of sentences, and the sentences of probability 0.5 or more with UTF-8 byte offsets."""
    get = weights.__getitem__
    at, total, found, split = 0, 0.0, [], sentences(text)
    quiet = log1p(exp(bias)) if bias < 30 else bias
    for part in split:
        z = sum(map(get, set(part.split())))
        if z:
            z += bias
            total += log1p(exp(z)) if z < 30 else z
            if z >= 0:
                found.append({"start": at, "end": at + len(part), "score": 1 / (1 + exp(-z))})
        else:
            total += quiet
        at += len(part) + 1
    return -expm1(-total), len(split), found


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled texts of at most ``max_chars`` characters."""
    return fit_in_task(labelled_sample(docs, labels, "toxic", modulus, held, rows, max_chars), fit)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_sentences, offending for every row and whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = WordWeights(model.weights)
        for batch in (p for b in batches for p in parts(b)):
            rows = [score_text(model.bias, weights, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
                ],
                names=["doc_id", "score", "n_sentences", "offending"],
            )

    return whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending"
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``; the text is scored where it stands."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep() -> Callable[[list[str]], list[bool]]:
        model = shared.value
        weights = WordWeights(model.weights)
        return lambda texts: [score_text(model.bias, weights, t)[0] < threshold for t in texts]

    return filter_rows(docs, keep)
