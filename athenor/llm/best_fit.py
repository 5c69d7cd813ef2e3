"""Best-fit packing by large-item matching.

A document longer than 1024 ids is cut into pieces of 1024, of which the first may be shorter; any other stays whole. Pieces of
1024 are sequences of their own. Of the rest, those above one third of a sequence meet at most one other of their kind in a
bin, so they are matched greedily: the largest with the largest that still fits, which gives as many pairs as any matching (the larger of two
pieces never has a partner that the smaller lacks). Then the smaller pieces, largest first, go each to the tightest gap that takes it.

Pieces of one length are alike, so the whole plan follows from how many pieces each length has: at most 1,023 counts reach the driver, and the
plan's runs ("the next n pieces of this length go to the bins from here on, so many to a bin") are bounded by the lengths, whatever the
rows. Every piece then finds its run by its number among the pieces of its length, in Spark.

Null texts count as empty and give the closing id alone; repeated rows give repeated pieces, null ids stay, an empty table gives
no pieces, and columns besides doc_id and text are not looked at, whatever their names. Texts of any length are encoded and cut
whole; a special token's string in a text is read as the library's plain call reads it. Equal lengths are placed in the
order of the table's partitions and rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.storage import materialize
from athenor.llm.common import WORD, parts, whole_text

CAPACITY, CLOSING, MEMO = 1024, 2, 400_000
#: What the vocabulary file's byte-level pattern splits text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ByteLevelEncoder:
    """ids of whole texts as little-endian 32-bit bytes, as the library gives them for a byte-level vocabulary file.

    No pre-token goes on over a space or a line end that follows other characters, so in texts without two neighbouring white
    spaces the words are encoded apart. Words of up to WORD characters are kept, MEMO of them at most, so the memo is bounded in bytes;
    unknown ones are encoded together by the faster library with the same ranks. Characters that came after Unicode 3.2, on whose
    class the two libraries may disagree, and special tokens go to the file's own library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        from athenor.llm.packing import _later_characters

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:  # a file of the installed package, on every executor
            special = {t["content"] for t in json.load(file)["added_tokens"]}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that the file writes as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(shown)))}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.library.get_vocab(with_added_tokens=True).items() if t not in special}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(max(ranks.values()) + 1, bool)  # tokens that begin with a space or a line end
        self.begins[[i for t, i in ranks.items() if t[:1] in b" \n"]] = True
        self.special, self.late = sorted(special), _later_characters().search
        self.double = re.compile(r"\s\s").search
        self.known = {w: self._whole(w or " ") for w in ("", "\n")}

    def _whole(self, text: str) -> bytes:
        own = self.late(text) or any(map(text.__contains__, self.special))
        return np.array(self.library.encode(text, add_special_tokens=False).ids if own else self.encode(text), "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """ids of words; those that begin a line have the line end before them, all others follow a space."""
        spaced = [w if w[0] == "\n" else " " + w for w in new]
        if self.late("".join(spaced)):
            self.known.update((w, self._whole(t)) for w, t in zip(new, spaced, strict=True) if self.late(t))
            new, spaced = [w for w in new if not self.late(w)], [t for t in spaced if not self.late(t)]
        data = np.array(self.encode("".join(spaced)), "<u4")
        cut = np.append(np.flatnonzero(self.begins[data]), len(data))
        if len(cut) != len(new) + 1:
            raise ValueError("the vocabulary has tokens that go on over white space")
        raw, cut = data.tobytes(), (4 * cut).tolist()
        self.known.update((w, raw[a:b]) for w, a, b in zip(new, cut[:-1], cut[1:], strict=True))

    def documents(self, texts: list[str]) -> list[bytes]:
        known = self.known
        plain = [None if any(map(t.__contains__, self.special)) or self.double(t) or t[-1:].isspace() else ("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        new = list(set(chain.from_iterable(filter(None, plain))).difference(known))
        for at in range(0, len(new), 5_000):
            self._learn(new[at : at + 5_000])
        get = known.__getitem__
        out = [self._whole(t) if words is None else b"".join(map(get, words))[4:] for t, words in zip(texts, plain, strict=True)]
        room = MEMO - len(known)
        for w in new if room < 0 else filter(lambda w: len(w) > WORD, new):
            del known[w]
        return out


@lru_cache(1)
def encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def cut(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece; ``place`` counts the pieces of one length inside the partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, np.int64)
        closing, names = CLOSING.to_bytes(4, "little"), [c.split()[0] for c in PIECES.split(", ")]
        for batch in (p for b in batches for p in parts(b, "text", 1 << 20)):
            data = [d + closing for d in words.documents(batch.column(1).to_pylist())]
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
            each = -(-sizes // CAPACITY)
            doc = np.repeat(np.arange(len(sizes)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            first = (sizes - (each - 1) * CAPACITY)[doc]
            start = np.where(piece > 0, first + (piece - 1) * CAPACITY, 0)
            length = np.where(piece > 0, CAPACITY, first)
            crcs = [zlib.crc32(data[d][a:b]) for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            count = np.bincount(length, minlength=CAPACITY + 1)
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(doc)) - (np.cumsum(count) - count)[length[order]] + seen[length[order]]
            seen += count
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crcs, np.full(len(doc), part, np.int32), place))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, PIECES)


class Plan:
    """Runs of pieces: (length, first of them, how many, first bin, pieces to a bin, offset of a bin's first)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity, self.left, self.taken, self.bins, self.runs = capacity, dict(counts), dict.fromkeys(counts, 0), 0, []
        self.gaps: list[int] = []  # in ascending order
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap: first bin and number of bins
        large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
        self._match(large)
        for n in sorted(set(counts).difference(large), reverse=True):
            self._fill(n)

    def _put(self, length: int, pieces: int, first_bin: int, to_a_bin: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], pieces, first_bin, to_a_bin, offset))
        self.taken[length] += pieces
        self.left[length] -= pieces

    def _new(self, bins: int, used: int) -> int:
        self._leave(self.bins, bins, self.capacity - used)
        self.bins += bins
        return self.bins - bins

    def _leave(self, first_bin: int, bins: int, gap: int) -> None:
        if bins and gap:
            if gap not in self.open:
                insort(self.gaps, gap)
            self.open.setdefault(gap, []).append((first_bin, bins))

    def _match(self, large: list[int]) -> None:
        """``large`` in descending order: each with the largest partner that fits, alone if there is none."""
        for x in large:
            for y in (n for n in large if n <= min(x, self.capacity - x)):
                if pairs := self.left[x] // 2 if y == x else min(self.left[x], self.left[y]):
                    first = self._new(pairs, x + y)
                    self._put(x, pairs, first, 1, 0)
                    self._put(y, pairs, first, 1, x)
            if self.left[x]:
                self._put(x, self.left[x], self._new(self.left[x], x), 1, 0)

    def _fill(self, n: int) -> None:
        """All pieces of one small length: the tightest gaps first, each filled as far as it goes, then new bins."""
        while self.left[n] and (at := bisect_left(self.gaps, n)) < len(self.gaps):
            gap = self.gaps[at]
            first, bins = self.open[gap].pop()
            if not self.open[gap]:
                del self.open[gap], self.gaps[at]
            self._into(n, first, bins, gap)
        if self.left[n]:
            bins = -(-self.left[n] // (self.capacity // n))
            self.bins += bins
            self._into(n, self.bins - bins, bins, self.capacity)

    def _into(self, n: int, first: int, bins: int, gap: int) -> None:
        each = gap // n
        full = min(bins, self.left[n] // each)
        if full:
            self._put(n, full * each, first, each, self.capacity - gap)
            self._leave(first, full, gap - each * n)
        first, bins = first + full, bins - full
        if bins and (rest := self.left[n]):  # fewer than a bin takes
            self._put(n, rest, first, each, self.capacity - gap)
            self._leave(first, 1, gap - rest * n)
            first, bins = first + 1, bins - 1
        self._leave(first, bins, gap)


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece; sequences of one whole piece have negative numbers."""
    pieces = materialize(cut(docs, path), "pieces")
    rest = pieces.where(F.col("length") < CAPACITY)
    each = materialize(rest.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    counts = {r[0]: r[1] for r in each.groupBy("length").agg(F.sum("n")).collect()}  # at most CAPACITY - 1 rows
    runs = np.array(sorted(Plan(counts).runs), np.int64).reshape(-1, 6)
    keys = (runs[:, 0] << 50) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            run = runs[np.searchsorted(keys, (length << 50) + number, "right") - 1]
            at = number - run[:, 1]
            found = [run[:, 3] + at // run[:, 4], run[:, 5] + at % run[:, 4] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=[c.split()[0] for c in PLACED.split(", ")])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = each.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rest.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("number"))
    whole = pieces.where(F.col("length") == CAPACITY)
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.shiftleft(F.col("part").cast("long"), 36) - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.mapInArrow(place, PLACED).union(alone)
