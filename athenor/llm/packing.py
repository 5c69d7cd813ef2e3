"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of 2048 and then one piece for each binary digit of the rest, largest first. Every
piece is a whole sequence of its own: pieces of one length form a bucket, no sequence crosses documents, and as all
lengths are powers of two nothing is padded. Sequences are numbered inside their bucket, so that batches of one length
can be read off as ranges.

Null texts count as empty and give the closing id alone; repeated rows give repeated pieces under sequences of their own, null ids
stay, an empty table gives no pieces, and columns besides doc_id and text are not looked at, whatever their names. Texts of any length are
encoded and cut whole. Strings that the vocabulary has as special tokens are read as the library's plain call reads them.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
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

LONGEST, CLOSING, MEMO = 2048, 1, 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, part int, place long"

#: White space that the libraries and Python see differently, and what the vocabulary may read as a special token: such texts are encoded whole.
_ODD, _SPECIAL = "\x1c\x1d\x1e\x1f\x85", re.compile(r"<\|(?:start|end)oftext\|>", re.I)
_BREAK = b"\xff\xff\xff\xff"


def _later_characters() -> re.Pattern:
    """Characters that came after Unicode 3.2, about which libraries may disagree."""
    old, ranges = unicodedata.ucd_3_2_0.category, []
    for code in range(0x80, 0x110000):
        if old(chr(code)) == "Cn":
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


class WordEncoder:
    """ids of white-space-delimited words as little-endian 32-bit bytes.

    The vocabulary lower-cases, drops white space and never merges across it, so words can be encoded apart. Words and
    pre-tokens met before are kept up to a bound in number and in length; beyond it new ones are encoded again in each block of texts. All new words of
    a block are normalised and split together; unknown pre-tokens are encoded together, and cut apart where tokens end a
    pre-token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {"\n": _BREAK}  # words and pre-tokens alike: a word that is one pre-token has its ids
        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.split = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.late = _later_characters().search

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_tokens(self, new: list[str], known: dict[str, bytes]) -> None:
        ids = np.array(self.whole.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cut) != len(new):
            known.update((t, self.ids(t)) for t in new)
            return
        data, at = ids.tobytes(), 0
        for token, end in zip(new, cut, strict=True):
            known[token] = data[at:end]
            at = end

    def _learn_words(self, new: list[str]) -> list[str]:
        """Adds the words to the known ones; gives the pre-tokens that came along."""
        known = self.known
        joined = "\n".join(new)  # no word has a line end
        if not joined.isascii():
            if self.late(joined):
                late = [w for w in new if self.late(w)]
                known.update((w, self.ids(w)) for w in late)
                new = list(set(new).difference(late))
                joined = "\n".join(new)
            joined = unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3")  # capital sigma becomes the same letter in every place
        if not new:
            return []
        split = self.split(joined.lower())
        unknown = list(set(split).difference(known))
        for at in range(0, len(unknown), 5_000):
            self._learn_tokens(unknown[at : at + 5_000], known)
        known.update(zip(new, b"".join(map(known.__getitem__, split)).split(_BREAK), strict=True))
        return unknown

    def documents(self, texts: list[str]) -> list[bytes]:
        """ids of each whole text."""
        known = self.known
        plain = [None if any(map(t.__contains__, _ODD)) or ("<|" in t and _SPECIAL.search(t)) else t.split() for t in texts]
        new = list(set(chain.from_iterable(filter(None, plain))).difference(known))
        unknown = self._learn_words(new)
        get = known.__getitem__
        out = [self.ids(t) if parts is None else b"".join(map(get, parts)) for t, parts in zip(texts, plain, strict=True)]
        full = len(known) > MEMO
        for w in chain(new, unknown):
            if full or len(w) > WORD:
                known.pop(w, None)
        return out


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def cut_lengths(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the pieces of documents of these many ids, as ``binary_lengths`` gives them."""
    powers = 1 << np.arange(LONGEST.bit_length() - 2, -1, -1)
    digits = (sizes[:, None] % LONGEST & powers) > 0
    full, some = sizes // LONGEST, digits.sum(1)
    doc = np.repeat(np.arange(len(sizes)), full + some)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full + some) - full - some, full + some)
    lengths = np.full(len(doc), LONGEST, np.int64)
    lengths[nth >= full[doc]] = np.broadcast_to(powers, digits.shape)[digits]
    ends = np.cumsum(lengths)
    return doc, ends - lengths - (np.cumsum(sizes) - sizes)[doc], lengths


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece; ``place`` counts the pieces of one bucket inside the partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, counts = encoder(path), TaskContext.get().partitionId(), [0] * (LONGEST.bit_length())
        closing, names = CLOSING.to_bytes(4, "little"), [c.split()[0] for c in PIECES.split(", ")]
        for batch in (p for b in batches for p in parts(b, "text", 1 << 20)):
            data = [d + closing for d in words.documents(batch.column(1).to_pylist())]
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
            doc, start, length = cut_lengths(sizes)
            crcs = [zlib.crc32(data[d][a:b]) for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True)]
            bucket = np.log2(length).astype(np.int32)
            place = np.empty(len(doc), np.int64)
            for k in np.unique(bucket).tolist():
                at = np.flatnonzero(bucket == k)
                place[at] = np.arange(counts[k], counts[k] + len(at))
                counts[k] += len(at)
            columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length, crcs, sizes[doc], bucket, np.full(len(doc), part, np.int32), place))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket for each piece.

    ``sequence_id`` is 16 times the sequence's number in its bucket plus the bucket, the base-2 logarithm of its length.
    """
    cut = materialize(pieces(docs, path), "pieces")
    counts = cut.groupBy("bucket", "part").agg(F.count("*").alias("n"))  # at most 12 rows for each partition
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "part", F.coalesce(before, F.lit(0)).alias("before"))
    joined = cut.join(offsets, ["bucket", "part"])
    return joined.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        ((F.col("before") + F.col("place")) * 16 + F.col("bucket")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "bucket",
    )
