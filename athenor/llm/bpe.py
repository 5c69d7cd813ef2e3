"""Byte-level BPE in padded numpy matrices.

Text is split by the vocabulary's pattern; pre-tokens of similar length share a padded matrix of ids. Each round looks every
neighbouring pair up in one hash table, every row merges its leftmost pair of least rank, and the matrix is compacted; rows
without a pair leave. Pre-tokens and words met before are kept up to a bound in number and in length. Long pre-tokens are cut into rows of the same matrices
and joined again where the tokens on both sides of a cut agree.

Null texts count as empty and have no ids; repeated rows give repeated results, null ids stay, an empty table gives no rows, and columns
besides doc_id and text are not looked at, whatever their names. Decoding joins the tokens' bytes, so it gives back the text's UTF-8.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.llm.common import WORD, parts, whole_text

MEMO, LONG, CUT, JOINT, NONE = 300_000, 48, 32, 4, np.int32(2**31 - 1)

#: Unicode white space, as the pattern's \s has it; Python's own notion has four more.
_SPACE = "\t-\r \x85\xa0  -     　"


class PairTable:
    """Rank of the token that two neighbouring tokens make, by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(8, int(len(rank)).bit_length() + 2)
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key, at = left.astype(np.int64) << 32 | right, None
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] == -1)
            self.keys[at[free]] = key[free]  # of several for one slot the last stays, the others go on
            stays = self.keys[at] == key
            self.ranks[at[stays]] = rank[stays]
            key, rank, at = key[~stays], rank[~stays], (at[~stays] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair makes no token."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out.reshape(left.shape)


class Vocabulary:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:  # a file of the installed package, on every executor
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = dict(sorted((r, t) for t, r in ranks.items()))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        pattern = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.split = regex.compile(pattern).findall
        self.double = regex.compile(f"[{_SPACE}]{{2}}").search
        self.units = regex.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
        self.known: dict[str, bytes] = {}  # pre-tokens
        self.after: dict[str, bytes] = {}  # words after one space
        self.alone: dict[str, bytes] = {}  # any other stretch that begins where a pre-token begins

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """ids of each pre-token."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            longest = len(words[order[start]]) * 5 // 4 + 2
            stop = start
            while stop < len(order) and len(words[order[stop]]) <= longest and (stop - start) * longest < 1 << 20:
                stop += 1
            part = order[start:stop]
            if longest <= LONG:
                self._merge_matrix([words[i] for i in part], part, out)
            else:
                for i, ids in zip(part, self._merge_cut([words[i] for i in part]), strict=True):
                    out[i] = ids
            start = stop
        return out

    def _merge_matrix(self, words: list[bytes], part: list[int], out: list[np.ndarray]) -> None:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        place = np.array(part)
        while len(place):
            rank = np.full((len(place), max(width - 1, 1)), NONE, np.int32)
            if width > 1:
                real = ids[:, 1:] >= 0
                rank[real] = self.pairs.find(ids[:, :-1][real], ids[:, 1:][real])
            best = rank.argmin(1)  # the leftmost of the least
            least = rank[np.arange(len(place)), best]
            over = least == NONE
            for row, i, n in zip(ids[over], place[over].tolist(), sizes[over].tolist(), strict=True):
                out[i] = row[:n].copy()
            ids, place, sizes, best, least = ids[~over], place[~over], sizes[~over], best[~over], least[~over]
            if not len(place):
                return
            ids[np.arange(len(place)), best] = least
            at = np.arange(width - 1)
            ids = np.take_along_axis(ids, at + (at > best[:, None]), 1)  # closes the gap behind the merged pair
            sizes = sizes - 1
            width = int(sizes.max())
            ids = ids[:, :width]

    def _merge_cut(self, words: list[bytes]) -> list[np.ndarray]:
        """Long rows: cut into stretches of CUT bytes that are merged as rows of their own, then neighbours are put together again.

        A sequence is the merges' result if every two neighbouring tokens are neighbours in the result for some stretch of the
        text. So of two stretches only the JOINT tokens on both sides of the cut are merged again, and if the outermost of them
        come out as they were, the rest stands; if not, twice as many tokens are taken.
        """
        pieces = [w[a : a + CUT] for w in words for a in range(0, len(w), CUT)]
        done = self.merge(pieces)
        rows, at = [], 0
        for w in words:
            n = -(-len(w) // CUT)
            rows.append(done[at : at + n])
            at += n
        while any(len(row) > 1 for row in rows):
            todo = [(r, k, JOINT) for r, row in enumerate(rows) for k in range(0, len(row) - 1, 2)]
            joined: dict[tuple[int, int], np.ndarray] = {}
            while todo:
                ends = [(rows[r][k][-n:], rows[r][k + 1][:n]) for r, k, n in todo]
                again = [np.zeros(0, np.int32)] * len(todo)
                order = sorted(range(len(todo)), key=lambda i: len(ends[i][0]) + len(ends[i][1]))
                texts = [b"".join(map(self.tokens.__getitem__, np.concatenate(ends[i]).tolist())) for i in order]
                for a in range(0, len(order), 4_096):
                    self._merge_matrix(texts[a : a + 4_096], order[a : a + 4_096], again)
                wider = []
                for (r, k, n), (left, right), new in zip(todo, ends, again, strict=True):
                    a, b = rows[r][k], rows[r][k + 1]
                    if (n >= len(a) or new[0] == left[0]) and (n >= len(b) or new[-1] == right[-1]):
                        joined[r, k] = np.concatenate([a[: max(0, len(a) - n)], new, b[n:]])
                    else:
                        wider.append((r, k, 2 * n))
                todo = wider
            rows = [[joined[r, k] if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)] for r, row in enumerate(rows)]
        return [row[0] for row in rows]

    def _learn(self, new: list[str], prefix: str, memo: dict[str, bytes]) -> None:
        split = [self.split(prefix + w) for w in new]
        known = self.known
        unknown = list({t for parts in split for t in parts if t not in known})
        known.update(zip(unknown, (i.astype("<u4").tobytes() for i in self.merge([t.encode("utf-8", "replace") for t in unknown])), strict=True))
        get = known.__getitem__
        memo.update((w, b"".join(map(get, parts))) for w, parts in zip(new, split, strict=True))
        for t in unknown if len(known) > MEMO else [t for t in unknown if len(t) > WORD]:
            del known[t]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each whole text as little-endian 32-bit bytes.

        No pre-token goes on over white space after other characters, so words after single spaces can be encoded apart.
        """
        heads, tails = [], []
        for t in texts:
            if self.double(t):
                heads.append(self.units(t))
                tails.append([])
            else:
                first, *rest = t.split(" ")
                heads.append([first])
                tails.append(rest)
        joined = []
        for memo, prefix, stretches in ((self.alone, "", heads), (self.after, " ", tails)):
            new = list({w for parts in stretches for w in parts if w not in memo})
            self._learn(new, prefix, memo)
            get = memo.__getitem__
            joined.append([b"".join(map(get, parts)) for parts in stretches])
            for w in new if len(memo) > MEMO else [w for w in new if len(w) > WORD]:
                del memo[w]
        return [a + b for a, b in zip(*joined, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit numbers) and decoded (their bytes, from the ids) for every row and whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in (p for b in batches for p in parts(b)):
            ids = words.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(words.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
