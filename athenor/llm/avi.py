"""Motion-JPEG in AVI: writing, reading through the RIFF index, intra decoding, and shots.

``read_avi`` follows ``idx1`` to the frames. ``decode_frames`` decodes baseline (SOF0, to its first component) and lossless
(SOF3, predictor 1, one component) frames. The writer stores 8-bit samples losslessly: its Huffman code for the difference
category s has 10 - s bits, so that a category with its s further bits always takes 10 bits, and whole films are coded and
decoded as matrices; so a stored file is a quarter larger than its samples. Shots end where the histogram difference of neighbouring
frames exceeds what the frames before it showed, by their mean and deviation.

A text is stored as its UTF-8 bytes with spaces up to a positive multiple of 192, in grey frames of 64 x 48 samples; an ``strd``
chunk says how many samples of the last frame count, and only those enter histograms. Null counts as empty, that is 192 spaces; equal texts
give equal files, repeated rows repeated results, null ids stay, an empty table gives no rows, and columns besides doc_id and text are not
looked at, whatever their names. Texts of any length are stored whole. A null file has no clips; a file that cannot be read or decoded has
one row with ``error`` instead of a clip.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.llm.common import parts, whole_text

WIDTH, HEIGHT, RATE, UNIT, LARGEST_FRAME = 64, 48, 24, 192, 1 << 26
BINS, WINDOW, FLOOR, SPREAD = 32, 8, 0.30, 3.0
STORED = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames int, clips array<struct<first_frame:int,n_frames:int,start_s:double,end_s:double>>"
CLIP = pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])

#: Fixed values of the format: coefficients by diagonal order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


# ---- JPEG ----------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _canonical(counts: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(code, bits, value) of a Huffman table."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, bits, values[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_COUNTS, _VALUES = bytes([0] + [1] * 9 + [0] * 6), bytes(range(8, -1, -1))


@lru_cache
def _ten_bit_tables() -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit word of each difference from -255, and difference of each word."""
    word, diff = np.zeros(511, np.uint64), np.zeros(1024, np.int16)
    for code, _, s in _canonical(_COUNTS, _VALUES):
        for extra in range(1 << s):
            d = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            w = code << s | extra
            diff[w] = d
            if -255 <= d <= 255:
                word[d + 255] = w
    return word, diff


def _lossless_header(width: int, height: int) -> bytes:
    return b"\xff\xd8" + _segment(0xC4, b"\x00" + _COUNTS + _VALUES) + _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """One JPEG for each of (n, height, width) 8-bit frames; height * width must be a multiple of 4."""
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    w = _ten_bit_tables()[0][d.reshape(n, -1, 4) + 255]
    packed = w[:, :, 0] << np.uint64(30) | w[:, :, 1] << np.uint64(20) | w[:, :, 2] << np.uint64(10) | w[:, :, 3]
    data = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(n, -1, 8)[:, :, 3:]).reshape(n, -1)
    head = _lossless_header(width, height)
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in data]


class JpegHeader:
    """What stands before the entropy-coded data."""

    def __init__(self, head: bytes) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, list] = {}
        self.restart, at = 0, 2
        while at < len(head):
            marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body, at = head[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    self.quant[n] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + 64 * (wide + 1) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = _canonical(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1, 0xC3):
                self.kind, self.depth = marker, body[0]
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                if not 0 < self.height * self.width <= LARGEST_FRAME:
                    raise ValueError(f"frame of {self.width} x {self.height}")
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                self.predictor = body[1 + 2 * body[0]]
        if not hasattr(self, "kind") or not hasattr(self, "scan"):
            raise ValueError("only baseline and lossless JPEG frames can be decoded")

    def lookup(self, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits and value of the code that begins each 16-bit word."""
        bits, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for code, n, v in self.huffman[table]:
            bits[code << (16 - n) : (code + 1) << (16 - n)], value[code << (16 - n) : (code + 1) << (16 - n)] = n, v
        return bits, value


@lru_cache(64)
def jpeg_header(head: bytes) -> JpegHeader:
    return JpegHeader(head)


def split_jpeg(data: bytes) -> tuple[JpegHeader, bytes]:
    """Header, and the data up to the end marker."""
    at = 2
    while data[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return jpeg_header(data[:at]), data[at : data.rindex(b"\xff\xd9")]


def _decode_ten_bit(header: JpegHeader, scans: list[bytes]) -> np.ndarray:
    n = len(scans)
    raw = np.frombuffer(b"".join(s.replace(b"\xff\x00", b"\xff") for s in scans), np.uint8).reshape(n, -1, 5)
    wide = np.zeros((n, raw.shape[1], 8), np.uint8)
    wide[:, :, 3:] = raw
    packed = wide.reshape(n, -1).view(">u8").astype(np.int64)
    words = np.stack([packed >> 30, packed >> 20 & 1023, packed >> 10 & 1023, packed & 1023], axis=2)
    d = _ten_bit_tables()[1][words].reshape(n, header.height, header.width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)


class _Bits:
    def __init__(self, data: bytes) -> None:
        data = data.replace(b"\xff\x00", b"\xff")
        self.number, self.left = int.from_bytes(data + b"\xff\xff\xff\xff", "big"), 8 * len(data) + 32

    def peek(self, n: int) -> int:
        return self.number >> (self.left - n) & ((1 << n) - 1)

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        word = self.peek(16)
        self.left -= int(table[0][word])
        return int(table[1][word])

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek(n)
        self.left -= n
        return v if v >> (n - 1) else v - (1 << n) + 1


_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _decode_baseline(h: JpegHeader, data: bytes) -> np.ndarray:
    """First component's samples; the others are read over."""
    most_h, most_v = max(p[0] for p in h.parts.values()), max(p[1] for p in h.parts.values())
    across, down = -(-h.width // (8 * most_h)), -(-h.height // (8 * most_v))
    single = len(h.scan) == 1
    if single:
        across, down = -(-h.width // 8), -(-h.height // 8)
    tables = {c: (h.lookup(dc), h.lookup(16 | ac)) for c, dc, ac in h.scan}
    first = h.scan[0][0]
    fh, fv = (1, 1) if single else h.parts[first][:2]
    out = np.zeros((down * fv * 8, across * fh * 8))
    parts = [p for p in _restarts(data)] if h.restart else [data]
    mcu = 0
    for part in parts:
        bits, last = _Bits(part), dict.fromkeys(h.parts, 0)
        for _ in range(h.restart or across * down):
            if mcu == across * down:
                break
            my, mx = divmod(mcu, across)
            mcu += 1
            for c, _, _ in h.scan:
                ch, cv, q = h.parts[c]
                dc, ac = tables[c]
                for v in range(1 if single else cv):
                    for u in range(1 if single else ch):
                        block = np.zeros(64)
                        last[c] += bits.signed(bits.symbol(dc))
                        block[0], k = last[c], 1
                        while k < 64:
                            rs = bits.symbol(ac)
                            if rs == 0:
                                break
                            k += rs >> 4
                            if rs & 15:
                                block[k] = bits.signed(rs & 15)
                            k += 1
                        if c == first:
                            square = np.zeros(64)
                            square[ZIGZAG] = block * h.quant[q]
                            y, x = (my * fv + v) * 8, (mx * fh + u) * 8
                            out[y : y + 8, x : x + 8] = _BASIS @ square.reshape(8, 8) @ _BASIS.T + 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[: h.height, : h.width]


def _restarts(data: bytes) -> list[bytes]:
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [*out, data[start:]]


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame; frames that share the ten-bit code and a size are decoded together. ValueError for a broken frame."""
    out: list = [None] * len(jpegs)
    together: dict[int, tuple[JpegHeader, list[int], list[bytes]]] = {}
    try:
        for i, data in enumerate(jpegs):
            header, scan = split_jpeg(data)
            if header.kind != 0xC3:
                out[i] = _decode_baseline(header, scan)
            elif header.huffman.get(0) == _canonical(_COUNTS, _VALUES) and header.predictor == 1 and len(header.parts) == 1:
                kept = together.setdefault(id(header), (header, [], []))
                kept[1].append(i)
                kept[2].append(scan)
            else:
                out[i] = _decode_lossless(header, scan)
        for header, at, scans in together.values():
            for i, frame in zip(at, _decode_ten_bit(header, scans), strict=True):
                out[i] = frame
    except (IndexError, KeyError, struct.error, AttributeError) as broken:
        raise ValueError(f"broken JPEG frame: {broken}") from broken
    return out


def _decode_lossless(h: JpegHeader, data: bytes) -> np.ndarray:
    """Any Huffman code, sample by sample."""
    if h.predictor != 1 or len(h.parts) != 1:
        raise ValueError("lossless frames need predictor 1 and one component")
    bits, table = _Bits(data), h.lookup(h.scan[0][1] if h.scan[0][1] in h.huffman else 0)
    out = np.zeros((h.height, h.width), np.int64)
    for y in range(h.height):
        for x in range(h.width):
            before = out[y, x - 1] if x else out[y - 1, 0] if y else 1 << (h.depth - 1)
            out[y, x] = before + bits.signed(bits.symbol(table)) & 0xFFFF
    return out.astype(np.uint8)


# ---- RIFF ----------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(jpegs: list[bytes], width: int, height: int, rate: int = RATE, extra: bytes = b"") -> bytes:
    """One video stream with an ``idx1`` index; ``extra`` goes to ``strd``."""
    largest = max(map(len, jpegs), default=0)
    movi, index, at = [], [], 4
    for data in jpegs:
        part = _chunk(b"00dc", data)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(data)))
        movi.append(part)
        at += len(part)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(jpegs), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(jpegs), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture) + (_chunk(b"strd", extra) if extra else b""))
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places; lists give their type as the name."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        start, stop = at + 8, min(at + 8 + size, end)
        yield (data[start : start + 4], start + 4, stop) if name in (b"LIST", b"RIFF") else (name, start, stop)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> dict:
    """rate, width, height, extra and the frames of the first video stream, in the order of the index. ValueError for a broken file."""
    try:
        return _read_avi(data)
    except (IndexError, struct.error) as broken:
        raise ValueError(f"broken AVI file: {broken}") from broken


def _read_avi(data: bytes) -> dict:
    found: dict = {"extra": b"", "frames": [], "rate": float(RATE)}
    (kind, start, end), *_ = [*_chunks(data, 0, len(data)), (b"", 0, 0)]
    if kind != b"AVI ":
        raise ValueError("not an AVI file")
    inside, entries = None, None
    for name, a, b in _chunks(data, start, end):
        if name == b"hdrl":
            for n, c, d in _chunks(data, a, b):
                if n == b"avih":
                    found["rate"] = 1e6 / max(1, struct.unpack_from("<I", data, c)[0])
                    found["width"], found["height"] = struct.unpack_from("<II", data, c + 32)
                elif n == b"strl":
                    for m, e, f in _chunks(data, c, d):
                        if m == b"strh" and data[e : e + 4] == b"vids":
                            scale, per = struct.unpack_from("<II", data, e + 20)
                            found["rate"] = max(1, per) / max(1, scale)
                        elif m == b"strd":
                            found["extra"] = data[e:f]
        elif name == b"movi":
            inside = a - 4, b
        elif name == b"idx1":
            entries = [struct.unpack_from("<4sIII", data, at) for at in range(a, b - 15, 16)]
    if inside is None:
        raise ValueError("an AVI file without frames' list")
    if entries is None:
        found["frames"] = [data[a:b] for name, a, b in _chunks(data, inside[0] + 4, inside[1]) if name[2:] in (b"dc", b"db")]
        return found
    base = 0 if entries and data[entries[0][2] : entries[0][2] + 4] == entries[0][0] else inside[0]  # offsets may be absolute
    found["frames"] = [data[base + at + 8 : base + at + 8 + size] for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
    return found


# ---- shots ---------------------------------------------------------------------------------------------------------


def histogram_differences(frames: list[np.ndarray] | np.ndarray, used: list[int] | None = None) -> np.ndarray:
    """Half the absolute difference of neighbouring frames' histograms, each as shares of its samples; 0 for the first frame.

    Of a frame only its first ``used`` samples count; frames may differ in size.
    """
    shares = np.zeros((len(frames), BINS))
    for i, frame in enumerate(frames):
        samples = frame.reshape(-1)[: None if used is None else used[i]]
        shares[i] = np.bincount(samples >> 3, minlength=BINS) / max(1, len(samples))
    return np.append(np.zeros(min(1, len(frames))), np.abs(np.diff(shares, axis=0)).sum(1) / 2)


def shot_cuts(differences: np.ndarray) -> list[int]:
    """Frames that begin a new shot: over FLOOR and over mean + SPREAD deviations of up to WINDOW differences since the last cut."""
    cuts, since = [], 1
    for i in np.flatnonzero(differences > FLOOR).tolist():
        before = differences[max(since, i - WINDOW) : i]
        if not len(before) or differences[i] > before.mean() + SPREAD * max(before.std(), 0.01):
            cuts.append(i)
            since = i + 1
    return cuts


def shots(film: dict, frames: list[np.ndarray] | np.ndarray) -> list[tuple[int, int, float, float]]:
    """(first_frame, n_frames, start_s, end_s) of each shot; an eight-byte ``strd`` says how many samples of the film count."""
    if not len(frames):
        return []
    sizes = [f.size for f in frames]
    if len(film["extra"]) == 8 and sum(sizes[:-1]) < (count := struct.unpack("<Q", film["extra"])[0]) < sum(sizes):
        sizes[-1] = count - sum(sizes[:-1])
    cuts = shot_cuts(histogram_differences(frames, sizes))
    return [(a, b - a, a / film["rate"], b / film["rate"]) for a, b in zip([0, *cuts], [*cuts, len(frames)], strict=True)]


def clips(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, clip, first_frame, n_frames, start_s, end_s, error) for each shot of the AVI files in a binary column.

    Null files and files without frames have no row; one that cannot be read has a row with ``error`` and nothing else.
    """
    names = [key, "clip", "first_frame", "n_frames", "start_s", "end_s", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column(1)):
                if not data.is_valid:
                    continue
                try:
                    film = read_avi(data.as_py())
                    found = [(k, *shot, None) for k, shot in enumerate(shots(film, decode_frames(film["frames"])))]
                except ValueError as broken:
                    found = [(*[None] * 5, str(broken))]
                at += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double, error string")


# ---- texts as films ------------------------------------------------------------------------------------------------


def films(texts: list[str]) -> list[tuple[int, bytes]]:
    """Number of UTF-8 bytes and AVI file of each text."""
    sizes, parts, used = [], [], []
    area = WIDTH * HEIGHT
    for text in texts:
        data = text.encode("utf-8", "replace")
        size = max(UNIT, -(-len(data) // UNIT) * UNIT)
        sizes.append((len(data), size))
        parts.append(data.ljust(size, b" ").ljust(-(-size // area) * area, b"\0"))
        used.append(-(-size // area))
    jpegs, at, out = encode_lossless(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, HEIGHT, WIDTH)), 0, []
    for (n, size), frames in zip(sizes, used, strict=True):
        out.append((n, write_avi(jpegs[at : at + frames], WIDTH, HEIGHT, extra=struct.pack("<Q", size))))
        at += frames
    return out


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """STORED for every row and whole text, all read back from the file; with ``keep_media`` the file itself as ``media``."""
    names = [c.split()[0] for c in STORED.split(", ")] + ["media"] * keep_media
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.list_(CLIP), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text", 1 << 20)):
            stored = films(batch.column(1).to_pylist())
            read = [read_avi(data) for _, data in stored]
            frames = np.stack(decode_frames([f for r in read for f in r["frames"]]))
            at, rows = 0, []
            for doc_id, (n, data), film in zip(batch.column(0).to_pylist(), stored, read, strict=True):
                own = frames[at : at + len(film["frames"])]
                payload = own.tobytes()[: struct.unpack("<Q", film["extra"])[0]]
                found = [dict(zip(CLIP.names, shot, strict=True)) for shot in shots(film, own)]
                rows.append((doc_id, n, payload, len(data), hashlib.sha256(data).hexdigest(), len(own), found, data)[: len(names)])
                at += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    source = whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return source.mapInArrow(run, STORED + ", media binary" * keep_media)


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips (each shot with its times)."""
    cuts = F.concat_ws(",", F.transform(F.expr("slice(clips, 2, greatest(size(clips) - 1, 0))"), lambda c: c["first_frame"].cast("string")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("frames=%d;shots=%d;cuts=%s", F.col("n_frames"), F.size("clips"), cuts).alias("feature"),
        "clips",
    )
