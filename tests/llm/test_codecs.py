"""Round trips: media, byte-pair encoding, packing, licenses, and the pipeline."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from athenor.llm import avi, bpe, licenses, packing
from athenor.llm.queries import QUERIES
from tests.llm.fixtures import empty, hard, hard_rows

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def reference():
    with open(BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- media ---------------------------------------------------------------------------------------------------------


def test_media_of_hard_rows(spark):
    got = avi.digests(avi.store_texts(hard(spark))).collect()
    want = []
    for i, t, *_ in hard_rows():
        data = (t or "").encode()
        padded = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        want.append((i is None, i or 0, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert avi.digests(avi.store_texts(empty(spark))).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=192, max_size=192 * 8))
def test_any_bytes_survive_a_lossless_frame(data):
    frame = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(1, -1, 16)
    jpeg = avi.encode_lossless(frame)[0]
    assert (avi.decode_frames([jpeg])[0] == frame[0]).all()
    header, scan = avi.split_jpeg(jpeg)
    assert (avi._decode_lossless(header, scan) == frame[0]).all()


def baseline_jpeg(blocks, across):
    """A grey baseline frame from rows of quantised coefficients, each with the shortest code that a flat table gives."""
    counts, values = bytes([0] * 7 + [255] + [0] * 8), bytes(range(255))  # symbol s has the 8-bit code s
    bits, last = "", 0

    def signed(v):
        n = abs(v).bit_length()
        return n, (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")

    for block in blocks:
        n, extra = signed(int(block[0]) - last)
        last = int(block[0])
        bits += format(n, "08b") + extra
        run = 0
        for v in block[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += format(0xF0, "08b")
                run -= 16
            n, extra = signed(int(v))
            bits += format(run << 4 | n, "08b") + extra
            run = 0
        if run:
            bits += format(0, "08b")
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    height, width = 8 * (len(blocks) // across), 8 * across
    seg = avi._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x01" * 64) + seg(0xC4, b"\x00" + counts + values) + seg(0xC4, b"\x10" + counts + values)
    return head + seg(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_baseline_frames_decode():
    rng = np.random.default_rng(0)
    blocks = np.zeros((6, 64), int)
    blocks[:, 0] = rng.integers(-500, 500, 6)
    blocks[:, 1:] = rng.integers(-20, 20, (6, 63)) * (rng.random((6, 63)) < 0.2)
    got = avi.decode_frames([baseline_jpeg(blocks, 3)])[0]
    for k, block in enumerate(blocks):
        square = np.zeros(64)
        square[avi.ZIGZAG] = block
        want = np.clip(np.rint(avi._BASIS @ square.reshape(8, 8) @ avi._BASIS.T + 128), 0, 255)
        assert (got[k // 3 * 8 : k // 3 * 8 + 8, k % 3 * 8 : k % 3 * 8 + 8] == want).all()


def test_shots_become_timed_clips(spark):
    rng = np.random.default_rng(1)
    shots = [(40, 10), (200, 14), (90, 8)]
    frames = np.concatenate([np.clip(rng.normal(m, 4, (n, 16, 16)), 0, 255) for m, n in shots]).astype(np.uint8)
    film = avi.write_avi(avi.encode_lossless(frames), 16, 16, rate=10)
    media = spark.createDataFrame([("a", film), ("b", None)], "name string, data binary")
    got = [(r.name, r.first_frame, r.n_frames, round(r.start_s, 3), round(r.end_s, 3)) for r in avi.clips(media, "name", "data").orderBy("clip").collect()]
    assert got == [("a", 0, 10, 0.0, 1.0), ("a", 10, 14, 1.0, 2.4), ("a", 24, 8, 2.4, 3.2)]


def test_films_without_an_index_are_read():
    film = avi.write_avi(avi.encode_lossless(np.zeros((2, 4, 4), np.uint8)), 4, 4)
    assert len(avi.read_avi(film[: film.rindex(b"idx1")])["frames"]) == len(avi.read_avi(film)["frames"]) == 2


def test_broken_films_give_an_error_row(spark):
    film = avi.write_avi(avi.encode_lossless(np.full((3, 4, 4), 9, np.uint8)), 4, 4)
    unequal = avi.write_avi(avi.encode_lossless(np.zeros((1, 4, 4), np.uint8)) + avi.encode_lossless(np.zeros((1, 8, 4), np.uint8)), 4, 4)
    no_list = film.replace(b"movi", b"none")
    rows = [("few", film[:4]), ("none", b""), ("text", b"not a film at all"), ("list", no_list), ("jpeg", film.replace(b"\xff\xda", b"\xff\x01")), ("half", film[: len(film) // 2]), ("null", None), ("good", film), ("unequal", unequal)]
    got = {}
    for r in avi.clips(spark.createDataFrame(rows, "name string, data binary"), "name", "data").collect():
        got.setdefault(r.name, []).append(r)
    assert set(got) == {n for n, _ in rows} - {"null", "half"} or set(got) == {n for n, _ in rows} - {"null"}
    assert all(got[n][0].error and got[n][0].clip is None for n in ("few", "none", "text", "list", "jpeg"))
    assert [(r.clip, r.n_frames, r.error) for r in got["good"]] == [(0, 3, None)] and got["unequal"][0].n_frames == 2


def test_padding_of_the_last_frame_is_no_shot(spark):
    rng = np.random.default_rng(6)
    letters = list("etaoin shrdlu ")
    docs = spark.createDataFrame([(i, "".join(rng.choice(letters, int(n)))) for i, n in enumerate(rng.integers(3_100, 40_000, 60))], "doc_id long, text string")
    got = avi.digests(avi.store_texts(docs)).collect()
    assert all(r.feature.endswith("shots=1;cuts=") and len(r.clips) == 1 for r in got)
    changing = spark.createDataFrame([(1, "a" * 3_072 * 9 + "Z" * 3_072 * 4)], "doc_id long, text string")
    (row,) = avi.digests(avi.store_texts(changing)).collect()
    assert row.feature == "frames=13;shots=2;cuts=9" and [(c.first_frame, c.n_frames, c.start_s, c.end_s) for c in row.clips] == [(0, 9, 0.0, 9 / 24), (9, 4, 9 / 24, 13 / 24)]


def read_by_hand(film):
    """Samples of a stored film by another way: chunks found from the index, difference codes read bit by bit."""
    count = struct.unpack_from("<Q", film, film.index(b"strd") + 8)[0]
    movi, index, out = film.index(b"movi"), film.rindex(b"idx1"), []
    for at in range(index + 8, index + 8 + struct.unpack_from("<I", film, index + 4)[0], 16):
        place, size = struct.unpack_from("<II", film, at + 8)
        jpeg = film[movi + place + 8 : movi + place + 8 + size]
        table = jpeg.index(b"\xff\xc4")
        counts, values = jpeg[table + 5 : table + 21], jpeg[table + 21 :]
        codes, code, k = {}, 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                codes[format(code, f"0{bits}b")] = values[k]
                code, k = code + 1, k + 1
            code <<= 1
        height, width = struct.unpack_from(">HH", jpeg, jpeg.index(b"\xff\xc3") + 5)
        data = jpeg[jpeg.index(b"\xff\xda") + 10 : -2].replace(b"\xff\x00", b"\xff")
        stream = "".join(format(b, "08b") for b in data)
        frame, place = [], 0
        for i in range(height * width):
            end = place + 1
            while stream[place:end] not in codes:
                end += 1
            n = codes[stream[place:end]]
            extra, place = stream[end : end + n], end + n
            d = 0 if not n else int(extra, 2) if extra[0] == "1" else int(extra, 2) - (1 << n) + 1
            frame.append((d + (128 if i == 0 else frame[i - width] if i % width == 0 else frame[i - 1])) & 0xFFFF)
        out += frame
    return bytes(out[:count])


def test_stored_films_are_read_by_another_reader(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 12")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in avi.store_texts(docs, keep_media=True).collect():
        assert read_by_hand(r.media).rstrip(b" ") == texts[r.doc_id].rstrip(b" ") and hashlib.sha256(r.media).hexdigest() == r.media_sha256


# ---- byte-pair encoding --------------------------------------------------------------------------------------------


def test_bytes_encode_as_the_library_does(spark, reference):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [t or "" for _, t, *_ in hard_rows()]
    words = bpe.vocabulary(BYTE_BPE, public_tokenizers.PATTERN)
    got = words.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
    assert [words.decode(g) for g in got] == [t.encode() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "12", "'s", "'", "\t", "日本", "!", "\xa0", "\x1c", "…\n", "ß"]), max_size=25).map("".join))
def test_any_text_encodes_as_the_library_does(text):
    with open(BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)} if not hasattr(test_any_text_encodes_as_the_library_does, "ref") else None
    if ranks:
        test_any_text_encodes_as_the_library_does.ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = bpe.vocabulary(BYTE_BPE, public_tokenizers.PATTERN)
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == test_any_text_encodes_as_the_library_does.ref.encode_ordinary(text)


def test_long_stretches_without_a_space(reference):
    import random
    import time

    rng = random.Random(8)
    base64_like = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=1_000_000))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))
    few = ["".join(rng.choices(letters, k=rng.randrange(49, 3_000))) for letters in ("ab", "the", "aeinrst", "0123456789", "=-_", "éèa", "のはを") for _ in range(15)]
    words = bpe.Vocabulary(BYTE_BPE, public_tokenizers.PATTERN)
    start = time.time()
    got = words.encode([base64_like])
    assert time.time() - start < 20
    texts = [base64_like[:200_000], chinese, "x" * 30_001, " " * 5_003, "ab" * 9_999, "\n" * 777, *few]
    assert len(got[0]) > 4 * 100_000 and words.decode(got[0]) == base64_like.encode()
    for t, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), t[:40]


def test_full_memos_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    words = bpe.Vocabulary(BYTE_BPE, public_tokenizers.PATTERN)
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in words.encode(["some words here", "words  again"])] == [reference.encode_ordinary(t) for t in ("some words here", "words  again")]


def test_bpe_on_hard_rows(spark, reference):
    got = bpe.digests(bpe.encode(hard(spark), BYTE_BPE, public_tokenizers.PATTERN)).collect()
    want = [(i is None, i or 0, len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in hard_rows()]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.digests(bpe.encode(empty(spark), BYTE_BPE, public_tokenizers.PATTERN)).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


def whole_encoder():
    return Tokenizer.from_file(WORD_BPE)


def check_packing(rows, got):
    t = whole_encoder()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in got)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[i])
        assert {r.doc_tokens for r in by_doc[i]} == {len(ids)} and sum(n for _, n, _ in own) == len(ids)
        at = 0
        for start, n, crc in own:
            assert start == at and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n


def test_packing_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packing([(r.doc_id, r.text) for r in docs.collect()], QUERIES["op4_packing"](spark, "/root/testdata/sf0.001").collect())


def test_packing_of_hard_rows(spark):
    docs = hard(spark)
    got = packing.pack(docs, WORD_BPE)
    assert got.select("sequence_id").distinct().count() == got.count()
    single = [r for r in got.collect() if r.doc_id not in (2, None)]
    check_packing([(i, t) for i, t, *_ in hard_rows() if i not in (2, None)], single)
    assert packing.pack(empty(spark), WORD_BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_words_apart_encode_as_the_whole_text(texts):
    assert packing.encoder(WORD_BPE).documents(texts) == [packing.encoder(WORD_BPE).ids(t) for t in texts]


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "x<|STARTOFTEXT|>y", "ΑΣ ΣΑΣ Σ", "İstanbul ΌΣΟΣ.", "e\u0301 \u0301e", "a\x85b\x1cc", "\U0001fae8 new", "don't 12,5% \u2028 z\u00a0q"])
def test_odd_texts_encode_as_the_plain_call(text):
    want = whole_encoder().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordEncoder(WORD_BPE).documents(["some words", text, text + " more"])[1], "<u4").tolist() == want


@given(st.lists(st.integers(1, 9_000), max_size=6))
def test_many_lengths_at_once(sizes):
    doc, start, length = packing.cut_lengths(np.array(sizes, np.int64))
    want = [(d, n) for d, size in enumerate(sizes) for n in packing.binary_lengths(size)]
    assert list(zip(doc.tolist(), length.tolist(), strict=True)) == want
    assert all(start[i] == (start[i - 1] + length[i - 1] if i and doc[i] == doc[i - 1] else 0) for i in range(len(doc)))


@given(st.integers(1, 100_000))
def test_lengths_are_the_binary_digits(n):
    parts = packing.binary_lengths(n)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and len(set(p for p in parts if p < 2048)) == len([p for p in parts if p < 2048])


# ---- licenses ------------------------------------------------------------------------------------------------------


def test_template_join_against_brute_force():
    import random

    rng = random.Random(0)
    words = sorted({w for _, t in licenses.TEMPLATES for w in licenses.normalised(t).split()})
    index = licenses.TemplateIndex(licenses.TEMPLATES, {w: rng.randint(0, 9) for w in words})
    for _ in range(2_000):
        label, text = rng.choice(licenses.TEMPLATES)
        line = [w for w in licenses.normalised(text).split() if rng.random() < 0.88] + rng.sample(words, rng.randint(0, 5)) + [b"zzz"]
        want = []
        for name, template in licenses.TEMPLATES:
            own = set(licenses.normalised(template).split())
            if len(own & set(line)) * 5 >= 4 * len(own):
                want.append((name, len(own & set(line)) / len(own)))
        assert sorted(index.matches(line)) == sorted(want)


def test_license_rows(spark):
    texts = {1: "It is under the\nMIT license. Under the MIT license", 2: "Licensed under the Apache License, Version 2.0.", 3: "licensed under CC BY-NC 4.0", 4: "nothing here", 5: None,
             6: "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (10, 2, 2, 6, "mit")
    assert (got[2].base_labels, got[2].labels, got[2].n_base) == ("apache-2", "apache-2", 1)
    assert got[3].base_labels == "cc-by-nc" and got[6].base_labels == "" and got[6].labels == "mit" and 0.8 <= got[6].score < 1
    assert all((got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, None, "", 0.0) for i in (4, 5))
    assert licenses.scan(hard(spark)).count() == len(hard_rows()) and licenses.scan(empty(spark)).count() == 0


def test_wrapped_notices_and_near_misses(spark):
    wrapped = {
        "mit": "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n */",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
        "apache-2": "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
        "mpl-2": "This Source Code Form is subject\nto the terms of the Mozilla\nPublic License, v. 2.0.",
        "cc-by": "This work is licensed under a\nCreative Commons Attribution 4.0 International License",
        "cc-by-sa": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License",
        "cc-by-nc": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License",
        "cc0": "To the extent possible under law, the author\nhas waived all copyright and related or\nneighboring rights to this work",
    }
    misses = [
        "Released under the terms of the GNU license", "Licensed under the Apache License, Version 1.0", "This work is licensed under the GNU Free Documentation License, version 1.3",
        "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License. See the GNU General Public License",
        "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.osedu.org/licenses/ECL-2.0", "Licensed under CC BY SA 4.0",
        "This program is free software: you can\n" + "zzz " * 30 + "\nredistribute it and/or modify it under the terms of the " + "zzz " * 30 + "GNU General Public License",
    ]
    texts = [f"some prose\nbefore it\n{t}\nand behind it" for t in [*wrapped.values(), *misses[:-1]]] + [misses[-1]]
    got = [r for _, r in sorted((r.doc_id, r) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())]
    assert [r.labels for r in got[:9]] == list(wrapped) and all(r.score == 1 for r in got[:9])
    assert [r.matches[0].line for r in got[:9]] == [3, *[2] * 8] and all(len(r.matches) == 1 for r in got[:9])
    # of the last, one line has 15 of the 16 words needed
    assert [r.labels for r in got[9:]] == [""] * len(misses)


def test_stretches_against_all_stretches():
    import random

    rng = random.Random(1)
    index = licenses.TemplateIndex(licenses.TEMPLATES, {w: 1 for _, t in licenses.TEMPLATES for w in licenses.normalised(t).split()})
    for _ in range(300):
        words = []
        for _ in range(3):
            words += [rng.choice([b"zzz", b"sharealike", b"noncommercial", b"license", b"affero"]) for _ in range(rng.randint(0, 4))]
            for w in licenses.normalised(rng.choice(licenses.TEMPLATES)[1]).split():
                words += [w] * (rng.random() < 0.9) + [rng.choice([b"zzz", b"noncommercial", b"lesser"])] * (rng.random() < 0.04)
        found = list(index.stretches(words, licenses._joined(words)))
        want = {}
        for t, (own, length) in enumerate(index.spans):
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + length) + 1):
                    part = words[a:b]
                    joined = licenses._joined(part)
                    if len(own.intersection(part)) >= index.templates[t][2] and index.decided(t, joined) and not any(r in joined for r in index.rivals[t]):
                        want[t] = max(want.get(t, 0), len(own.intersection(part)) / len(own))
        assert want == {t: max(c for u, c, *_ in found if u == t) for t in {f[0] for f in found}}


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import re

    import corpus_pipeline
    from athenor.functions.storage import materialize, table
    from tests.llm.test_dedup import brute_near

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], folder), name))
    clean, good, unique, apart, packed = kept[1:]
    assert all(k.columns == docs.columns for k in kept[:-1])
    before = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in good.collect()]
    first = {}
    for i, t in sorted(before):
        first.setdefault(t, i)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(first.values())
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c in brute_near([(r.doc_id, r.text) for r in unique.collect()])})
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in apart.collect()}
    assert clean.count() > 0.7 * docs.count() and good.count() > 0.6 * docs.count()
    rows = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert rows == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_base_places_of_documents_by_brute_force(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            own = phrase.encode().split()
            found = [i for i in range(len(words)) if words[i] == own[0] and words[i : i + len(own)] == own]
            places += found
            labels |= {label} if found else set()
        row = got[r.doc_id]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(row.labels.split(",")) and 0 <= row.score <= 1 and (row.score > 0) == (row.labels != "")


def test_very_long_text_of_phrases(spark):
    import time

    text = "Licensed under the MIT License. " * 300_000  # 9.6 MB, one line
    start = time.time()
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (1_500_000, 300_000, 1, 1_499_996) and time.time() - start < 60


@pytest.mark.parametrize(("text", "labels"), [("released under the terms of the GPL license", ""), ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc")])
def test_templates_of_other_families_are_not_met(spark, text, labels):
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.labels == labels
