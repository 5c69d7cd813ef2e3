"""Best-fit packing, the prefix trie and the divergence audit against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from athenor.functions.storage import table
from athenor.llm import best_fit, divergence, prefix_trie
from athenor.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import empty, hard, hard_rows
from tests.oracle import both

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_divergence"])
def test_query_equals_sql(spark, name):
    left, right = both(spark, FOLDER, QUERIES[name], ORACLES[name])
    assert left == right and left


# best-fit packing


def library_ids(text):
    return library_ids.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


library_ids.tokenizer = Tokenizer.from_file(VOCABULARY)


def check_packed(rows, packed):
    """Every id of every row in exactly one piece, sequences gapless and within bounds, only long documents cut."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        assert 1 <= r.length <= 1024
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(list)
    for doc_id, text in rows:
        ids = library_ids(text)
        first = (len(ids) - 1) % 1024 + 1
        bounds = [(0, first), *((a, 1024) for a in range(first, len(ids), 1024))]
        wanted[doc_id] += [(k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(bounds)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return sequences


def test_best_fit_packs_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    sequences = check_packed(rows, QUERIES["op11_best_fit"](spark, FOLDER).collect())
    total = sum(n for held in sequences.values() for _, n in held)
    assert len(sequences) <= 1.02 * total / 1024 + 1


def test_best_fit_hard_rows(spark):
    packed = best_fit.pack(hard(spark), VOCABULARY)
    check_packed([r[:2] for r in hard_rows()], packed.collect())
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert best_fit.pack(empty(spark), VOCABULARY).collect() == []


@given(st.lists(st.text(alphabet=" \n\tab1'é日😀.　\x1c\U00010d40", max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_are_encoded_as_the_library_encodes_texts(texts):
    texts += ["<|endoftext|> a", "a<|endoftext|>", "it's\nso"]
    got = best_fit.encoder(VOCABULARY).documents(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library_ids(t)[:-1] for t in texts]


def test_words_without_spaces_leave_the_memo(spark):
    encoder = best_fit.encoder(VOCABULARY)
    encoder.documents(["".join(chr(0x4E00 + (i * j) % 20_000) for i in range(300)) for j in range(1, 40)])
    assert max(map(len, encoder.known)) <= best_fit.WORD


def plain_bins(lengths, capacity):
    """The same rules, one piece after the other."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    bins = []
    while large:
        x = large.pop(0)
        y = next((i for i, n in enumerate(large) if n <= capacity - x), None)
        bins.append([x] if y is None else [x, large.pop(y)])
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(capacity - sum(b) for b in bins)


@given(st.sampled_from([7, 10, 31, 100, 1024]).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c - 1), st.integers(1, 9), max_size=12))))
@settings(max_examples=200, deadline=None)
def test_plan_places_each_piece_as_the_plain_rules_do(case):
    capacity, counts = case
    bins = defaultdict(list)
    numbers = defaultdict(set)
    for length, number, pieces, first, to_a_bin, offset in best_fit.Plan(counts, capacity).runs:
        for i in range(pieces):
            bins[first + i // to_a_bin].append((offset + i % to_a_bin * length, length))
            numbers[length].add(number + i)
    assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(v)) for k, v in counts.items()}
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in held) for held in bins.values()) == plain_bins([n for n, k in counts.items() for _ in range(k)], capacity)


# prefix trie


def plain_trie(rows):
    def key(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, key(role or "", text or ""), (role or "", text or "")))
    turns = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(head, [])[:h] + own[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in whole.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below[node] = [sum(below[k][0] for k in children[node]) or 1, (len(members[node]) - 1) * words + sum(below[k][1] for k in children[node])]
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), *below[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def trie_rows(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, n int"


def made_conversations():
    rng = random.Random(5)
    rows = [(40, t, "user", f"a long one {t}", "k", 1) for t in range(200)]
    rows += [(c, t, "user", f"a long one {t}" if t < stop else f"other {c}", "k", 1) for c, stop in ((41, 64), (42, 128), (43, 129), (44, 64), (60, 63)) for t in range(stop + rng.choice([0, 1, 70]))]
    rows += [(c, t, rng.choice(["user", None]), rng.choice(["x", "y z", None, "", " "]), "k", 1) for c in range(100, 260) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}", "k", 1) for c in range(300, 420) for t in range(5)]
    rows += [(500, None, "user", "tie"), (500, None, None, "tie"), (500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "user", "a"), (None, 1, "user", "nobody"), (-7, 0, "user", "below zero"), (521, 0, "user", "without a head"), (2**62, 3, "é", "日本 \x85 ok")]
    rows = [r if len(r) == 6 else (*r, "k", 1) for r in rows]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1, 7, 50_000])
def test_trie_equals_plain_trie(spark, shard):
    rows = made_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    assert trie_rows(prefix_trie.nodes(prefix_trie.rebuilt(df), shard)) == plain_trie([r[:4] for r in rows])


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame([], CONVERSATIONS))).collect() == []
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(turnless, 0, "user", "gone")]
    got = trie_rows(prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame([(*rows[0], "k", 1)], CONVERSATIONS))))
    assert got == plain_trie(rows) and len(got) == 1


def test_trie_equals_sql_on_hard_conversations(spark, tmp_path):
    spark.createDataFrame([r for r in made_conversations() if (r[0] or 0) >= 0 and r[0] not in (40, 41, 42, 43, 44)], CONVERSATIONS).coalesce(1).write.parquet(str(tmp_path / "c"))
    (next((tmp_path / "c").glob("part*.parquet"))).rename(tmp_path / "conversations.parquet")
    left, right = both(spark, str(tmp_path), QUERIES["op12_prefix_trie"], ORACLES["op12_prefix_trie"])
    assert left == right and left


def test_double_array_holds_what_was_put():
    rng = random.Random(3)
    trie, put = prefix_trie.DoubleArray(), {}
    states = [0]
    for _ in range(800):
        symbols = rng.sample(range(1, 2_000), rng.choice([1, 1, 1, 2, 5, 40]))
        state = states.pop(0)
        trie.put(state, symbols)
        for a in symbols:
            put[state, a] = trie.base[state] + a
        states += [put[state, a] for a in symbols]
    assert len(set(put.values())) == len(put)
    assert all(trie.check[slot] == state for (state, _), slot in put.items())
    assert len(trie.check) < 16 * len(put) + 2 * 2_000  # random children, the worst to place


# divergence


def plain_audit(rows):
    docs = [((lang or ""), (source or ""), re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 10]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        total = sum(counts.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        shares = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        of_lang = {t: share(total, t) for t in kept}
        for s, p in shares.items():
            pair = [(-sum(f(p[t], q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            term = [(-f(p[t], of_lang[t]), t) for t in kept if counts[s][t] and p[t] > of_lang[t]]
            for part, found, top in (("pair", pair, None), ("term", term, 10)):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


DOCUMENTS = "doc_id long, text string, lang string, source string, term string, n int"


def test_audit_equals_plain_audit(spark):
    rng = random.Random(9)
    words = ["The", "the", "CAFÉ", "café", "日本", "x-y", "a1b", "naïve", "zz", "word"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "é"]), "t", 1) for i in range(160)]
    rows += [(1, None, "en", "none", "t", 1), (None, "", "en", "none", "t", 1), (2, "only two terms", "de", "a", "t", 1), (3, None, "de", "b", "t", 1), (4, "alone", "it", "a", "t", 1)]
    rows += [(5, f"the word {i}", "many", f"s{i}", "t", 1) for i in range(150)]  # sources of three blocks
    got = divergence.audit(spark.createDataFrame(rows, DOCUMENTS).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit([r[1:4] for r in rows])


def test_audit_of_hard_rows_and_of_nothing(spark):
    got = sorted(map(tuple, divergence.audit(hard(spark)).collect()))
    assert got == plain_audit([(r[1], r[2], r[3]) for r in hard_rows()])
    assert divergence.audit(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_shares_are_exact_where_64_bits_are_not_enough(spark):
    from pyspark.sql import functions as F

    n, total, terms = 9_000_000_000_000_000, 9_100_000_000_000_003, 7
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 1_000_000_000 * (n + 2) // (total + 2 * terms)
