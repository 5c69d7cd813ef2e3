"""Trained operators: held-out accuracy, exact sums and hard rows."""

import collections
import math
import resource
import zlib

import numpy as np
import pyarrow as pa
import pytest

from athenor.llm import html_crf, language_model, quality, toxicity
from athenor.llm.queries import QUERIES
from tests.llm.fixtures import empty, hard

FOLDER = "/root/testdata/sf0.01"


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "threshold"), [("op1_toxicity", "toxic", 5, 0, 0.5), ("op7_quality_classifier", "quality", 4, 2, 0.7)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, rest, threshold):
    got = {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == held(i, modulus, rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for i, r in got.items())
    right = [got[i].predicted == y for i, y in labels.items() if held(i, modulus, rest)]
    assert len(right) > 30 and np.mean(right) >= 0.9


def _labels(spark, column):
    return spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 0), (6, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").select("doc_id", column)


@pytest.mark.parametrize(("module", "apply", "keep", "column"), [(toxicity, toxicity.toxicity, toxicity.keep_clean, "toxic"), (quality, quality.quality, quality.keep_good, "quality")])
def test_classifiers_on_hard_rows(spark, module, apply, keep, column):
    labels = _labels(spark, column)
    docs = hard(spark)
    assert apply(docs, labels).count() == docs.count()
    assert all(r.score is not None for r in apply(docs, labels).collect())
    assert keep(docs, labels).columns == docs.columns
    assert apply(empty(spark), labels).count() == 0
    assert apply(docs, labels.limit(0)).count() == docs.count()


def test_long_texts_score_alike_wherever_their_parts_are_cut():
    model = quality.QualityModel(np.random.default_rng(0).normal(size=quality.BUCKETS), 0.0)
    long = " ".join(f"w{i % 613}" for i in range(350_000))
    words = long.encode().split()
    s, n, h = model.words(words)
    want = (s.sum() + model.moves[quality.pair_buckets(h)].sum()) / (n.sum() + len(words) - 1)
    for before in ([], ["a b"], ["x " * 150_000], ["", "y " * 90_000, ""]):
        got = model.scores([*before, long, "z", long])
        assert np.allclose(got[[len(before), -1]], 1 / (1 + np.exp(-want)), rtol=1e-12)


def test_offending_sentences_are_located():
    clean = ["a fine day. the sun shines", "we walk home. it rains!", "books are good"] * 20
    bad = ["a fine day. you dolt! the sun shines", "you dolt. it rains", "books are good. you dolt"] * 20
    model = toxicity.fit(clean + bad, np.array([0] * 60 + [1] * 60))
    score, n, found = toxicity.score_text(model.bias, toxicity.WordWeights(model.weights), "Ünter us. You DOLT! the sun")
    assert score > 0.5 and n == 3 and [("Ünter us. You DOLT! the sun".encode()[f["start"] : f["end"]]).strip() for f in found] == [b"You DOLT"]


def test_language_model_sums(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    counts, n = collections.Counter(), 0
    for i, t in docs:
        if not held(i, 7, 2):
            counts.update(t.encode().lower().split())
            n += 1
    total, distinct = sum(counts.values()) + n, len(counts) + 1
    got = {r.doc_id: r for r in QUERIES["op2_language_model"](spark, "/root/testdata/sf0.001").collect()}
    for i, t in docs:
        w = t.encode().lower().split()
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(counts[x] for x in w), n])
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].n_tokens == len(w) + 1 and got[i].train_tokens == total
        assert got[i].n_known == sum(x in counts for x in w) + 1 and got[i].held_out == held(i, 7, 2)
    out = [r for i, r in got.items() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_on_hard_rows(spark):
    docs = hard(spark)
    got = language_model.language_model(docs).collect()
    assert len(got) == docs.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert language_model.language_model(empty(spark)).count() == 0


def test_rare_words_beyond_the_head_come_by_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 50}" for k in range(20))) for i in range(60)], "doc_id long, text string")
    whole = {r.doc_id: r for r in language_model.language_model(docs).collect()}
    monkeypatch.setattr(language_model, "HEAD", 5)
    few = {r.doc_id: r for r in language_model.language_model(docs).collect()}
    assert all(math.isclose(whole[i].base_score, few[i].base_score, rel_tol=1e-9) and whole[i].n_known == few[i].n_known for i in whole)


def test_language_model_on_parts_without_any_word(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \t\n")], "doc_id long, text string").coalesce(1)
    got = language_model.language_model(docs).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 1), (2, 1), (3, 1)] and all(r.score <= 0 for r in got)


def test_words_and_kinds_of_whole_columns():
    texts = [" Ab\x0bC\x0c ", "", "x", "a\x1cB\x85c\xa0d\u2003\u00c9 \u00e9", "\x00 \x00\x00", " \n", "aZ" * 40_000]
    for column in (pa.array(texts), pa.array(["other words", *texts, "behind"]).slice(1, len(texts))):
        words, sizes = language_model.words_in(column)
        assert words.to_pylist() == [w for t in texts for w in language_model.words_of(t)] and sizes.tolist() == [len(language_model.words_of(t)) for t in texts]
        for part in (words, words.slice(2)):
            assert language_model.kinds_of(part).tolist() == [language_model.kind_of(w) for w in part.to_pylist()]
    assert len(language_model.kinds_of(pa.array([], pa.binary()))) == 0


def test_counts_handed_on_early_add_up(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(50))) for i in range(80)], "doc_id long, text string")
    whole, early = ({bytes(r.word): r.n for r in language_model.word_counts(docs, most).collect()} for most in (500_000, 3))
    assert whole == early == collections.Counter(w for r in docs.collect() for w in language_model.words_of(r.text))


def test_windows_use_the_same_memory_again():
    rng = np.random.default_rng(6)
    flat = language_model.start(rng.random(language_model.CLASSES * language_model.MEMBERS))
    pieces = [rng.integers(0, 900, 24 * 8 + 1) for _ in range(512)]

    def faults(f):
        f()  # has the memory from here on
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        f()
        return resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before

    ids = np.ascontiguousarray(np.array(pieces).T)
    live, h = np.full(language_model.WINDOW, len(pieces)), np.zeros((len(pieces), language_model.STATE), np.float32)
    windows = range(0, 24 * 8, language_model.WINDOW)
    # six arrays of 200 pages each are made for the recurrence of one such window alone
    assert faults(lambda: [language_model.gradient(flat, ids[w : w + 24], ids[w + 1 : w + 25], live, h) for w in windows]) < 600 * len(windows)


def test_network_is_a_distribution():
    rng = np.random.default_rng(0)
    ids = np.arange(language_model.CLASSES * language_model.MEMBERS)
    for scale in (1, 60):  # the second could overflow
        p = language_model.views(language_model.start(rng.random(len(ids))) * np.float32(scale))
        states = language_model._with_one(np.repeat(rng.uniform(-1, 1, (1, language_model.STATE)).astype(np.float32), len(ids), 0))
        assert math.isclose(np.exp(language_model.Output(p, states, ids).logs().astype(np.float64)).sum(), 1, rel_tol=1e-3)


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    flat = language_model.start(rng.random(language_model.CLASSES * language_model.MEMBERS))
    ids, live = rng.integers(0, 60, (6, 4)), np.array([4, 4, 3, 1, 1])
    h = rng.normal(0, 0.3, (4, language_model.STATE)).astype(np.float32)
    g, _, loss = language_model.gradient(flat, ids[:-1], ids[1:], live, h)
    at = 0
    for k, shape in language_model.shapes().items():
        n = int(np.prod(shape))
        i = at + int(np.abs(g[at : at + n]).argmax())
        both = []
        for step in (1e-2, -1e-2):
            moved = flat.copy()
            moved[i] += np.float32(step)
            both.append(language_model.gradient(moved, ids[:-1], ids[1:], live, h)[2])
        assert math.isclose((both[0] - both[1]) / 2e-2, g[i], rel_tol=3e-2, abs_tol=1e-4), k
        at += n


def slow_log10(flat, ids):
    """One word at a time, by the textbook's formulas."""
    p = {k: v.astype(np.float64) for k, v in language_model.views(flat).items()}
    n = language_model.STATE
    h, last, total = np.zeros(n), language_model.END, 0.0
    for i in ids:
        x = p["emb"][last] @ p["wx"] + p["b"]
        r, z = 1 / (1 + np.exp(-(x[:n] + h @ p["wh"][0]))), 1 / (1 + np.exp(-(x[n : 2 * n] + h @ p["wh"][1])))
        new = np.tanh(x[2 * n :] + r * (h @ p["wh"][2]))
        h = (1 - z) * new + z * h
        c, m = divmod(int(i), language_model.MEMBERS)
        classes, members = np.append(h, 1) @ p["wc"], np.append(h, 1) @ p["ww"][c]
        total += classes[c] - np.log(np.exp(classes).sum()) + members[m] - np.log(np.exp(members).sum())
        last = i
    return total / math.log(10)


def test_scores_of_whole_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = docs.where(language_model.crc_of_id() % 7 != 2)
    table, counts = language_model.count_corpus(training)
    flat = language_model.train(training, counts)
    number = {bytes(r.word): r.n for r in table.collect()}
    head = {w: i + language_model.MEMBERS for i, (w, _) in enumerate(sorted(number.items(), key=lambda x: (-x[1], x[0]))[: language_model.VOCABULARY])}
    kinds = collections.defaultdict(int)
    for w, n in number.items():
        if w not in head:
            kinds[language_model.kind_of(w)] += n + 1
    got = {r.doc_id: r.score for r in language_model.score(docs, training).collect()}
    for r in docs.where("doc_id % 7 = 0").collect():
        words = language_model.words_of(r.text or "")
        ids = [head.get(w) or language_model.kind_of(w) for w in words]
        want = slow_log10(flat, [*ids, language_model.END])
        want += sum(math.log10(number.get(w, 0) + 1) - math.log10(kinds[i] + 1) for w, i in zip(words, ids, strict=True) if w not in head)
        assert math.isclose(got[r.doc_id], want, rel_tol=1e-4), r.doc_id


def test_partitions_do_not_change_the_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_WORDS", 8_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 90")
    got = [{r.doc_id: r.score for r in language_model.language_model(docs.repartition(n)).collect()} for n in (1, 7)]
    assert got[0].keys() == got[1].keys() and all(math.isclose(x, got[1][i], rel_tol=1e-6) for i, x in got[0].items())


def test_every_word_is_trained_on_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 90}" for k in range(i * 700))) for i in range(6)] + [(None, None), (7, "")], "doc_id long, text string")
    table, counts = language_model.count_corpus(docs)
    pieces = [r.piece for r in language_model._pieces(docs, counts.head).collect()]
    assert sum(len(p) - 1 for p in pieces) == counts.tokens and max(map(len, pieces)) == language_model.PIECE + 1
    cuts, seen, kept = [np.array(p) for p in pieces], [], language_model.gradient

    def counted(flat, ids, target, live, h):
        seen.append(int(live.sum()))
        return kept(flat, ids, target, live, h)

    monkeypatch.setattr(language_model, "gradient", counted)
    language_model.train_pieces(language_model.start(np.ones(1024)), cuts, 0.01)
    assert sum(seen) == counts.tokens


def test_state_goes_on_over_windows(monkeypatch):
    rng = np.random.default_rng(4)
    p = language_model.start(rng.random(language_model.CLASSES * language_model.MEMBERS))
    docs = [rng.integers(0, 900, n) for n in (1, 23, 24, 25, 100, 7)]
    short = language_model.score_ids(p, docs, 2)
    monkeypatch.setattr(language_model, "WINDOW", 1_000)
    assert np.allclose(short, language_model.score_ids(p, docs, 64), rtol=1e-4)


def test_pages_of_other_layouts():
    model = html_crf.train()
    pages = html_crf.labelled_pages(150, seed=77)
    right = [model.extract(h)[0] == "\n".join(" ".join(m.split()) for m in main) for h, main in pages]
    assert np.mean(right) >= 0.9


def test_self_closed_svg_and_deep_pages():
    def texts(html):
        return [b.text for b in html_crf.leaf_blocks(html)]

    assert texts('<article><h1>T</h1><svg class="i"/><p>one</p><svg a=">" /><p>two <svg/>more</p><svg><path d="m"/></svg><p>three</p></article>') == ["T", "one", "two more", "three"]
    assert texts("<p>a</p><svg><title>no</title><g/></svg><p>b</p>") == ["a", "b"]
    deep = "<article>" + "".join(f'<div class="k{chr(97 + i // 26)}{chr(97 + i % 26)}">' for i in range(600)) + '<div class="advert"><p>in</p></div><p>after</p>' + "</div>" * 600 + "<p>end</p></article><p>out</p>"
    got = html_crf.leaf_blocks(deep)
    assert ["c:advert" in b.path for b in got] == [True, False, False, False] and ["t:article" in b.path for b in got] == [True, True, True, False]
    few = html_crf.leaf_blocks(deep, frozenset(["t:article", "c:advert"]))
    assert [b.path for b in few] == [("t:article", "c:advert"), ("t:article",), ("t:article",), ()]
    assert [b.path for b in html_crf.leaf_blocks("<div>" * 700 + "</div>" * 699 + '<p class="x">y</p></div></b></i><p>z', frozenset(["c:x", "t:div"]))] == [("t:div", "c:x"), ()]


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<article><p>a &amp; b<br>c</p><p>d"), (None, "u", "<<<>>> & <script>x"), (4, "u", "<article><p>a &amp; b<br>c</p><p>d")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_crf.extract(pages).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id == 4] == ["a & b c\nd"] * 2 and all(r.n_chars == len(r.text) for r in got)
    assert html_crf.extract(pages.limit(0)).count() == 0


def test_chain_probabilities_by_enumeration():
    import itertools

    pages = [(html_crf.leaf_blocks("<nav>x</nav><p>some words here.</p><footer>y</footer>"), [0, 1, 0])] * 3
    model = html_crf.fit(pages, steps=30)
    blocks = pages[0][0]
    e = model.emissions(blocks)

    def worth(y):
        return model.begin[y[0]] + sum(e[i] for i in range(3) if y[i]) + sum(model.change[a, b] for a, b in itertools.pairwise(y))

    assert tuple(model.viterbi(blocks)) == max(itertools.product((0, 1), repeat=3), key=worth)


def test_pages_of_the_table(spark):
    """The table's pages keep their main text in one ``article`` of headings and paragraphs, here read by the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks += [""] if tag in ("article", "h1", "p") else []
            self.blocks[-1] += " " if tag == "br" and self.inside else ""

        def handle_endtag(self, tag):
            self.inside &= tag != "article"

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r.text for r in html_crf.extract(pages).collect()}
    right, both, mine, theirs = 0, 0, 0, 0
    for r in pages.collect():
        reader = Article()
        reader.feed(r.html or "")
        want = [" ".join(b.split()) for b in reader.blocks if b.strip()]
        own = got[r.page_id].split("\n") if got[r.page_id] else []
        right += own == want
        common = sum((collections.Counter(own) & collections.Counter(want)).values())
        both, mine, theirs = both + common, mine + len(own), theirs + len(want)
    print(f"pages right {right / len(got):.3f}, block F1 {2 * both / (mine + theirs):.4f}")
    assert right >= 0.97 * len(got) and 2 * both / (mine + theirs) >= 0.99
