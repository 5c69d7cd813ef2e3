"""What tasks remember of words stays small in bytes, however long the words are."""

import random

import public_tokenizers
import pytest

from athenor.llm import best_fit, bpe, near_dedup, packing, quality, toxicity
from athenor.llm.common import WORD

RNG = random.Random(3)
TEXTS = ["".join(chr(RNG.randrange(0x4E00, 0x9FA5)) for _ in range(2_000)) for _ in range(60)] + ["abc " + "x" * 100_000, "short words stay here"]


def kept():
    yield "bpe", lambda: (v := bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), v.encode(TEXTS), [v.known, v.after, v.alone])[-1]
    yield "packing", lambda: (v := packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), v.documents(TEXTS), [v.known])[-1]
    yield "best_fit", lambda: (v := best_fit.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json")), v.documents(TEXTS), [v.known])[-1]
    yield "near_dedup", lambda: (v := near_dedup.WordHash(), [near_dedup.shingles(t, v) for t in TEXTS], [v])[-1]
    yield "toxicity", lambda: (v := toxicity.WordWeights({b"abc": 1.0}), [v[w] for t in TEXTS for w in t.encode().split()], [v])[-1]


@pytest.mark.parametrize(("name", "memos"), list(kept()), ids=lambda x: x if isinstance(x, str) else "")
def test_long_words_are_not_kept(name, memos):
    found = memos()
    assert any(len(m) > 1 for m in found)
    for memo in found:
        assert max(map(len, memo), default=0) <= WORD
        assert sum(len(k) + (len(v) if isinstance(v, bytes) else 8) for k, v in memo.items()) < 2_000


def test_quality_keeps_short_words_and_scores_the_same():
    model = quality.fit([t for t in TEXTS[-30:]], __import__("numpy").arange(30) % 2)
    once = model.scores(TEXTS).tolist()
    assert max(map(len, model.memo)) <= WORD and len(model.sums) == len(model.memo)
    assert model.scores(TEXTS).tolist() == once
