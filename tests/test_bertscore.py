"""BERTScore against plain loops, with and without weights."""

import math

import numpy as np
import pytest

from corpusmill.operators import bertscore
from corpusmill.providers import HashingTokenEmbedder, token_vectors


def plain(a, b, wa, wb):
    """Loops over tokens; a and b are lists of vectors."""
    if not a or not b:
        return 0.0, 0.0, 0.0
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / ((math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y))) or 1.0)
    p = sum(w * max(cos(x, y) for y in b) for x, w in zip(a, wa)) / sum(wa) if sum(wa) else 0.0
    r = sum(w * max(cos(x, y) for x in a) for y, w in zip(b, wb)) / sum(wb) if sum(wb) else 0.0
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


TEXTS = [
    (1, "the cat sat on the mat", "the cat sat on a mat"), (2, "a dog", "an entirely different thing"), (3, "", "words"), (4, "words", None), (5, "same same", "same"),
    (6, "the " * 1300 + "end", "the end"), (7, "the", "the"),
]


@pytest.mark.parametrize("weighted", [True, False])
def test_scores_equal_plain_loops(spark, weighted, monkeypatch):
    monkeypatch.setattr(bertscore, "BLOCK", 3)
    model = HashingTokenEmbedder(8)
    df = spark.createDataFrame(TEXTS, "id long, g string, r string").repartition(3)
    pairs = token_vectors(token_vectors(df, model, "g", "generated"), model, "r", "reference")
    idf = bertscore.token_idf(pairs, "reference_tokens") if weighted else None
    got = {r["id"]: (r["precision"], r["recall"], r["f1"]) for r in bertscore.bert_score(pairs, idf=idf).collect()}
    seen = [set((r or "").lower().split()) for _, _, r in TEXTS]
    weight = lambda w: math.log((len(TEXTS) + 1) / (sum(w in s for s in seen) + 1)) if weighted else 1.0
    for k, g, r in TEXTS:
        (ta, a), (tb, b) = model.embed_tokens([g, r])
        assert np.allclose(got[k], plain(a.tolist(), b.tolist(), list(map(weight, ta)), list(map(weight, tb)))), k
    assert len(got) == len(TEXTS) and got[7] == pytest.approx((1, 1, 1)) and got[3] == (0, 0, 0)


def test_no_pairs(spark):
    pairs = spark.createDataFrame([], "id long, generated_tokens array<string>, generated_vectors array<array<float>>, reference_tokens array<string>, reference_vectors array<array<float>>")
    assert bertscore.bert_score(pairs, idf=bertscore.token_idf(pairs, "reference_tokens")).count() == 0
