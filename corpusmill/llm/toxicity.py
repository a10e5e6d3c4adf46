"""Toxicity by multiple-instance learning.

Only documents are labelled; their sentences are the instances. A sentence's score is a logistic
function of the words in it, with weights that are never negative and a fixed low base; without a
weighted word it is zero, so length alone counts for nothing. A document's score is the noisy-or of
its sentences': one bad sentence is enough. Labels may be wrong at a rate
that is learnt with the weights, so single mislabelled documents don't make words toxic. The sentence
scores then locate what is offending.

A word's features are itself and its first four, five and six bytes, so inflected forms share weight.
Words and sentences are cut on bytes: A-Z lower-cased, ``. ! ?`` and line ends end a sentence, other
ASCII marks divide words.
"""

from __future__ import annotations

from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import TRAIN_TEXT_BYTES, crc32_mod, labelled_rows

#: At most so many labelled documents are read for training.
TRAIN_DOCS = 4000
#: The log-odds of a sentence without a word that is weighed, and the least score a sentence counts with.
BASE, FLOOR = -10.0, 0.02
#: Weights below this are dropped.
LEAST = 2.0
#: What cross-validation chooses from, from loose to strict: (pull of weights to zero, documents a word must be in, its least log-odds).
CHOICES = tuple((pull, docs, odds) for pull in (0.004, 0.008, 0.016) for docs in (5, 8) for odds in (1.5, 2.0))
FOLDS = 3
THRESHOLD = 0.3

_TABLE = bytes(10 if chr(b) in ".!?\n\r" else b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return [words for x in raw.split(b"\n") if (words := x.split())]


PREFIXES = (4, 5, 6)


def features(words: list[bytes]) -> set[bytes]:
    """The words of a sentence and their marked prefixes."""
    return {f for w in words for f in (w, *(b"^" + w[:k] for k in PREFIXES if len(w) >= k))}


class Sample:
    """The training documents as numbers: which features that may matter each sentence has."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.y, self.n = np.array(labels, float) > 0.5, len(texts)
        self.names: list[bytes] = []
        word, sent, doc = array("i"), array("i"), array("i")
        for d, text in enumerate(texts) if (at := self._likely(texts)) else ():
            for x in sentences(text):
                n = len(word)
                for f in features(x):
                    if (k := at.get(xxhash.xxh64_intdigest(f))) is not None:
                        self.names[k] = f
                        word.append(k)
                        sent.append(len(doc))
                if len(word) > n:
                    doc.append(d)
        self.word, self.sent, self.doc = (np.array(x, np.int32) for x in (word, sent, doc))
        both = np.unique(self.doc[self.sent].astype(np.int64) * max(1, len(self.names)) + self.word) if len(word) else np.zeros(0, np.int64)
        self.in_doc, self.of_word = both // max(1, len(self.names)), both % max(1, len(self.names))

    def _likely(self, texts: list[str]) -> dict[int, int]:
        """The features in enough documents that are not plainly clean, by hash, so that no others are ever held."""
        if not self.y.any():
            return {}
        own = [np.unique(np.fromiter((xxhash.xxh64_intdigest(f) for f in features([w for x in sentences(t) for w in x])), np.uint64)) for t in texts]
        codes, counts = np.unique(np.concatenate(own), return_counts=True)
        bad_codes, bad = np.unique(np.concatenate([x for x, t in zip(own, self.y) if t]), return_counts=True)
        hits = np.zeros(len(codes))
        hits[np.searchsorted(codes, bad_codes)] = bad
        likely = (counts >= min(n for _, n, _ in CHOICES)) & (self._odds(hits, counts, self.y.mean()) >= min(odds for _, _, odds in CHOICES) - 0.5)
        self.names = [b""] * int(likely.sum())
        return {h: k for k, h in enumerate(codes[likely].tolist())}

    @staticmethod
    def _odds(hits: np.ndarray, counts: np.ndarray, rate: float) -> np.ndarray:
        """How much likelier a document with each feature is to be toxic, in log-odds, smoothed."""
        return np.log((hits + 4 * rate) / (counts - hits + 4 * (1 - rate))) - np.log(rate / (1 - rate))

    def fit(self, among: np.ndarray, pull: float, least_docs: int, least_odds: float, steps: int = 150) -> np.ndarray:
        """Weights of all features by projected gradient ascent of the noisy-or likelihood of some of the documents."""
        rate, size = self.y[among].mean(), len(self.names)
        if not size or not 0 < rate < 1:
            return np.zeros(size)
        held = among[self.in_doc]
        counts = np.bincount(self.of_word[held], minlength=size)
        hits = np.bincount(self.of_word[held], self.y[self.in_doc[held]].astype(float), size)
        odds = self._odds(hits, counts, rate)
        used = (counts >= least_docs * among.mean()) & (odds >= least_odds)
        keep = used[self.word] & among[self.doc[self.sent]]
        word, sent = self.word[keep], self.sent[keep]
        w, n_sent = np.where(used, np.clip(odds * 3, 0, 12), 0), len(self.doc)
        false_rate, miss_rate = min(0.05, rate / 2), 0.1
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(BASE + np.bincount(sent, w[word], n_sent), -30, 30)))
            stay = np.bincount(self.doc, np.log1p(-np.minimum(p, 1 - 1e-9)), self.n)  # log of the chance that no sentence is toxic
            toxic = -np.expm1(stay)
            q = false_rate + (1 - false_rate - miss_rate) * toxic
            slope = np.where(self.y, 1 / q, -1 / (1 - q)) * (1 - false_rate - miss_rate) * among
            grad = np.bincount(word, (slope[self.doc] * np.exp(stay[self.doc]) * p)[sent], size) - pull * (w > 0)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = np.where(used, np.clip(w + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 0.05), 0, 14), 0)
            if step % 25 == 0:  # the label error rates, by expectation
                was = np.where(self.y, toxic * (1 - miss_rate) / q, toxic * miss_rate / (1 - q))[among]
                y = self.y[among]
                false_rate = float(np.clip((y * (1 - was)).sum() / max((1 - was).sum(), 1), 0.005, 0.3))
                miss_rate = float(np.clip((~y * was).sum() / max(was.sum(), 1), 0.005, 0.3))
        return np.where(w >= LEAST, w, 0)

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Each document's score under weights."""
        sums = np.bincount(self.sent, w[self.word], len(self.doc)) if len(self.word) else np.zeros(0)
        p = _sentence(sums)
        return 0.0 - np.expm1(np.bincount(self.doc, np.log1p(-np.minimum(p, 1 - 1e-9)), self.n) if len(p) else np.zeros(self.n))


def _sentence(sums):
    """A sentence's score from the sum of its weights."""
    p = 1 / (1 + np.exp(-np.clip(BASE + sums, -30, 30)))
    return np.where((sums > 0) & (p >= FLOOR), p, 0.0)


def choose(sample: Sample, folds: int = FOLDS) -> tuple[tuple[float, int, float], dict]:
    """The strictest choice whose squared error on folds that its weights haven't seen is within a standard error of the least; all errors."""
    fold, errors, spread = np.arange(sample.n) % folds, {}, {}
    for choice in CHOICES:
        lost = np.zeros(sample.n)
        for k in range(folds):
            own = fold == k
            lost[own] = ((sample.scores(sample.fit(~own, *choice)) - sample.y) ** 2)[own]
        errors[choice], spread[choice] = float(lost.mean()), float(lost.std() / np.sqrt(sample.n))
    best = min(CHOICES, key=errors.__getitem__)
    return [c for c in CHOICES if errors[c] <= errors[best] + spread[best]][-1], errors


def train_words(texts: list[str], labels: list[int]) -> dict[bytes, float]:
    """Word weights from documents' labels; empty if no document or every document is toxic."""
    sample = Sample(texts, labels)
    if not sample.names:
        return {}
    w = sample.fit(np.ones(sample.n, bool), *choose(sample)[0])
    return {x: float(k) for x, k in sorted(zip(sample.names, w)) if k}


def sentence_scores(text: str | None, weights: dict[bytes, float]) -> np.ndarray:
    sums = np.array([sum(weights.get(f, 0.0) for f in features(x)) for x in sentences(text)], float)
    return _sentence(sums)


def document_score(text: str | None, weights: dict[bytes, float]) -> float:
    return float(0.0 - np.expm1(np.log1p(-np.minimum(sentence_scores(text, weights), 1 - 1e-9)).sum()))


def heads(weights: dict[bytes, float]) -> set[bytes]:
    """The first four bytes of every word that can have a feature with a weight."""
    return {f[1:5] if f[:1] == b"^" else f[:4] for f in weights}


def _score(raw: bytes, weights: dict[bytes, float], first: set[bytes]) -> tuple[float, int]:
    """As document_score() for translated bytes, and the number of sentences over one half."""
    stay, offending = 0.0, 0
    if first.isdisjoint({w[:4] for w in raw.split()}):
        return 0.0, 0
    for x in raw.split(b"\n"):
        words = x.split()
        if first.isdisjoint([w[:4] for w in words]):
            continue
        total = sum(weights.get(f, 0.0) for f in sorted(features(words)))
        if not total:
            continue
        p = float(_sentence(total))
        offending += p >= 0.5
        stay += np.log1p(-min(p, 1 - 1e-9))
    return float(0.0 - np.expm1(stay)), int(offending)


def _score_batches(batches, shared):
    weights = shared.value
    first = heads(weights)
    for batch in batches:
        told = [_score((x.as_py() or "").encode("utf-8", "surrogatepass").translate(_TABLE), weights, first) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in told], pa.float64()), pa.array([n for _, n in told], pa.int64())], names=["doc_id", "score", "n_offending"])


def score_documents(docs: DataFrame, weights: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_offending (sentences that score one half or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the training sample
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(partial(_score_batches, shared=shared), f"doc_id {two.schema['doc_id'].dataType.simpleString()}, score double, n_offending long")


def _locate_batches(batches, shared, least):
    weights = shared.value
    for batch in batches:
        ids, index, spans, scores = [], [], [], []
        for k, x in enumerate(batch.column(1)):
            for n, (words, p) in enumerate(zip(sentences(x.as_py()), sentence_scores(x.as_py(), weights))):
                if p >= least:
                    ids.append(k)
                    index.append(n)
                    spans.append(b" ".join(words).decode("utf-8", "replace"))
                    scores.append(float(p))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(index, pa.int32()), pa.array(spans, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "sentence", "words", "score"])


def offending_sentences(docs: DataFrame, weights: dict[bytes, float], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each sentence that scores ``least`` or more: doc_id, sentence (its number), words, score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(partial(_locate_batches, shared=shared, least=least), f"doc_id {two.schema['doc_id'].dataType.simpleString()}, sentence int, words string, score double")


def train_from(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_text_bytes: int = TRAIN_TEXT_BYTES) -> dict[bytes, float]:
    """Weights from at most ``max_docs`` labelled documents, drawn from those of at most ``max_text_bytes`` bytes."""
    rows = labelled_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), max_docs, max_text_bytes)
    return train_words([r["text"] for r in rows], [r["label"] for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending of every document.

    Labels of documents whose crc32(doc_id) mod 4 is 2 are held out. Null and empty texts have no
    sentence and score 0; without labels every score is 0. A null doc_id isn't held out.
    Repeated rows stay; an empty table gives an empty table; no other column is read.
    """
    weights = train_from(docs, labels.where(crc32_mod(F.col("doc_id"), 4) != 2), max_docs)
    told = score_documents(docs, weights)
    held = F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return told.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_offending")
