"""Quality classification by co-training.

Two logistic classifiers see a document through separate views: *content*, the frequencies of
character-class trigrams and a few ratios of the text; and *page metadata*, the language, the source
and the page's size and layout. Both start from the same labelled sample. In each round each one
labels the texts of an unlabelled sample that it is most sure of, and those go to the training set
of the other. Both are then calibrated on labelled texts that neither has seen, and one score is
made of the calibrated views.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import TRAIN_TEXT_BYTES, labelled_rows, map_batches, sample_rows

#: Training reads at most so many labelled and so many unlabelled documents.
LABELLED, UNLABELLED = 2000, 2000
ROUNDS, SHARE, SURE = 3, 0.03, 0.97
#: A document is rejected if its chance of being good is below this.
REJECT = 0.5

_CLASSES = 16
_RATIOS = 6
_BUCKETS = 64


def _class_table() -> np.ndarray:
    table = np.full(256, 15, np.uint16)
    for k, marks in enumerate(["aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "$%&*#^~@+=<>\\", "\"'`()[]{}", "-_/:;"]):
        for c in marks:
            table[ord(c)] = k
    table[128:192] = 13
    table[192:] = 14
    return table


_TABLE = _class_table()
_CONTENT = _CLASSES**3 + _RATIOS
_META = 3 * _BUCKETS + 4


def content_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's class trigrams, and its ratios."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    c = _TABLE[np.frombuffer(raw, np.uint8)]
    code = c[:-2] << 8 | c[1:-1] << 4 | c[2:] if len(c) > 2 else np.zeros(0, np.uint16)
    words = raw.split()
    n, lines = max(len(words), 1), [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    ratios = [
        distinct / n if n < 200 else min(1.0, distinct / n**0.9),
        again / n,
        min(len(raw) / n, 30.0) / 10,
        len(set(lines)) / max(len(lines), 1),
        np.count_nonzero(c == 10) / max(len(raw), 1) * 5,
        np.count_nonzero(c == 2) / max(len(raw), 1) * 5,
    ]
    return code, np.array(ratios)


def metadata_view(lang: str | None, source: str | None, n_chars: int | None, text: str | None) -> list[int]:
    """The hashed facts about a page that hold: language, source, size and layout classes."""
    lines = (text or "").count("\n") + 1
    size = len(text or "") if n_chars is None else max(0, int(n_chars))

    def bucket(x: str | None) -> int:
        return 0 if x is None else 1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (_BUCKETS - 1)

    layout = min(15, int(2 * math.log2(1 + size / lines))) if size else 0
    return [bucket(lang), _BUCKETS + bucket(source), 2 * _BUCKETS + min(31, int(2 * math.log2(1 + size))), 2 * _BUCKETS + 32 + layout]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 80, rate: float = 0.1) -> np.ndarray:
    """Logistic regression with the bias in the last place; both classes weigh the same."""
    share = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    for step in range(1, steps + 1):
        slope = ((_sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y) * share).astype(x.dtype)
        grad = np.append(slope @ x, slope.sum()) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets: chance = sigmoid(a z + b), a never negative."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = _sigmoid(a * z + b)
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = max(0.0, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


class CoTrained:
    """Both views' weights, their calibrations and how the calibrated log-odds combine. Without labels it gives one half."""

    def __init__(self):
        self.content, self.meta = np.zeros(_CONTENT + 1), np.zeros(_META + 1)
        self.scale = [(0.0, 0.0), (0.0, 0.0)]
        self.mix = (0.0, 0.0, 0.0)

    def views(self, code, ratios, facts) -> tuple[float, float]:
        grams = self.content[code].sum() / max(len(code), 1) * 10
        return float(grams + ratios @ self.content[-1 - _RATIOS : -1] + self.content[-1]), float(self.meta[facts].sum() + self.meta[-1])

    def score(self, code, ratios, facts) -> tuple[float, float, float]:
        """The chance of good quality: by content, by metadata, by both."""
        z = [a * x + b for (a, b), x in zip(self.scale, self.views(code, ratios, facts))]
        both = self.mix[0] * z[0] + self.mix[1] * z[1] + self.mix[2]
        return tuple(float(_sigmoid(np.array(x))) for x in (*z, both))


def _matrices(rows) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros((len(rows), _CONTENT), np.float32), np.zeros((len(rows), _META), np.float32)
    for k, r in enumerate(rows):
        code, ratios = content_view(r["text"])
        a[k, : _CLASSES**3] = np.bincount(code, minlength=_CLASSES**3) / max(len(code), 1) * 10
        a[k, _CLASSES**3 :] = ratios
        b[k, metadata_view(r["lang"], r["source"], r["n_chars"], r["text"])] = 1
    return a, b


def co_train(labelled: list, unlabelled: list, rounds: int = ROUNDS) -> CoTrained:
    """labelled: rows with text, lang, source, n_chars, label; unlabelled: the same without label."""
    model = CoTrained()
    y = np.array([float(r["label"] > 0.5) for r in labelled])
    if len(set(y)) < 2:
        if len(y):
            model.mix = (0.0, 0.0, 10.0 if y[0] else -10.0)
        return model
    x = _matrices(labelled)
    u = _matrices(unlabelled)
    used = np.flatnonzero((x[0] != 0).mean(axis=0) > 0.002)  # trigrams that hardly occur get no weight
    x, u = (x[0][:, used], x[1]), (u[0][:, used], u[1])
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    own = [(x[v][~held], y[~held]) for v in (0, 1)]
    left = np.arange(len(unlabelled))
    ridges = (1e-4, 1e-3)
    for k in range(rounds + 1):
        weights = [_fit(own[v][0], own[v][1], ridges[v]) for v in (0, 1)]
        if k == rounds or not len(left):
            break
        taken = np.zeros(len(left), bool)
        for v in (0, 1):
            p = _sigmoid(u[v][left] @ weights[v][:-1] + weights[v][-1])
            most = max(1, int(SHARE * len(unlabelled)))
            order = np.argsort(p, kind="stable")
            low, high = order[:most][p[order[:most]] <= 1 - SURE], order[-most:][p[order[-most:]] >= SURE]
            for found, label in ((low, 0.0), (high, 1.0)):
                other = 1 - v
                own[other] = (np.concatenate([own[other][0], u[other][left[found]]]), np.concatenate([own[other][1], np.full(len(found), label)]))
                taken[found] = True
        left = left[~taken]
    model.content[[*used, -1]], model.meta = weights
    judged = held if held.any() else ~held
    z = [x[v][judged] @ weights[v][:-1] + weights[v][-1] for v in (0, 1)]
    model.scale = [_calibrate(z[v], y[judged]) for v in (0, 1)]
    c = np.stack([a * q + b for (a, b), q in zip(model.scale, z)], 1)
    mix = np.array([1.0, 0.5, 0.0])
    for _ in range(400):  # unbalanced: the combined score keeps the labels' base rate
        g = np.append((_sigmoid(c @ mix[:2] + mix[2]) - y[judged]) @ c, (_sigmoid(c @ mix[:2] + mix[2]) - y[judged]).sum()) / len(c)
        mix = mix - 0.2 * g
        mix[:2] = np.clip(mix[:2], 0, 3)
    model.mix = tuple(float(k) for k in mix)
    return model


def _score_batches(batches, shared):
    model: CoTrained = shared.value
    for batch in batches:
        ids, texts, langs, sources, sizes = (batch.column(k) for k in range(5))
        told = []
        for t, lang, source, n in zip(texts, langs.to_pylist(), sources.to_pylist(), sizes.to_pylist()):
            text = t.as_py()
            told.append(model.score(*content_view(text), metadata_view(lang, source, n, text)))
        columns = [pa.array([x[k] for x in told], pa.float64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "content_score", "metadata_score", "score"])


def _four(docs: DataFrame, id_name: str) -> DataFrame:
    """The columns both views read; those that the table doesn't have are null."""
    have = set(docs.columns)
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(F.col("doc_id").alias(id_name), F.col("text").cast("string").alias("text"), *[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def train_from(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, most_bytes: int = TRAIN_TEXT_BYTES) -> CoTrained:
    """Co-trains on at most ``labelled`` labelled documents and ``unlabelled`` others, drawn after leaving out texts over ``most_bytes`` bytes.

    No document is in both samples, so neither view has seen the labelled quarter held for calibration.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    known = labelled_rows(_four(docs, "id"), own, labelled, most_bytes)
    return co_train(known, sample_rows(_four(docs, "id"), unlabelled, most_bytes, "pool", [r["id"] for r in known]))


def score_quality(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, content_score, metadata_score and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    four = _four(docs, "doc_id")
    return map_batches(four, partial(_score_batches, shared=shared), f"doc_id {four.schema['doc_id'].dataType.simpleString()}, content_score double, metadata_score double, score double")


def quality(docs: DataFrame, labels: DataFrame, least: float = REJECT) -> DataFrame:
    """doc_id, content_score, metadata_score, score (0 to 1, the chance of good quality) and kept.

    Null and empty texts have no trigrams and are scored by their metadata and empty ratios; a null
    lang, source or n_chars is a value of its own (n_chars: the text's length). Without labels
    everything scores one half and is kept. Repeated rows stay; an empty table gives an empty table.
    """
    told = score_quality(docs, train_from(docs, labels))
    return told.withColumn("kept", F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; texts are not shuffled. Edge cases as in quality()."""
    model = docs.sparkSession.sparkContext.broadcast(train_from(docs, labels))
    four = _four(docs, "doc_id").schema
    cast = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns and docs.schema[c].dataType != four[c].dataType]
    read = docs.withColumns({f"__{c}": F.col(c).cast(four[c].dataType) for c in cast})
    at = {c: read.columns.index(f"__{c}" if c in cast else c) for c in ("text", "lang", "source", "n_chars") if c in docs.columns}
    own = list(range(len(docs.columns)))

    def kept(batches):
        for batch in batches:
            none = [None] * batch.num_rows
            have = {c: batch.column(k) if c == "text" else batch.column(k).to_pylist() for c, k in at.items()}
            good = []
            for t, lang, source, n in zip(have.get("text", none), have.get("lang", none), have.get("source", none), have.get("n_chars", none)):
                text = t.as_py() if t is not None else None
                good.append(model.value.score(*content_view(text), metadata_view(lang, source, n, text))[2] >= least)
            yield batch.select(own).filter(pa.array(good, pa.bool_()))

    return map_batches(read, kept, docs.schema)
