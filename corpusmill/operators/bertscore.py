"""BERTScore over token vectors: every token is matched greedily with the most similar token of the other text.

Vectors come from a provider or from a table; weights are the inverse document frequencies of tokens over
the reference texts, or one. The matching is numpy in blocks, a pair of texts at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import matrix

#: Tokens of one text that are compared with all of the other at once.
BLOCK = 512


def token_idf(references: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """token, idf, unseen: ln((texts + 1) / (texts with the token + 1)) over reference texts, a row each, and ln(texts + 1), the weight of all other tokens.

    Null tokens, and tokens repeated in one text, don't count.
    """
    texts = references.select(F.array_distinct(F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))).alias("t"))
    seen = texts.select(F.explode("t").alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("df"))
    return seen.join(F.broadcast(texts.agg(F.count("*").alias("m")))).select("token", F.log((F.col("m") + 1) / (F.col("df") + 1)).alias("idf"), F.log(F.col("m") + 1).alias("unseen"))


def _unit(column) -> np.ndarray:
    """A row for each token, of unit length; zero vectors stay zero."""
    if not len(column):
        return np.zeros((0, 0))
    x = matrix(column)
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1)[:, None]


def matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest similarity that each row of a, and of b, has with a row of the other."""
    to_a, to_b = np.zeros(len(a)), np.full(len(b), -np.inf)
    for at in range(0, len(a), BLOCK):
        s = a[at : at + BLOCK] @ b.T
        to_a[at : at + BLOCK] = s.max(axis=1)
        np.maximum(to_b, s.max(axis=0), out=to_b)
    return to_a, to_b


def _mean(values: np.ndarray, weights: np.ndarray) -> float:
    total = weights.sum()
    return float((values * weights).sum() / total) if total > 0 else 0.0


def score(a: np.ndarray, b: np.ndarray, weights_a: np.ndarray, weights_b: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and F1 of a generated text's unit vectors (a) against a reference's (b); zeros if one has none."""
    if not len(a) or not len(b):
        return 0.0, 0.0, 0.0
    to_a, to_b = matched(a, b)
    p, r = _mean(to_a, weights_a), _mean(to_b, weights_b)
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def _weighted(rows: DataFrame, side: str, idf: DataFrame | None, unseen: float) -> DataFrame:
    """id and the weights of one side's tokens, in their order, by an equi-join on tokens."""
    tokens = rows.select("id", F.posexplode(f"{side}_tokens").alias("at", "token"))
    weighed = tokens.join(idf.select("token", "idf"), "token", "left").select("id", "at", F.coalesce("idf", F.lit(unseen)).alias("w")) if idf is not None else tokens.select("id", "at", F.lit(1.0).alias("w"))
    return weighed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias(f"{side}_w"))


def _scores(batches):
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            generated, reference = (batch.column(c).slice(k, 1).flatten() for c in (1, 2))
            weights = [np.array(batch.column(c)[k].as_py() or [], float) for c in (3, 4)]
            out.append(score(_unit(generated), _unit(reference), *weights))
        p, r, f = (pa.array([x[j] for x in out], pa.float64()) for j in range(3))
        yield pa.RecordBatch.from_arrays([batch.column(0), p, r, f], names=["id", "precision", "recall", "f1"])


def bert_score(pairs: DataFrame, id_col: str = "id", idf: DataFrame | None = None) -> DataFrame:
    """id, precision, recall, f1 for pairs (id, generated_tokens, generated_vectors, reference_tokens, reference_vectors).

    Tokens are array<string>, vectors an array of as many vectors, all of one length. idf: the weights of
    token_idf(), of the references; a token that they don't have weighs as one in none of them, as do null
    tokens. Without it all tokens weigh the same. A text that is null or has no tokens scores 0.
    Ids are not repeated; only they and tokens are shuffled to find the weights.
    """
    strings, vectors = "array<string>", "array<array<double>>"
    rows = pairs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(f"{s}_{c}").cast(t), F.array().cast(t)).alias(f"{s}_{c}") for s in ("generated", "reference") for c, t in (("tokens", strings), ("vectors", vectors))])
    unseen = 0.0 if idf is None else float(idf.agg(F.max("unseen")).first()[0] or 0.0)
    both = rows.join(_weighted(rows, "generated", idf, unseen), "id", "left").join(_weighted(rows, "reference", idf, unseen), "id", "left")
    held = both.select("id", "generated_vectors", "reference_vectors", "generated_w", "reference_w")
    return held.mapInArrow(_scores, f"id {rows.schema['id'].dataType.simpleString()}, precision double, recall double, f1 double")

