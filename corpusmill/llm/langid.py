"""Language identification by prediction by partial matching.

A context tree for each language holds how often each byte followed each context of up to ``ORDER``
bytes in labelled text. Its statistics are frozen after training. A byte costs the bits of its
probability in the longest known context (escape method C: a context seen n times with q different
bytes gives a byte seen c times c / (n + q), and the escape q / (n + q)); on escape the next shorter
context is asked, and last of all a uniform byte. A text's code length in a language is the exact sum
over all its bytes; the shortest wins.

Costs of all byte sequences that occur in training are worked out once, as fixed-point integers, so
sums don't depend on their order. The lookup is one gather: bytes are renumbered to 64 symbols
(the 63 most frequent and one for the rest), and four symbols index a dense table. Sequences that
aren't in it take the escape chain, over sorted tables.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import TRAIN_TEXT_BYTES, crc32_mod, sample_by_group, slices

ORDER = 3
UNIT = 1 << 16  # of a bit
#: Training reads at most so many labelled texts of each language, however rare, and at most so many bytes of all languages.
TRAIN_DOCS, TRAIN_BYTES = 1000, 8_000_000
#: Texts are scored in blocks of this many bytes, so memory doesn't grow with a text.
BLOCK = 1 << 20


def _grams(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The codes of all n-byte sequences that lie within one text; starts: of the texts in data."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.int64)
    for k in range(n):
        code = code << 8 | data[k : len(data) - n + 1 + k]
    inside = np.ones(len(code), bool)
    for s in starts.tolist():
        inside[max(0, s - n + 1) : s] = False
    return code[inside]


class ContextTrees:
    """Frozen statistics: for each order k, sorted codes of k + 1 bytes and their costs, and of k bytes and their escapes."""

    def __init__(self, languages: list[str], symbols: list[np.ndarray], costs: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray]):
        self.languages, self.symbols, self.costs, self.contexts, self.escapes = languages, symbols, costs, contexts, escapes

    @classmethod
    def train(cls, texts: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
        names = sorted(texts)
        joined = {x: np.frombuffer(b"".join(texts[x]), np.uint8).astype(np.int64) for x in names}
        starts = {x: np.cumsum([0, *map(len, texts[x])])[1:-1] for x in names}
        symbols, costs, contexts, escapes = [], [], [], []
        uniform = np.full(len(names), 8 * UNIT, np.int64)
        for k in range(order + 1):
            found = [np.unique(_grams(joined[x], starts[x], k + 1), return_counts=True) for x in names]
            seen = np.unique(np.concatenate([f[0] for f in found])) if names else np.zeros(0, np.int64)
            above = np.unique(seen >> 8)
            cost, out = np.full((len(seen), len(names)), -1, np.int64), np.zeros((len(above), len(names)), np.int64)
            for i, (code, count) in enumerate(found):
                at = np.searchsorted(above, code >> 8)
                n = np.bincount(at, count, len(above)).astype(np.int64)
                q = np.bincount(at, minlength=len(above))
                bits = lambda p: np.rint(-np.log2(p) * UNIT).astype(np.int64)
                cost[np.searchsorted(seen, code), i] = bits(count / (n + q)[at])
                out[n > 0, i] = bits(q[n > 0] / (n + q)[n > 0])
            for i in range(len(names)):  # what isn't seen here escapes
                todo = np.flatnonzero(cost[:, i] < 0)
                esc = out[np.searchsorted(above, seen[todo] >> 8), i]
                if k:
                    lower = seen[todo] & ((1 << 8 * k) - 1)
                    cost[todo, i] = esc + costs[k - 1][np.searchsorted(symbols[k - 1], lower), i]
                else:
                    cost[todo, i] = esc + uniform[i]
            symbols.append(seen)
            costs.append(cost)
            contexts.append(above)
            escapes.append(out)
        return cls(names, symbols, costs, contexts, escapes)

    def cost(self, code: np.ndarray, k: int) -> np.ndarray:
        """The cost of the last byte of each code of k + 1 bytes in the k bytes before it, in each language."""
        if k < 0:
            return np.full((len(code), len(self.languages)), 8 * UNIT, np.int64)
        out = np.zeros((len(code), len(self.languages)), np.int64)
        if not len(code):
            return out
        at = np.searchsorted(self.symbols[k], code)
        known = at < len(self.symbols[k])
        known[known] = self.symbols[k][at[known]] == code[known]
        out[known] = self.costs[k][at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            context = code[rest] >> 8
            at = np.searchsorted(self.contexts[k], context)
            held = at < len(self.contexts[k])
            held[held] = self.contexts[k][at[held]] == context[held]
            esc = np.zeros((len(rest), len(self.languages)), np.int64)
            esc[held] = self.escapes[k][at[held]]
            out[rest] = esc + self.cost(code[rest] & ((1 << 8 * k) - 1), k - 1)
        return out

    def compile(self) -> None:
        """Builds the dense table over renumbered bytes; at order 3 only."""
        self.order = len(self.symbols) - 1
        last = np.bincount(self.symbols[-1] & 255, minlength=256) if len(self.symbols[-1]) else np.zeros(256, np.int64)
        top = np.argsort(-last, kind="stable")[:63]
        self.small = np.full(256, 63, np.int32)
        self.small[top] = np.arange(63)
        if self.order != 3:
            self.dense = None
            return
        code = self.symbols[3]
        parts = [self.small[code >> 8 * k & 255] for k in (3, 2, 1, 0)]
        plain = np.all(np.array(parts) < 63, axis=0)
        key = parts[0] << 18 | parts[1] << 12 | parts[2] << 6 | parts[3]
        self.dense = np.full(1 << 24, -1, np.int32)
        self.dense[key[plain]] = np.flatnonzero(plain)
        self.narrow = self.costs[3].astype(np.int32)

    def _windows(self, data: np.ndarray) -> np.ndarray:
        """The cost, in each language, of the last byte of every sequence of order + 1 bytes in data."""
        wide = self.order + 1
        n = len(data) - wide + 1
        if self.dense is not None:
            s = self.small[data]
            key = s[:n] << 18
            key |= s[1 : n + 1] << 12
            key |= s[2 : n + 2] << 6
            key |= s[3 : n + 3]
            at = self.dense[key]
            odd = np.flatnonzero(at < 0)
            each = self.narrow[np.maximum(at, 0)] if len(self.narrow) else np.zeros((n, len(self.languages)), np.int32)
        else:
            odd = np.arange(n)
            each = np.zeros((n, len(self.languages)), np.int32)
        code = np.zeros(len(odd), np.int64)
        for j in range(wide):
            code = code << 8 | data[odd + j]
        code, where = np.unique(code, return_inverse=True)  # what isn't known is often the same
        each[odd] = self.cost(code, self.order)[where]
        return each

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language, in UNITs of a bit. Each text starts without a context."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        for k in np.flatnonzero(size > BLOCK).tolist():  # a block takes the bytes before it as context
            out[k] = self.lengths([texts[k][:BLOCK]])[0]
            for at in range(BLOCK, len(texts[k]), BLOCK):
                out[k] += self._windows(np.frombuffer(texts[k][at - self.order : at + BLOCK], np.uint8)).sum(axis=0, dtype=np.int64)
        short = np.flatnonzero(size <= BLOCK)
        size = size[short]
        data = np.frombuffer(b"".join(texts[k] for k in short.tolist()), np.uint8)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
        wide = self.order + 1
        for k in range(self.order):  # the first bytes of each text have short contexts
            own = np.flatnonzero(size > k)
            code = np.zeros(len(own), np.int64)
            for j in range(k + 1):
                code = code << 8 | data[starts[own] + j]
            out[short[own]] += self.cost(code, k)
        own = np.flatnonzero(size >= wide)
        n = len(data) - wide + 1
        if not len(own) or n <= 0:
            return out
        # each text owns the sequences that start at its bytes, but for its last three
        spans = np.empty(2 * len(own), np.int64)
        spans[0::2], spans[1::2] = starts[own], starts[own] + size[own] - wide + 1
        each = self._windows(data)
        padded = np.concatenate([each, np.zeros((1, each.shape[1]), each.dtype)])
        out[short[own]] += np.add.reduceat(padded, np.minimum(spans, n), axis=0, dtype=np.int64)[0::2]
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _identify(batches, shared):
    model: ContextTrees = shared.value
    if not hasattr(model, "dense"):
        model.compile()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        langs, scores = [], []
        for lo, hi in slices(texts):
            part = texts[lo:hi]
            lengths = model.lengths([(x or "").encode("utf-8", "surrogatepass") for x in part])
            for x, row in zip(part, lengths):
                if not x or not model.languages or not has_letter(x):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmin())
                gap = (row - row[best]) / UNIT / max(1.0, len(x)) ** 0.5  # bits; tempered, for bytes aren't independent
                langs.append(model.languages[best])
                scores.append(float(1 / np.exp2(-gap).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def train_trees(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_text_bytes: int = TRAIN_TEXT_BYTES) -> ContextTrees:
    """Context trees from at most ``max_docs`` labelled texts a language, whole ones of at most ``max_text_bytes`` bytes.

    All texts together have at most ``max_bytes`` bytes, shared evenly by the languages; a language of few rows is learnt from those.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("text <> ''")
    texts: dict[str, list[bytes]] = {}
    for row in sample_by_group(known, "lang", max_docs, max_bytes, max_text_bytes):
        texts.setdefault(row["lang"], []).append(row["text"].encode("utf-8", "surrogatepass"))
    return ContextTrees.train(texts, order)


def identify_languages(docs: DataFrame, model: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document; ``und`` and 0 for null and for texts without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(partial(_identify, shared=shared), f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows with a language whose crc32(doc_id) mod 3 isn't 1.

    A null doc_id is neither held out nor learnt from. Without any labelled row every text is ``und``.
    Repeated rows stay; an empty table gives an empty table; no other column is read.
    """
    third = crc32_mod(F.col(id_col), 3)
    model = train_trees(docs.where(third != 1), id_col=id_col, text_col=text_col, lang_col=lang_col)
    told = identify_languages(docs, model, id_col, text_col)
    return told.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
