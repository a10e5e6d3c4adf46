"""Spelling variants by full neighbourhood generation.

Every word emits all its distinct deletions, replacements and insertions over the observed alphabet,
and these candidates are hash-joined to the vocabulary; a candidate that is a word is a near word by
construction, so no distance is ever measured.

A vocabulary of a million words has about a thousand million candidates, so they are joined where they
are made. An edit leaves one half of a word as it was: those in the second half keep the first and
the other way round. So words and vocabulary are shuffled by that half, six rows a word, and
candidates are looked up in the hash set of the words that share it. A half's words are few, for they
differ in the other half only.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, portions

RUN = re.compile("[a-zÀ-ÿ]+")
LONG_RUN = re.compile("[a-zÀ-ÿ]{5,}")
NO_LETTER = re.compile("[^a-zÀ-ÿ]")
#: A word has so many code points at least. A run of fewer never makes one.
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One in so many (document, run) pairs loses a code point.
ONE_IN = 97
#: Characters of a text that are taken at once, and words that a task counts before it passes them on.
BLOCK, HELD = 1 << 20, 400_000
#: Candidates of longer words are made as hashes, each in constant time, and only those that hit as texts.
LITERAL = 256
MODULUS, BASE = (1 << 31) - 1, 1_000_003


def blocks(text: str, size: int = BLOCK):
    """Consecutive parts of a text that no run of letters crosses."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            stop = NO_LETTER.search(text, end)
            end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end


def _counted(batches):
    held: Counter = Counter()

    def passed():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in (part for b in batches for part in portions([b], 1)):
        for doc, text in zip(batch.column(0), batch.column(1)):
            start = crc32(f"{doc.as_py()}:".encode())
            for block in blocks(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")):
                runs = LONG_RUN.findall(block)
                held.update(runs)
                found = list(set(runs))
                for run, h in zip(found, map(crc32, map(str.encode, found), repeat(start))):
                    if not h % ONE_IN:
                        n, at = runs.count(run), h % len(run)
                        held[run] -= n
                        held[run[:at] + run[at + 1 :]] += n
        if len(held) > HELD:
            yield passed()
            held = Counter()
    if held:
        yield passed()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with at least ``least`` occurrences."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) & (F.char_length("word") >= LEAST_LENGTH))


def _hash_parts(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, powers of the base, and sums of the products of the two up to each place."""
    c = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.int64)
    power = np.ones(1, np.int64)
    while len(power) < len(c) + 1:
        power = np.concatenate([power, power * pow(BASE, len(power), MODULUS) % MODULUS])
    power = power[: len(c) + 1]
    return c, power, np.concatenate([[0], np.cumsum(c * power[:-1] % MODULUS)])


def _long_hits(word: str, places: range, gaps: range, alphabet: list[str], known: set[str]) -> set[str]:
    """Those candidates of a long word that are known, by the polynomial hash of each candidate."""
    c, power, upto = _hash_parts(word)
    total = int(upto[-1])
    hashes = {d: np.array([int(_hash_parts(w)[2][-1]) % MODULUS for w in known if len(w) == len(word) + d and w != word], np.int64) for d in (-1, 0, 1)}
    i, g, found = np.array(places, np.int64), np.array(gaps, np.int64), set()
    back = pow(BASE, -1, MODULUS)
    if len(hashes[-1]):
        made = (upto[i] + (total - upto[i + 1]) % MODULUS * back) % MODULUS
        found |= {word[:k] + word[k + 1 :] for k in i[np.isin(made, hashes[-1])]}
    for x in alphabet:
        if len(hashes[0]):
            made = (total + (ord(x) - c[i]) * power[i]) % MODULUS
            found |= {word[:k] + x + word[k + 1 :] for k in i[np.isin(made, hashes[0])]}
        if len(hashes[1]):
            made = (upto[g] + ord(x) * power[g] + (total - upto[g]) % MODULUS * BASE) % MODULUS
            found |= {word[:k] + x + word[k:] for k in g[np.isin(made, hashes[1])]}
    return found & known


def _hits(word: str, places: range, gaps: range, alphabet: list[str], known: set[str]) -> set[str]:
    """Those of a word's candidates with an edit at these places that are known words."""
    if len(word) > LITERAL:
        return _long_hits(word, places, gaps, alphabet, known)
    found = known.intersection([word[:i] + word[i + 1 :] for i in places])
    for i in places:
        around = (word[:i], word[i + 1 :])
        found |= known.intersection([x.join(around) for x in alphabet])
    for g in gaps:
        around = (word[:g], word[g:])
        found |= known.intersection([x.join(around) for x in alphabet])
    return found


def _near(batches, alphabet: list[str]):
    """word, near, n of near, from rows (key, first, length, word, n) in the order of key; see near_words()."""
    key, words, out = None, {}, ([], [], [])

    def joined():
        if len(words) > 1:
            known, half = set(words), length // 2
            for word in words:
                if len(word) != length:
                    continue
                places, gaps = (range(half, length), range(half, length + 1)) if first else (range(half), range(half))
                for near in _hits(word, places, gaps, alphabet, known):
                    # an edit of equal neighbours may be told of both halves: then the second counts
                    if near != word and (first or not near.startswith(word[:half])):
                        out[0].append(word), out[1].append(near), out[2].append(words[near])

    def passed():
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for k, f, size, word, n in zip(*(column.to_pylist() for column in batch.columns)):
            if k != key:
                if key is not None:
                    joined()
                if len(out[0]) > 20_000:
                    yield passed()
                key, first, length, words = k, f, size, {}
            words[word] = n
    if key is not None:
        joined()
    yield passed()


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs of a vocabulary (word, n) that differ by one inserted, deleted or replaced code point, both ways.

    For words of each length, a key is that length with the first, or the last, half. A word stands
    under the keys of its own length, as a word that makes candidates and one that is found, and of the
    lengths beside it, to be found. The alphabet (at most 90 letters) is all that is collected.
    """
    alphabet = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").distinct().collect())
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("length"))
    rows = rows.select("word", "n", "length", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    half = F.floor(F.col("length") / 2).cast("int")
    kept = F.when(F.col("first"), F.expr("left(word, CAST(floor(length / 2) AS INT))")).otherwise(F.expr("right(word, length - CAST(floor(length / 2) AS INT))"))
    keyed = rows.select(F.concat(F.when(F.col("first"), "a").otherwise("b"), F.col("length").cast("string"), F.lit(":"), kept).alias("key"), "first", "length", "word", "n").where(half > 0)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_near, alphabet=alphabet), "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last by pointer doubling. n doubles at each form, so the chains have at most 62 steps and this six rounds."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, least: int = LEAST_COUNT, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of the documents with the near word it is a variant of.

    Words: maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased, of at least five code
    points and ``least`` occurrences; where 97 divides the crc32 of '<doc_id>:<run>', the run's code
    point at crc32 % length is taken out first. form: of a word's near words that of largest n (ties:
    smallest), if its n is ``factor`` times the word's or more, else null. root: the last of the chain
    of forms, the word itself without one.

    Null texts are empty, a null doc_id is an empty text; each row counts, repeated ones too; other
    columns are not read. Texts are taken in blocks and words of any length are whole. No documents, no rows.
    """
    words = cut(vocabulary(docs, least))
    own = words.select("word", "n", F.lit(0).alias("one"), F.lit(None).cast("struct<less:bigint,near:string>").alias("best"))
    pairs = near_words(words).select("word", F.lit(None).cast("long").alias("n"), F.lit(1).alias("one"), F.struct((-F.col("near_n")).alias("less"), "near").alias("best"))
    told = own.unionByName(pairs).groupBy("word").agg(F.max("n").alias("n"), F.sum("one").alias("n_near"), F.min("best").alias("best"))
    counts = -F.col("best.less") >= factor * F.col("n")
    told = cut(told.select("word", "n", "n_near", F.when(counts, F.col("best.near")).alias("form"), F.when(counts, -F.col("best.less")).alias("form_n")))
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
