"""Divergence of sources: term distributions of all sources of a language, compared by systolic rotation.

A language's sources are dealt into blocks, and its kept terms into slices of a bounded number of terms.
The vectors of a block and slice stay in the partition they were checkpointed in (no exchange moves them again), while compressed
vectors of the other blocks come by in the rounds of a round-robin tournament; a meeting gives the
distances of all pairs of sources of the two blocks, for both directions. Partial sums of slices are
then added up. Each partition also keeps the foremost terms of its sources, a heap each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, drop_path, portions, resident, shared_path, small

#: Bytes of a term in lower-cased UTF-8: ASCII letters and all beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of a language that a kept term is in at least, and what smooths the counts.
LEAST_DOCUMENTS, PRIOR, UNIT = 30, 5, 1_000_000_000
TOP = 50
#: Terms of a slice and sources of a block, on average; rounds of the tournament that make one job.
SLICE, BLOCK, ROUNDS = 65_536, 16, 4
#: Entries that a task counts before it passes them on.
HELD = 500_000


def _counted(batches):
    """lang, source, term, n, docs: sums over what a task has read, or over a part of it."""
    count, docs = {}, {}

    def passed():
        for (lang, source), seen in count.items():
            terms = [t.decode("utf-8", "replace") for t in seen]
            within = docs[lang, source]
            for at in range(0, max(1, len(terms)), 50_000):
                part = terms[at : at + 50_000]
                same = lambda x: pa.array([x]).take(pa.array(np.zeros(len(part), np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(part, pa.string()), pa.array(list(seen.values())[at : at + 50_000], pa.int64()), pa.array([within[t] for t in list(seen)[at : at + 50_000]], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in (part for b in batches for part in portions([b], 2)):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            terms = TERM.findall(text.as_buffer().to_pybytes().lower())
            group = lang, source
            if group not in count:
                count[group], docs[group] = Counter(), Counter()
            held -= len(count[group])
            count[group].update(terms)
            docs[group].update(set(terms))
            held += len(count[group])
        if held > HELD:
            yield from passed()
            count, docs, held = {}, {}, 0
    yield from passed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly."""
    if not len(count):
        return np.zeros(0, np.int64)
    low, by = count + PRIOR, total + PRIOR * terms
    if int(low.max()) < (1 << 63) // UNIT:
        return 1 + low * UNIT // by
    return np.array([1 + int(x) * UNIT // by for x in low], np.int64)


def _pack(at: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    return zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes(), 1), zlib.compress(count.astype(np.int64).tobytes(), 1)


def _unpack(at: bytes, count: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(zlib.decompress(at), np.int32)).astype(np.int64), np.frombuffer(zlib.decompress(count), np.int64)


class _Resident:
    """The sources of one block and slice: dense shares, and sums that give the distance to any constant share."""

    def __init__(self, rows: list[dict], width: int):
        self.names = [r["source"] for r in rows]
        self.shares = np.empty((len(rows), width), np.int64)
        for own, r in zip(self.shares, rows):
            at, count = _unpack(r["at"], r["n"])
            own[:] = _shares(np.zeros(1, np.int64), r["total"], r["terms"])[0]
            own[at] = _shares(count, r["total"], r["terms"])
        self.ordered = np.sort(self.shares, axis=1)
        self.upto = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(self.ordered, axis=1)], axis=1)

    def distances(self, r: dict) -> np.ndarray:
        """Of all these sources to one: its terms cost a step each, all others come from the sums."""
        at, count = _unpack(r["at"], r["n"])
        zero = int(_shares(np.zeros(1, np.int64), r["total"], r["terms"])[0])
        width = self.shares.shape[1]
        below = np.array([np.searchsorted(row, zero) for row in self.ordered], np.int64)
        left = self.upto[np.arange(len(below)), below]
        rest = zero * below - left + (self.upto[:, -1] - left) - zero * (width - below)
        mine = self.shares[:, at]
        return rest + np.abs(mine - _shares(count, r["total"], r["terms"])).sum(axis=1) - np.abs(mine - zero).sum(axis=1)


VECTOR = "lang string, slice int, block int, source string, total long, terms long, width int, at binary, n binary"


def _pairs(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])


def _meet(key: tuple, home: pa.Table, guests: pa.Table) -> pa.Table:
    """Distances of each guest to each resident, told for both."""
    rows, out = home.to_pylist(), []
    if rows and len(guests):
        own = _Resident(rows, rows[0]["width"])
        for g in guests.to_pylist():
            for name, value in zip(own.names, own.distances(g)):
                out += [(g["lang"], name, g["source"], int(value)), (g["lang"], g["source"], name, int(value))]
    return _pairs(out)


def _at_home(table: pa.Table) -> pa.Table:
    """Distances of the residents of one block among themselves."""
    rows, out = table.to_pylist(), []
    own = _Resident(rows, rows[0]["width"])
    for k, r in enumerate(rows):
        out += [(r["lang"], r["source"], name, int(v)) for j, (name, v) in enumerate(zip(own.names, own.distances(r))) if j != k]
    return _pairs(out)


def _partner(block, round_, blocks):
    """The block that meets this one in a round of the circle method; itself where it has none to meet. blocks is even."""
    last = blocks - 1
    other = F.pmod(2 * round_ - block, last)
    return F.when(block == last, round_).when(block == round_, last).otherwise(other)


def _vectors(docs: DataFrame, least: int, slice_terms: int, block_sources: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (lang, source, total, terms, block, blocks); entries (lang, slice, at, source, n, ...), a row for each kept term of a group; and kept terms."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "counts")
    term_counts(docs).write.parquet(path)
    counts = spark.read.parquet(path)
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    by_term = cut(by_term.select("lang", "term", "lang_n"))
    size = cut(by_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")))
    size = small(size, size.count(), 100)  # else the join would deal out all terms of a language to one task
    slices = F.ceil(F.col("terms") / slice_terms).cast("int")
    placed = by_term.join(size, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), slices).cast("int"))
    # a slice has about as many terms as asked for, whatever the language has
    w = Window.partitionBy("lang", "slice")
    kept = cut(placed.select("lang", "slice", "term", "lang_n", (F.row_number().over(w.orderBy("term")) - 1).alias("at"), F.count("*").over(w).cast("int").alias("width")))
    own = cut(counts.join(kept.select("lang", "term", "slice", "at", "width"), ["lang", "term"]).drop("docs"))
    drop_path(spark, path)
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / block_sources).alias("b")).select("lang", F.when(F.col("b") > 1, F.col("b") + F.col("b") % 2).otherwise(1).alias("blocks"))
    groups = groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang").join(size, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), F.col("blocks").cast("int").alias("blocks"))
    return cut(groups), own, kept


def _compressed(table: pa.Table) -> pa.Table:
    """One source's entries of one slice as a compressed vector."""
    first = table.slice(0, 1)
    at, n = (table[c].to_numpy() for c in ("at", "n"))
    order = np.argsort(at)
    real = order[at[order] >= 0]
    a, b = _pack(at[real], n[real])
    return first.select(["lang", "slice", "block", "source", "total", "terms", "width"]).append_column("at", pa.array([a], pa.binary())).append_column("n", pa.array([b], pa.binary()))


def _foremost(top: int):
    def run(table: pa.Table) -> pa.Table:
        """A slice's terms with a larger share in one source than in its language, the foremost of them."""
        first = table.slice(0, 1).to_pylist()[0]
        gain = _shares(table["n"].to_numpy(), first["total"], first["terms"]) - _shares(table["lang_n"].to_numpy(), first["lang_total"], first["terms"])
        order = np.lexsort((table["at"].to_numpy(), -gain))
        order = order[gain[order] > 0][:top]
        same = lambda x: pa.array([x] * len(order), pa.string())
        return pa.table([same(first["lang"]), same(first["source"]), table["term"].combine_chunks().take(pa.array(order)).cast(pa.string()), pa.array(gain[order])], names=["lang", "source", "item", "value"])

    return run


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, slice_terms: int = SLICE, block_sources: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms from its language.

    Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language
    keeps those in at least ``least`` of its documents. A term's share p of a group is
    1 + floor(10^9 (count + 5) / (N + 5 V)), with N the group's occurrences of the V kept terms. Part
    'pair': the sum of |p - q| over all kept terms for each other source, the most distant first
    (ties: by name). Part 'term': p - q against the whole language for terms that the group has and
    whose share is larger there, the first ``top``.

    Null text, lang and source are empty. Each row is a document, repeated ones too. A group without
    terms has the shares of zero counts; a language that keeps none has pairs of value 0. Other columns are
    not read; no documents, no rows. Arithmetic is exact: whole numbers, of any size where counts are multiplied.
    """
    groups, own, kept = _vectors(docs, least, slice_terms, block_sources)
    entries = own.join(groups.drop("blocks"), ["lang", "source"])
    # every source is in every slice of its language, if only by a place that holds no term
    places = kept.select("lang", "slice", "width").distinct().join(groups, "lang")
    blank = places.select("lang", "slice", "block", "source", "total", "terms", "width", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("n"))
    real = entries.select("lang", "slice", "block", "source", "total", "terms", "width", "at", "n")
    vectors = real.unionByName(blank).groupBy("lang", "slice", "source").applyInArrow(_compressed, VECTOR)
    keys = ["lang", "slice", "block"]
    home = resident(vectors, *keys)
    pairs = [home.groupBy(*keys).applyInArrow(_at_home, "lang string, source string, item string, value long")]
    most = groups.agg(F.max("blocks")).first()[0] or 1
    of_lang = groups.select("lang", "blocks").distinct()
    for at in range(0, most - 1, rounds):
        round_ = F.explode(F.sequence(F.lit(at), F.lit(min(at + rounds, most - 1) - 1))).alias("round")
        guests = home.toDF(*home.columns).join(of_lang, "lang").select("*", round_).where("round < blocks - 1").withColumn("host", _partner(F.col("block"), F.col("round"), F.col("blocks")))
        # one of the two travels; which one it is changes, so that all blocks are hosts alike
        travels = F.when((F.col("block") + F.col("host")) % 2 == 0, F.col("block") > F.col("host")).otherwise(F.col("block") < F.col("host"))
        guests = guests.where(travels & (F.col("block") != F.col("host"))).withColumn("block", F.col("host").cast("int")).drop("blocks", "round", "host")
        met = home.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(_meet, "lang string, source string, item string, value long")
        pairs.append(cut(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    bare = groups.where("terms = 0").select("lang", "source", "block", "blocks")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(bare)
    wide = entries.join(kept.select("lang", "term", "lang_n"), ["lang", "term"]).select("lang", "slice", "source", "term", "at", "n", "lang_n", "total", "lang_total", "terms")
    heaps = wide.groupBy("lang", "slice", "source").applyInArrow(_foremost(top), "lang string, source string, item string, value long")
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    return ranked(found, "pair").unionByName(ranked(heaps, "term").where(F.col("rank") <= top))
