"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

*Memtables*: each task of a flush sorts its (digest, identifier) entries by digest and writes them as
files of at most MEMTABLE entries, which make up one sorted run. *Filters*: a flush also writes a
sparse blocked Bloom filter of its run, a row for each block that has an entry: the bits set in it and
the number of entries. *Probing*: over the filters alone, the blocks are found in which entries, of
one run or of several, may be equal: those with fewer bits than unequal entries would set. A run none
of whose blocks is among them isn't read. *Compaction*: the entries of such blocks merge into one entry
for each digest that occurs again: the identifier to keep and the number of rows. Map-side aggregation
leaves one entry for each digest and task, so a text with very many copies is no hot key. Runs of one
level merge into a sorted run of the next when there are FANOUT of them.
*Byte verification*: the texts of digests with two entries or more are compared byte by byte: a digest
must have one text. Digests for which that fails (collisions) are grouped once more by the text itself.

Texts are read twice; the second time only different texts of repeated digests are shuffled, and of each
one a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower, cut, drop_path, shared_path, small

#: Entries of a memtable, and runs of a level before they merge.
MEMTABLE, FANOUT = 1_000_000, 8
#: Bits that an entry sets in its block: one in each of so many equal parts of a block's 64 bits.
PARTS = 4
#: Bytes of a digest, of a digest with an identifier, and of a level's entry, as joins hold them.
KEY_BYTES, PAIR_BYTES, ENTRY_BYTES = 64, 96, 160


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keyed(docs: DataFrame, text_col: str, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    """Columns t (the normalised text) and d (its digest), and ``more``."""
    made = docs.select(*more, ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return made.withColumn("d", digest(F.col("t")))


def _wins(keep: str) -> Column:
    """The row that stays: the largest or smallest identifier; null identifiers lose, repeated rows go by row number."""
    row = F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id"), F.col("r").alias("r"))
    if keep == "largest":
        return F.max(row)
    return F.min(F.struct(F.col("id").isNull().alias("hasnt"), F.col("id").alias("id"), F.col("r").alias("r")))


def _block(d: Column) -> Column:
    """The block of a digest: 40 bits of a hash of it."""
    return F.shiftrightunsigned(F.xxhash64(d), 24)


def _bits(d: Column) -> Column:
    """The bits that a digest sets in its block, from the other 24 bits of its hash."""
    h, wide = F.xxhash64(d), 64 // PARTS
    bits = F.lit(0).cast("long")
    for k in range(PARTS):
        place = F.shiftrightunsigned(h, 4 * k).bitwiseAND(F.lit(wide - 1)).cast("int") + wide * k
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits


@dataclass
class Run:
    """A sorted run of the index: its number and level, and where its entries and its filter lie."""

    number: int
    level: int
    path: str
    filter_path: str


class MergeIndex:
    """A log-structured merge index over the texts of a table.

    ``flush`` adds a table's rows as a sorted run, ``compact`` merges what may be equal, and ``verified``
    gives one row for each flushed row. ``read`` tells the runs that the last compaction read. Runs and
    filters lie in the shared folder until ``drop``.
    """

    def __init__(self, spark, keep: str = "largest", digest: Callable[[Column], Column] = sha256_digest, memtable: int = MEMTABLE, fanout: int = FANOUT):
        if keep not in ("largest", "smallest"):
            raise ValueError("keep must be largest or smallest")
        self.spark, self.keep, self.digest, self.memtable, self.fanout = spark, keep, digest, memtable, fanout
        self.runs: list[Run] = []
        self.tables: list[tuple[DataFrame, str, str]] = []
        self.level: DataFrame | None = None
        self.read: list[int] = []
        self.made = 0

    def _written(self, rows: DataFrame, level: int) -> Run:
        run = Run(self.made, level, shared_path(self.spark, "run"), shared_path(self.spark, "filter"))
        self.made += 1
        rows.sortWithinPartitions("d").write.option("maxRecordsPerFile", self.memtable).parquet(run.path)
        entries = self.spark.read.parquet(run.path).select(_block(F.col("d")).alias("block"), _bits(F.col("d")).alias("bits"))
        entries.groupBy("block").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("n")).write.parquet(run.filter_path)
        return run

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        rows = _keyed(docs, text_col, self.digest, F.col(id_col).alias("id"))
        row = F.struct(F.lit(len(self.tables)).alias("flush"), F.monotonically_increasing_id().alias("row"))
        self.runs.append(self._written(rows.select("d", "id", row.alias("r")), 0))
        self.tables.append((docs, id_col, text_col))
        self.level = None
        level = 0
        while len(own := [x for x in self.runs if x.level == level]) >= self.fanout:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            merged = self._written(self._entries(own).repartitionByRange(parts, "d"), level + 1)
            self.runs = [x for x in self.runs if x.level != level] + [merged]
            for x in own:
                drop_path(self.spark, x.path)
                drop_path(self.spark, x.filter_path)
            level += 1

    def _entries(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.parquet(*[x.path for x in runs])

    def rows(self) -> DataFrame:
        """d, id and r (flush and row) of every flushed row."""
        return self._entries(self.runs)

    def _shared_blocks(self) -> DataFrame:
        """The blocks in which entries may be equal, and how many entries those have; from the filters alone."""
        filters = self.spark.read.parquet(*[x.filter_path for x in self.runs])
        blocks = filters.groupBy("block").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
        return cut(blocks.where(F.bit_count("bits") < F.col("n") * PARTS).select("block", "n"))

    def compact(self) -> DataFrame:
        """One entry for each digest that occurs again: win (the row that stays) and n (rows)."""
        if self.level is None:
            blocks = self._shared_blocks()
            n = blocks.count()
            blocks = small(blocks.select("block"), n, 16)
            self.read = [x.number for x in self.runs if n and self.spark.read.parquet(x.filter_path).join(blocks, "block", "left_semi").limit(1).count()]
            found = self._entries([x for x in self.runs if x.number in self.read]) if self.read else self.rows().limit(0)
            found = found.withColumn("block", _block(F.col("d"))).join(blocks, "block", "left_semi")
            self.level = cut(found.groupBy("d").agg(_wins(self.keep).alias("win"), F.count("*").alias("n")).where("n > 1"))
        return self.level

    def _texts(self) -> DataFrame:
        found = None
        for k, (docs, id_col, text_col) in enumerate(self.tables):
            row = F.struct(F.lit(k).alias("flush"), F.monotonically_increasing_id().alias("row")).alias("r")
            part = _keyed(docs, text_col, self.digest, F.col(id_col).alias("id"), row)
            found = part if found is None else found.unionByName(part)
        return found

    def verified(self) -> DataFrame:
        """id, keep_id, group_size, kept and d (the digest) of every flushed row."""
        level = self.compact()
        n = level.count()
        alone = self.rows().withColumns({"win": F.struct("id", "r"), "n": F.lit(1).cast("long")})
        if not n:
            return self._told(alone)
        hits = small(level.select("d"), n, KEY_BYTES)
        texts = self._texts().select("d", "t").join(hits, "d", "left_semi").groupBy("d", "t").agg(F.count("*").alias("n"))
        clash = cut(texts.groupBy("d").agg(F.count("*").alias("texts")).where("texts > 1").select("d"))
        out = None
        if clashes := clash.count():
            rows = cut(self._texts().join(small(clash, clashes, KEY_BYTES), "d", "left_semi"))
            groups = cut(rows.groupBy("d", "t").agg(_wins(self.keep).alias("win"), F.count("*").alias("n")))
            out = self._told(rows.join(groups, ["d", "t"]))
            level = level.join(clash, "d", "left_anti")
        of = level.select("d", F.struct("win.id", "win.r").alias("win"), "n")
        rows = self.rows() if out is None else self.rows().join(small(clash, clashes, KEY_BYTES), "d", "left_anti")
        joined = rows.join(small(of, n, ENTRY_BYTES), "d", "left")
        told = self._told(joined.withColumns({"win": F.coalesce("win", F.struct("id", "r")), "n": F.coalesce("n", F.lit(1).cast("long"))}))
        return told if out is None else told.unionByName(out)

    @staticmethod
    def _told(joined: DataFrame) -> DataFrame:
        return joined.select("id", F.col("win.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("win.r") == F.col("r")).alias("kept"), "d")

    def drop(self) -> None:
        for x in self.runs:
            drop_path(self.spark, x.path)
            drop_path(self.spark, x.filter_path)
        self.runs = []


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest (or smallest) identifier stays; a null identifier loses to any
    other. Of repeated rows (same identifier and text) exactly one is kept. An empty table gives an
    empty table; other columns of ``docs`` are not read.
    """
    index = MergeIndex(docs.sparkSession, keep, digest)
    index.flush(docs, id_col, text_col)
    told = index.verified()
    return told.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("d")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that go are removed by an anti-join on (identifier, digest), nulls included. Rows repeated
    with the same identifier and text become one.
    """
    index = MergeIndex(docs.sparkSession, keep)
    index.flush(docs, id_col, text_col)
    told = cut(index.verified().select("id", "d", "kept", F.col("id").eqNullSafe(F.col("keep_id")).alias("own")))
    index.drop()
    gone, again = told.where("not own").select("id", "d").distinct(), told.where("own and not kept").select("id", "d").distinct()
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(id_col).alias("id"), sha256_digest(text).alias("d"), row)

    def without(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("id").alias("id2"), F.col("d").alias("d2"))
        n = right.count()
        if not n:
            return left if how == "left_anti" else left.limit(0)
        return left.join(small(right, n, PAIR_BYTES), (F.col("d") == F.col("d2")) & F.col("id").eqNullSafe(F.col("id2")), how)

    stay = without(rows, gone, "left_anti")
    once = without(stay, again, "left_anti")
    if again.limit(1).count():
        first = without(stay, again, "left_semi").groupBy("id", "d").agg(F.first("row").alias("row"))
        once = once.unionByName(first.select("id", "d", "row"))
    return once.select("row.*")
