"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast up to about this many bytes (its rows times a row's bytes); beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, which has no other machine, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusmill/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of shared_path(), through the file system it lies in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and forgets how it was made.

    Spark deletes the files of such tables that nothing refers to any more where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as this package's own sessions do.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def resident(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys and materialised so that Spark knows where its rows lie: what groups or cogroups it by those keys moves none of them.

    Adaptive plans don't tell how they leave their rows, so the last step, a single exchange, is none.
    """
    spark, kept = df.sparkSession, cut(df)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` rows of about ``row_bytes`` bytes stay within BROADCAST_BYTES; else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII takes the short way."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc32_mod(col: Column, by: int) -> Column:
    """crc32 of a value's text form, modulo ``by``; null for null."""
    return F.crc32(col.cast("string")) % by


#: What training reads: no text of more bytes than this (a parameter of everything that trains).
TRAIN_TEXT_BYTES = 64_000


def _usable(df: DataFrame, most_bytes: int) -> DataFrame:
    return df.where(F.col("id").isNotNull() & (F.octet_length("text") <= most_bytes))


def _fetched(df: DataFrame, ids: DataFrame, most_bytes: int) -> list[Row]:
    """A row for each of a bounded number of ids, with the other columns of the ids' table; of repeated ids the least row counts."""
    rest = [c for c in df.columns if c != "id"]
    rows = _usable(df, most_bytes).join(F.broadcast(ids), "id")
    more = [F.first(c).alias(c) for c in ids.columns if c != "id"]
    one = rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("row"), *more)
    return sorted(one.select("id", "row.*", *[c for c in ids.columns if c != "id"]).collect(), key=lambda r: r["id"])


def sample_rows(df: DataFrame, most: int, most_bytes: int = TRAIN_TEXT_BYTES, salt: str = "", without: list | None = None) -> list[Row]:
    """At most ``most`` rows of a table with columns id and text, for training: the first in the order of a salted hash of id.

    The choice doesn't depend on how rows lie. Rows whose id or text is null, whose text has over
    ``most_bytes`` bytes, or whose id is in the short list ``without`` are left out before the choice,
    so what reaches the driver is bounded by most * most_bytes. Of rows with one id the least counts.
    """
    usable = _usable(df, most_bytes).select("id")
    if without:
        usable = usable.join(F.broadcast(df.sparkSession.createDataFrame([(x,) for x in without], df.select("id").schema)), "id", "left_anti")
    ids = usable.distinct().orderBy(F.xxhash64(F.lit(salt), "id"), "id").limit(most)
    return _fetched(df, ids, most_bytes)


def sample_by_group(df: DataFrame, group: str, most: int, most_total_bytes: int, most_bytes: int = TRAIN_TEXT_BYTES) -> list[Row]:
    """Training rows (id, text, group) for each group alike: the first ``most`` in the order of a hash of id, up to a number of bytes.

    ``most_total_bytes`` bounds all groups' texts together; each group may use an equal share of it.
    Null groups are left out. Ranking sends at most ``most`` (id, size) rows of a group and task.
    """
    sized = _usable(df, most_bytes).where(F.col(group).isNotNull()).select("id", F.col(group).alias("g"), F.octet_length("text").cast("long").alias("size"))
    order = [F.xxhash64("id"), F.col("id"), F.col("size")]
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= most)
    ranked = cut(ranked.groupBy("g", "id").agg(F.min("rank").alias("rank"), F.min("size").alias("size")))
    groups = max(1, ranked.select("g").distinct().count())
    upto = F.sum("size").over(Window.partitionBy("g").orderBy("rank"))  # of ``most`` rows at most
    ids = cut(ranked.withColumn("upto", upto).where(F.col("upto") <= most_total_bytes // groups).select(F.col("id").alias("own_id"), F.col("g").alias("own_g")).distinct())
    rows = _usable(df, most_bytes).join(small(ids, ids.count(), 64), (F.col("id") == F.col("own_id")) & (F.col(group) == F.col("own_g")), "left_semi")
    one = rows.groupBy("id", group).agg(F.min("text").alias("text"))
    return sorted(one.collect(), key=lambda r: (r[group], r["id"]))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int = TRAIN_TEXT_BYTES) -> list[Row]:
    """At most ``most`` rows (id, text, what else docs has, label) for training, chosen as in sample_rows().

    docs: id, text and more. labels: id, label; of repeated ids the largest label counts, nulls don't.
    Labels whose documents are absent or too long are left out before the choice; only ids are shuffled.
    """
    own = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    there = own.join(_usable(docs, most_bytes).select("id"), "id", "left_semi")
    ids = cut(there.orderBy(F.xxhash64(F.lit(""), "id"), "id").limit(most))
    return _fetched(docs, ids, most_bytes)


#: Bytes of an Arrow batch that map_batches() asks Spark for, about.
BATCH_BYTES, BATCH_BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _then_released(batches, run):
    yield from run(batches)
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the second stands for what Python itself has freed
        pool.release_unused()


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow() for texts: batches have a bounded number of bytes, and a task gives freed memory back at its end.

    Spark else counts a batch by its rows, so texts make batches of tens of MB, in the JVM outside its heap and in
    Python, and Python processes keep for the next step what they once took. What is mapped may run later,
    so the bound stays in the session; where a session has set one itself, that holds.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES_KEY, None) is None:
        conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
    return df.mapInArrow(partial(_then_released, run=run), schema)


def portions(batches, column: int, most: int = 2_000_000):
    """The rows of Arrow batches in order, as batches with a bounded number of bytes in one string column, one row at least."""
    for batch in batches:
        held = batch.column(column)
        width = np.int64 if pa.types.is_large_string(held.type) or pa.types.is_large_binary(held.type) else np.int32
        ends = np.frombuffer(held.buffers()[1], width)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, width)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def slices(texts: list, chars: int = 500_000):
    """(from, to) of consecutive texts with a bounded number of characters, one text at least."""
    at, held = 0, 0
    for k, x in enumerate(texts):
        size = len(x or "")
        if k > at and held + size > chars:
            yield at, k
            at, held = k, 0
        held += size
    if texts:
        yield at, len(texts)
