"""Writers: text, JSON lines and arrays, CSV, partitioned splits and vector collections, all as Spark's distributed writes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.batches import portions


def text(df: DataFrame, path: str, col: str, mode: str = "errorifexists") -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def text_per_document(df: DataFrame, path: str, name: str, col: str) -> None:
    """A file for each document, in a folder of its name, with a line end after the text; a document is one row."""
    df.select(F.col(name).cast("string").alias("name"), F.col(col).cast("string").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def json_array(df: DataFrame, path: str) -> None:
    """Files that are JSON arrays, one for each partition that has rows: a line a row, with brackets and commas."""

    def lines(batches):
        first = True
        for batch in portions(batches, 0):
            marks = pa.array(["[" if first and k == 0 else "," for k in range(len(batch))], pa.string())
            first = False
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column(0), "")], names=["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def json_rows(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines. append adds to what is there, so a rerun repeats rows; else it is replaced."""
    df.write.mode("append" if append else "overwrite").json(path)


def report(df: DataFrame, path: str) -> None:
    """A summary of few rows, as one JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_rows(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table is written with its header alone."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def splits(df: DataFrame, path: str, split_col: str = "split", files: int = 16) -> None:
    """A folder for each split with at most ``files`` files: rows of a split are dealt by hash over so many tasks before they are written."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    df.repartition(F.col(split_col), part).write.mode("overwrite").partitionBy(split_col).json(path)


def collection(chunks: DataFrame, path: str, name: str, append: bool = False) -> None:
    """Chunks and vectors of one collection; a read of one collection touches its folder only.

    What the collection held is replaced, so a rerun repeats nothing, and others stay as they are; append adds to it.
    """
    rows = chunks.withColumn("collection", F.lit(name)).write.option("partitionOverwriteMode", "dynamic")
    rows.mode("append" if append else "overwrite").partitionBy("collection").parquet(path)
