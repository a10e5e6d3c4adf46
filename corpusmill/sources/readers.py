"""Readers with declared schemas and checks. All go through Spark's own sources, so any file system Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources import large_files

DOCUMENTS = "doc_id string, language string, content string, original_length int, prepared_length int"
QA = "doc_id string, context_chunk_preview string, page_range string, question string, answer string, metadata struct<source:string,generation_timestamp:double>"
TRAINING = "doc_id string, context string, question string, answer string, similarity double"
RESULTS = "doc_id string, question string, reference string, generated string, rougeL double, bertscore_f1 double, f1_facts double, has_ref_facts boolean, has_gen_facts boolean"


class SchemaError(ValueError):
    """A source lacks what it must have."""


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaError(f"columns {', '.join(missing)} are missing")
    return df


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt", deep: bool = False, folder: str | None = None) -> DataFrame:
    """file_name, content: a row for each file, whole; ``deep`` looks into folders too.

    With ``folder``, files lie in folders ``folder=name``, as sinks.text_per_document leaves them, and are named by these.
    """
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", deep or folder is not None).text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    if folder:
        name = F.concat(F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), f"{folder}=([^/]*)/", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 0))
    return files.select(name.alias("file_name"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """file_name, length, content (bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("_metadata.file_name").alias("file_name"), "length", "content")


def _in_one_task(spark: SparkSession, path: str) -> bool:
    """Whether no file is larger than what a task reads anyway; larger ones are cut (see large_files)."""
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return large_files.largest_file(spark, path) <= most


def _json_rows(spark: SparkSession, path: str, schema: str, needs: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Records of JSON arrays with a column _bad (the text of what can't be read), and whether one lacks a needed field or can't be read."""
    if _in_one_task(spark, path):
        df = spark.read.schema(f"{schema}, _bad string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    else:
        df = large_files.json_records(spark, path, schema, "_bad")
    wrong = F.col("_bad").isNotNull()
    for c in needs:
        wrong = wrong | F.col(c).isNull()
    return df, wrong


def json_array(spark: SparkSession, path: str, schema: str = DOCUMENTS, needs: tuple[str, ...] = ("doc_id", "content")) -> DataFrame:
    """Rows of JSON arrays, of large files by many tasks. A query that meets a record without a needed field, or what isn't an object, fails."""
    df, wrong = _json_rows(spark, path, schema, needs)
    said = F.concat(F.lit(f"a record lacks {' or '.join(needs)} or can't be read: "), F.substring(F.coalesce("_bad", F.to_json(F.struct(*[c for c in df.columns if c != "_bad"]))), 1, 200))
    return df.where(F.when(wrong, F.raise_error(said).cast("boolean")).otherwise(True)).drop("_bad")


def json_array_and_bad(spark: SparkSession, path: str, schema: str = DOCUMENTS, needs: tuple[str, ...] = ("doc_id", "content")) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON arrays, and the text (record) of those that lack a needed field or can't be read."""
    df, wrong = _json_rows(spark, path, schema, needs)
    rest = [c for c in df.columns if c != "_bad"]
    return df.where(~wrong).drop("_bad"), df.where(wrong).select(F.coalesce("_bad", F.to_json(F.struct(*rest))).alias("record"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of JSON lines. strict: a bad line fails the query; else bad and blank lines are left out. limit: the first rows by ``order``."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    return df.orderBy(*(order or df.columns[:1])).limit(limit) if limit is not None else df


def json_lines_and_bad(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines (line) that can't be read as such; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"))
    bad = F.col("p").isNull() | F.col("p._bad").isNotNull()
    return parsed.where(~bad).select("p.*").drop("_bad"), parsed.where(bad).select(F.col("value").alias("line"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, needs: tuple[str, ...] = ("doc_id", "question", "generated"), strict: bool = True) -> DataFrame:
    """Rows of CSV files with a header; quoted cells may hold line ends. Without a needed column: SchemaError, or no rows if not ``strict``.

    Files that are larger than a task's share are read by many tasks. Without ``schema`` the header names the columns, all strings.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if not schema:
        names = header.csv(path).columns
        if any(c not in names for c in needs):
            return require(header.csv(path), list(needs)) if strict else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in needs))
        schema = ", ".join(f"`{c}` string" for c in names)
    found = header.schema(schema).csv(path) if _in_one_task(spark, path) else large_files.csv_records(spark, path, schema)
    if not strict and any(c not in found.columns for c in needs):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in needs))
    return require(found, list(needs))


def csv_and_bad(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files with a header, and the text (record) of those that don't fit the schema."""
    found = large_files.csv_records(spark, path, schema, "_bad")
    return found.where("_bad is null").drop("_bad"), found.where("_bad is not null").select(F.col("_bad").alias("record"))


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored collection's chunks and vectors; ValueError if there is none of that name."""
    found = spark.read.parquet(path).where(F.col("collection") == name)
    if found.isEmpty():
        raise ValueError(f"there is no collection {name}")
    return found


def complete_rows(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "question", "answer")) -> DataFrame:
    """Rows in which no needed field is null or empty."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return df.where(keep)
