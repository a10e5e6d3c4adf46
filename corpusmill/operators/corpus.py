"""Corpus profile, catalog, preparation, boilerplate and deduplication by content hash."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx


def profiled(docs: DataFrame, name_col: str, text_col: str = "text") -> DataFrame:
    """name, pages, language, size_chars, size of each text."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(name_col).alias("name"), tx.page_count(c).alias("pages"), tx.language_vote(c).alias("language"), F.length(c).cast("long").alias("size_chars"), tx.size_bucket(F.length(c)).alias("size"))


def profile(found: DataFrame) -> DataFrame:
    """One row: totals, documents of each size (zero if none), of each language and page count, and mean pages (0 if empty)."""
    def histogram(c: str):
        counts = found.where(F.col(c).isNotNull()).groupBy(c).count()
        return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "count")))).alias(f"by_{c}"))

    total = found.agg(F.count("*").alias("total_documents"), *[F.count_if(F.col("size") == s).alias(s) for s in ("small", "medium", "large")], F.coalesce(F.avg("pages"), F.lit(0.0)).alias("avg_pages"), F.count_if(F.col("pages") < 6).alias("short_documents"))
    return total.join(F.broadcast(histogram("language"))).join(F.broadcast(histogram("pages")))


def page_histogram(found: DataFrame) -> DataFrame:
    """pages, documents, percent of all documents."""
    counts = found.groupBy("pages").agg(F.count("*").alias("documents"))
    return counts.withColumn("percent", F.col("documents") * 100.0 / F.sum("documents").over(Window.partitionBy()))


def catalog(docs: DataFrame, name_col: str, text_col: str = "text") -> DataFrame:
    """filename, original_pdf, pages, size_chars, type, preview (the first line's first 200 characters)."""
    c, name = F.coalesce(F.col(text_col), F.lit("")), F.col(name_col).cast("string")
    return docs.select(
        name.alias("filename"),
        F.regexp_replace(name, r"\.txt$", ".pdf").alias("original_pdf"),
        tx.page_count(c).alias("pages"),
        F.length(c).cast("long").alias("size_chars"),
        tx.document_type(c).alias("type"),
        F.substring(F.substring_index(c, "\n", 1), 1, 200).alias("preview"),
    )


def samples(found: DataFrame, order_col: str, n: int = 3) -> DataFrame:
    """The first n rows by a key."""
    return found.orderBy(order_col).limit(n)


def prepared(docs: DataFrame, limit: int = 100_000, sample: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, language, content, original_length, prepared_length: page marks removed, long texts cut to three parts.

    ``sample`` takes that many documents, by a seeded hash of their ids.
    """
    if sample is not None:
        docs = docs.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256), id_col).limit(sample)
    raw = F.coalesce(F.col(text_col), F.lit(""))
    language = tx.language_vote(raw, (("russian", "[а-яА-Я]"), ("english", "[a-zA-Z]")))
    content = tx.head_middle_tail(F.replace(raw, F.lit(tx.PAGE_MARK), F.lit("")), limit)
    return docs.select(F.col(id_col).alias("doc_id"), language.alias("language"), content.alias("content"), F.length(raw).cast("long").alias("original_length")).withColumn("prepared_length", F.length("content").cast("long"))


def volume(df: DataFrame, text_col: str = "content") -> DataFrame:
    """documents, total_chars, avg_chars, tokens (a quarter of the characters)."""
    n = F.length(F.col(text_col))
    return df.agg(F.count("*").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"), F.avg(n).alias("avg_chars"), F.floor(F.coalesce(F.sum(n), F.lit(0)) / 4).cast("long").alias("tokens"))


def generation_cost(answers: DataFrame, answer_col: str, per_thousand: float = 15.0) -> DataFrame:
    """answers, tokens and cost at a price a thousand estimated tokens."""
    tokens = F.coalesce(F.sum(tx.token_estimate(F.col(answer_col))), F.lit(0))
    return answers.agg(F.count("*").alias("answers"), tokens.alias("tokens"), (tokens / 1000 * per_thousand).alias("cost"))


def status_counts(log: DataFrame, status_col: str, prefixes: dict[str, str]) -> DataFrame:
    """How many statuses start with each prefix."""
    return log.agg(*[F.count_if(F.col(status_col).startswith(p)).alias(name) for name, p in prefixes.items()])


def _running(line: Column) -> Column:
    """Whether a frequent line is a header or footer: a short number, no word over three characters, or the name of a page."""
    return (line.rlike(r"(?U)^\d+$") & (F.length(line) < 5)) | ~F.exists(F.split(line, r"(?U)\s+"), lambda w: F.length(w) > 3) | line.contains("страница") | line.contains("page")


class Lines(NamedTuple):
    """How texts become lines, what lines are the same, and which frequent lines are headers or footers."""

    split: Callable[[Column], Column] = tx.split_lines
    key: Callable[[Column], Column] = lambda x: F.lower(tx.py_strip(x))
    running: Callable[[Column], Column] = _running


def line_frequency(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", how: Lines = Lines()) -> DataFrame:
    """doc, line (stripped, lower case), pages it is on; a null is a page."""
    lines = F.array_distinct(F.filter(F.transform(how.split(F.col(text_col)), how.key), lambda x: x != ""))
    found = pages.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("page"), F.explode(lines).alias("line")).groupBy("doc", "line")
    return found.agg((F.count_distinct("page") + F.max(F.col("page").isNull().cast("long"))).alias("pages"))


def repeated_lines(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", ratio: float = 0.9, least_pages: int = 6, how: Lines = Lines()) -> DataFrame:
    """doc, line: headers and footers. In documents of ``least_pages`` pages or more, lines that at least ``ratio`` of the pages (two at least)
    have, and that are short numbers, have no word over three characters, or name a page."""
    total = pages.groupBy(F.col(doc_col).alias("doc2")).agg(F.count_distinct(page_col).alias("n")).where(F.col("n") >= least_pages)
    found = line_frequency(pages, doc_col, page_col, text_col, how).where(how.running(F.col("line")))
    often = found.join(total, F.col("doc") == F.col("doc2")).where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * ratio)))
    return often.select("doc", "line")


def kept_lines(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", ratio: float = 0.9, least_pages: int = 6, how: Lines = Lines()) -> DataFrame:
    """The pages with the array of their lines but headers and footers for a text; the lines to remove are gathered a document."""
    often = repeated_lines(pages, doc_col, page_col, text_col, ratio, least_pages, how)
    gone = often.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__gone"))  # no more than a page has lines
    both = pages.join(gone, F.col(doc_col) == F.col("__doc"), "left")
    kept = F.filter(how.split(F.col(text_col)), lambda x: ~F.coalesce(F.array_contains(F.col("__gone"), how.key(x)), F.lit(False)))
    return both.withColumn(text_col, kept).drop("__doc", "__gone")


def without_repeated_lines(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", ratio: float = 0.9, least_pages: int = 6) -> DataFrame:
    """The pages with their headers and footers removed."""
    return kept_lines(pages, doc_col, page_col, text_col, ratio, least_pages).withColumn(text_col, F.array_join(text_col, "\n"))


def dedup_by_hash(docs: DataFrame, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """sha, first_id, copies of each different content (a string or bytes); null is a content of its own."""
    sha = F.sha2(F.col(content_col).cast("binary"), 256)
    return docs.groupBy(sha.alias("sha")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
