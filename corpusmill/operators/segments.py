"""Greedy segments of pages under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import PAGE_MARK, py_strip, token_estimate
from corpusmill.operators.ordered import BLOCK, greedy_starts, running_sums, sorted_blocks
from corpusmill.session import cut


def page_array(text: Column, mark: str = PAGE_MARK) -> Column:
    """The stripped, non-blank parts of a text between page marks."""
    parts = F.split(F.replace(text, F.lit(mark), F.lit("\x00")), "\x00")
    return F.filter(F.transform(parts, py_strip), lambda p: p != "")


def greedy_segments(pages: Column, budget: int = 12000) -> Column:
    """array<struct<text, page_range, token_estimate>>: pages in order, a new segment where the next page would exceed the budget.

    A page over the budget is a segment of its own. The sizes are folded to where segments start, in the
    JVM, and the pages are sliced once.
    """
    sizes = F.transform(pages, lambda p, i: F.struct((i + 1).alias("i"), token_estimate(p).alias("n")))
    empty = F.struct(F.lit(0).cast("bigint").alias("open"), F.array().cast("array<struct<first:int,before:bigint>>").alias("starts"), F.lit(0).cast("bigint").alias("all"))

    def step(done: Column, item: Column) -> Column:
        joins = (F.size(done["starts"]) > 0) & (done["open"] + item["n"] <= budget)
        start = F.array(F.struct(item["i"].alias("first"), done["all"].alias("before")))
        return F.struct(F.when(joins, done["open"] + item["n"]).otherwise(item["n"]).alias("open"), F.when(joins, done["starts"]).otherwise(F.concat(done["starts"], start)).alias("starts"), (done["all"] + item["n"]).alias("all"))

    def cut(done: Column) -> Column:
        """The segments between one start and the next, or the end of all pages."""
        ends = F.concat(F.slice(done["starts"], F.lit(2), F.greatest(F.size(done["starts"]) - 1, F.lit(0))), F.array(F.struct((F.size(pages) + 1).alias("first"), done["all"].alias("before"))))
        return F.zip_with(done["starts"], F.slice(ends, F.lit(1), F.size(done["starts"])), lambda a, b: F.struct(
            F.array_join(F.slice(pages, a["first"], b["first"] - a["first"]), "\n\n").alias("text"),
            F.concat_ws("-", a["first"].cast("string"), (b["first"] - 1).cast("string")).alias("page_range"),
            (b["before"] - a["before"]).alias("token_estimate"),
        ))

    return F.aggregate(sizes, empty, step, cut)


def page_segments(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page", text_col: str = "text", budget: int = 12000, block_rows: int = BLOCK) -> DataFrame:
    """doc, segment (from 0), text, page_range, token_estimate for a table of pages: as segments(), where a document's pages are rows.

    However many pages a document has, they are summed up, cut and joined by many tasks: a page starts a
    segment if the tokens up to its end are over the budget, counted from where the open one began. What
    is gathered is a segment's text. page_range has the pages' places in their document, from 1. Null texts are empty pages.

    Only sizes are sorted and folded; texts wait and are joined to their segments by a number of their row. The
    folds are cut from one another, so a task runs one Python process and not one for each fold.
    """
    rows = pages.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("page"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    blocks = sorted_blocks(rows.select("doc", "page", "row", token_estimate(F.col("text")).cast("long").alias("tokens"), F.lit(1).alias("one")), ["doc", "page"], block_rows)
    upto = cut(running_sums(blocks, "doc", ["tokens", "one"], ["upto", "place"]).withColumns({"upto": F.col("upto").cast("long"), "place": F.col("place").cast("long")}))
    placed = cut(greedy_starts(upto.withColumn("next", F.col("upto") - F.col("tokens") + budget + 1), "doc", "upto", "next", "starts"))
    numbered = running_sums(placed.withColumn("start", F.col("starts").cast("int")), "doc", ["start"], ["segment"]).join(rows.select("row", "text"), "row")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n")
    found = numbered.groupBy("doc", (F.col("segment").cast("int") - 1).alias("segment")).agg(texts.alias("text"), F.concat_ws("-", F.min("place"), F.max("place")).alias("page_range"), F.sum("tokens").alias("token_estimate"))
    return found


def segments(docs: DataFrame, budget: int = 12000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, segment (from 0), text, page_range, token_estimate."""
    cut = docs.select(F.col(id_col).alias("doc_id"), page_array(F.col(text_col)).alias("pages"))
    return cut.select("doc_id", F.posexplode(greedy_segments(F.col("pages"), budget)).alias("segment", "s")).select("doc_id", "segment", "s.*")
