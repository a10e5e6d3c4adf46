"""Page layout: words to lines, tables to Markdown, and which words and tables belong together.

Input is a table of placed words or boxes (however they were decoded); coordinates are doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from corpusmill.functions.vectors import iou
from corpusmill.operators.overlap import BOX, overlap, overlaps, placed_boxes, small_pages, whole_box
from corpusmill.session import cut

# Tolerances of the layout.
Y_TOLERANCE, TAB_GAP, LEAST_IOU = 3.0, 50.0, 0.4


def markdown_table(rows: Column, drop_empty: bool = True) -> Column:
    """Markdown of array<array<string>>: rows padded to one width, line ends and bars made blanks, a ruler under the first row.

    With ``drop_empty``, empty columns and then empty rows go, and fewer than two rows give an empty
    text; without, tabs and bars in cells become blanks and a header alone is a table.
    """
    clean = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "\r\n" if drop_empty else "|\n\t", "  " if drop_empty else "   "))
    cells = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), clean))
    wide = F.coalesce(F.array_max(F.transform(cells, lambda r: F.size(r))), F.lit(0))
    even = F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))
    if drop_empty:
        places = F.when(wide > 0, F.sequence(F.lit(1), F.greatest(wide, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        used = F.filter(places, lambda k: F.exists(even, lambda r: F.element_at(r, k) != ""))
        even = F.filter(F.transform(even, lambda r: F.transform(used, lambda k: F.element_at(r, k))), lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.element_at(even, 1)
    ruler = line(F.transform(head, lambda c: F.lit("---")))
    body = F.transform(F.slice(even, F.lit(2), F.greatest(F.size(even) - 1, F.lit(0))), line)
    least = 2 if drop_empty else 1
    return F.when((F.size(even) < least) | (F.size(cells) < least), "").otherwise(F.array_join(F.concat(F.array(line(head), ruler), body), "\n"))


def words_outside(words: DataFrame, zones: DataFrame, page_col: str = "page") -> DataFrame:
    """Words (page, x0, y0, x1, y1, ...) that overlap no zone (page, x0, y0, x1, y1): an anti-join with the boxes that overlap one.

    Pages of few boxes are joined by the page alone, those of many are cut into tiles (see overlap). Words
    without a page or a whole box overlap nothing.
    """
    few = small_pages(words, zones, page_col)
    if few is None:
        return _words_outside_tiles(words, zones, page_col)
    z = placed_boxes(zones, page_col, "__z").where(few("__page"))
    w = {c: F.col(c).cast("double") for c in BOX}
    over = (w["x0"] < F.col("__zx1")) & (w["x1"] > F.col("__zx0")) & (w["y0"] < F.col("__zy1")) & (w["y1"] > F.col("__zy0")) & whole_box("")
    here = F.coalesce(few(page_col), F.lit(True))
    found = words.where(here).join(z, (F.col(page_col) == F.col("__page")) & over, "left_anti")
    return found if few.every else found.unionByName(_words_outside_tiles(words.where(~here), zones.where(~few(page_col)), page_col))


def _words_outside_tiles(words: DataFrame, zones: DataFrame, page_col: str) -> DataFrame:
    over = overlaps(words, zones, page_col).select(F.col("page").alias("__page"), *[F.col(f"a{c}").alias(f"__{c}") for c in BOX]).distinct()
    same = F.col(page_col) == F.col("__page")
    for c in BOX:
        same = same & (F.col(c).cast("double") == F.col(f"__{c}"))
    return words.join(over, same, "left_anti")


def _line_starts(y: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Where a line begins: at a page's first word, and where a word is over the tolerance from the line's first."""
    out, at = [], 0.0
    for v, new in zip(y.tolist(), pages.tolist()):
        if new or abs(v - at) > Y_TOLERANCE:
            at, new = v, True
        out.append(new)
    return np.array(out, bool)


def _line_batches(batches):
    """page, y, text of words (page, y0, x0, x1, word, and k: the place on the page, from 1) that come sorted; the last line of a batch waits for the next."""
    rest = None
    for batch in _and_end(batches):
        held = [*([] if rest is None else [rest]), *([] if batch is None else [pa.Table.from_batches([batch])])]
        if not sum(map(len, held)):
            continue
        words = pa.concat_tables(held)
        page, y, x0, x1 = words["page"].combine_chunks(), *(words[c].to_numpy() for c in ("y0", "x0", "x1"))
        new = words["k"].to_numpy() == 1
        new[0] = True  # what waited is a line's beginning
        starts = np.flatnonzero(_line_starts(y, new))
        if batch is not None:
            rest, starts = words.slice(starts[-1]), starts[:-1]
            words = words.slice(0, len(words) - len(rest))
        if not len(starts):
            continue
        n = len(words)
        line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        order = np.lexsort((x0[:n], line))  # stable
        wide = np.append(False, x0[order[1:]] - x1[order[:-1]] > TAB_GAP)
        wide[starts] = False
        word = words["word"].combine_chunks().take(pa.array(order))
        parts = pc.if_else(pa.array(wide), pc.binary_join_element_wise(pa.scalar("\t"), word, " "), word)
        lines = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), parts)
        first = pa.array(starts)
        yield pa.RecordBatch.from_arrays([page.take(first), pa.array(y[starts]), pc.binary_join(lines, " ")], names=["page", "y", "text"])


def _and_end(batches):
    """The batches, and None after the last."""
    yield from batches
    yield None


def _paired(pairs: list[dict], least: float) -> list[dict]:
    """Of one page's overlaps, in order of zone and table, the best free one of each zone."""
    used, out = set(), []
    zones: dict[int, list[dict]] = {}
    for p in pairs:
        zones.setdefault(p["zone_id"], []).append(p)
    for own in zones.values():
        free = [p for p in own if p["table_id"] not in used]
        if free and (best := max(free, key=lambda p: p["iou"]))["iou"] > least:
            used.add(best["table_id"])
            out.append(best)
    return out


def _folded(pages: DataFrame, make: Callable[[list[dict]], list[dict]], item: str) -> DataFrame:
    """page and the made items of a table (page, held): Arrow batches of whole pages, no shuffle."""
    kind, made_type = pages.schema["page"].dataType.simpleString(), to_arrow_type(_parse_datatype_string(item))

    def run(batches):
        for batch in batches:
            made = [make(x) for x in batch.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(made, made_type)], names=["page", "items"])

    folded = pages.select("page", "held").mapInArrow(run, f"page {kind}, items {item}")
    return folded.select("page", F.explode("items").alias("i")).select("page", "i.*")


def text_lines(words: DataFrame, page_col: str = "page") -> DataFrame:
    """page, y, text: words from top to bottom, a new line where one is over the tolerance from the line's first; a tab for wide gaps.

    A line's place depends on the one before, so a page's words are sorted and folded by one task, a line at a time.
    """
    flat = words.select(F.col(page_col).alias("page"), *[F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1")], F.col("word").cast("string").alias("word"))
    # A window, for it demands that a page's words are in one task. Of repartition() nothing is left where a join has dealt rows by page before,
    # and adaptive execution may read that join's exchange another way.
    order = flat.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "word", "x1")))
    return order.mapInArrow(_line_batches, f"page {flat.schema['page'].dataType.simpleString()}, y double, text string")


def matched_tables(zones: DataFrame, tables: DataFrame, page_col: str = "page", least: float = LEAST_IOU) -> DataFrame:
    """page, zone_id, table_id, iou: each zone, in order, takes the free table of the page with the greatest overlap, if over ``least``.

    Pages of many boxes are cut into tiles to find overlaps (see overlap); the choice among a page's pairs
    that are over ``least`` is made together. Ids are longs.
    """
    held = F.sort_array(F.collect_list(F.struct("zone_id", "table_id", "iou"))).alias("held")
    pairs = _table_pairs(zones, tables, page_col, least)
    return _folded(pairs.groupBy("page").agg(held), partial(_paired, least=least), "array<struct<zone_id:bigint,table_id:bigint,iou:double>>")


def _table_pairs(zones: DataFrame, tables: DataFrame, page_col: str, least: float) -> DataFrame:
    """page, zone_id, table_id, iou of all pairs over ``least``."""
    box = lambda n: F.struct(*[F.col(f"{n}{c}").alias(c) for c in BOX])
    if few := small_pages(zones, tables, page_col):
        z, t = placed_boxes(zones, page_col, "a", "zone_id").where(few("__page")), placed_boxes(tables, page_col, "b", "table_id").where(few("__page"))
        pairs = z.join(t.withColumnRenamed("__page", "__other"), (F.col("__page") == F.col("__other")) & overlap("a", "b"))
        pairs = pairs.select(F.col("__page").alias("page"), "zone_id", "table_id", iou(box("a"), box("b")).alias("iou")).where(F.col("iou") > least)
        return pairs if few.every else pairs.unionByName(_tiled_pairs(zones.where(~few(page_col)), tables.where(~few(page_col)), page_col, least))
    return _tiled_pairs(zones, tables, page_col, least)


def _tiled_pairs(zones: DataFrame, tables: DataFrame, page_col: str, least: float) -> DataFrame:
    box = lambda n: F.struct(*[F.col(f"{n}{c}").alias(c) for c in BOX])
    named = lambda d, n, i: d.select(F.col(page_col).alias("page"), F.col(i), *[F.col(c).cast("double").alias(f"{n}{c}") for c in BOX])
    pairs = overlaps(zones, tables, page_col).select("page", *[F.col(f"{n}{c}") for n in "ab" for c in BOX], iou(box("a"), box("b")).alias("iou")).where(F.col("iou") > least)
    for d, n, i in ((zones, "a", "zone_id"), (tables, "b", "table_id")):
        pairs = pairs.join(named(d, n, i), ["page", *[f"{n}{c}" for c in BOX]])
    return pairs.select("page", "zone_id", "table_id", "iou")


def page_text(elements: DataFrame) -> DataFrame:
    """page, text of elements (page, y, kind, text), from top to bottom; tables in their marks."""
    shown = F.when(F.col("kind") == "table", F.concat(F.lit("\n[ТАБЛИЦА]\n"), F.col("text"), F.lit("\n[/ТАБЛИЦА]"))).otherwise(F.col("text"))
    rows = elements.select("page", F.struct("y", "kind", shown.alias("s")).alias("e"))
    return rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["s"]), "\n").alias("text"))


def laid_out(words: DataFrame, zones: DataFrame, tables: DataFrame) -> DataFrame:
    """page, text of whole pages from placed words (page, x0, y0, x1, y1, word), table zones (zone_id and a box) and tables read by another way.

    tables: page, table_id, a box and rows (array<array<string>>). Each zone takes the table that overlaps
    it most; zones without one are text. Words outside the zones that have a table become lines, and
    lines and tables follow each other by their upper edges. Pages without any are left out.
    """
    paired = cut(matched_tables(zones, tables))  # two parts of the result need it
    own = zones.select("page", "zone_id", *BOX).join(paired.select("page", "zone_id", "table_id"), ["page", "zone_id"])
    lines = text_lines(words_outside(words, own)).select("page", "y", F.lit("text").alias("kind"), "text")
    # Markdown is made of the tables that a zone took, so they are joined and kept before it
    taken = cut(own.select("page", "table_id", "y0").join(tables.select("page", "table_id", "rows"), ["page", "table_id"]))
    placed = taken.select("page", F.col("y0").alias("y"), F.lit("table").alias("kind"), markdown_table(F.col("rows")).alias("text")).where("text <> ''")
    return page_text(lines.unionByName(placed))
