"""Tables on pages of placed words: found by the gaps between cells and the lines in which cells start at the same places.

Words become lines, lines are cut into cells at wide gaps, and a run of lines of several cells each, close
below one another, is a table if cells of most of its lines start at two places or more. All of
it is windows over a page's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.layout import Y_TOLERANCE

#: A gap between words that parts cells; how far below the line before a table's next may begin, in that line's heights; how far cells of a
#: column may start from each other; the share of a table's lines that a column is in at least; and lines of a table at least.
CELL_GAP, LINE_HEIGHTS, ALIGNED, SHARE, LEAST_LINES = 12.0, 2.5, 6.0, 0.6, 2


def _since(condition, w):
    """How often a condition has held so far."""
    return F.sum(F.when(condition, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cells(words: DataFrame, page_col: str = "page", gap: float = CELL_GAP, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """page, line (from 1, downwards), cell (from 1), x0, y0, x1, y1, text: words (page, x0, y0, x1, y1, word) in lines, cut where a gap is wider than ``gap``.

    A word that begins over ``tolerance`` below the one before it, from top to bottom, begins a line.
    Words without a page or a whole box are left out; null words are empty.
    """
    box = ["x0", "y0", "x1", "y1"]
    rows = words.select(F.col(page_col).alias("page"), *[F.col(c).cast("double").alias(c) for c in box], F.coalesce("word", F.lit("")).alias("word")).dropna(subset=["page", *box])
    down = Window.partitionBy("page").orderBy("y0", "x0", "x1", "word")
    rows = rows.withColumn("fall", F.col("y0") - F.lag("y0").over(down)).withColumn("line", _since(F.col("fall").isNull() | (F.col("fall") > tolerance), down))
    along = Window.partitionBy("page", "line").orderBy("x0", "x1", "word")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("space", F.col("x0") - reach).withColumn("cell", _since(F.col("space").isNull() | (F.col("space") > gap), along))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "word"))), lambda x: x["word"]), " ")
    edges = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return rows.groupBy("page", "line", "cell").agg(*edges, text.alias("text"))


def found_tables(words: DataFrame, page_col: str = "page", gap: float = CELL_GAP, least_lines: int = LEAST_LINES) -> DataFrame:
    """page, zone_id, table_id (both from 1, downwards), x0, y0, x1, y1, rows (array<array<string>>) of the tables on pages of placed words.

    A cell goes to the column that starts nearest to it; columns without a cell in a line are empty there.
    The result serves operators.layout.laid_out as zones and as tables.
    """
    each = cells(words, page_col, gap)
    lines = each.groupBy("page", "line").agg(F.count("*").alias("n"), F.min("y0").alias("top"), F.max("y1").alias("low"))
    down = Window.partitionBy("page").orderBy("line")
    apart = (F.col("n") < 2) | F.lag("n").over(down).isNull() | (F.lag("n").over(down) < 2) | (F.col("top") - F.lag("top").over(down) > LINE_HEIGHTS * (F.lag("low").over(down) - F.lag("top").over(down)))
    runs = lines.withColumn("apart", apart).withColumn("run", _since(F.col("apart"), down)).where("n >= 2")
    size = runs.groupBy("page", "run").agg(F.count("*").alias("lines")).where(F.col("lines") >= least_lines)
    held = each.join(runs.select("page", "line", "run"), ["page", "line"]).join(size, ["page", "run"])
    # columns: starts of cells, in order, that lie near one another
    right = Window.partitionBy("page", "run").orderBy("x0", "line", "cell")
    starts = held.withColumn("step", F.col("x0") - F.lag("x0").over(right)).withColumn("group", _since(F.col("step").isNull() | (F.col("step") > ALIGNED), right))
    columns = starts.groupBy("page", "run", "group").agg(F.count_distinct("line").alias("in_lines"), F.first("lines").alias("lines"), F.avg("x0").alias("at")).where(F.col("in_lines") >= SHARE * F.col("lines"))
    grids = columns.groupBy("page", "run").agg(F.sort_array(F.collect_list("at")).alias("columns")).where(F.size("columns") >= 2)
    near = F.array_min(F.transform("columns", lambda c, i: F.struct(F.abs(c - F.col("x0")).alias("off"), i.alias("i"))))["i"]
    placed = held.join(grids, ["page", "run"]).withColumn("column", near)
    filled = placed.groupBy("page", "run", "line").agg(F.collect_list(F.struct("column", "cell", "text")).alias("own"), F.first("columns").alias("columns"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    row = F.transform("columns", lambda c, i: F.array_join(F.transform(F.array_sort(F.filter("own", lambda o: o["column"] == i)), lambda o: o["text"]), " "))
    filled = filled.withColumn("row", row)
    boxes = filled.groupBy("page", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]).alias("rows"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    number = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "run")).cast("long")
    return boxes.select("page", number.alias("zone_id"), number.alias("table_id"), "x0", "y0", "x1", "y1", "rows")
