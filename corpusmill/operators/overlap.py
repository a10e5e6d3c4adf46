"""Rectangles that overlap, on pages of any number of them.

A page of many boxes is cut into tiles, more where it has more boxes. A box stands in every tile it touches, and a
pair of boxes is told by one tile alone, that of the corner where the later left edge meets the later upper
edge. Within a tile a sweep over upper edges finds the pairs; tiles that hold very many boxes are
swept in several blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
#: Boxes of a page from which on it is cut into tiles, of a tile on average, and of a block at most, about.
MANY, TILE, BLOCK = 20_000, 128, 4096
#: Candidates that a sweep compares at once.
AT_ONCE = 1 << 20


def overlap(a: str, b: str) -> Column:
    """Whether the boxes with these prefixes share more than an edge."""
    return (F.col(f"{a}x0") < F.col(f"{b}x1")) & (F.col(f"{a}x1") > F.col(f"{b}x0")) & (F.col(f"{a}y0") < F.col(f"{b}y1")) & (F.col(f"{a}y1") > F.col(f"{b}y0"))


def sweep(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows x0, y0, x1, y1 of a and b that overlap."""
    order = np.argsort(b[:, 1], kind="stable")
    b = b[order]
    lowest = np.maximum.accumulate(b[:, 3]) if len(b) else b[:, 3]
    end, begin = np.searchsorted(b[:, 1], a[:, 3], "left"), np.searchsorted(lowest, a[:, 1], "right")
    n = np.maximum(0, end - begin)
    out, at = [], 0
    upto = np.cumsum(n)
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        some = n[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(begin[at:to], some)
        fits = (a[i, 0] < b[j, 2]) & (a[i, 2] > b[j, 0]) & (a[i, 1] < b[j, 3]) & (a[i, 3] > b[j, 1])
        out.append((i[fits], order[j[fits]]))
        at = to
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _boxes(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in BOX], axis=1) if len(table) else np.zeros((0, 4))


def _told(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
    """The pairs of one tile that it is for this tile to tell."""
    i, j = sweep(_boxes(a), _boxes(b))
    if len(i):
        left, up = np.maximum(a["x0"].to_numpy()[i], b["x0"].to_numpy()[j]), np.maximum(a["y0"].to_numpy()[i], b["y0"].to_numpy()[j])
        row = a.slice(0, 1).to_pylist()[0]
        here = (_tile_of(left, row["left"], row["wide"], row["grid"]) == row["tx"]) & (_tile_of(up, row["top"], row["high"], row["grid"]) == row["ty"])
        i, j = i[here], j[here]
    x, y = (t.take(pa.array(k)) for t, k in ((a, i), (b, j)))
    columns = {"page": x["page"]} | {f"a{c}": x[c] for c in BOX} | {f"b{c}": y[c] for c in BOX}
    return pa.table(columns)


def _tile_of(x: np.ndarray, first, width, grid) -> np.ndarray:
    return np.clip(np.floor((x - first) / width), 0, grid - 1).astype(np.int64)


def _tile(x: Column, first: str, width: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("grid") - 1, F.floor((x - F.col(first)) / F.col(width)))).cast("int")


def whole_box(prefix: str) -> Column:
    """Whether the box with this prefix has four finite coordinates."""
    fine = F.lit(True)
    for c in BOX:
        x = F.col(f"{prefix}{c}").cast("double")
        fine = fine & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return fine


def placed_boxes(boxes: DataFrame, page_col: str, prefix: str, *more: str) -> DataFrame:
    """__page, the box with its prefix and more columns of the rows with a page and a whole box."""
    rows = boxes.select(F.col(page_col).alias("__page"), *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in BOX], *more)
    return rows.where(whole_box(prefix) & F.col("__page").isNotNull())


def _distinct_boxes(boxes: DataFrame, page_col: str) -> DataFrame:
    rows = boxes.select(F.col(page_col).alias("page"), *[F.col(c).cast("double").alias(c) for c in BOX])
    return rows.where(whole_box("") & F.col("page").isNotNull()).distinct()


@dataclass(frozen=True)
class SmallPages:
    """Tells the pages of few boxes by their column; a null page is none."""

    large: tuple = ()

    @property
    def every(self) -> bool:
        return not self.large

    def __call__(self, page: str) -> Column:
        return ~F.col(page).isin(list(self.large)) if self.large else F.lit(True)


def small_pages(a: DataFrame, b: DataFrame, page_col: str, many: int | None = None) -> SmallPages | None:
    """The pages that have ``many`` (MANY) boxes of both tables at most; None if over a thousand have more.

    Only the page column is read, and counted before it is shuffled.
    """
    pages = a.select(F.col(page_col).alias("page")).unionByName(b.select(F.col(page_col).alias("page"))).where("page is not null")
    large = [r["page"] for r in pages.groupBy("page").count().where(F.col("count") > (many or MANY)).limit(1001).collect()]
    return None if len(large) > 1000 else SmallPages(tuple(large))


def tiled_overlaps(a: DataFrame, b: DataFrame, page_col: str = "page") -> DataFrame:
    """page, and ax0 to by1: the pairs of different boxes of a and b on one page that overlap, each once.

    Boxes without four finite coordinates or a page overlap nothing. Boxes may be given with their edges the wrong way round.
    """
    a, b = _distinct_boxes(a, page_col), _distinct_boxes(b, page_col)
    lo = {c: F.least(f"{c}0", f"{c}1") for c in "xy"}
    hi = {c: F.greatest(f"{c}0", f"{c}1") for c in "xy"}
    size = a.unionByName(b).groupBy("page").agg(F.count("*").alias("n"), *[f(w[c]).alias(name) for c, names in (("x", ("left", "right")), ("y", ("top", "low"))) for f, w, name in ((F.min, lo, names[0]), (F.max, hi, names[1]))])
    grid = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n") / TILE))).cast("int")
    wide = lambda c, d: F.when(F.col(d) > F.col(c), F.col(d) - F.col(c)).otherwise(1.0) / F.col("grid")
    size = size.withColumn("grid", grid).select("page", "left", "top", "grid", wide("left", "right").alias("wide"), wide("top", "low").alias("high"))

    def placed(boxes: DataFrame) -> DataFrame:
        rows = boxes.toDF(*boxes.columns).join(size.toDF(*size.columns), "page")
        for c, first, width in (("x", "left", "wide"), ("y", "top", "high")):
            rows = rows.withColumn(f"t{c}", F.explode(F.sequence(_tile(lo[c], first, width), _tile(hi[c], first, width))))
        return rows

    at = ["page", "tx", "ty"]
    x, y = placed(a), placed(b)
    n, m = (d.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c)) for d, c in ((x, "n"), (y, "m")))
    both = n.join(m, at)
    salt = lambda c: F.pmod(F.xxhash64(*BOX), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = x.join(both, at).withColumn("ai", salt("n")).withColumn("bi", every("m"))
    y = y.join(both.toDF(*both.columns), at).withColumn("bi", salt("m")).withColumn("ai", every("n"))
    keys = [*at, "ai", "bi"]
    schema = f"page {a.schema['page'].dataType.simpleString()}, " + ", ".join(f"{s}{c} double" for s in "ab" for c in BOX)
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(_told, schema)


def overlaps(a: DataFrame, b: DataFrame, page_col: str = "page", many: int | None = None) -> DataFrame:
    """As tiled_overlaps(), but pages of few boxes are joined by the page alone."""
    many = many or MANY
    u, v = _distinct_boxes(a, page_col), _distinct_boxes(b, page_col)
    large = [r["page"] for r in u.unionByName(v).groupBy("page").count().where(F.col("count") > many).limit(1001).collect()]
    if len(large) > 1000:
        return tiled_overlaps(u, v)
    chosen = F.col("page").isin(large) if large else F.lit(False)
    named = lambda d, s: d.where(~chosen).select("page", *[F.col(c).alias(f"{s}{c}") for c in BOX])
    found = named(u, "a").join(named(v, "b"), "page").where(overlap("a", "b"))
    return found.unionByName(tiled_overlaps(u.where(chosen), v.where(chosen))) if large else found
