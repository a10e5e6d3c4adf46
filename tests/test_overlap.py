"""Overlapping boxes: tiles against brute force, on pages of many boxes and of odd ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import layout, overlap

BOX = "page string, x0 double, y0 double, x1 double, y1 double"


def brute(a, b):
    return {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[2] and x[2] > y[0] and x[1] < y[3] and x[3] > y[1]}


def boxes(rng, n, span, size):
    at = rng.integers(0, span, (n, 2)) / 2  # on a grid of halves: many edges just touch
    return np.concatenate([at, at + rng.integers(0, size, (n, 2)) / 2], axis=1)


def table(spark, page, rows):
    return spark.createDataFrame([(page, *map(float, r)) for r in rows], BOX).repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_sweep(seed, monkeypatch):
    monkeypatch.setattr(overlap, "AT_ONCE", 50)
    rng = np.random.default_rng(seed)
    a, b = boxes(rng, 70, 60, 12), boxes(rng, 50 * (seed > 0), 60, 30)
    i, j = overlap.sweep(a, b)
    assert set(zip(i.tolist(), j.tolist())) == brute(a, b) and len(i) == len(brute(a, b))


def pairs_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_tiles_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "TILE", 16)
    monkeypatch.setattr(overlap, "BLOCK", 20)
    rng = np.random.default_rng(7)
    a = np.concatenate([boxes(rng, 500, 1000, 40), boxes(rng, 120, 20, 6), [[0, 0, 500, 500], [3, 3, 3, 9], [9, 9, 4, 4]]])  # a dense corner, one box over all, a line, one the wrong way round
    b = np.concatenate([boxes(rng, 300, 1000, 60), boxes(rng, 90, 20, 6)])
    x = table(spark, "p", a).unionByName(table(spark, "q", a[:40])).unionByName(spark.createDataFrame([("p", None, 0.0, 9.0, 9.0), ("p", float("nan"), 0.0, 9.0, 9.0), (None, 0.0, 0.0, 9.0, 9.0)], BOX))
    y = table(spark, "p", b).unionByName(table(spark, "q", b[:30]))
    want = {(p, *a[i], *b[j]) for p, n, m in (("p", len(a), len(b)), ("q", 40, 30)) for i, j in brute(a[:n], b[:m])}
    assert pairs_of(overlap.tiled_overlaps(x, y)) == want and len(want) > 1000
    assert pairs_of(overlap.overlaps(x, y, many=100)) == want == pairs_of(overlap.overlaps(x, y))
    assert overlap.tiled_overlaps(x.limit(0), y).count() == 0


def test_a_page_of_many_boxes_is_many_tasks(spark):
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.uniform(0, 3000, (30_000, 2)), np.zeros((30_000, 2))], axis=1)
    a[:, 2:] = a[:, :2] + rng.uniform(1, 12, (30_000, 2))
    rows = spark.createDataFrame(__import__("pandas").DataFrame(a, columns=["x0", "y0", "x1", "y1"])).withColumn("page", F.lit("p"))
    found = overlap.overlaps(rows, rows.where("x0 < 1500"))
    i, _ = overlap.sweep(a, a[a[:, 0] < 1500])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as the tiles are here, one task would take them all
    try:
        told = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in told) == len(i) and len(told) == 4 and max(r["count"] for r in told) < 0.5 * len(i)


def test_words_and_tables_of_large_pages(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = table(spark, "p", boxes(rng, 200, 200, 10)).withColumns({"word": F.lit("w"), "n": F.lit(1), "grid": F.lit(2)})
    zones, tables = table(spark, "p", boxes(rng, 30, 200, 40)), table(spark, "p", boxes(rng, 60, 200, 40))
    both = zones.limit(12)
    tables = tables.unionByName(both).withColumn("table_id", F.monotonically_increasing_id())
    zones = zones.withColumn("zone_id", F.monotonically_increasing_id())
    zones, tables = (spark.createDataFrame(d.collect(), d.schema) for d in (zones, tables))
    outside, paired = (lambda: sorted(map(tuple, layout.words_outside(words, zones).collect()))), (lambda: sorted(map(tuple, layout.matched_tables(zones, tables, least=0.1).collect())))
    want = outside(), paired()
    monkeypatch.setattr(overlap, "MANY", 50)
    monkeypatch.setattr(overlap, "TILE", 8)
    assert (outside(), paired()) == want and 0 < len(want[0]) < 200 and len(want[1]) > 10
