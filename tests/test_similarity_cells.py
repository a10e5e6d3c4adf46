"""The similarity join of keys with many rows: equal to all pairs, with most cells left out where vectors form clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retrieval


def table(spark, x, keys, ids=None):
    rows = [(keys[i], int(i) if ids is None else ids[i], [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc string, vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).repartition(3)


def rows_of(df):
    return sorted((r["doc"], r["left_id"], r["right_id"], r["sim"], r["rank"]) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    def set_to(n):
        monkeypatch.setattr(retrieval, "BLOCK", n)

    return set_to


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_equal_to_all_pairs(spark, small_blocks, spread):
    rng = np.random.default_rng(3)
    hearts = rng.normal(size=(12, 10))
    x = hearts[rng.integers(0, 12, 900)] + rng.normal(size=(900, 10)) * spread
    x[5] = 0
    x[20:60] = x[20]  # a group of equal vectors: ties
    keys = ["hot"] * 700 + ["mid"] * 150 + ["few"] * 49 + [None]
    df = table(spark, x, keys)
    join = lambda **more: rows_of(retrieval.similarity_join(df, df, "doc", "vec_id", "vec_id", k=4, **more))
    want, floor = join(), join(least=0.9)
    small_blocks(60)
    assert set(retrieval.pivots(df.select(F.col("doc").alias("k"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")).where("k is not null"))) == {"hot", "mid"}
    assert join() == want and len(want) == 898 * 4
    assert join(least=0.9) == floor


def test_two_tables(spark, small_blocks):
    rng = np.random.default_rng(5)
    df, other = table(spark, rng.normal(size=(150, 4)), ["a"] * 120 + ["b"] * 30), table(spark, rng.normal(size=(300, 4)), ["a"] * 299 + ["c"]).withColumnRenamed("vec_id", "chunk_id")
    join = lambda: rows_of(retrieval.similarity_join(df, other, "doc", "vec_id", "chunk_id", k=3))
    want = join()
    small_blocks(40)
    assert join() == want and len(want) == 360


def test_most_cells_are_left_out(spark, small_blocks):
    """Of clustered vectors, the share of (row, cell) visits that the triangle inequality rules out."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 12))[np.arange(2000) % 25] + rng.normal(size=(2000, 12)) * 0.05
    small_blocks(80)
    rows = table(spark, x, ["hot"] * 2000).select(F.col("doc").alias("k"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    cells = retrieval.pivots(rows)
    best = retrieval._best_of(3, None, True, "doc")
    _, _, more = retrieval.visits_needed(rows, rows, cells, best, "doc string, left_id long, right_id long, sim double", 3, None)
    all_visits = 2000 * (len(cells["hot"]) - 1)
    left_out = 1 - more.count() / all_visits
    print(f"{left_out:.3f} of {all_visits} visits are left out")
    assert len(cells["hot"]) == 25 and left_out > 0.75


def test_many_queries_go_in_blocks(spark, small_blocks, monkeypatch):
    rng = np.random.default_rng(8)
    df = table(spark, rng.normal(size=(300, 6)), ["a"] * 300)
    ask = lambda same: sorted(map(tuple, retrieval.knn(df.where("vec_id % 3 = 0"), df, 4, 0.1, skip_same=same).select("query_id", "match_id", "sim", "rank").collect()))
    want = ask(True), ask(False)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 1000)
    small_blocks(70)
    assert (ask(True), ask(False)) == want and len(want[1]) > 300
