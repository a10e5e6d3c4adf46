"""The inverted-file index: exact with all cells, found again with some, and read by cells."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retrieval, vector_index
from corpusmill.plans import QUERIES

SF = "/root/testdata/sf0.01"


def table(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit("x"), "id": F.lit(1)}).repartition(3)


def triples(df):
    return sorted((r["query_id"], r["rank"], r["match_id"], r["sim"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    hearts = rng.normal(size=(30, 16))
    return np.concatenate([hearts[k % 30] + rng.normal(size=16) * 0.3 for k in range(3000)]).reshape(3000, 16)


def test_all_cells_are_exact(spark, tmp_path, clustered):
    df = table(spark, clustered)
    asked = df.where("vec_id % 20 = 0")
    cells = vector_index.build_index(df, f"{tmp_path}/i")
    assert cells == 55
    want = triples(retrieval.knn(asked, df, k=10, least=0.2, skip_same=True))
    assert triples(vector_index.search_index(spark, f"{tmp_path}/i", asked, 10, cells, 0.2, skip_same=True)) == want


def test_few_cells_recall_and_pruning(spark, tmp_path, clustered):
    df = table(spark, clustered)
    path = f"{tmp_path}/i"
    cells = vector_index.build_index(df, path, cells=40)
    asked = df.where("vec_id % 20 = 0")
    exact, found = defaultdict(set), defaultdict(set)
    for to, rows in ((exact, retrieval.knn(asked, df, 10, -1.0, skip_same=True)), (found, vector_index.search_index(spark, path, asked, 10, 6, -1.0, skip_same=True))):
        for r in rows.collect():
            to[r["query_id"]].add(r["match_id"])
    assert len(exact) == 150 and sum(len(exact[q] & found[q]) for q in exact) >= 0.9 * 1500
    # one query reads the files of its cells and no others
    rows, probes = vector_index.probed_rows(spark, path, df.where("vec_id = 7"), 3)
    wanted = {r["cell"] for r in probes.collect()}
    read = {r[0] for r in rows.select(F.regexp_extract(F.input_file_name(), r"cell=(\d+)", 1).cast("int")).distinct().collect()}
    assert read == wanted and len(wanted) == 3 < cells
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_given_vectors_recall(spark):
    exact, found = defaultdict(set), defaultdict(set)
    for to, name in ((exact, "index_all_cells"), (found, "index_probed_cells")):
        for r in QUERIES[name](spark, SF).collect():
            to[r["query_id"]].add(r["match_id"])
    assert len(exact) == 25 and sum(len(exact[q] & found[q]) for q in exact) >= 0.9 * sum(map(len, exact.values()))


def test_hot_cell_ties_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    x = np.concatenate([np.tile([1.0, 0.0, 0.0], (500, 1)), np.eye(3)[[1, 2] * 20], np.zeros((3, 3))])
    df = table(spark, x).unionByName(spark.createDataFrame([(900, None), (None, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>").withColumns({"cell": F.lit("x"), "id": F.lit(1)}))
    path = f"{tmp_path}/i"
    cells = vector_index.build_index(df, path, cells=8)
    assert cells == 3 and spark.read.parquet(f"{path}/rows").count() == 540
    got = triples(vector_index.search_index(spark, path, df.where("vec_id in (0, 20, 541, 900)"), 4, 1, 0.5, skip_same=True))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 4, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 3, 1.0)]


def test_empty_index(spark, tmp_path):
    df = table(spark, np.zeros((0, 3)))
    assert vector_index.build_index(df, f"{tmp_path}/i") == 0
    assert vector_index.search_index(spark, f"{tmp_path}/i", table(spark, np.eye(3)), 4, 2).count() == 0


def test_centroids():
    rng = np.random.default_rng(2)
    hearts = np.eye(8)[:5]
    c = vector_index.centroids(np.concatenate([hearts + rng.normal(size=(5, 8)) * 0.01 for _ in range(50)]), 5)
    assert sorted((c @ hearts.T).argmax(axis=1)) == [0, 1, 2, 3, 4] and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert len(vector_index.centroids(np.zeros((4, 2)), 3)) == 0 and len(vector_index.centroids(np.eye(2), 9)) == 2
