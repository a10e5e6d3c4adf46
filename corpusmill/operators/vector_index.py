"""An inverted-file index over vectors: approximate cosine search that reads a few cells only.

Centroids are learnt from a bounded sample by spherical k-means; every row is stored with the cell of
its nearest centroid, in Parquet partitioned by cell, so a search prunes the files of all cells that no
query probes. Rows of the probed cells are scored exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import DIGITS, matrix, topk

#: Rows that centroids are learnt from (the first by a hash of their id), rounds of learning, and cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 4096
#: Rows of a cell that one task stores or scores, about.
BLOCK = 16_384
SEED = 4


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1)[:, None], length


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, by spherical k-means; empty cells take the rows that lie worst."""
    x, length = _unit(np.asarray(sample, np.float64))
    x = np.unique(x[length > 0], axis=0)
    if len(x) <= cells:
        return x
    c = x[np.random.default_rng(SEED).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        bare = np.nonzero(np.bincount(own, minlength=len(c)) == 0)[0]
        total[bare] = x[np.argsort(near.max(axis=1), kind="stable")[: len(bare)]]
        c, length = _unit(total)
        c[length == 0] = x[0]
    return c


def _probed(batches, centres, probes: int):
    """Rows with each of their nearest cells: id, v, cell. Zero vectors are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            x, length = _unit(matrix(part.column(1)))
            part, x = part.filter(pa.array(length > 0)), x[length > 0]
            if not len(x):
                continue
            near, n = x @ centres.value.T, min(probes, len(centres.value))
            cells = np.argsort(-near, axis=1, kind="stable")[:, :n] if n < len(centres.value) else np.tile(np.arange(n), (len(x), 1))
            row = pa.array(np.repeat(np.arange(len(x)), n))
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(cells.ravel().astype(np.int32))], names=["id", "v", "cell"])


def _assigned(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    return rows.mapInArrow(partial(_probed, centres=shared, probes=probes), f"id long, v {rows.schema['v'].dataType.simpleString()}, cell int")


def _two(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")


def build_index(vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> int:
    """Writes an index of all rows to ``path`` and returns its number of cells.

    cells: by default the square root of the number of rows, MOST_CELLS at most. Cells with many rows
    are written by several tasks. Rows with null ids or vectors and zero vectors are not stored. What
    lies at the path is replaced. The vectors are of one length.
    """
    rows = _two(vectors, id_col, vector_col)
    n = rows.count()
    learnt = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    centres = centroids(np.array([r["v"] for r in learnt]), min(cells or max(1, int(np.ceil(n**0.5))), MOST_CELLS)) if learnt else np.zeros((0, 0))
    spark = vectors.sparkSession
    told = [(k, [float(x) for x in c], n) for k, c in enumerate(centres)]
    spark.createDataFrame(told, "cell int, centre array<double>, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    placed = _assigned(rows, centres, 1) if len(centres) else rows.where("false").withColumn("cell", F.lit(0))
    some = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (BLOCK * 16)))))  # a cell may hold a large share of all rows
    placed.repartition("cell", some).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return len(centres)


def _scored(key: tuple, rows: pa.Table, asked: pa.Table, k: int, least: float, skip_same: bool) -> pa.Table:
    """query_id, match_id, sim: each query's best rows of one block of a cell."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(rows) and len(asked):
        ids, own = rows["id"].to_numpy(), asked["id"].to_numpy()
        x, q = (_unit(matrix(t["v"].combine_chunks()))[0] for t in (rows, asked))
        for at in range(0, len(q), 256):
            s = np.round(q[at : at + 256] @ x.T, DIGITS)
            if skip_same:
                s[own[at : at + 256, None] == ids[None, :]] = -np.inf
            s[s < least] = -np.inf
            if k < s.shape[1]:  # all that tie with the last place are passed on
                s[s < np.partition(s, -k, axis=1)[:, -k][:, None]] = -np.inf
            a, b = np.nonzero(s > -np.inf)
            out.append((own[at + a], ids[b], s[a, b]))
    a, b, s = (np.concatenate(c) for c in zip(*out))
    return pa.table({"query_id": a, "match_id": b, "sim": s})


def probed_rows(spark: SparkSession, path: str, queries: DataFrame, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The stored rows (id, v, cell) of all cells that the queries probe, by partition pruning, and the queries (id, v, cell), a row for each probe."""
    told = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS rows at most
    stored = spark.read.parquet(f"{path}/rows") if told else spark.createDataFrame([], "id long, v array<double>, cell int")
    wanted = _two(queries, id_col, vector_col)
    if not told:
        return stored, wanted.where("false").withColumn("cell", F.lit(0))
    asked = _assigned(wanted, np.array([r["centre"] for r in told]), probes)
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
    return stored.where(F.col("cell").isin(cells)) if len(cells) < len(told) else stored, asked


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 16, least: float = 0.6, id_col: str = "vec_id", vector_col: str = "embedding", skip_same: bool = False) -> DataFrame:
    """query_id, match_id, sim (cosine, rounded to six digits), rank: for each query the k most similar rows of the ``probes`` cells nearest to it.

    With all cells probed the result is exact, that of ``retrieval.knn``. Ties go to the smaller id.
    Queries are dealt to their cells, whatever their number; a cell of many rows is several blocks.
    """
    rows, asked = probed_rows(spark, path, queries, probes, id_col, vector_col)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("cell", "block", "id", "v")
    visits = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")

    def best(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _scored(key, a, b, k, least, skip_same)

    found = placed.groupBy("cell", "block").cogroup(visits.groupBy("cell", "block")).applyInArrow(best, "query_id long, match_id long, sim double")
    return topk(found, ["query_id"], [F.col("sim").desc(), F.col("match_id")], k)
