"""Exact vector retrieval: nearest neighbours, similarity joins within a document, and contexts.

``knn`` scores a bounded set of query vectors, held by every task, against all rows in blocks of
numpy products, keeps each block's best, and only those are shuffled. ``similarity_join`` does the same
for the rows of one document, block by block, and leaves out blocks that can hold nothing near enough. Ties go to the smaller id everywhere.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.prompts import CONTEXT_JOIN
from corpusmill.session import cut

#: Bytes of query vectors that every task holds; more queries are dealt to blocks instead.
QUERY_BYTES = 32 << 20
DIGITS = 6


def topk(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def matrix(column) -> np.ndarray:
    values = column.flatten() if isinstance(column, pa.ListArray | pa.LargeListArray) else column
    return np.asarray(values.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _score_block(batches, shared, k, least, skip_same):
    ids, unit = shared.value
    for batch in batches:
        keep = batch.column(1).is_valid()
        batch = batch.filter(keep)
        if not batch.num_rows or not len(ids):
            continue
        own = batch.column(0).to_numpy(zero_copy_only=False)
        x = matrix(batch.column(1))
        length = np.linalg.norm(x, axis=1)
        x = x / np.where(length > 0, length, 1)[:, None]
        for at in range(0, len(ids), 512):
            s = np.round(unit[at : at + 512] @ x.T, DIGITS)
            s[:, length == 0] = -np.inf
            if skip_same:
                s[ids[at : at + 512, None] == own[None, :]] = -np.inf
            s[s < least] = -np.inf
            n = min(k, s.shape[1])
            if n < s.shape[1]:  # all that tie with the last place are passed on
                floor = np.partition(s, -n, axis=1)[:, -n]
                s[s < floor[:, None]] = -np.inf
            q, c = np.nonzero(s > -np.inf)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + q]), pa.array(own[c]), pa.array(s[q, c])], names=["query_id", "match_id", "sim"])


def knn(queries: DataFrame, corpus: DataFrame, k: int = 10, least: float = 0.6, id_col: str = "vec_id", vector_col: str = "embedding", skip_same: bool = False) -> DataFrame:
    """query_id, match_id, sim (rounded to six digits), rank: for each query the k most similar rows of at least ``least``.

    Zero and null vectors match nothing. Ids are longs. Queries of up to QUERY_BYTES are scored where the
    rows lie; more of them are joined with the rows in blocks (similarity_join).
    """
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    size = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8
    if size > QUERY_BYTES:
        names = ("vec_id", "vec_id") if skip_same else ("vec_id", "match_id")
        left, right = (d.select(F.lit(0).alias("all"), F.col(i).cast("long").alias(n), F.col(v).alias("embedding")) for d, i, n, v in ((asked, "id", names[0], "v"), (corpus, id_col, names[1], vector_col)))
        near = similarity_join(left, right, "all", *names, k=k, least=least)
        return near.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("match_id"), "sim", "rank")
    rows = asked.collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    v = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)
    length = np.linalg.norm(v, axis=1) if len(rows) else np.zeros(0)
    unit = v[length > 0] / length[length > 0, None]
    shared = corpus.sparkSession.sparkContext.broadcast((ids[length > 0], unit))
    two = corpus.select(F.col(id_col).cast("long").alias("id"), vector_col)
    near = two.mapInArrow(partial(_score_block, shared=shared, k=k, least=least, skip_same=skip_same), "query_id long, match_id long, sim double")
    return topk(near, ["query_id"], [F.col("sim").desc(), F.col("match_id")], k)


#: Rows of a block of similarity_join, on either side, and pivots at most, of all keys together.
BLOCK, PIVOTS = 2048, 16_384
#: Similarities are rounded to six digits, and angles are exact to less.
SLACK = 2e-6


def _blocks(side: DataFrame, other: DataFrame, own: str, theirs: str) -> DataFrame:
    """The rows of a side with their block (own) within their key, once for each block (theirs) of the other side's rows of that key."""
    n, m = (d.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c)) for d, c in ((side, "n"), (other, "m")))
    placed = side.join(n.join(m, "k"), "k").withColumn(own, F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    return placed.select("k", "id", "v", own, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias(theirs))


def _best_of(k: int, least: float | None, same: bool, key: str):
    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        """The k best rows of one block for each row of another; all that tie with the last place are passed on."""
        u, v = (matrix(t["v"].combine_chunks()) if len(t) else np.zeros((0, 0)) for t in (x, y))
        out = [[], [], []]
        if len(u) and len(v):
            ids, own = (t["id"].to_numpy() for t in (x, y))
            norms = [np.linalg.norm(m, axis=1) for m in (u, v)]
            u, v = (m / np.where(n > 0, n, 1)[:, None] for m, n in zip((u, v), norms))
            for at in range(0, len(ids), 256):
                s = np.round(u[at : at + 256] @ v.T, DIGITS)
                s[norms[0][at : at + 256] == 0] = s[:, norms[1] == 0] = -np.inf
                if same:
                    s[ids[at : at + 256, None] == own[None, :]] = -np.inf
                if least is not None:
                    s[s < least] = -np.inf
                n = min(k, s.shape[1])
                if n < s.shape[1]:
                    s[s < np.partition(s, -n, axis=1)[:, -n][:, None]] = -np.inf
                p, q = np.nonzero(s > -np.inf)
                for column, part in zip(out, (p + at, q, s[p, q])):
                    column.append(part)
        p, q, s = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, float)))
        one = x["k"].combine_chunks().slice(0, 1) if len(x) else y["k"].combine_chunks().slice(0, 1)
        return pa.table({key: one.take(pa.array(np.zeros(len(p), np.int64))), "left_id": x["id"].combine_chunks().take(pa.array(p)), "right_id": y["id"].combine_chunks().take(pa.array(q)), "sim": pa.array(s, pa.float64())})

    return best


def similarity_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, vector_col: str = "embedding", k: int = 3, least: float | None = None) -> DataFrame:
    """key, left_id, right_id, sim, rank: for each left row its k most similar right rows of the same key, by cosine.

    A row is never paired with itself if both id columns are one. Null keys, ids and vectors and zero
    vectors match nothing. The right rows of a key with more than BLOCK of them are dealt to the nearest of a number of pivots; each left row
    is scored against its own pivot's cell, and then only against those cells that the triangle inequality doesn't
    rule out: ones whose rows all lie farther than its k-th best so far. Other keys are a block by a block.
    """
    a, b = (d.select(F.col(key).alias("k"), F.col(i).alias("id"), F.col(vector_col).alias("v")).where("k is not null and id is not null and v is not null") for d, i in ((left, left_id), (right, right_id)))
    best = _best_of(k, least, left_id == right_id, key)
    kinds = {"k": a.schema["k"].dataType.simpleString(), "a": a.schema["id"].dataType.simpleString(), "b": b.schema["id"].dataType.simpleString()}
    schema = f"`{key}` {kinds['k']}, left_id {kinds['a']}, right_id {kinds['b']}, sim double"
    cells = pivots(b)
    heavy = F.col("k").isin(list(cells)) if cells else F.lit(False)
    c, d = (a.where(~heavy), b.where(~heavy)) if cells else (a, b)
    x, y = _blocks(c, d, "own", "theirs"), _blocks(d, c, "theirs", "own")
    scored = x.groupBy("k", "own", "theirs").cogroup(y.groupBy("k", "own", "theirs")).applyInArrow(best, schema)
    if cells:
        scored = scored.unionByName(_by_cells(a.where(heavy), b.where(heavy), cells, best, schema, key, k, least))
    return topk(scored, ["left_id"], [F.col("sim").desc(), F.col("right_id")], k)


def pivots(rows: DataFrame, block: int | None = None) -> dict:
    """Pivot vectors (unit length) for each key (k) with more than a block of rows: its first rows by a hash of their id, about one a block."""
    block = block or BLOCK
    large = rows.groupBy("k").count().where(F.col("count") > block).orderBy(F.desc("count"), "k").limit(PIVOTS // 2).collect()
    total = sum(r["count"] for r in large)
    wanted = {r["k"]: min(-(-r["count"] // block), PIVOTS * r["count"] // total) for r in large}
    wanted = {key: n for key, n in wanted.items() if n > 1}
    if not wanted:
        return {}
    first = rows.where(F.col("k").isin(list(wanted))).withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("id"), "id"))).where(F.col("nth") <= max(wanted.values()))
    found: dict = {}
    for r in first.select("k", "nth", "v").orderBy("k", "nth").collect():
        if r["nth"] <= wanted[r["k"]]:
            found.setdefault(r["k"], []).append(r["v"])
    unit = {}
    for key, v in found.items():
        x = np.unique(np.array(v, np.float64), axis=0)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if len(x) > 1:
            unit[key] = x / np.linalg.norm(x, axis=1)[:, None]
    return unit


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ p.T, -1, 1))


def _visits(batches, shared, near: bool, least: float | None):
    """Rows (k, id, v, cell, angle): each row with its nearest pivot's cell (near), or with all other cells that may hold
    a row as near as its k-th best so far (the column after v). Zero vectors have none."""
    cells, radius = shared.value
    for batch in batches:
        for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
            keys, x = part.column(0).to_pylist(), matrix(part.column(2))
            length = np.linalg.norm(x, axis=1)
            x = x / np.where(length > 0, length, 1)[:, None]
            kth = None if near else part.column(3).to_numpy(zero_copy_only=False)
            rows, found, angles = [], [], []
            for key in dict.fromkeys(keys):
                own = np.array([i for i, other in enumerate(keys) if other == key and length[i] > 0], np.int64)
                if not len(own):
                    continue
                angle = _angles(x[own], cells[key])
                nearest = angle.argmin(axis=1)
                if near:
                    r, c = np.arange(len(own)), nearest
                else:
                    bound = np.cos(np.maximum(0, angle - radius[key][None, :] - SLACK)) + SLACK
                    may = bound >= np.maximum(kth[own], -1.0 if least is None else least)[:, None]
                    may[np.arange(len(own)), nearest] = False
                    may[:, radius[key] < 0] = False  # cells without rows
                    r, c = np.nonzero(may)
                rows.append(own[r]), found.append(c), angles.append(angle[r, c])
            row, cell, angle = (np.concatenate(z) if z else np.zeros(0, t) for z, t in zip((rows, found, angles), (np.int64, np.int64, float)))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["k", "id", "v", "cell", "angle"])


def _placed(rows: DataFrame, shared, near: bool, least: float | None = None) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(partial(_visits, shared=shared, near=near, least=least), f"k {kinds['k']}, id {kinds['id']}, v {kinds['v']}, cell int, angle double")


def visits_needed(a: DataFrame, b: DataFrame, cells: dict, best, schema: str, k: int, least: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Right rows by cell, the first scores of each left row (against its own cell), and the left rows' further visits."""
    spark = a.sparkSession
    shared = spark.sparkContext.broadcast((cells, None))
    stored = cut(_placed(b, shared, True))
    radius = {key: np.full(len(p), -1.0) for key, p in cells.items()}
    for r in stored.groupBy("k", "cell").agg(F.max("angle").alias("r")).collect():  # PIVOTS rows at most
        radius[r["k"]][r["cell"]] = r["r"]
    own = cut(_placed(a, shared, True).select("k", "id", "v", "cell"))
    first = cut(_meet(own, stored, best, schema))
    kth = topk(first, ["left_id"], [F.col("sim").desc(), F.col("right_id")], k).groupBy(F.col("left_id").alias("id")).agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    known = own.join(kth, "id", "left").select("k", "id", "v", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("kth"))
    return stored, first, _placed(known, spark.sparkContext.broadcast((cells, radius)), False, least)


def _meet(visits: DataFrame, stored: DataFrame, best, schema: str) -> DataFrame:
    """Scores of visiting rows against the rows of the cells they visit; cells and visits of many rows are several blocks."""
    at = ["k", "cell"]
    n, m = (d.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c)) for d, c in ((visits, "n"), (stored, "m")))
    both = n.join(m, at)
    x = visits.join(both, at).select(*at, F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("theirs"), "id", "v")
    y = stored.join(both.toDF(*both.columns), at).select(*at, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("own"), F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("theirs"), "id", "v")
    keys = [*at, "own", "theirs"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(best, schema)


def _by_cells(a: DataFrame, b: DataFrame, cells: dict, best, schema: str, key: str, k: int, least: float | None) -> DataFrame:
    stored, first, more = visits_needed(a, b, cells, best, schema, k, least)
    return first.unionByName(_meet(cut(more.select("k", "id", "v", "cell")), stored, best, schema))


def contexts(ranked: DataFrame, texts: DataFrame, text_id: str, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """left_id, n, mean_sim, best_sim, context: the ranked texts joined best first, where their mean similarity is ``least`` or more."""
    joined = ranked.join(texts.select(F.col(text_id).alias("right_id"), F.col(text_col).alias("chunk")), "right_id")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk"))), lambda s: s["chunk"])
    grouped = joined.groupBy("left_id").agg(F.count("*").alias("n"), F.avg("sim").alias("mean_sim"), F.max("sim").alias("best_sim"), F.array_join(parts, CONTEXT_JOIN).alias("context"))
    return grouped.where(F.col("mean_sim") >= least)
