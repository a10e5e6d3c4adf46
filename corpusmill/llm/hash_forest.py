"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of hash bits and keeps the strings sorted. A query descends
in each tree to the longest prefix it shares with any string; then all trees ascend together, a bit at a
time, until the prefixes of that length hold as many rows as asked for. All rows under these prefixes are
scored exactly.

On Spark a tree's sorted array is cut at its first bits into buckets, and a bucket of too many rows
into blocks, each a sorted array of its own. Queries visit the blocks' strings, without vectors, to count
what shares how long a prefix; and the vectors too, with the length that the counts of all trees give, to
be scored. A query for which the buckets hold too little visits the buckets of
shorter prefixes, up to the whole table. Rows of equal vectors are searched as one.

Largest inner products become smallest angles by one more component, which brings all rows to the length
of the longest and is zero in queries.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

#: Trees, and bits of a hash string.
TREES, BITS = 24, 64
#: Rows under a query's prefixes in all trees together: MANY times the number of all rows to the power of GROWS. Rows found in several trees count in each.
MANY, GROWS = 2.0, 0.9
#: Rows that a bucket has on average at least, and a block at most, about. Bits by which the search goes up at once.
BUCKET, UP = 4096, 3
#: Rows, the first by a hash of their id, from which the bits' thresholds are learnt.
SAMPLE = 4000
SEED = 12


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: a row for each id (of repeated ids the least vector), not zero and of finite numbers only; floats stay floats."""
    v = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return fine.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class _Planes:
    """Hash strings: a bit for each random direction, set where a vector's projection is over the sample's median."""

    def __init__(self, sample: np.ndarray, longest: float, trees: int, bits: int):
        dims = sample.shape[1]
        self.longest, self.trees, self.bits = longest, trees, bits
        self.normals = np.random.default_rng(SEED).normal(size=(trees * bits, dims + 1))
        self.over = np.median(self._lifted(sample) @ self.normals.T, axis=0) if len(sample) else np.zeros(trees * bits)

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def strings(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows by trees, as signed numbers in the order of the strings."""
        if query:
            x = np.concatenate([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))], axis=1)
        else:
            x = self._lifted(x)
        bits = (x @ self.normals.T > self.over).reshape(len(x), self.trees, self.bits)
        full = np.zeros((len(x), self.trees, 64), bool)
        full[:, :, : self.bits] = bits
        found = np.packbits(full, axis=2).view(">u8")[:, :, 0].astype(np.uint64)
        return (found ^ np.uint64(1 << 63)).view(np.int64)


def _hashed(batches, planes, query: bool):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            strings = planes.value.strings(_matrix(part.column(1)), query)
            row = pa.array(np.repeat(np.arange(len(strings)), planes.value.trees))
            tree = np.tile(np.arange(planes.value.trees, dtype=np.int32), len(strings))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(strings.ravel()), part.column(0).take(row), part.column(1).take(row)], names=["tree", "hash", "id", "v"])


KEYS = ["tree", "bucket", "block"]


def _bucket(bits: int):
    """The first bits of a string, of which the sign bit is turned."""
    return F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")


def _range(strings: np.ndarray, hashes: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings begin and end that share each hash's first bits. length: how many, for each hash."""
    free = np.where(length > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(length, 63).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
    free = np.where(length >= 64, np.uint64(0), free)
    plain = hashes.view(np.uint64) ^ np.uint64(1 << 63)
    low, high = (((x) ^ np.uint64(1 << 63)).view(np.int64) for x in (plain & ~free, plain | free))
    return np.searchsorted(strings, low, "left"), np.searchsorted(strings, high, "right")


def _count(top: int, bits: int):
    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        """query, length, n: rows of this block that share so many first bits with a query, for all lengths down to its longest match."""
        strings, hashes, ids = np.sort(rows["hash"].to_numpy()), asked["hash"].to_numpy(), asked["id"].to_numpy()
        out = []
        for length in range(top, bits + 1):
            if not len(ids):
                break
            begin, end = _range(strings, hashes, np.full(len(hashes), length))
            some = end > begin
            ids, hashes = ids[some], hashes[some]
            out.append((ids, np.full(len(ids), length, np.int32), (end - begin)[some]))
        q, length, n = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        return pa.table({"query": q, "length": pa.array(length, pa.int32()), "n": pa.array(n, pa.int64())})

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query; ties go to the smaller id."""
    if len(score) > k:
        some = np.nonzero(score >= np.partition(score, -k)[-k])[0]
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.arange(len(score))


def _score(k: int):
    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        """query, id, score: each query's best rows of this block under its prefix. Scores are sums in one order, whatever the block."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(asked):
            order = np.argsort(rows["hash"].to_numpy(), kind="stable")
            strings, ids, v = rows["hash"].to_numpy()[order], rows["id"].to_numpy()[order], _matrix(rows["v"])[order]
            q, own = _matrix(asked["v"]), asked["id"].to_numpy()
            begin, end = _range(strings, asked["hash"].to_numpy(), asked["length"].to_numpy())
            for a, b in {(int(a), int(b)) for a, b in zip(begin, end) if b > a}:
                same = np.nonzero((begin == a) & (end == b))[0]
                for at in range(0, len(same), 128):
                    few = same[at : at + 128]
                    for row, score in zip(few, q[few] @ v[a:b].T):
                        best = a + _best(score, ids[a:b], k)
                        out.append((np.full(len(best), own[row]), ids[best], (v[best] * q[row]).sum(axis=1)))
        x, y, s = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query": x, "id": y, "score": s})

    return run


def _dealt(rows: DataFrame, top: int) -> DataFrame:
    return rows.withColumn("bucket", _bucket(top))


def forest_search(classes: DataFrame, queries: DataFrame, k: int, trees: int = TREES, bits: int = BITS, many: float = MANY, grows: float = GROWS, bucket: int = BUCKET) -> DataFrame:
    """query, id, score: for each row of queries (id, v) about the k rows of classes (id, v) with the largest inner product, and others.

    The vectors of each side are distinct, finite, not zero and of one length.
    """
    spark = classes.sparkSession
    n, longest = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    empty = spark.createDataFrame([], "query long, id long, score double")
    if not n:
        return empty
    learnt = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    planes = spark.sparkContext.broadcast(_Planes(np.array([r["v"] for r in sorted(learnt, key=lambda r: r["id"])]), float(np.sqrt(longest)) * (1 + 1e-12), trees, bits))
    schema = f"tree int, hash long, id long, v {classes.schema['v'].dataType.simpleString()}"
    strings = classes.select("id", "v").mapInArrow(partial(_hashed, planes=planes, query=False), schema)
    asked = cut(queries.select("id", "v").mapInArrow(partial(_hashed, planes=planes, query=True), schema))
    target, found = max(k, int(np.ceil(many * n**grows))), []
    top = min(bits, max(0, int(np.log2(max(1, n / bucket)))))
    while True:
        placed = _dealt(strings, top)
        wanted = _dealt(asked, top)
        if found:
            placed = placed.join(wanted.select("tree", "bucket").distinct(), ["tree", "bucket"], "left_semi")
        sizes = cut(placed.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / (4 * bucket)).cast("int").alias("blocks")))
        block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(0).cast("int")
        index = cut(placed.join(sizes, ["tree", "bucket"]).withColumn("block", block).drop("blocks"))
        visits = wanted.join(sizes, ["tree", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        slim = visits.select(*KEYS, "hash", "id")
        counts = index.select(*KEYS, "hash").groupBy(*KEYS).cogroup(slim.groupBy(*KEYS)).applyInArrow(_count(top, bits), "query long, length int, n long")
        enough = counts.groupBy("query", "length").agg(F.sum("n").alias("n")).where((F.col("n") >= target) | F.lit(top == 0) & (F.col("length") == 0))
        lengths = cut(enough.groupBy("query").agg(F.max("length").alias("length")))
        ready = visits.join(lengths.withColumnRenamed("query", "id"), "id")
        scored = index.groupBy(*KEYS).cogroup(ready.groupBy(*KEYS)).applyInArrow(_score(k), "query long, id long, score double")
        found.append(cut(scored.groupBy("query", "id").agg(F.max("score").alias("score"))))
        if not top:
            break
        asked = cut(asked.join(lengths.select(F.col("query").alias("id")), "id", "left_anti"))
        if asked.limit(1).count() == 0:
            break
        top = max(0, top - UP)
    out = empty
    for part in found:
        out = out.unionByName(part)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, many: float = MANY, grows: float = GROWS, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows found with the largest inner product, the best first (ties: smaller id).

    Rows whose id is null, or whose vector is null, zero, of another length than most or holds null or
    non-finite numbers, take no part on either side. Of rows with one id that with the least vector counts;
    a query's own id is none of its candidates. All candidates are returned if there are fewer
    than k; no rows give none. Other columns are not read.

    many, grows: the prefixes of all trees must hold many * rows ** grows rows together; trees: their
    number. On vectors with little structure, recall needs a large part of all rows: see the README.
    """
    rows = cut(_sound(vectors, id_col, vector_col))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    first = Window.partitionBy("v").orderBy("id")
    some = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)  # one more, for the query itself
    classes = cut(some.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("id"), "v", "members"))
    asked = _sound(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.col("v").cast(rows.schema["v"].dataType).alias("v"))
    wanted = cut(asked.where(F.size("v") == (common["n"] if common else 0)))
    of = Window.partitionBy("v").orderBy("query_id")
    heads = cut(wanted.withColumn("nth", F.row_number().over(of)).where("nth = 1").select(F.col("query_id").alias("id"), "v"))
    found = forest_search(classes.select("id", "v"), heads, k + 1, trees=trees, many=many, grows=grows, bucket=bucket)
    order = [F.col("score").desc(), F.col("id")]
    by_query = Window.partitionBy("query")
    near = found.withColumn("nth", F.row_number().over(by_query.orderBy(*order))).where(F.col("nth") <= k + 1).drop("nth")
    rows_near = near.join(classes.select("id", "members"), "id").select("query", "score", F.explode("members").alias("id"))
    rows_near = rows_near.withColumn("nth", F.row_number().over(by_query.orderBy(*order))).where(F.col("nth") <= k + 1)
    lists = cut(rows_near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("near")))
    of_query = wanted.join(heads.withColumnRenamed("id", "query"), "v").select("query_id", "query")
    mine = of_query.join(lists, "query").select("query_id", F.expr(f"slice(filter(near, x -> x.id <> query_id), 1, {int(k)})").alias("near"))
    each = mine.select("query_id", F.posexplode("near").alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
