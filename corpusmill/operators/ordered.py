"""Folds over the rows of a key in their order, however many rows a key has.

Rows are range-sorted by key and order into blocks, which are partitions; a key with many rows spans many
blocks, and each block continues one key of the block before at most. So what has to pass from block to
block is one state a block:

- running sums need the sums of the blocks before (``running_sums``);
- a greedy choice, where a row is taken if it lies at or past a threshold and then moves it, needs the
  threshold with which a block begins, and that depends on all rows before (``greedy_starts``). Each block tells for
  every row it may begin with where its last choice leads, into which later block and with which
  threshold; these pointers are then doubled, so the blocks that a key's choice enters are known after
  a number of rounds that is the logarithm of the blocks.

The driver holds a few numbers for each block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import partial
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut

#: Rows of a block, about.
BLOCK = 200_000
NONE = -(1 << 62)


def sorted_blocks(rows: DataFrame, order: list[str], block_rows: int = BLOCK) -> DataFrame:
    """The rows and their __block, materialised in order; the first column of ``order`` is the key."""
    parts = max(1, -(-rows.count() // block_rows))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(placed.withColumn("__block", F.spark_partition_id()))


def _runs(keys: list) -> list[tuple[Any, int, int]]:
    """(key, from, to) of runs of equal keys."""
    out, at = [], 0
    for key, same in groupby(keys):
        n = sum(1 for _ in same)
        out.append((key, at, at + n))
        at += n
    return out


def by_weight(rows: DataFrame, key: str, light: Callable[[DataFrame], DataFrame], heavy: Callable[[DataFrame], DataFrame], most: int = BLOCK) -> DataFrame:
    """``light`` over the rows of keys with ``most`` rows at most, and ``heavy`` over all others; both must give the same.

    The keys that are heavy are no more than the rows by ``most``; where that is over a thousand, all rows take the heavy way.
    """
    found = [r[0] for r in rows.groupBy(key).count().where(F.col("count") > most).limit(1001).collect()]
    if not found:
        return light(rows)
    if len(found) > 1000:
        return heavy(rows)
    chosen = F.coalesce(F.col(key).isin([k for k in found if k is not None]), F.lit(None in found))
    return light(rows.where(~chosen)).unionByName(heavy(rows.where(chosen)))


# -- running sums -----------------------------------------------------------------------------------


def _summed(column: pa.Array) -> np.ndarray:
    """Whole numbers stay whole; nulls add nothing."""
    if pa.types.is_integer(column.type):
        return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _block_sums(batches, n: int):
    """A row for each block: its first and last key, whether these are one run, and the sums of the last run."""
    block, first, key, runs, sums = None, None, None, 0, [0] * n
    for batch in batches:
        columns = [_summed(batch.column(2 + k)) for k in range(n)]
        for k, a, b in _runs(batch.column(1).to_pylist()):
            if block is None:
                block, first, key, runs = batch.column(0)[0].as_py(), k, k, 1
            elif k != key:
                key, runs, sums = k, runs + 1, [0] * n
            sums = [s + c[a:b].sum() for s, c in zip(sums, columns)]
    if block is not None:
        yield pa.RecordBatch.from_pylist([{"block": block, "first": repr(first), "last": repr(key), "single": runs == 1, "sums": [float(s) for s in sums]}])


def _run_sums(batches, n: int, before):
    key, sums, fresh = None, None, True
    for batch in batches:
        columns = [_summed(batch.column(batch.num_columns - n + k)) for k in range(n)]
        out = [c.astype(np.float64) for c in columns]
        keys = batch.column(1).to_pylist()
        for k, a, b in _runs(keys):
            if fresh:
                sums, key, fresh = list(before.value.get(batch.column(0)[0].as_py(), [0.0] * n)), k, False
            elif k != key:
                sums, key = [0.0] * n, k
            for j in range(n):
                run = np.cumsum(out[j][a:b])
                out[j][a:b] = run + sums[j]
                sums[j] += run[-1]
        kept = [batch.column(k) for k in range(2, batch.num_columns - n)]
        yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, out)], names=[*batch.schema.names[2 : batch.num_columns - n], *[f"__sum{k}" for k in range(n)]])


def running_sums(blocks: DataFrame, key: str, columns: list[str], names: list[str]) -> DataFrame:
    """The rows of sorted_blocks() with, for each column, the sum over its key's rows up to this one, as a double in a column of that name.

    Nulls add nothing. Sums of whole numbers are exact up to 2^53. Rows stay where they are: one pass gives each block's sums, another adds
    up, beginning with what the blocks before have told of the key that goes on.
    """
    n, rest = len(columns), blocks.columns
    spark = blocks.sparkSession
    told = blocks.select("__block", F.col(key).cast("string").alias("k"), *columns).mapInArrow(partial(_block_sums, n=n), "block long, first string, last string, single boolean, sums array<double>").collect()
    before, last, sums = {}, None, None
    for r in sorted(told, key=lambda r: r["block"]):
        goes_on = sums is not None and r["first"] == last
        if goes_on:
            before[r["block"]] = sums
        sums = [a + b for a, b in zip(sums, r["sums"])] if goes_on and r["single"] else list(r["sums"])
        last = r["last"]
    held = blocks.select(F.col("__block").alias("__at"), F.col(key).cast("string").alias("__key"), *rest, *[F.col(c).alias(f"__add{k}") for k, c in enumerate(columns)])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema], *[f"__sum{k} double" for k in range(n)]])
    added = held.mapInArrow(partial(_run_sums, n=n, before=spark.sparkContext.broadcast(before)), schema)
    return added.withColumnsRenamed({f"__sum{k}": name for k, name in enumerate(names)})


# -- greedy choices ---------------------------------------------------------------------------------------


def _block_ends(batches):
    """A row for each block: first and last key, whether these are one run, the first run's last place, and for the last run
    where its last row would move the threshold, and the threshold it leaves if the run begins here."""
    block = None
    for batch in batches:
        keys, enter, leave = (batch.column(k).to_pylist() for k in (1, 2, 3))
        for k, e, v in zip(keys, enter, leave):
            if block is None:
                block, first, key, runs, first_last, reach, at = batch.column(0)[0].as_py(), k, k, 1, NONE, NONE, NONE
            elif k != key:
                key, runs, reach, at = k, runs + 1, NONE, NONE
            if e is None:
                continue
            if runs == 1:
                first_last = e
            reach = v
            if e >= at:
                at = v
    if block is not None:
        yield pa.RecordBatch.from_pylist([{"block": block, "first": repr(first), "last": repr(key), "single": runs == 1, "first_last": first_last, "reach": reach, "left": at}])


def _pointers(batches, chains):
    """For a block that continues a key, rows (block, x, to, t): a choice that enters it with a threshold up to x (and over the row before)
    leaves it for block ``to`` with threshold t; to is -1 where the key ends. Only thresholds that may come are told."""
    held, block = [], None
    for batch in batches:
        block = batch.column(0)[0].as_py()
        keys = batch.column(1).to_pylist()
        if chains.value[block]["first"] != repr(keys[0]):
            break
        n = next((b for _, _, b in _runs(keys)), 0)
        held.append(np.stack([c.slice(0, n).drop_null().to_numpy(zero_copy_only=False) for c in (batch.column(2), batch.column(3))]))
        if n < len(keys):
            break
    if not held:
        return
    for _ in batches:  # the rest of the block is not this key's
        pass
    enter, leave = np.concatenate(held, axis=1)
    own = chains.value[block]
    following = np.maximum(np.searchsorted(enter, leave, "left"), np.arange(1, len(enter) + 1)).tolist()
    out = leave.tolist()
    for k in range(len(out) - 1, -1, -1):
        if following[k] < len(out):
            out[k] = out[following[k]]
    most = min(len(enter), int(np.searchsorted(enter, own["reach_before"], "left")) + 1)
    x, t = enter[:most], np.array(out[:most], np.int64)
    some = np.append(t[1:] != t[:-1], True) if most else np.zeros(0, bool)  # of equal ends the last entry stands for all
    x, t = x[some], t[some]
    to = [own["later"][at] if at < len(own["later"]) else -1 for at in (bisect_left(own["lasts"], v) for v in t.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block, np.int32)), pa.array(x), pa.array(to, pa.int32()), pa.array(t)], names=["block", "x", "to", "t"])


def _followed(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
    """Where the requests (from_block, x, t) that enter this block lead on to."""
    order = np.argsort(table["x"].to_numpy())
    at = np.searchsorted(table["x"].to_numpy()[order], asked["t"].to_numpy(), "left")
    row = pa.array(order[at[at < len(order)]]) if len(order) else pa.array([], pa.int64())
    some = asked.filter(pa.array(at < len(order)))
    return pa.table({"block": some["from_block"], "x": some["x"], "to": table["to"].take(row), "t": table["t"].take(row)})


_POINTER = "block int, x long, to int, t long"


def _lookup(table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: from_block, x, to, t."""
    at = asked.select(F.col("to").alias("block"), "from_block", "x", "t")
    return table.groupBy("block").cogroup(at.groupBy("block")).applyInArrow(_followed, _POINTER)


def _taken(batches, begins):
    key, at, fresh = None, NONE, True
    for batch in batches:
        out = []
        keys, enter, leave = (batch.column(k).to_pylist() for k in (1, batch.num_columns - 2, batch.num_columns - 1))
        if fresh:
            key, at, fresh = keys[0], begins.value.get(batch.column(0)[0].as_py(), NONE), False
        for k, e, v in zip(keys, enter, leave):
            if k != key:
                key, at = k, NONE
            ok = e is None or e >= at
            out.append(ok)
            if ok and e is not None:
                at = v
        kept = batch.columns[2:-2]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.bool_())], names=[*batch.schema.names[2:-2], "__taken"])


def greedy_starts(blocks: DataFrame, key: str, enter: str, leave: str, name: str) -> DataFrame:
    """The rows of sorted_blocks() with a column ``name``: whether the greedy choice takes them.

    A key's threshold is at first below all; a row is taken if its ``enter`` is at the threshold or over
    it, which then becomes its ``leave``. Both are whole numbers that don't fall within a key; a row
    without ``enter`` is taken and moves nothing. A null key is a key.
    """
    spark = blocks.sparkSession
    four = blocks.select("__block", F.col(key).cast("string").alias("k"), F.col(enter).cast("long").alias("e"), F.col(leave).cast("long").alias("l"))
    told = sorted(four.mapInArrow(_block_ends, "block long, first string, last string, single boolean, first_last long, reach long, left long").collect(), key=lambda r: r["block"])
    # chains of blocks that one key goes through; each but the first of a chain needs its beginning
    chains, entries, open_, last = {}, [], [], None
    for r in told:
        goes_on = last is not None and r["first"] == last["last"]
        if goes_on:
            if not open_:
                open_, head = [], last
            reach = max(head["reach"], *[c["reach"] for c in open_], NONE) if open_ else head["reach"]
            open_.append(r)
            chains[r["block"]] = {"first": r["first"], "reach_before": reach, "chain": open_, "head": head}
        if not goes_on or not r["single"]:
            open_ = []
        last = r
    for block, c in chains.items():
        later = [r for r in c["chain"] if r["block"] > block]
        c["later"], c["lasts"] = [r["block"] for r in later], list(np.maximum.accumulate([r["first_last"] for r in later])) if later else []
    begins = dict.fromkeys(chains, 1 << 62)  # blocks that the choice passes over take nothing
    for block, c in chains.items():
        if c["chain"][0]["block"] == block:
            lasts = list(np.maximum.accumulate([r["first_last"] for r in c["chain"]]))
            at = bisect_left(lasts, c["head"]["left"])
            if at < len(lasts):
                entries.append((c["chain"][at]["block"], c["head"]["left"]))
    if chains:
        slim = {b: {k: c[k] for k in ("first", "reach_before", "later", "lasts")} for b, c in chains.items()}
        shared = spark.sparkContext.broadcast(slim)
        table = cut(four.where(F.col("__block").isin(list(chains))).mapInArrow(partial(_pointers, chains=shared), _POINTER))
        begins |= dict(entries)
        while entries:
            asked = spark.createDataFrame([(b, 0, b, t) for b, t in begins.items() if t < 1 << 62], "from_block int, x long, to int, t long")
            found = {(r["to"], r["t"]) for r in _lookup(table, asked).collect() if r["to"] >= 0}
            entries = [e for e in found if begins[e[0]] != e[1]]
            begins |= dict(entries)
            if entries:
                on = _lookup(table.toDF(*table.columns), table.where("to >= 0").select(F.col("block").alias("from_block"), "x", "to", "t"))
                table = cut(on.unionByName(table.where("to < 0")))
    rest = blocks.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema], "__taken boolean"])
    held = blocks.select(F.col("__block").alias("__at"), F.col(key).cast("string").alias("__key"), *rest, F.col(enter).cast("long").alias("__enter"), F.col(leave).cast("long").alias("__leave"))
    return held.mapInArrow(partial(_taken, begins=spark.sparkContext.broadcast(begins)), schema).withColumnRenamed("__taken", name)
