"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each document of a source, in a shuffled order, gets a virtual finish time: the source's
cumulative words up to and with it, divided by the source's target. Documents may be taken
``max_passes`` times, so each has one finish time a pass. All are ordered by finish time, over all
sources, and the order is cut where the running total reaches the budget.

No source is gathered in one task. Cumulative words come from sums over (source, bucket of the
shuffle key) and a window within a bucket; the number of buckets grows with the square root of the rows.
The global order is a range sort: finish times are range-partitioned, so a partition's words and those
of the partitions before it tell which one holds the cut, and only that one's rows are summed up one by
one. Documents are then compared with the cut's key; nothing is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank (from 0) in code point order, null last. Ranks come from range partitions and their counts."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    put = cut(sources.withColumn("none", F.col("source").isNull()).repartitionByRange(parts, "none", "source").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("part").orderBy("none", "source")
    return put.join(starts, "part").withColumn("rank", F.col("start") + F.row_number().over(within) - 1).drop("part", "start", "none")


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, max_passes: int) -> DataFrame:
    """source, source_size, target for a table (source, source_size).

    Weights repeat over the sources in code point order. A target stops at ``max_passes`` times its
    source's size; the excess is shared again by weight until none is above. Each round sends three
    sums to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(_ranked(sizes).withColumn("w", weight).withColumn("cap", F.col("source_size") * max_passes))
    total, weight_sum = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    budget, level, full = total * total_share, 0.0, -1
    while weight_sum:
        level = budget / weight_sum
        n, over, rest = ranked.agg(F.count_if(F.col("w") * level > F.col("cap")), F.sum(F.when(F.col("w") * level > F.col("cap"), F.col("cap"))), F.sum(F.when(F.col("w") * level > F.col("cap"), 0.0).otherwise(F.col("w")))).first()
        if n == full:
            break
        full, budget, weight_sum = n, total * total_share - (over or 0), rest
    target = F.when(F.col("w") * level > F.col("cap"), F.col("cap").cast("double")).otherwise(F.col("w") * level)
    if full >= 0 and not weight_sum:  # every source is at its most
        target = F.col("cap").cast("double")
    return ranked.select("source", "source_size", target.alias("target"))


def _first_over(items: DataFrame, budget: float) -> Row | None:
    """The key of the first item, in key order, with which the running total exceeds the budget; None if all fit.

    items: key, size. They are range-sorted by key; of partitions there are as many as a shuffle has.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = cut(items.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    sums = put.groupBy("part").agg(F.sum("size").alias("words"))
    running = sums.withColumn("upto", F.sum("words").over(Window.orderBy("part")))  # a row a partition
    edge = running.where(F.col("upto") > F.lit(budget)).orderBy("part").first()
    if edge is None:
        return None
    base = edge["upto"] - edge["words"]
    over = put.where(F.col("part") == edge["part"]).withColumn("upto", F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    return over.where(F.col("upto") + base > F.lit(budget)).agg(F.min("key")).first()[0]


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, max_passes: int = 2, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    size counts the words of the text (null and empty: 0). taken is size times the passes whose
    finish time lies before the cut: 0, 1 ... ``max_passes``. Sources sort by code point, null is a
    source of its own and comes last. The shuffled order follows md5(seed:doc_id), so reruns agree;
    rows of the same identifier follow their size, then a hash of their text, and of fully repeated
    rows each is taken for itself. An empty table gives an empty table; no other column is read.
    """
    return _mixed(docs, weights, total_share, max_passes, seed, id_col, source_col, text_col).drop("k", "x")


def _source_key(source_col: str) -> Column:
    """Never null, in the order of the sources."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))


def _mixed(docs: DataFrame, weights: tuple[float, ...], total_share: float, max_passes: int, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """As mix_sources(), with the source's key k and a hash x of each text."""
    own = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("x")))
    key = _source_key("source")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = cut(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    most = sizes.agg(F.max("rows")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(most, 1), 16) / 2))  # the largest source has about as many buckets as a bucket has rows
    goals = targets(sizes.drop("rows"), weights, total_share, max_passes).withColumn("k", key).drop("source")

    rows = own.withColumn("k", key).withColumn("h", order).withColumn("b", F.substring("h", 1, digits)).drop("source")
    # every source has at most 16**digits buckets, whatever its rows
    bucket = rows.groupBy("k", "b").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").join(goals, "k")
    starts = cut(starts)
    within = Window.partitionBy("k", "b").orderBy("h", "doc_id", "size", "x").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("upto", F.sum("size").over(within)).join(starts, ["k", "b"])
    queued = cut(queued.select("doc_id", "size", "x", "source_size", "target", "k", "h", (F.col("start") + F.col("upto")).alias("upto")))

    def finish(n: int) -> Column:
        return (F.col("upto") + F.col("source_size") * n).cast("double") / F.col("target")

    def item(n: int) -> Column:
        return F.struct(finish(n).alias("finish"), F.col("k").alias("k"), F.lit(n).alias("pass"), F.col("h").alias("h"), F.col("doc_id").alias("id"), F.col("size").alias("size"))

    real = queued.where("size > 0 and target > 0")
    items = real.select("size", F.explode(F.array(*[item(n) for n in range(max_passes)])).alias("key"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    stop = _first_over(items, min(total * total_share, float(total * max_passes)))
    takes = [F.lit(True)] * max_passes
    if stop is not None:
        edge = F.struct(F.lit(stop["finish"]), F.lit(stop["k"]), F.lit(stop["pass"]), F.lit(stop["h"]), F.lit(stop["id"]).cast(queued.schema["doc_id"].dataType), F.lit(stop["size"]).cast("long"))
        takes = [item(n) < edge for n in range(max_passes)]
    passes = sum((F.when(x, 1).otherwise(0) for x in takes), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * passes).otherwise(F.lit(0))
    return queued.select("doc_id", "size", "k", "x", "source_size", "target", taken.cast("long").alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, max_passes: int = 2, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows are told apart by identifier, source and text; what is taken of fully repeated rows is shared
    among them. Documents without a word are not taken.
    """
    told = _mixed(docs, weights, total_share, max_passes, seed, id_col, source_col, text_col).where("size > 0")
    own = ["doc_id", "size", "k", "x"]
    times = cut(told.groupBy(*own).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("mix_times"), F.count("*").alias("mix_rows")).where("mix_times > 0"))
    repeats = times.where("mix_rows > 1").limit(1).count()
    times = times.select(*[F.col(c).alias(f"mix_{c}") for c in own], "mix_times", "mix_rows")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_doc_id"), word_count(F.col(text_col)).alias("own_size"), _source_key(source_col).alias("own_k"), F.xxhash64(F.col(text_col)).alias("own_x"))
    both = row.join(times, F.col("own_doc_id").eqNullSafe(F.col("mix_doc_id")) & (F.col("own_size") == F.col("mix_size")) & (F.col("own_k") == F.col("mix_k")) & (F.col("own_x") == F.col("mix_x")))
    again = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("again")
    if not repeats:
        return both.select("row", again(F.col("mix_times"))).select("row.*")
    alone = both.where("mix_rows = 1").select("row", again(F.col("mix_times")))
    place = F.row_number().over(Window.partitionBy(*[f"mix_{c}" for c in own]).orderBy("mix_rows"))
    share = F.floor(F.col("mix_times") / F.col("mix_rows")) + F.when(F.col("place") <= F.col("mix_times") % F.col("mix_rows"), 1).otherwise(0)
    shared = both.where("mix_rows > 1").withColumn("place", place).withColumn("share", share.cast("long")).where("share > 0")
    return alone.unionByName(shared.select("row", again(F.col("share")))).select("row.*")
