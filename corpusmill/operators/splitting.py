"""Leak-free train, validation and test splits: all rows of a group go to one split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
BUCKETS = 1024


def group_assignment(df: DataFrame, group_col: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """group, split. Groups are ordered by sha256(seed:group); the first floor(n train) are train, the next floor(n val) val.

    The order is found from counts of hash buckets and a rank within each, so no task sees all groups.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("grp").cast("string")), 256)
    groups = df.select(F.col(group_col).alias("grp")).distinct().withColumn("h", order).withColumn("b", F.substring("h", 1, 3))
    sizes = groups.groupBy("b").agg(F.count("*").alias("size"))
    ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    starts = sizes.select("b", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy()).alias("n"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("b").orderBy("h", "grp"))
    ranked = groups.join(F.broadcast(starts), "b").withColumn("rank", rank)
    n_train, n_val = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.select(F.col("grp").alias(group_col), split.alias("split"))


def group_split(df: DataFrame, group_col: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """The rows with their split. Rows with a null group form one group."""
    named = group_assignment(df, group_col, train, val, seed).withColumnRenamed(group_col, "__group")
    return df.join(named, df[group_col].eqNullSafe(named["__group"])).drop("__group")


def split_stats(rows: DataFrame, group_col: str) -> DataFrame:
    """split, docs, qa_pairs."""
    return rows.groupBy("split").agg(F.count_distinct(group_col).alias("docs"), F.count("*").alias("qa_pairs"))
