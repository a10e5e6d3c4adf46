"""Connected components over an edge table, by alternating large-star and small-star steps.

Only built-in DataFrame operations. A round needs five shuffles of the edges at most; a hub's rows are
aggregated before they are shuffled, and its joins have a written side with one row for each
node, so adaptive execution can split a hub's partition. The driver sees one truth value a round.

What a step leaves is a written table: Spark knows its size, so small ones are broadcast and their files
are read together, and it goes as soon as the next step has read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, drop_path, shared_path


def _nearest(edges: DataFrame) -> DataFrame:
    """Of each node the least of itself and its neighbours, and whether it is neither a root nor a leaf of one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    less = F.count_if(F.col("v") < F.col("u"))
    stirs = (less > 1) | ((less == 1) & F.max(F.col("v") > F.col("u")))
    return both.groupBy("u").agg(F.min("v").alias("m"), stirs.alias("stirs")).select("u", F.least("u", "m").alias("m"), "stirs")


def _large_star(edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row an edge, so repeated ones can wait for the small star."""
    return edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(nearest.select("u", "m"), "u").select(F.col("far").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Returns (node, component) for every node of an edge, materialised; component is its smallest node.

    Nulls and loops are ignored, repeated edges count once, an empty table gives an empty table.
    Nodes may be of any type that can be ordered.
    """
    spark, held = edges.sparkSession, {}

    def written(name: str, df: DataFrame) -> DataFrame:
        was, held[name] = held.get(name), shared_path(spark, name)
        df.write.parquet(held[name])
        if was:
            drop_path(spark, was)
        return spark.read.schema(df.schema).parquet(held[name])

    u, v = F.col(a), F.col(b)
    now = written("edges", edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct())
    nearest = written("nearest", _nearest(now))
    # when no node stirs, each component is a star around its least node; that comes within the square of the logarithm of the nodes
    while nearest.agg(F.max("stirs")).first()[0]:
        large = written("large", _large_star(now, nearest))
        now = written("edges", _small_star(large, written("least", large.groupBy("u").agg(F.min("v").alias("m")))))
        nearest = written("nearest", _nearest(now))
    found = cut(nearest.select(F.col("u").alias("node"), F.col("m").alias("component")))
    for path in held.values():
        drop_path(spark, path)
    return found
