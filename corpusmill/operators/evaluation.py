"""Answer evaluation: ROUGE-L, joins of results with contexts, summaries, running averages."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ordered import BLOCK, by_weight, running_sums, sorted_blocks
from corpusmill.session import cut

ASCII_TOKENS, UNICODE_TOKENS = re.compile(r"[a-z0-9]+"), re.compile(r"\w+")


def lcs_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, by the bit-parallel method: one big integer addition a word."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & places.get(w, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def rouge_l_score(generated: str | None, reference: str | None, tokens: re.Pattern = ASCII_TOKENS) -> float:
    a, b = tokens.findall((generated or "").lower()), tokens.findall((reference or "").lower())
    n = lcs_length(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def rouge_l(generated: Column, reference: Column, unicode: bool = False) -> Column:
    """The F measure of the longest common word subsequence. By default only a-z and 0-9 make words; ``unicode`` takes all letters."""
    tokens = UNICODE_TOKENS if unicode else ASCII_TOKENS

    @F.pandas_udf("double")
    def score(g: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_score(x, y, tokens) for x, y in zip(g, r)], dtype=np.float64)

    return score(generated, reference)


def last_wins(contexts: DataFrame, keys: list[str], seq_col: str, context_col: str = "context") -> DataFrame:
    """One row for each key: its last context (blank: null) and how many it had."""
    found = contexts.groupBy(*keys).agg(F.max_by(context_col, seq_col).alias(context_col), F.count("*").alias("entries"))
    return found.withColumn(context_col, F.when(F.trim(F.col(context_col)) != "", F.col(context_col)))


def with_contexts(results: DataFrame, contexts: DataFrame, keys: list[str], seq_col: str, context_col: str = "context") -> DataFrame:
    """Results with the last context of their keys, or null."""
    return results.join(last_wins(contexts, keys, seq_col, context_col), keys, "left")


def describe(df: DataFrame, col: str) -> DataFrame:
    """n, mean, median (linear), min, max and population standard deviation; nulls don't count.

    The values are materialised, so their plan runs once. The median is exact: an approximate quantile sketch gives two values that enclose it closely, and
    only the values between them are counted and put in order.
    """
    v = cut(df.select(F.col(col).alias("v")).where("v is not null"))
    half = 2e-5  # twice the sketch's error
    told = v.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"), F.percentile_approx("v", [0.5 - half, 0.5 + half], F.lit(100_000)).alias("around"))
    near = v.join(F.broadcast(told.select("n", "around")))  # one row
    below = near.agg(F.count_if(F.col("v") < F.col("around")[0]).alias("below"))
    counts = near.where("v between around[0] and around[1]").groupBy("v").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = counts.join(F.broadcast(below)).withColumn("upto", F.col("below") + F.sum("c").over(Window.orderBy("v")))
    first, second = (F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1 + k) / 2), F.col("v"))) for k in (0, 1))
    median = upto.agg(((first + second) / 2).cast("double").alias("median"))
    return told.drop("around").join(F.broadcast(median)).select("n", "mean", "median", "min", "max", "std")


def search_accuracy(best: DataFrame, sim_col: str = "best_sim", least: float = 0.5, id_col: str = "query_id") -> DataFrame:
    """queries, accuracy (percent of at least ``least``), mean_sim, best_query, worst_query (smallest id of equals); zeros if empty."""
    sim = F.coalesce(F.col(sim_col), F.lit(0.0))
    return best.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.avg(F.when(sim >= least, 100.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(sim), F.lit(0.0)).alias("mean_sim"),
        F.max_by(id_col, F.struct(sim, -F.col(id_col))).alias("best_query"),
        F.min_by(id_col, F.struct(sim, F.col(id_col))).alias("worst_query"),
    )


def summary(results: DataFrame, targets: dict[str, float], facts_col: str | None = None) -> DataFrame:
    """num_examples, with and without facts, and for each metric its average and whether it meets its target."""
    aggs = [F.count("*").alias("num_examples")]
    if facts_col:
        aggs += [F.count_if(F.col(facts_col)).alias("examples_with_facts"), F.count_if(~F.col(facts_col)).alias("examples_without_facts")]
    found = results.agg(*aggs, *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in targets])
    for m, target in targets.items():
        found = found.withColumn(f"target_{m}", F.lit(target)).withColumn(f"{m}_met", F.col(f"avg_{m}") >= target)
    return found


def faithfulness(results: DataFrame, col: str = "faithful") -> DataFrame:
    """total, evaluated, faithful, unfaithful and score (rounded to four digits; 0 if none is evaluated); nulls aren't evaluated."""
    return results.agg(F.count("*").alias("total_examples"), F.count(col).alias("evaluated_examples"), F.count_if(F.col(col) == 1).alias("faithful_count"), F.count_if(F.col(col) == 0).alias("unfaithful_count"), F.coalesce(F.round(F.avg(col), 4), F.lit(0.0)).alias("faithfulness_score"))


def running_averages(rows: DataFrame, keys: list[str], seq_col: str, metrics: list[str], every: int = 15, most: int = BLOCK) -> DataFrame:
    """keys, n and each metric's mean over the rows so far of its key, at every ``every``-th row; nulls don't count in means.

    A key of over ``most`` rows is summed up by many tasks (see ordered.running_sums).
    """
    wanted = [*keys, "n", *[f"avg_{m}" for m in metrics]]

    def one(light: DataFrame) -> DataFrame:
        so_far = Window.partitionBy(*keys).orderBy(seq_col).rowsBetween(Window.unboundedPreceding, 0)
        out = light.withColumn("n", F.count("*").over(so_far)).withColumns({f"avg_{m}": F.avg(m).over(so_far) for m in metrics})
        return out.where(F.col("n") % every == 0).select(*wanted)

    def many(heavy: DataFrame) -> DataFrame:
        added = {"__one": F.lit(1)} | {f"__has{k}": F.col(m).isNotNull().cast("int") for k, m in enumerate(metrics)}
        blocks = sorted_blocks(heavy.withColumns(added), ["__group", seq_col], most)
        names = [*added, *metrics]
        sums = running_sums(blocks, "__group", names, [f"__upto{k}" for k in range(len(names))])
        n = len(metrics)
        means = {f"avg_{m}": F.when(F.col(f"__upto{k + 1}") > 0, F.col(f"__upto{n + k + 1}") / F.col(f"__upto{k + 1}")) for k, m in enumerate(metrics)}
        return sums.withColumns({"n": F.col("__upto0").cast("long")} | means).where(F.col("n") % every == 0).select(*wanted)

    keyed = rows.withColumn("__group", F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys])))
    return by_weight(keyed, "__group", one, many, most)
