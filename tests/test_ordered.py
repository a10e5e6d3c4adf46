"""Folds over the rows of hot keys: cut into blocks anywhere, they equal the plain folds."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat, evaluation, ordered, segments

T0 = dt.datetime(2024, 1, 1)


def plain_taken(rows):
    out, at = {}, {}
    for key, order, enter, leave in rows:
        ok = enter is None or enter >= at.get(key, ordered.NONE)
        out[key, order] = ok
        if ok and enter is not None:
            at[key] = leave
    return out


@pytest.mark.parametrize("seed", range(7))
def test_greedy_starts(spark, seed):
    """A hot key over all blocks, others between; steps that are short, reach over many blocks, or beyond the end."""
    rng = random.Random(seed)
    step = [3, 40, 400, 3000, 100_000, 7, -5][seed]
    rows = []
    for key, n in ((None, 40), ("a", 700), ("b", 1), ("c", 90), ("d", 260)):
        at = 0
        for k in range(n):
            at += rng.choice([0, 0, 1, 1, 2, 9]) if seed < 5 else rng.choice([1, 100])
            rows.append((key, k, at, at + step))
    rows += [("a", -1, None, None), ("z", 0, None, None), ("z", 1, 5, 6)]
    df = spark.createDataFrame(rows, "k string, o int, e long, l long").repartition(3)
    blocks = ordered.sorted_blocks(df, ["k", "o"], 50)
    assert blocks.select("__block").distinct().count() >= 12
    got = {(r["k"], r["o"]): r["taken"] for r in ordered.greedy_starts(blocks, "k", "e", "l", "taken").collect()}
    assert got == plain_taken(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(key, k, rng.choice([None, 1, 2, 5]), rng.random()) for key, n in (("x", 300), (None, 120), ("y", 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "k string, o int, a int, b double").repartition(3)
    sums = ordered.running_sums(ordered.sorted_blocks(df, ["k", "o"], 30), "k", ["a", "b"], ["sa", "sb"]).collect()
    assert len(sums) == len(rows)
    upto = Counter()
    want = {}
    for key, k, a, b in rows:
        upto[key, "a"] += a or 0
        upto[key, "b"] += b
        want[key, k] = upto[key, "a"], upto[key, "b"]
    for r in sums:
        assert r["sa"] == want[r["k"], r["o"]][0] and abs(r["sb"] - want[r["k"], r["o"]][1]) < 1e-9


def test_hot_users(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), T0 + dt.timedelta(seconds=rng.randrange(4000) / 4), k) for k in range(900)]
    rows += [(1, None, 1000), (2, None, 1001)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long").repartition(3)
    want = {r["id"]: r["accepted"] for r in chat.rate_limited(df, "user_id", "ts", "event_id", 3).collect()}
    got = {r["id"]: r["accepted"] for r in chat.rate_limited(df, "user_id", "ts", "event_id", 3, most=100).collect()}
    assert got == want and len(got) == 902 and 100 < sum(got.values()) < 800
    assert chat.rate_limited(df.limit(0), "user_id", "ts", "event_id", 3, most=100).count() == 0


def test_hot_averages(spark):
    rng = random.Random(5)
    rows = [("a" if k % 3 else "b", "x", k, rng.choice([None, 1.0, 2.5]), rng.random()) for k in range(500)]
    rows += [("c", None, k, None, 1.0) for k in range(7)]
    df = spark.createDataFrame(rows, "k1 string, k2 string, seq int, m double, o double").repartition(3)
    show = lambda most: {(r["k1"], r["k2"], r["n"]): tuple(None if x is None else round(x, 9) for x in (r["avg_m"], r["avg_o"])) for r in evaluation.running_averages(df, ["k1", "k2"], "seq", ["m", "o"], 5, most).collect()}
    assert show(50) == show(10_000) and len(show(50)) == 500 // 3 // 5 + 333 // 5 + 1


def test_pages_of_hot_documents(spark):
    rng = random.Random(6)
    docs = {"hot": 400, "few": 3, "one": 1}
    pages = [(d, k, "x" * rng.choice([1, 8, 40, 41, 80, 400]) if rng.random() < 0.97 else None) for d, n in docs.items() for k in range(n)]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string").repartition(3)
    got = {(r["doc"], r["segment"]): (r["text"], r["page_range"], r["token_estimate"]) for r in segments.page_segments(df, budget=25, block_rows=20).collect()}
    for d in docs:
        own = [t or "" for x, _, t in pages if x == d]
        plain = spark.range(1).select(segments.greedy_segments(F.array(*map(F.lit, own)), 25).alias("s")).first()["s"]
        assert [got[d, k] for k in range(len(plain))] == [tuple(s) for s in plain]
    assert len(got) == len({k for k in got})


def test_texts_of_pages_stay_out_of_python(spark):
    """Of the folds of pages only one is left to run with the result, and no text goes through it."""
    df = spark.createDataFrame([("a", k, "some text") for k in range(50)], "doc_id string, page int, text string")
    plan = segments.page_segments(df, budget=25, block_rows=20)._jdf.queryExecution().executedPlan().toString()
    folds = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(folds) == 1 and "text" not in folds[0]
