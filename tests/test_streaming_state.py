"""Streams with event-time state: any split of a replay gives what the batch operators give, and a restart loses nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat as batch
from corpusmill.streaming import chat

T0 = dt.datetime(2024, 1, 1)
LATE = 300


def write(spark, path, rows, schema, splits):
    """One file a split, in the order given; a last one moves the watermark on."""
    for k, part in enumerate(splits):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")


def replay(spark, make, path, schema, name, checkpoint=None):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    q = make(stream).writeStream.format("parquet").option("path", f"{path}-{name}").option("checkpointLocation", checkpoint or f"{path}-{name}-cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.parquet(f"{path}-{name}")


def disordered(rows, rng, late=LATE):
    """The rows in an order in which none comes more than the lateness after its time."""
    return sorted(range(len(rows)), key=lambda k: rows[k][1] + dt.timedelta(seconds=rng.uniform(0, late * 0.9)))


def made_events(rng, n=60):
    rows = [(rng.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(seconds=rng.choice([rng.randrange(3000), rng.randrange(3000) / 8])), k) for k in range(n)]
    rows += [(4, T0, 900), (4, T0, 901), (None, T0, 902), (4, None, 903)]
    return rows


EVENTS = "user_id long, ts timestamp, event_id long"


@pytest.mark.parametrize("parts", [1, 4])
def test_rate_limit_and_sessions_in_any_split(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = made_events(rng)
    fine = [r for r in rows if r[0] is not None and r[1] is not None]
    order = [k for k in disordered([r if r[1] else (*r[:1], T0, *r[2:]) for r in rows], rng)]
    splits = [order[k * len(order) // parts : (k + 1) * len(order) // parts] for k in range(parts)]
    rows.append((99, T0 + dt.timedelta(days=1), 999))
    splits.append([len(rows) - 1])
    write(spark, f"{tmp_path}/e", rows, EVENTS, splits)
    df = spark.createDataFrame(fine, EVENTS)

    got = replay(spark, lambda s: chat.rate_limit_stream(s, 40, lateness=LATE), f"{tmp_path}/e", EVENTS, "limit").where("user <> 99")
    want = batch.rate_limited(df, "user_id", "ts", "event_id", 40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    got = replay(spark, lambda s: chat.session_sweep_stream(s, timeout=120, lateness=LATE), f"{tmp_path}/e", EVENTS, "sweep").where("user <> 99")
    want = batch.inactivity_sessions(df, "user_id", "ts", 120).select("user", "session_start", "last_used", "events")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 4


MESSAGES = "user long, ts timestamp, seq long, kind string, text string"


def made_messages(rng, n=50):
    said = lambda: rng.choice([("start", None), ("document", None), ("question", "a"), ("question", " "), ("question", "b" * 1001), ("question", "c"), ("photo", None)])
    return [(rng.choice([1, 1, 2]), T0 + dt.timedelta(seconds=30 * k + rng.choice([0, 0, 0, 400])), k, *said()) for k in range(n)]


def test_dialogue_restarted_half_way(spark, tmp_path):
    rng = random.Random(7)
    rows = made_messages(rng)
    order = disordered(rows, rng)
    want = sorted(map(tuple, batch.dialogues(spark.createDataFrame(rows, MESSAGES), timeout=350, keep=4).collect()))
    make = lambda s: chat.dialogue_stream(s, timeout=350, keep=4, lateness=LATE)
    rows.append((99, T0 + dt.timedelta(days=1), 999, "start", None))
    splits = [order[:25], order[25:], [len(rows) - 1]]

    write(spark, f"{tmp_path}/whole", rows, MESSAGES, splits)
    unbroken = replay(spark, make, f"{tmp_path}/whole", MESSAGES, "out")
    kept = spark.read.format("statestore").option("stateVarName", "now").load(f"{tmp_path}/whole-out-cp")
    assert sorted(map(tuple, unbroken.where("user <> 99").collect())) == want
    assert any(r[4] for r in want) and max(len(r[5]) for r in want) == 4

    # stopped after the first file, started again from the checkpoint
    write(spark, f"{tmp_path}/cut", rows, MESSAGES, splits[:1])
    first = replay(spark, make, f"{tmp_path}/cut", MESSAGES, "out").count()
    held = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(f"{tmp_path}/cut-out-cp")
    assert 0 < first < len(want) and held.count() == 25 - first  # what has not been passed yet waits in state
    for k, part in enumerate(splits[1:], 1):
        spark.createDataFrame([rows[i] for i in part], MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/cut/{k:03d}")
    broken = replay(spark, make, f"{tmp_path}/cut", MESSAGES, "out")
    assert sorted(map(tuple, broken.collect())) == sorted(map(tuple, unbroken.collect()))
    after = spark.read.format("statestore").option("stateVarName", "now").load(f"{tmp_path}/cut-out-cp")
    state = lambda df: sorted(str(r) for r in df.select("key", "value").collect())
    assert state(after) == state(kept)


def test_state_goes(spark, tmp_path):
    """The sweep: users that are idle leave no state."""
    rows = [(u, T0 + dt.timedelta(seconds=u), u) for u in range(20)] + [(99, T0 + dt.timedelta(days=1), 999), (99, T0 + dt.timedelta(days=2), 1000)]
    write(spark, f"{tmp_path}/e", rows, EVENTS, [range(20), [20], [21]])
    got = replay(spark, lambda s: chat.rate_limit_stream(s, 5, lateness=1), f"{tmp_path}/e", EVENTS, "limit")
    assert got.where("accepted").count() == 21
    left = spark.read.format("statestore").option("stateVarName", "now").load(f"{tmp_path}/e-limit-cp")
    assert {r[0] for r in left.select(F.col("key").getField("user")).collect()} <= {99}
