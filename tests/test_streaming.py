import datetime as dt

from pyspark.sql import functions as F

from corpusmill.operators import chat as batch
from corpusmill.streaming import chat

T0 = dt.datetime(2024, 1, 1)


def rows_of(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def events(spark, path, rows):
    df = spark.createDataFrame([(u, k, T0 + dt.timedelta(seconds=s)) for k, (u, s) in enumerate(rows)], "user_id long, event_id long, ts timestamp_ntz")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_sessions_match_batch(spark, tmp_path):
    rows = [(1, 0), (1, 3600), (1, 7201), (2, 0), (2, 3601), (3, 100), (9, 90_000)]
    df, stream = events(spark, f"{tmp_path}/e", rows)
    got = {(r["user"], r["session_start"], r["events"]) for r in rows_of(spark, chat.session_stream(stream), "sessions")}
    want = {(r["user"], r["session_start"].replace(tzinfo=None), r["events"]) for r in batch.inactivity_sessions(df, "user_id", "ts").collect() if r["user"] != 9}
    assert got == want  # user 9's session isn't over when the stream ends


def test_rate_limit_matches_batch(spark, tmp_path):
    rows = [(1, s) for s in (0, 1, 2, 3, 4)] + [(2, s) for s in (0, 5, 5, 7)]
    df, stream = events(spark, f"{tmp_path}/e", rows)
    got = {r["id"]: r["accepted"] for r in rows_of(spark, chat.rate_limit_stream(stream, 2), "limited")}
    want = {r["id"]: r["accepted"] for r in batch.rate_limited(df, "user_id", "ts", "event_id", 2).collect()}
    assert got == want and got[0] and not got[1] and got[2]


def test_windows(spark, tmp_path):
    _, stream = events(spark, f"{tmp_path}/e", [(1, 0), (1, 59), (1, 60), (2, 10_000)])
    got = {(r["start"], r["events"]) for r in rows_of(spark, chat.window_counts(stream, "ts", "1 minute"), "windows")}
    assert got == {(T0, 2), (T0 + dt.timedelta(seconds=60), 1)}


def test_dialogue(spark, tmp_path):
    said = [(1, 1, "question", "a"), (1, 2, "document", None), (1, 3, "question", " "), (1, 4, "question", "b"), (1, 5, "other", None), (1, 6, "start", None), (1, 7, "question", "c")]
    df = spark.createDataFrame(said, "user long, seq long, kind string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/m")
    rows = rows_of(spark, chat.dialogue_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/m")), "dialogue")
    got = [(r["action"], r["state"], r["history_size"]) for r in sorted(rows, key=lambda r: r["seq"])]
    assert got == [("ask_for_document", 0, 0), ("upload", 1, 0), ("refuse", 1, 0), ("answer", 1, 2), ("unsupported", 1, 2), ("greet", 0, 0), ("ask_for_document", 0, 0)]
    assert chat.next_state(1, "question", "x" * 1001) == (1, "refuse")


def test_history(spark):
    df = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(5)], "u long, turn long, role string, text string")
    got = batch.history_text(df, "u", "turn", F.col("turn") * 60, 3).first()["history"]
    assert got == "Вы [00:02]: m2\n\nБот [00:03]: m3\n\nВы [00:04]: m4"
    assert [r[0] for r in spark.range(1).select(batch.remaining_text(F.lit(100), F.lit(161))).collect()] == ["0:58:59"]
