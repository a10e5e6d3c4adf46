"""Queries of chat sessions, limits and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chat
from corpusmill.plans.registry import registry, table
from corpusmill.session import work_path
from corpusmill.streaming import chat as streams

QUERIES, ORACLE_SQL, query = registry()

_GAPS = "g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events))"


def _events(spark, sf):
    return table(spark, sf, "events")


@query(f"WITH {_GAPS} SELECT user_id AS user, min(ts) AS session_start, max(ts) AS last_used, count(*) AS events FROM g GROUP BY user_id, s")
def session_windows(spark, sf):
    return chat.inactivity_sessions(_events(spark, sf), "user_id", "ts")


@query(f"WITH {_GAPS} SELECT user_id AS user, CAST(max(s) AS BIGINT) AS sessions FROM g GROUP BY 1")
def sessions_by_gap(spark, sf):
    return chat.sessions_by_gap(_events(spark, sf), "user_id", "ts").groupBy("user").agg(F.max("session").alias("sessions"))


@query("SELECT count(*) AS users, count(*) FILTER (last >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR) AS active FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)")
def active_sessions(spark, sf):
    e = _events(spark, sf)
    return chat.active_sessions(e, "user_id", "ts", None, 6 * 3600)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, ts, k, TRUE AS accepted, ts AS last FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.event_id, e.ts, e.k, epoch_us(e.ts) - epoch_us(w.last) >= 3600000000, CASE WHEN epoch_us(e.ts) - epoch_us(w.last) >= 3600000000 THEN e.ts ELSE w.last END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
    SELECT user_id AS user, event_id AS id, ts, accepted FROM w"""
)
def rate_limit(spark, sf):
    return chat.rate_limited(_events(spark, sf), "user_id", "ts", "event_id", 3600)


def _streamed(spark, sf, make):
    """All events as a stream that ends; its output and checkpoint go to the shared folder."""
    path, schema = work_path(spark, "stream"), _events(spark, sf).schema
    out = make(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*"))  # a pattern, for a file alone is no folder
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query(ORACLE_SQL["rate_limit"])
def streamed_rate_limit(spark, sf):
    return _streamed(spark, sf, lambda e: streams.rate_limit_stream(e, 3600)).select("user", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "accepted")


@query(f"WITH {_GAPS} SELECT user_id AS user, min(ts) AS session_start, max(ts) AS last_used, count(*) AS events FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR < (SELECT max(ts) FROM events)")
def streamed_sessions(spark, sf):
    """Those sessions that are over when the events end."""
    s = _streamed(spark, sf, lambda e: streams.session_sweep_stream(e, lateness=0))
    return s.select("user", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "last_used")], "events")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def history_last_n(spark, sf):
    return chat.last_messages(table(spark, sf, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id AS key, string_agg((CASE WHEN role = 'user' THEN 'Вы' ELSE 'Бот' END) || ' [' || strftime(make_timestamp(CAST(turn * 61 * 1000000 AS BIGINT)), '%H:%M') || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20 GROUP BY conv_id")
def history_text(spark, sf):
    return chat.history_text(table(spark, sf, "conversations"), "conv_id", "turn", F.col("turn") * 61)


@query("SELECT event_id, greatest(0, 3600 - CAST(floor(value * 50) AS BIGINT)) AS remaining, greatest(0, 3600 - CAST(floor(value * 50) AS BIGINT)) // 3600 || ':' || lpad(CAST(greatest(0, 3600 - CAST(floor(value * 50) AS BIGINT)) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(greatest(0, 3600 - CAST(floor(value * 50) AS BIGINT)) % 60 AS VARCHAR), 2, '0') AS shown FROM events")
def session_remaining(spark, sf):
    now = F.floor(F.col("value") * 50).cast("long")
    return _events(spark, sf).select("event_id", chat.remaining_seconds(F.lit(0), now).alias("remaining"), chat.remaining_text(F.lit(0), now).alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 400::BIGINT WHEN n > 20971520 THEN 413 WHEN n = 0 THEN 400 WHEN doc_id % 5 IN (1, 3) THEN 422 ELSE 200 END AS status FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 30000000 WHEN doc_id % 11 = 0 THEN 0 ELSE length(text) END AS n FROM documents)")
def upload_statuses(spark, sf):
    d = F.col("doc_id")
    name = F.concat(F.lit("f"), F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".docx", ".docx", ".exe"))), (d % 5 + 1).cast("int")))
    size = F.when(d % 7 == 0, 30000000).when(d % 11 == 0, 0).otherwise(F.length("text"))
    return table(spark, sf, "documents").select("doc_id", chat.upload_status(name, size, d % 5 == 0, d % 5 == 2).alias("status"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 1000 THEN 'long' END AS refusal FROM documents")
def question_checks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", chat.question_refusal(F.col("text")).alias("refusal"))


@query("WITH s AS (SELECT sha256(text) AS h, 's' || doc_id AS session_id, doc_id % 97 AS last_used FROM documents WHERE doc_id % 3 = 0), b AS (SELECT h, session_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY last_used DESC, session_id DESC) AS r FROM s) WHERE r = 1) SELECT doc_id, b.session_id AS reused_session FROM documents d LEFT JOIN b ON sha256(d.text) = b.h")
def reused_collections(spark, sf):
    d = table(spark, sf, "documents").withColumn("content_hash", F.sha2("text", 256))
    s = d.where("doc_id % 3 = 0").select("content_hash", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), (F.col("doc_id") % 97).alias("last_used"))
    return chat.reused_collections(d.select("doc_id", "content_hash"), s).select("doc_id", "reused_session")
