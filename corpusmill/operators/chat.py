"""Chat sessions: inactivity sessions, rate limits, bounded histories, upload and question checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.prompts import history_line
from corpusmill.operators.ordered import BLOCK, by_weight, greedy_starts, sorted_blocks

# Limits of the service and its answers to uploads.
SESSION_TIMEOUT = 3600
MAX_UPLOAD = 20 * 1024 * 1024
MAX_NAME, MAX_QUESTION = 255, 1000
STORED, SHOWN = 200, 20


def inactivity_sessions(events: DataFrame, user_col: str, ts_col: str, timeout: int = SESSION_TIMEOUT) -> DataFrame:
    """user, session_start, last_used, events. A gap of more than ``timeout`` seconds ends a session; one of just that doesn't."""
    w = F.session_window(F.col(ts_col), f"{timeout} seconds")
    found = events.where(F.col(user_col).isNotNull()).groupBy(F.col(user_col).alias("user"), w).agg(F.min(ts_col).alias("session_start"), F.max(ts_col).alias("last_used"), F.count("*").alias("events"))
    return found.drop("session_window")


def sessions_by_gap(events: DataFrame, user_col: str, ts_col: str, timeout: int = SESSION_TIMEOUT) -> DataFrame:
    """As inactivity_sessions(), with the events' session numbers: user, ts, session (from 1)."""
    by_user = Window.partitionBy(user_col).orderBy(ts_col)
    gap = F.unix_micros(F.col(ts_col).cast("timestamp")) - F.unix_micros(F.lag(ts_col).over(by_user).cast("timestamp"))
    starts = F.when(gap.isNull() | (gap > timeout * 1_000_000), 1).otherwise(0)
    running = by_user.rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("starts", starts).select(F.col(user_col).alias("user"), F.col(ts_col).alias("ts"), F.sum("starts").over(running).alias("session"))


def active_sessions(events: DataFrame, user_col: str, ts_col: str, now: Column | None, timeout: int = SESSION_TIMEOUT) -> DataFrame:
    """One row: users, and those last seen at most ``timeout`` seconds before ``now`` (None: the last event of all)."""
    last = events.groupBy(user_col).agg(F.max(ts_col).alias("last"))
    if now is None:
        last = last.join(F.broadcast(last.agg(F.max("last").alias("now"))))  # one row
        now = F.col("now")
    return last.agg(F.count("*").alias("users"), F.count_if(F.col("last") >= now - F.expr(f"INTERVAL {timeout} SECONDS")).alias("active"))


def remaining_seconds(start: Column, now: Column, timeout: int = SESSION_TIMEOUT) -> Column:
    """Seconds left of a session that began (or was last used) at epoch second ``start``, 0 at least."""
    return F.greatest(F.lit(0), timeout - (now - start))


def remaining_text(start: Column, now: Column, timeout: int = SESSION_TIMEOUT) -> Column:
    s = F.floor(remaining_seconds(start, now, timeout)).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def limit_step(last: float | None, at: float, wait: float) -> tuple[float, bool]:
    """The last accepted time after a request, and whether it passes."""
    ok = last is None or at - last >= wait
    return (at if ok else last), ok


def accepted(seconds: list[float], limit: float) -> list[bool]:
    """Which of a user's requests pass: those at least ``limit`` after the last one that passed."""
    out, last = [], None
    for s in seconds:
        last, ok = limit_step(last, s, limit)
        out.append(ok)
    return out


def rate_limited(events: DataFrame, user_col: str, ts_col: str, id_col: str, limit: float = 2.0, most: int = BLOCK) -> DataFrame:
    """user, id, ts, accepted. Only accepted requests move the clock, so what passes depends on all of a user's events before.

    Users with up to ``most`` events are read by one task each, sorted, a batch at a time; all others
    by many (see ordered.greedy_starts). A null user is a user of its own; an event without a time passes.
    """
    wait = round(limit * 1_000_000)
    rows = events.select(F.col(user_col).alias("user"), F.col(id_col).alias("id"), F.col(ts_col).alias("ts"))
    rows = rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))

    def many(heavy: DataFrame) -> DataFrame:
        blocks = sorted_blocks(heavy.withColumn("next", F.col("at") + wait), ["user", "ts", "id"], most)
        return greedy_starts(blocks, "user", "at", "next", "accepted").select("user", "id", "ts", "accepted")

    return by_weight(rows, "user", lambda light: _limited(light, wait), many, most)


def _limited(rows: DataFrame, wait: int) -> DataFrame:
    rows = rows.repartition("user").sortWithinPartitions("user", "ts", "id").select("user", "id", "ts", "at")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("user", "id", "ts")) + ", accepted boolean"

    def run(batches):
        before, last = None, None
        for batch in batches:
            out = []
            users = batch.column(0).to_pylist()
            for user, at in zip(users, batch.column(3).to_pylist()):
                if user != before:
                    before, last = user, None
                ok = last is None or (at is not None and at - last >= wait)
                out.append(ok)
                last = at if ok else last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.bool_())], names=["user", "id", "ts", "accepted"])

    return rows.mapInArrow(run, schema)


def session_step(state: tuple | None, at: int, wait: int) -> tuple[tuple, tuple | None]:
    """(first, last, events) of the session after an event, and of the one that it ends."""
    if state is None or at - state[1] > wait:
        return (at, at, 1), state
    return (state[0], at, state[2] + 1), None


WAITING_DOCUMENT, WAITING_QUESTION = 0, 1


def next_state(state: int, kind: str, text: str | None) -> tuple[int, str]:
    """The dialogue's next state and what is done, for a message of a kind: start, document, question or other."""
    if kind == "start":
        return WAITING_DOCUMENT, "greet"
    if kind == "document":
        return WAITING_QUESTION, "upload"
    if kind == "question":
        if state == WAITING_DOCUMENT:
            return state, "ask_for_document"
        said = (text or "").strip()
        return state, "refuse" if not said or len(text or "") > MAX_QUESTION else "answer"
    return state, "unsupported"


#: What dialogues tell of each message, besides its user.
DIALOGUE = "seq long, action string, state int, history_size int, history array<string>"


def dialogue_step(state: tuple | None, at: int, kind: str, text: str | None, wait: int, keep: int) -> tuple[tuple, tuple]:
    """(state, history, time) after a message, and (action, state, history_size, history). A state idle for over ``wait`` begins anew."""
    now, history = (state[0], list(state[1])) if state is not None and at - state[2] <= wait else (WAITING_DOCUMENT, [])
    now, action = next_state(now, kind, text)
    if action in ("greet", "upload"):
        history = []
    elif action == "answer":
        history = [*history, f"user: {text}", "assistant: "][-keep:]
    return (now, history, at), (action, now, len(history), list(history))


def message_time(messages: DataFrame, ts_col: str) -> Column:
    """The time of messages; without such a column seq counts as seconds."""
    return F.col(ts_col).cast("timestamp") if ts_col in messages.columns else F.timestamp_seconds("seq")


def dialogues(messages: DataFrame, timeout: int = SESSION_TIMEOUT, keep: int = STORED, ts_col: str = "ts") -> DataFrame:
    """user, seq, action, state, history_size, history for messages (user, seq, kind, text, and a time): the two-state dialogue with its bounded history.

    The history holds the last ``keep`` entries since the last document: each answered question and a
    place for its answer, which a generator fills. ``timeout`` seconds after a message the state has gone;
    a later one begins anew. A user's messages are read in order of time and seq, a batch at a time, by
    one task; rows without user, time or seq are left out.
    """
    rows = messages.select("user", F.unix_micros(message_time(messages, ts_col)).alias("at"), F.col("seq").cast("long").alias("seq"), "kind", "text").where("user is not null and at is not null and seq is not null")
    rows = rows.repartition("user").sortWithinPartitions("user", "at", "seq")
    schema = f"user {rows.schema['user'].dataType.simpleString()}, {DIALOGUE}"

    def run(batches):
        before, state = None, None
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                out = []
                for user, at, kind, text in zip(*(part.column(c).to_pylist() for c in (0, 1, 3, 4))):
                    state = state if user == before else None
                    before = user
                    state, told = dialogue_step(state, at, kind, text, timeout * 1_000_000, keep)
                    out.append(told)
                action, now, size, history = zip(*out)
                columns = [part.column(0), part.column(2), pa.array(action), pa.array(now, pa.int32()), pa.array(size, pa.int32()), pa.array(history, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["user", "seq", "action", "state", "history_size", "history"])

    return rows.mapInArrow(run, schema)


def last_messages(messages: DataFrame, key_col: str, seq_col: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key_col).orderBy(F.col(seq_col).desc())
    return messages.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def history_text(messages: DataFrame, key_col: str, seq_col: str, epoch: Column, n: int = SHOWN) -> DataFrame:
    """key, history: the last n messages, oldest first, a blank line between."""
    rows = last_messages(messages.select(F.col(key_col).alias("key"), F.col(seq_col).alias("seq"), history_line(F.col("role"), F.col("text"), epoch).alias("line")), "key", "seq", n)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"])
    return rows.groupBy("key").agg(F.array_join(lines, "\n\n").alias("history"))


def upload_status(name: Column, size: Column, is_pdf: Column, is_docx: Column) -> Column:
    """The service's status for an upload: 200, 413 too large, 400 empty or of another kind, 422 not what its name says."""
    low = F.lower(name)
    kind = F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx")
    return (
        F.when(name.isNull() | kind.isNull(), 400)
        .when(size > MAX_UPLOAD, 413)
        .when(size.isNull() | (size == 0), 400)
        .when((kind == "pdf") & ~is_pdf, 422)
        .when((kind == "docx") & ~is_docx, 422)
        .otherwise(200)
    )


def upload_refusal(name: Column, size: Column, mime: Column, is_pdf: Column, is_docx: Column) -> Column:
    """Why a bot refuses a file: name, extension, type, size or content; null if it doesn't."""
    low = F.lower(F.coalesce(name, F.lit("")))
    pdf, docx = low.endswith(".pdf"), low.endswith(".docx")
    types = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    return (
        F.when(F.length(low) > MAX_NAME, "name")
        .when(~pdf & ~docx, "extension")
        .when(mime.isNotNull() & ~mime.isin(*types), "type")
        .when(size > MAX_UPLOAD, "size")
        .when((pdf & ~is_pdf) | (docx & ~is_docx), "content")
    )


def question_refusal(question: Column) -> Column:
    """Why a question is refused: empty or long; null if it isn't."""
    n = F.length(F.trim(F.coalesce(question, F.lit(""))))
    return F.when(n == 0, "empty").when(F.length(question) > MAX_QUESTION, "long")


def reused_collections(uploads: DataFrame, sessions: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Uploads with the session that already holds the same content (the latest used one), or null."""
    held = sessions.groupBy(hash_col).agg(F.max_by("session_id", F.struct("last_used", "session_id")).alias("reused_session"))
    return uploads.join(held, hash_col, "left")
