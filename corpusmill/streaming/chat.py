"""Chat state in Structured Streaming: inactivity sessions, rate limits, bounded histories and the dialogue's states.

What depends on the order of a user's events waits in state until the watermark has passed it, and is then
taken in the order of event time; timers of event time also take idle state away. So the results are
those of the batch operators, however the events are split into micro-batches and whichever order they come in,
as long as none is later than the watermark allows (Spark drops and counts those).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.chat import DIALOGUE, SESSION_TIMEOUT, STORED, dialogue_step, limit_step, message_time, next_state, session_step  # noqa: F401

def session_stream(events: DataFrame, user_col: str = "user_id", ts_col: str = "ts", timeout: int = SESSION_TIMEOUT, lateness: int = SESSION_TIMEOUT) -> DataFrame:
    """user, session_start, last_used, events of each session, once the watermark has passed its end."""
    marked = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, f"{lateness} seconds")
    w = F.session_window(F.col(ts_col), f"{timeout} seconds")
    found = marked.where(F.col(user_col).isNotNull()).groupBy(F.col(user_col), w).agg(F.min(ts_col).alias("session_start"), F.max(ts_col).alias("last_used"), F.count("*").alias("events"))
    return found.select(F.col(user_col).alias("user"), "session_start", "last_used", "events")


def window_counts(events: DataFrame, ts_col: str, size: str, slide: str | None = None, lateness: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Events of each tumbling (or sliding) window and key; later ones than ``lateness`` are dropped."""
    marked = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, lateness)
    w = F.window(F.col(ts_col), size, slide) if slide else F.window(F.col(ts_col), size)
    return marked.groupBy(w, *keys).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "events")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them and takes them in order, each with the key's state.

    step(key, state, row) gives the new state and rows of output; the state is a tuple, None at first.
    When the watermark reaches until(state), in microseconds, without a row, the state goes, and what
    ended(key, state) gives is put out.
    """

    def __init__(self, step: Callable, until: Callable, ended: Callable, row: str, state: str, columns: list[str]):
        self.step, self.until, self.ended = step, until, ended
        self.row, self.state, self.columns = row, state, columns

    def _wake(self, micros: int) -> None:
        """Sets a timer for the first watermark that has reached a time; timers come before the watermark, never at it."""
        self.handle.registerTimer(-(-micros // 1000) - 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.now = handle.getValueState("now", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            came = [tuple(None if pd.isna(x) else x for x in r) for r in pdf[_columns(self.row)].itertuples(index=False, name=None)]
            self.waiting.appendList(came)
            first = min([r[0] for r in came] + ([first] if first is not None else []))
        if first is not None:
            self._wake(first)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: r[:2])
        state, out = self.now.get() if self.now.exists() else None, []
        due = [r for r in waiting if r[0] <= passed]
        for row in due:
            state, more = self.step(key, state, row)
            out += more
        rest = waiting[len(due) :]
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        if state is not None and passed >= self.until(state):
            out += self.ended(key, state)
            state = None
        if state is None:
            self.now.clear()
        else:
            self.now.update(state)
        times = [r[0] for r in rest[:1]] + ([self.until(state)] if state is not None else [])
        if times:
            self._wake(min(times))
        yield pd.DataFrame(out, columns=self.columns)


def _in_order(rows: DataFrame, lateness: int, processor: InOrder, schema: str) -> DataFrame:
    """rows: user, at (microseconds), a column that orders rows of one time, and others."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only one with timers
    # watermarks are whole milliseconds: one that has reached a row's next is past the row
    timed = rows.dropna(subset=[c for c in ("user", "at", "id", "seq") if c in rows.columns]).withColumn("ts", F.timestamp_micros(F.expr("at + pmod(-at, 1000)")))
    marked = timed.withWatermark("ts", f"{lateness} seconds")
    return marked.groupBy("user").transformWithStateInPandas(processor, schema, "append", "eventTime")


def _columns(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(",")]


def _micros(ts: str) -> Any:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def session_sweep_stream(events: DataFrame, user_col: str = "user_id", ts_col: str = "ts", timeout: int = SESSION_TIMEOUT, lateness: int = SESSION_TIMEOUT) -> DataFrame:
    """user, session_start, last_used, events: every event touches its user's session, and a sweep by event time ends those idle for over ``timeout`` seconds.

    As operators.chat.inactivity_sessions; rows without user or time are left out.
    """
    rows = events.select(F.col(user_col).alias("user"), _micros(ts_col).alias("at"))
    wait = timeout * 1_000_000
    row = lambda key, s: (key[0], pd.Timestamp(s[0], unit="us"), pd.Timestamp(s[1], unit="us"), s[2])

    def step(key: Any, state: tuple | None, r: tuple) -> tuple:
        state, done = session_step(state, r[0], wait)
        return state, [row(key, done)] if done else []

    schema = f"user {rows.schema['user'].dataType.simpleString()}, session_start timestamp, last_used timestamp, events long"
    ended = lambda key, s: [row(key, s)]
    return _in_order(rows, lateness, InOrder(step, lambda s: s[1] + wait + 1, ended, "at long", "first long, last long, events long", _columns(schema)), schema)


def rate_limit_stream(events: DataFrame, limit: float, user_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id", lateness: int = 0) -> DataFrame:
    """user, id, ts, accepted, as operators.chat.rate_limited, once the watermark, ``lateness`` seconds behind, has passed a row.

    A user's state is the last accepted time, and goes when the limit has passed since. Rows without
    user, time or id are left out.
    """
    rows = events.select(F.col(user_col).alias("user"), _micros(ts_col).alias("at"), F.col(id_col).alias("id"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    wait = round(limit * 1_000_000)

    def step(key: Any, state: tuple | None, r: tuple) -> tuple:
        last, ok = limit_step(state[0] if state else None, r[0], wait)
        return (last,), [(key[0], r[1], pd.Timestamp(r[0], unit="us"), ok)]

    schema = f"user {kind['user']}, id {kind['id']}, ts timestamp, accepted boolean"
    return _in_order(rows, lateness, InOrder(step, lambda s: s[0] + wait, lambda key, s: [], f"at long, id {kind['id']}", "last long", _columns(schema)), schema)


def dialogue_stream(messages: DataFrame, timeout: int = SESSION_TIMEOUT, keep: int = STORED, ts_col: str = "ts", lateness: int = 0) -> DataFrame:
    """user, seq, action, state, history_size, history for messages (user, seq, kind, text, and a time): as operators.chat.dialogues.

    The state, the history with it, goes by event time, ``timeout`` seconds after the last message.
    Rows without user, time or seq are left out.
    """
    rows = messages.select("user", F.unix_micros(message_time(messages, ts_col)).alias("at"), "seq", "kind", "text")
    wait = timeout * 1_000_000

    def step(key: Any, state: tuple | None, r: tuple) -> tuple:
        state, told = dialogue_step(state, r[0], r[2], r[3], wait, keep)
        return state, [(key[0], r[1], *told)]

    schema = f"user {rows.schema['user'].dataType.simpleString()}, {DIALOGUE}"
    processor = InOrder(step, lambda s: s[2] + wait + 1, lambda key, s: [], "at long, seq long, kind string, text string", "state int, history array<string>, last long", _columns(schema))
    return _in_order(rows, lateness, processor, schema)
