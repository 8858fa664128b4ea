"""Structured Streaming over communications and threads. Batch stays the source of truth."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PHASES = {"search_evidence": "searching", "query_records": "querying", "find_connections": "connecting", "compose": "writing", "verify": "checking"}


def tumbling_counts(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """N-08: events by key and window; what is later than the watermark is left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """N-08: sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def stream_reconciliation(messages: DataFrame, cdr: DataFrame, tolerance_s: int = 90, late: str = "10 minutes") -> DataFrame:
    """N-08, J-12: pairs of two streams with the same ends and near times; the watermarks bound what is kept."""
    m = messages.select("msg_id", "sender", "receiver", F.col("ts").alias("m_ts")).withWatermark("m_ts", late)
    c = cdr.select("cdr_id", F.col("sender").alias("c_sender"), F.col("receiver").alias("c_receiver"), F.col("ts").alias("c_ts")).withWatermark("c_ts", late)
    near = F.expr(f"sender = c_sender and receiver = c_receiver and c_ts >= m_ts - interval {tolerance_s} seconds and c_ts <= m_ts + interval {tolerance_s} seconds")
    return m.join(c, near).select("msg_id", "cdr_id", "m_ts", "c_ts")


def stream_outcomes(messages: DataFrame, cdr: DataFrame, tolerance_s: int = 90, late: str = "10 minutes") -> DataFrame:
    """N-08, J-12, T-06: what `rules.reconciliation` gives, from two streams: msg_id, m_ts, candidates, outcome of each message.

    A left outer join within the tolerance, then one group a message. A message comes out once the watermarks say that no
    candidate can come any more, so its outcome never changes: one candidate is the same event, more decide nothing, none
    leaves it unmatched. What comes later than the watermark is left out, and so are messages without a time.
    """
    m = messages.select("msg_id", "sender", "receiver", "imei", "subscriber", F.col("ts").alias("m_ts")).withWatermark("m_ts", late)
    c = cdr.select("cdr_id", F.col("sender").alias("c_sender"), F.col("receiver").alias("c_receiver"), F.col("imei").alias("c_imei"), F.col("subscriber").alias("c_subscriber"), F.col("ts").alias("c_ts")).withWatermark("c_ts", late)
    near = F.expr(f"""sender = c_sender and receiver = c_receiver and (coalesce(imei = c_imei, false) or coalesce(subscriber = c_subscriber, false))
        and c_ts >= m_ts - interval {tolerance_s} seconds and c_ts <= m_ts + interval {tolerance_s} seconds""")
    found = m.join(c, near, "left_outer").groupBy("msg_id", "m_ts").agg(F.array_sort(F.collect_set("cdr_id")).alias("candidates"))
    n = F.size("candidates")
    return found.withColumn("outcome", F.when(n == 0, "unmatched").when(n == 1, "same_event").otherwise("abstain"))


def deduplicated(requests: DataFrame, time: str, late: str) -> DataFrame:
    """N-05: each request once, for as long as the watermark remembers."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(["thread_id", "request_id"])


def thread_totals(usage: DataFrame) -> DataFrame:
    """N-06, A-11: running totals of each thread, kept as state; usage: thread_id, tokens, calls."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, calls = state.get if state.exists else (0, 0)
        for b in batches:
            tokens, calls = tokens + int(b["tokens"].sum()), calls + int(b["calls"].sum())
        state.update((tokens, calls))
        yield pd.DataFrame({"thread_id": [key[0]], "tokens": [tokens], "calls": [calls]})

    return usage.groupBy("thread_id").applyInPandasWithState(add, "thread_id string, tokens long, calls long", "tokens long, calls long", "update", GroupStateTimeout.NoTimeout)


class TokenBucket:
    """N-03: rate and capacity per minute's requests; the clock is given, so that time can be tested."""

    def __init__(self, per_minute: float, now: float = 0.0) -> None:
        self.rate, self.capacity = per_minute / 60, max(1.0, per_minute / 10)
        self.level, self.at = self.capacity, now

    def delay(self, now: float) -> float:
        """Seconds until a request may go; 0 takes a token."""
        self.level, self.at = min(self.capacity, self.level + (now - self.at) * self.rate), now
        if self.level >= 1:
            self.level -= 1
            return 0.0
        return (1 - self.level) / self.rate


class InFlight:
    """N-04: at most so many calls at a time by the driver's threads; `taken` tells how many are under way."""

    def __init__(self, most: int) -> None:
        if most < 1:
            raise ValueError("at least one call must be allowed")
        self._free, self._guard, self.taken = threading.BoundedSemaphore(most), threading.Lock(), 0

    def try_enter(self) -> bool:
        entered = self._free.acquire(blocking=False)
        with self._guard:
            self.taken += entered
        return entered

    def leave(self) -> None:
        with self._guard:
            self.taken -= 1
        self._free.release()


def bounded_calls(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, in_flight: int) -> DataFrame:
    """N-04 for calls from tasks: each partition has one call under way, so there are as many partitions as calls may be."""
    return rows.repartition(in_flight).mapInPandas(lambda batches: map(call, batches), schema)


def lifecycle(turns: DataFrame, size: int = 512) -> DataFrame:
    """N-01, N-02: a turn's (turn_id, answer, status) events in order: started, the answer's slices, one terminal."""
    from ..functions.text import sliced

    parts = F.transform(sliced(F.coalesce("answer", F.lit("")), size), lambda d: F.struct(F.lit("delta").alias("event"), d.alias("data")))
    first = F.array(F.struct(F.lit("started").alias("event"), F.lit("").alias("data")))
    last = F.array(F.struct(F.when(F.col("status") == "completed", "completed").otherwise("failed").alias("event"), F.lit("").alias("data")))
    every = F.concat(first, F.when(F.col("status") == "completed", parts).otherwise(F.array().cast("array<struct<event:string,data:string>>")), last)
    return turns.select("turn_id", F.posexplode(every).alias("position", "e")).select("turn_id", "position", "e.event", "e.data")


def terminal_events(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """N-09: completed only where exactly one committed assistant message matches; a replayed failure is never retryable."""
    m = messages.filter("role = 'assistant' and status = 'completed'").groupBy("turn_id", "request_id").agg(F.count(F.lit(1)).alias("_n"))
    j = turns.join(m, ["turn_id", "request_id"], "left")
    event = F.when(F.col("outcome") == "failed", "failed").when(F.col("_n") == 1, "completed").otherwise("persistence_failed")
    return j.withColumn("event", event).withColumn("retryable", F.col("event").isin("persistence_failed") | ((F.col("event") == "failed") & ~F.col("replayed"))).drop("_n")


def progress(events: DataFrame) -> DataFrame:
    """N-10: known nodes by their phase; others are dropped."""
    phase = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    return events.withColumn("phase", F.try_element_at(phase, F.col("node"))).filter("phase is not null")


def sse_frames(text: Column) -> Column:
    """N-11: (event, data) of each whole frame of an event stream; comments are passed over, a frame cut off at the end is left out."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)^:.*\n?", "")
    whole = F.filter(F.split(lines, "\n\n"), lambda f: F.trim(f) != "")
    whole = F.when(lines.endswith("\n\n"), whole).otherwise(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))))
    field = lambda f, name: F.regexp_extract_all(f, F.lit(rf"(?m)^{name}: ?(.*)$"), F.lit(1))
    return F.transform(whole, lambda f: F.struct(F.coalesce(F.try_element_at(field(f, "event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(field(f, "data"), "\n").alias("data")))


def reassembled(deltas: DataFrame) -> DataFrame:
    """N-12: a turn's answer where its slices are numbered from 0 without a gap; else null."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("position", "data"))), lambda x: x["data"])
    g = deltas.groupBy("turn_id").agg(F.array_join(whole, "").alias("_a"), F.count(F.lit(1)).alias("n"), F.min("position").alias("_lo"), F.max("position").alias("_hi"), F.count_distinct("position").alias("_d"))
    return g.select("turn_id", "n", F.when((F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1) & (F.col("_d") == F.col("n")), F.col("_a")).alias("answer"))


def without_thread(tables: dict[str, DataFrame], thread: str, busy: bool) -> dict[str, DataFrame]:
    """N-14: every table without a thread's rows; a busy thread stays, an unknown one is an error."""
    if busy:
        raise RuntimeError("thread is busy")
    if all(t.filter(F.col("thread_id") == thread).isEmpty() for t in tables.values()):
        raise KeyError(thread)
    return {n: t.filter(F.col("thread_id") != thread) for n, t in tables.items()}
