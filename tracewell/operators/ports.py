"""Model ports: embeddings, entity and relationship candidates from outside clients, called from Arrow batches.

A client is made once a worker and called with one row at a time, by a bounded number of threads, spaced so that a worker
makes at most so many calls a second. A failure that may pass is tried again after a growing pause; any other, and what is
still failing after the last attempt, is told in the row's `call`, so one bad text costs no other row its result. The
rows go on with all their columns, so nothing depends on the order in which calls end or partitions come.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .telemetry import TRANSIENT

CALL = "struct<outcome: string, code: string, message: string, attempts: int, seconds: double>"
ENTITIES = "array<struct<entity_type: string, quote: string, char_start: int, char_end: int, aliases: array<string>>>"
RELATIONSHIPS = "array<struct<subject_type: string, subject: string, predicate: string, object_type: string, object: string, quote: string, char_start: int, char_end: int>>"


class PortError(Exception):
    """A client's failure by its code; codes that L-04 knows may pass."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code

    @property
    def transient(self) -> bool:
        return self.code in TRANSIENT


@dataclass(frozen=True)
class Policy:
    """How a worker calls: threads, attempts, the first pause and its ceiling in seconds (doubled each time), and calls a second (0: unbounded)."""

    in_flight: int = 4
    attempts: int = 3
    pause: float = 0.2
    longest: float = 5.0
    per_second: float = 0.0

    def __post_init__(self) -> None:
        if self.in_flight < 1 or self.attempts < 1 or min(self.pause, self.longest, self.per_second) < 0:
            raise ValueError("a policy needs at least one thread and one attempt, and no negative times")


class _Pace:
    """Start times that lie at least 1 / per_second apart, over all threads of a worker."""

    def __init__(self, per_second: float) -> None:
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = max(time.monotonic(), self.next)
                self.next = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


_clients: dict[tuple, tuple[Any, _Pace]] = {}
_making = threading.Lock()


def _client(make: Callable[[], Callable], policy: Policy) -> tuple[Any, _Pace]:
    """The worker's one client of a maker (equal makers are one, where they can be compared)."""
    key = (make, policy.per_second)
    with _making:
        if key not in _clients:
            _clients[key] = make(), _Pace(policy.per_second)
        return _clients[key]


def _one(client: Callable, pace: _Pace, policy: Policy, check: Callable[[Any], None], row: dict) -> tuple[Any, dict]:
    began = time.perf_counter()
    for attempt in range(1, policy.attempts + 1):
        pace.wait()
        try:
            value = client(row)
            check(value)
            return value, {"outcome": "ok", "code": None, "message": None, "attempts": attempt, "seconds": time.perf_counter() - began}
        except Exception as e:  # noqa: BLE001 - whatever a client raises is its row's failure
            code = e.code if isinstance(e, PortError) else "timeout" if isinstance(e, TimeoutError) else "connection_reset" if isinstance(e, ConnectionError) else type(e).__name__
            transient = code in TRANSIENT
            if not transient or attempt == policy.attempts:
                return None, {"outcome": "exhausted" if transient else "permanent", "code": code, "message": str(e)[:1000], "attempts": attempt, "seconds": time.perf_counter() - began}
            time.sleep(min(policy.longest, policy.pause * 2 ** (attempt - 1)))
    raise AssertionError("unreachable")


def called(rows: DataFrame, make: Callable[[], Callable[[dict], Any]], columns: list[str], out: str, kind: str, check: Callable[[Any], None] = lambda _: None, policy: Policy = Policy(), skip: str | None = None) -> DataFrame:  # noqa: B008
    """`rows` with a column `out` of type `kind`, what the client made of `columns`, and `call`, how that went.

    make: a picklable function, called once a worker, that gives the client: a function of a row's dict. check raises where
    a value is not to be taken. Rows whose column `skip` is null are not called: outcome `skipped`. Memory is bounded by an
    Arrow batch: its calls end before the next one is read. A task that is run again calls again.
    """
    schema = StructType([*rows.schema.fields, StructField(out, _parse_datatype_string(kind)), StructField("call", _parse_datatype_string(CALL))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        client, pace = _client(make, policy)
        skipped = None, {"outcome": "skipped", "code": None, "message": None, "attempts": 0, "seconds": 0.0}
        with ThreadPoolExecutor(policy.in_flight) as pool:
            for batch in batches:
                asked = batch.select(columns).to_pylist()
                done = list(pool.map(lambda row: skipped if skip and row[skip] is None else _one(client, pace, policy, check, row), asked))
                extra = [pa.array([d[i] for d in done], types.field(len(batch.schema) + i).type) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return rows.mapInArrow(each, schema)


class _Width:
    """A vector of this width, of finite numbers."""

    def __init__(self, width: int) -> None:
        self.width = width

    def __call__(self, vector: Any) -> None:
        if len(vector) != self.width:
            raise PortError("wrong_width", f"embedding has {len(vector)} dimensions, configured {self.width}")
        if not all(math.isfinite(x) for x in vector):
            raise PortError("not_finite", "embedding holds a number that is not finite")


def embedded(chunks: DataFrame, make: Callable[[], Callable[[dict], list[float]]], width: int, policy: Policy = Policy(), text: str = "text") -> DataFrame:  # noqa: B008
    """The embedder port: chunks with `embedding` and `call`. A vector of another width, or that isn't finite, is a permanent failure; null texts are skipped."""
    return called(chunks, make, [text], "embedding", "array<float>", _Width(width), policy, skip=text)


def entity_candidates(chunks: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The entity extractor port: (candidates as graph.entity_outcomes takes them, chunks with their `call`), of chunks (chunk_id, text).

    A candidate's seq is its place in the client's answer; its text is evidence, never an instruction.
    """
    got = called(chunks, make, ["chunk_id", "text"], "found", ENTITIES, policy=policy, skip="text")
    each = got.select("chunk_id", F.col("text").alias("chunk"), F.posexplode("found").alias("seq", "c"))
    return each.select("chunk_id", "seq", "chunk", "c.*"), got.drop("found")


def relationship_candidates(chunks: DataFrame, known: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The relationship extractor port: (candidates as graph.relationship_outcomes takes them, chunks with their `call`).

    known: chunk_id, entity_type, label, aliases of the entities that the client may name, which is told them in their
    order; a chunk without any is not called. A chunk's entities are no more than its text has room for.
    """
    told = known.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("entity_type", F.col("label").alias("text"), "aliases"))).alias("known"))
    got = called(chunks.join(told, "chunk_id", "left"), make, ["chunk_id", "text", "known"], "found", RELATIONSHIPS, policy=policy, skip="known")
    each = got.select("chunk_id", F.col("text").alias("chunk"), F.posexplode("found").alias("seq", "c"))
    return each.select("chunk_id", "seq", "chunk", "c.*"), got.drop("found", "known")


def call_totals(rows: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """§2.Q: the same rows, and what was counted while they passed: calls, attempts, retried, failed by class, seconds. No job of its own."""
    o = Observation(name) if name else Observation()
    n = lambda c: F.count(F.when(c, 1))
    outcome, attempts = F.col("call.outcome"), F.col("call.attempts")
    measures = [n(outcome != "skipped").alias("calls"), F.sum(attempts).alias("attempts"), n(attempts > 1).alias("retried"), n(outcome == "permanent").alias("permanent"), n(outcome == "exhausted").alias("exhausted"), F.sum("call.seconds").alias("seconds")]
    return rows.observe(o, *measures), o
