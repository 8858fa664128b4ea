"""Model ports: order, width, classes of failures, bounded calls, one client a worker, and what is counted on the way."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ports
from tracewell.plans.port_queries import QUICK, StubEmbedder


class Lengths:
    """A vector that tells the text; sleeps so that later calls end first."""

    def __call__(self, row):
        n = int(row["text"])
        time.sleep(0.002 * (5 - n % 5))
        return [float(n)] * 3


class Failing:
    def __call__(self, row):
        if row["text"] == "timeout":
            raise TimeoutError("too late")
        if row["text"] == "denied":
            raise ports.PortError("access_denied")
        if row["text"] == "bug":
            raise KeyError("x")
        if row["text"] == "nan":
            return [1.0, float("nan"), 1.0]
        return [0.0] * (4 if row["text"] == "wide" else 3)


class Peak:
    """How many calls run at once, told as a vector."""

    lock, now, peak = threading.Lock(), 0, 0

    def __call__(self, row):
        with Peak.lock:
            Peak.now += 1
            Peak.peak = max(Peak.peak, Peak.now)
        time.sleep(0.02)
        with Peak.lock:
            Peak.now -= 1
            return [float(Peak.peak)]


class Made:
    made = 0

    def __init__(self):
        Made.made += 1
        self.number = Made.made

    def __call__(self, row):
        return [float(self.number)]


def test_each_row_gets_its_own_vector_under_shuffles(spark):
    rows = spark.range(300).select("id", F.col("id").cast("string").alias("text")).repartition(7)
    got = ports.embedded(rows, Lengths, 3, QUICK).repartition(3).collect()
    assert len(got) == 300 and all(list(r.embedding) == [float(r.id)] * 3 and r.call.outcome == "ok" and r.call.attempts == 1 for r in got)


def test_failures_by_class(spark):
    rows = spark.createDataFrame([(x,) for x in ("fine", "timeout", "denied", "bug", "wide", "nan", None)], "text string")
    got = {r.text: r for r in ports.embedded(rows, Failing, 3, QUICK).collect()}
    told = {k: (r.call.outcome, r.call.code, r.call.attempts, r.embedding is None) for k, r in got.items()}
    assert told == {"fine": ("ok", None, 1, False), "timeout": ("exhausted", "timeout", 3, True), "denied": ("permanent", "access_denied", 1, True), "bug": ("permanent", "KeyError", 1, True), "wide": ("permanent", "wrong_width", 1, True), "nan": ("permanent", "not_finite", 1, True), None: ("skipped", None, 0, True)}
    assert got["wide"].call.message == "embedding has 4 dimensions, configured 3"


def test_calls_are_bounded_and_paced(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("text")).coalesce(1)
    peak = lambda n: max(r.embedding[0] for r in ports.embedded(rows, Peak, 1, ports.Policy(in_flight=n)).collect())
    assert peak(2) <= 2
    began = time.time()
    assert ports.embedded(rows.limit(11), Made, 1, ports.Policy(in_flight=4, per_second=10)).count() == 11 and time.time() - began >= 1.0
    for bad in ({"in_flight": 0}, {"attempts": 0}, {"pause": -1.0}):
        with pytest.raises(ValueError):
            ports.Policy(**bad)


def test_one_client_a_worker(spark):
    rows = spark.range(0, 30_000, 1, 1).select(F.col("id").cast("string").alias("text"))
    assert ports.embedded(rows, Made, 1).select(F.get("embedding", F.lit(0)).alias("n")).distinct().count() == 1


def test_counted_on_the_way(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("embedding_of"))
    rows, seen = ports.call_totals(ports.embedded(docs, StubEmbedder, 8, QUICK))
    out = rows.collect()
    got, calls = seen.get, [r.call for r in out]
    want = {"calls": sum(c.outcome != "skipped" for c in calls), "attempts": sum(c.attempts for c in calls), "retried": sum(c.attempts > 1 for c in calls), "permanent": sum(c.outcome == "permanent" for c in calls), "exhausted": 0}
    assert {k: got[k] for k in want} == want and want["retried"] > 0 and want["permanent"] > 0 and got["seconds"] == pytest.approx(sum(c.seconds for c in calls))


def test_empty(spark):
    none = spark.createDataFrame([], "chunk_id string, text string")
    known = spark.createDataFrame([], "chunk_id string, entity_type string, label string, aliases array<string>")
    assert ports.embedded(none, Lengths, 3).count() == 0 and ports.entity_candidates(none, Lengths)[0].count() == 0 and ports.relationship_candidates(none, known, Lengths)[0].count() == 0
