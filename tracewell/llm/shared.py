"""What the training-data operators share: tables, written cuts of lineage, text as numpy arrays, graph components."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds a worker's memory whatever the size of an Arrow batch.
PIECE_BYTES = 1 << 19
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Written(threading.local):
    """Tables that this thread has written by `cut` and not dropped, oldest first: work in other threads has lists of its own."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)


WRITTEN = Written()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode (tests) alone."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or os.path.join(tempfile.gettempdir(), "tracewell-checkpoints")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, keep: int = 0, last: int = 0) -> None:
    """Delete the tables that `cut` wrote in this thread, but for the first `keep` and the `last` of them. Nothing may still read them."""
    gone = WRITTEN.paths[keep : len(WRITTEN) - last]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.paths.remove(path)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of so many rows at most while the jobs run: whole texts are long, and a batch lies more than once in the
    memory of a worker and of its JVM, which keep what they took. What runs later has the session's own length again."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def small(df: DataFrame, limit: int) -> bool:
    """Whether a (written) table has at most so many rows; reads no more than it needs to tell."""
    return df.limit(limit + 1).count() <= limit


def held(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; an id of null has not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows with about `limit` bytes in all; null counts as empty.

    A row is never divided, so a text longer than the limit makes a piece of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs_of_rows(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with about `limit` bytes of text in all; a longer text is a run of its own."""
    for first, _, offsets in text_pieces(column, limit):
        yield first, first + len(offsets) - 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 2 * len(_powers), 256), 0x9E3779B97F4A7C15 | 1, U64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def runs(inside: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of inside bytes, and for each maximal run (within a row, and not across breaks) its first index among them and length."""
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, at
    start = np.empty(len(at), bool)
    start[0] = True
    np.not_equal(np.diff(at), 1, out=start[1:])
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets[:-1]] = True
    start |= edge[:-1][at]
    if breaks is not None:
        start |= breaks[at]
    first = np.flatnonzero(start)
    return at, first, np.diff(np.append(first, len(at)))


def hash_runs(data: np.ndarray, at: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run."""
    if not len(first):
        return np.zeros(0, U64)
    within = np.arange(len(at)) - np.repeat(first, lens)
    terms = (data[at].astype(U64) + U64(1)) * powers(int(lens.max()))[within]
    return mix(np.add.reduceat(terms, first) + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


_weights: dict[int, np.ndarray] = {}


def strong_hashes(data: np.ndarray, at: np.ndarray, first: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each run that no structure of the bytes defeats: every byte counts by a number mixed
    from it, times an odd number mixed from its place, so there is no base whose powers could cancel out."""
    if not len(first):
        return np.zeros(0, U64)
    n = int(lens.max())
    if len(_weights.get(seed, ())) < n:
        _weights[seed] = mix(np.arange(1, 2 * n + 256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)
    signs = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))
    within = np.arange(len(at)) - np.repeat(first, lens)
    return mix(np.add.reduceat(signs[data[at]] * _weights[seed][within], first) + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: the runs of anything but white space, A-Z lower-cased."""
    low = LOWER[data]
    at, first, lens = runs(~SPACE[low], offsets)
    return strong_hashes(low, at, first, lens), np.searchsorted(offsets, at[first], "right") - 1


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(each, schema)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) reaches, by alternating large and small stars.

    Every round is a pair of joins with a pre-aggregated minimum, so a hub's rows meet only in sums and in joins that
    can be split; a written table ends each round's lineage.
    """
    spark, first = edges.sparkSession, len(WRITTEN)
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low, "u")
        small_star = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        now = cut(small_star.filter("u <> v").distinct())
        drop_tables(spark, keep=first, last=1)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
