"""Token ids as files: frequency-ranked ids in whole bytes, their lengths apart in control bytes.

A file holds blocks, and a block stands for itself (all numbers little-endian):

    magic "TWID"  version u16  zero u16
    part u32  block u32  documents u32  ids u64  different ids u32  bytes of ranks u64  crc32 u32 of what follows
    doc_id i64 for each document (the smallest i64 for null), ids of each document u32
    the block's different ids u32, the most frequent first (ties: the smaller id)
    control bytes: two bits an id, its number of bytes less one, the first id in the lowest bits
    the ids' ranks, each in as many bytes

and a line feed ends it, as Spark's own writer of byte strings puts one there. Blocks follow one another by (part, block).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, runs_of_rows, shared_dir, table
from .units import Side, byte_level, public_file

MAGIC, NULL_ID = b"TWID", -(1 << 63)
_HEAD = struct.Struct("<4sHHIIIQIQI")
#: Ids in a block (a longer document is a block of its own), and blocks in a file.
BLOCK_IDS, FILE_BLOCKS = 1 << 20, 8
#: Lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2^32."""
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.append(size - 1, np.zeros(-len(size) % 4, np.int64)).reshape(-1, 4)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return (codes << np.arange(0, 8, 2)).sum(axis=1).astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpacked(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first n ranks: lengths by the table of control bytes, then each weight's bytes at once."""
    size = LENGTHS[control].ravel()[:n]
    first = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for w in range(4):
        has = size > w
        out[has] |= data[first[has] + w].astype(np.uint32) << np.uint32(8 * w)
    return out


def image(part: int, block: int, doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """A block of documents' ids, without the line feed."""
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    times = np.bincount(flat)  # ids are below the vocabulary's size
    known = np.flatnonzero(times)
    order = np.argsort(-times[known], kind="stable")
    rank = np.zeros(len(times), np.int64)
    rank[known[order]] = np.arange(len(order))
    control, data = packed(rank[flat])
    ids = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    body = b"".join([ids.tobytes(), np.array([len(d) for d in docs], "<u4").tobytes(), known[order].astype("<u4").tobytes(), control, data])
    return _HEAD.pack(MAGIC, 1, 0, part, block, len(docs), len(flat), len(known), len(data), zlib.crc32(body)) + body


def images(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, block, doc ids, ids of each document, all ids) of a file's blocks; a damaged one is an error."""
    at = 0
    while at < len(content):
        magic, version, _, part, block, docs, n, known, size, crc = _HEAD.unpack_from(content, at)
        at += _HEAD.size
        end = at + 12 * docs + 4 * known + (n + 3) // 4 + size
        if magic != MAGIC or version != 1 or end >= len(content) or content[end] != 10 or zlib.crc32(memoryview(content)[at:end]) != crc:
            raise ValueError("no whole block of token ids")
        ids, counts, values = np.frombuffer(content, "<i8", docs, at), np.frombuffer(content, "<u4", docs, at + 8 * docs), np.frombuffer(content, "<u4", known, at + 12 * docs)
        at += 12 * docs + 4 * known
        ranks = unpacked(np.frombuffer(content, np.uint8, (n + 3) // 4, at), np.frombuffer(content, np.uint8, size, at + (n + 3) // 4), n)
        yield part, block, ids, counts, values[ranks]
        at = end + 1


class Encoder:
    """Ids of whole texts; strings of special tokens are those tokens."""

    def __init__(self, side: Side) -> None:
        self.side = side
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(side.special, key=len, reverse=True))) + ")") if side.special else None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [self.specials.split(t or "") if self.specials else [t or ""] for t in texts]
        found = iter(self.side.encode([p for text in parts for p in text[::2]]))
        out = []
        for text in parts:
            ids = np.concatenate([np.array([self.side.special[p]] if k % 2 else next(found), np.int64) for k, p in enumerate(text)])
            out.append(ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(byte_level(path, plain=False))
    return _encoders[path]


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode each row's text (doc_id, text) and write the ids, with end_id behind each, in ascending order of doc_id.

    Nulls count as empty; a null doc_id comes before all others, rows that share one lie by their text's hash. Rows are
    dealt to as many ranges as spark.sql.shuffle.partitions says, sorted, encoded and packed in one stage; rows that
    share an id are dealt by hash and place too, so no id fills a range of its own. A part's blocks are written by Spark's writer of
    byte strings, so the files lie on any file system of Spark's and only whole files of finished tasks are seen.
    """
    vocabulary = vocabulary or public_file("byte_bpe_50k.json")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(vocabulary), TaskContext.get().partitionId()
        n, size, ids, held = 0, 0, [], []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([image(part, n, ids, held)], pa.binary())], ["image"])

        for batch in batches:
            for x, y in runs_of_rows(batch.column(1)):
                for doc_id, got in zip(batch.column(0).slice(x, y - x).to_pylist(), e.encode(batch.column(1).slice(x, y - x).to_pylist()), strict=True):
                    if held and size + len(got) >= block_ids:
                        yield full()
                        n, size, ids, held = n + 1, 0, [], []
                    ids.append(doc_id), held.append(np.append(got, end_id))
                    size += len(got) + 1
        if held:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_hash"), F.asc("_row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = dealt.mapInArrow(pack, "image binary")
    # As a string only in name: the writer puts the bytes as they are.
    blocks.select(F.col("image").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(part, block, doc, doc_id, before, n_tokens, ids_crc32 and with keep_ids the ids) from the files; before counts the block's ids before the document's."""
    schema = "part long, block long, doc long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, block, doc_ids, counts, ids in images(content.as_py()):
                    ends, n = np.cumsum(counts.astype(np.int64)), len(doc_ids)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array(np.full(n, part)), pa.array(np.full(n, block)), pa.array(np.arange(n)), pa.array(doc_ids.astype(np.int64), mask=doc_ids == NULL_ID), pa.array(ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                    names = ["part", "block", "doc", "doc_id", "before", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, schema)


def placed(read: DataFrame) -> DataFrame:
    """The rows of `read_ids` with start, the number of ids of all documents before each.

    A block's start is summed within its part, a part's over the parts: one row each, as many as there were tasks.
    """
    blocks = read.groupBy("part", "block").agg(F.sum("n_tokens").alias("_n"))
    parts = blocks.groupBy("part").agg(F.sum("_n").alias("_part_n"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_part_n").over(up_to(Window.orderBy("part"))), F.lit(0)).alias("_part_start"))
    blocks = blocks.select("part", "block", F.coalesce(F.sum("_n").over(up_to(Window.partitionBy("part").orderBy("block"))), F.lit(0)).alias("_block_start"))
    starts = blocks.join(parts, "part").select("part", "block", (F.col("_part_start") + F.col("_block_start")).alias("_start"))
    return read.join(starts, ["part", "block"]).withColumn("start", F.col("_start") + F.col("before")).drop("_start", "before")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of `docs`, from files written to the shared folder and read back.

    Nulls, ties and repeated rows as in `write_ids`; an empty table gives an empty result, other columns are left out.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_ids(docs, path, vocabulary, end_id, block_ids)
    return placed(cut(read_ids(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_binary_ids(spark, sf_dir: str) -> DataFrame:
    """Every document with the public byte-level vocabulary and end id 2."""
    return round_trip(table(spark, sf_dir, "documents"))
