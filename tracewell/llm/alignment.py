"""Alignment of two tokenizers: union-find over the graph of overlapping tokens, links counted over the whole corpus.

Tokens of both sides are nodes, two tokens that share a byte are an edge; a connected component is a smallest group of
tokens with the same bytes. Members of a component whose ranges end together are links. Documents lie in blocks of
bounded size: a block's different id pairs are counted together, go through the shuffle once for each block, and come
back with their corpus-wide counts to the block, where each document's links look them up by their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, runs_of_rows, table
from .units import KEPT_SIGNS, Side, byte_level, pieces_with_bytes, public_file, unit_pattern

#: Bytes of text in a block of documents (a longer text is a block of its own), and pairs in a row of a block's list.
BLOCK_BYTES, ROW_PAIRS = 8 << 20, 1 << 12


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each node's root, the smallest node of its component: all edges hook at once, then paths are halved to the roots."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each token of A, of each of B, links as two arrays of places); both sides cover the same bytes."""
    parts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, parts), np.searchsorted(ends_b, parts)
    root = union_find(len(ends_a) + len(ends_b), a, len(ends_a) + b)
    first, group_a = np.unique(root[: len(ends_a)], return_inverse=True)
    group_b = np.searchsorted(first, root[len(ends_a) :])
    together = (ends_a[a] == parts) & (ends_b[b] == parts) & (group_a[a] == group_b[b]) if len(parts) else np.zeros(0, bool)
    return group_a, group_b, a[together], b[together]


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts))


class Aligner:
    """What units have in common on both sides, kept for each different unit."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        self.pattern = unit_pattern("".join(x for x in a.starts if x in b.starts))
        base = [*range(max(len(a.pieces), len(b.pieces)))]
        self.shown = [[f"{i}{x}" for i in base] for x in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.signs = 0
        self.texts: list[str] = []
        self.numbers = np.zeros((4, 0), np.int64)  # whole, tokens of A, of B, groups
        self.links, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        (a, n_a, ok_a), (b, n_b, ok_b) = self.a.split(units), self.b.split(units)
        ok = ok_a & ok_b
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        group_a, group_b, link_a, link_b = groups_of(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]))
        owner = np.repeat(np.arange(len(units)), n_a)
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        first = np.searchsorted(group_a, np.arange(n))
        n_groups = np.bincount(owner[first], minlength=len(units)) if n else np.zeros(len(units), np.int64)
        # Tokens by group and side, each followed by what parts it from the next.
        ids, group = np.append(a, b), np.append(group_a, group_b)
        mark = np.append(np.append(group_a[1:] != group_a[:-1], True)[: len(a)] * 1, np.append(group_b[1:] != group_b[:-1], True)[: len(b)] * 2)
        order = np.argsort(group * 2 + (np.arange(len(ids)) >= len(a)), kind="stable")
        shown = [self.shown[m][i] for m, i in zip(mark[order].tolist(), ids[order].tolist(), strict=True)]
        at = _bounds(n_a + n_b).tolist()
        self.texts += ["".join(shown[x:y])[:-1] for x, y in zip(at, at[1:], strict=False)]
        self.numbers = np.concatenate([self.numbers, [ok, n_a, n_b, n_groups]], axis=1)
        n_links = np.bincount(owner[link_a], minlength=len(units))
        self.links = np.append(self.links, (a[link_a] << 32) | b[link_b])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(n_links))
        for u in units:
            self.places[u] = len(self.places)
            self.signs += len(u)

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Tokens of A and of B and groups of each text, its groups' digest, and its links as (A id << 32) + B id."""
        if self.signs > KEPT_SIGNS:
            self.forget()
        units = [self.pattern.findall(f" {t}") if t else [] for t in texts]
        new = set().union(*units) - self.places.keys()
        if new:
            self.learn(sorted(new, key=lambda u: not (self.a.joint(u) and self.b.joint(u))))
        counts = np.array([len(u) for u in units])
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        bounds = _bounds(counts)
        whole = np.array([bool(c) and bool(self.numbers[0, at[x:y]].all()) for c, x, y in zip(counts, bounds, bounds[1:], strict=False)], bool)
        sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(self.numbers[1:, at], axis=1)], axis=1)
        numbers = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]) * whole
        digests, kept, place = [], [], at.tolist()
        low, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        flat = self.links[np.repeat(low - _bounds(size)[:-1], size) + np.arange(int(size.sum()))]
        ends = _bounds(size)[bounds]
        for i, ok in enumerate(whole.tolist()):
            digests.append(hashlib.sha256(";".join([self.texts[p] for p in place[bounds[i] : bounds[i + 1]]]).encode()).hexdigest() if ok else "")
            kept.append(flat[ends[i] : ends[i + 1]] if ok else flat[:0])
        return numbers, digests, kept


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(byte_level(path_a), pieces_with_bytes(path_b))
    return _aligners[path_a, path_b]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit places, byte by byte of their weight: frequent pairs have small places, so most planes are empty."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_STORED = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("places", pa.binary()), ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_STORED_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, first int, pairs array<long>, times array<long>"


def _block_rows(block: int, ids: list[pa.Array], numbers: list[np.ndarray], digests: list[str], links: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A block's documents, whose links are places in its list of pairs, and the list: the most frequent pair first."""
    counts = np.array([len(x) for x in links])
    flat = np.concatenate(links) if links else np.zeros(0, np.int64)
    pairs, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place, at = rank[inverse], _bounds(counts).tolist()
    n_a, n_b, n_groups = np.concatenate(numbers, axis=1)
    none = lambda n, kind: pa.nulls(n, kind)
    n = len(counts)
    columns = [pa.array(np.full(n, block)), pa.chunked_array(ids, pa.int64()).combine_chunks(), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(counts), pa.array(digests, pa.string())]
    columns += [pa.array([planes(place[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.binary()), none(n, pa.int32()), none(n, _STORED.field("pairs").type), none(n, _STORED.field("times").type)]
    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_STORED)
    starts = [*range(0, len(order), ROW_PAIRS)]
    if starts:
        n = len(starts)
        lists = [pa.array([x[order[s : s + ROW_PAIRS]] for s in starts], _STORED.field("pairs").type) for x in (pairs, times)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *[none(n, f.type) for f in [*_STORED][1:8]], pa.array(starts, pa.int32()), *lists], schema=_STORED)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of `docs` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE's file of the tokenizers library, B a sentencepiece model with byte fallback; special tokens'
    strings are text. A null or empty text, and one that a side does not give back byte for byte behind a space, has no
    tokens: zeros and ''. Texts are worked on whole, PIECE_BYTES at a time; a longer one by itself. Ties for a B id's
    highest count all count as best. Repeated rows each count as occurrences and give equal rows, a null doc_id stays
    null, an empty table gives an empty result, other columns are left out. Files must be readable on every executor.
    """
    path_a, path_b = path_a or public_file("byte_bpe_50k.json"), path_b or public_file("piece_bpe_32k.model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, task = aligner(path_a, path_b), TaskContext.get().partitionId()
        n, size, held = 0, 0, ([], [], [], [])
        for batch in batches:
            for x, y in runs_of_rows(batch.column(1)):
                texts = batch.column(1).slice(x, y - x).to_pylist()
                more = sum(len(t or "") for t in texts)
                if size and size + more > block_bytes:
                    yield from _block_rows((task << 32) + n, *held)
                    n, size, held = n + 1, 0, ([], [], [], [])
                numbers, digests, links = al.aligned(texts)
                size += more + 1
                held[0].append(batch.column(0).slice(x, y - x)), held[1].append(numbers)
                held[2].extend(digests), held[3].extend(links)
        if size:
            yield from _block_rows((task << 32) + n, *held)

    stored = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, _STORED_DDL))
    lists = stored.filter("first is not null").select("block", "first", F.posexplode(F.arrays_zip("pairs", "times")).alias("i", "p"))
    lists = lists.select("block", (F.col("first") + F.col("i")).alias("place"), F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = lists.groupBy("pair").agg(F.sum("times").alias("n"))
    # A B id has at most as many pairs as A has ids, so the window's partitions are bounded by the vocabulary.
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))
    known = lists.select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "place", "n", "best")
    rows = stored.filter("first is null").drop("first", "pairs", "times")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's documents and its pairs' counts: sums over each document's places."""
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        if right.num_rows:
            place = right["place"].to_numpy()
            n[place], best[place] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        sums = [(int(best[p].sum()), int(n[p].sum())) for p in map(from_planes, left["places"].to_pylist())]
        out = left.drop_columns(["block", "places"])
        for i, name in enumerate(("n_best", "count_sum")):
            out = out.append_column(name, pa.array([s[i] for s in sums], pa.int64()))
        return out

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(look_up, schema)


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document with the two public vocabularies."""
    return aligned(table(spark, sf_dir, "documents"))
