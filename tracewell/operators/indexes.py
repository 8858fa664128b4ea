"""Indexes kept as Parquet: postings with block maxima and cells of vectors with exact bounds.

Both give what the scans of `retrieval` give. A build writes a folder of its own and then puts its name in place in one
step, so a search keeps the build that it began with.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import read_file, write_file
from . import retrieval as R

#: Blocks that a search looks at first, to learn how good an answer must be.
FIRST_BLOCKS = 8
#: Up to so many blocks are named in the scan's filter; more are joined.
NAMED_BLOCKS = 1000
#: What scores may lose by rounding to six places.
ROUNDING = 1e-6


class _Kept:
    """A build's folder and what is known of it in a few numbers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        found = read_file(spark, f"{root}/current.json")
        if found is None:
            raise FileNotFoundError(f"no index in {root}")
        self.spark, self.root, self.facts = spark, root, json.loads(found)
        self.folder = f"{root}/{self.facts['build']}"

    @staticmethod
    def new(root: str) -> str:
        return f"build-{uuid.uuid4().hex}"

    @staticmethod
    def put(spark: SparkSession, root: str, facts: dict) -> None:
        write_file(spark, f"{root}/current.json", json.dumps(facts).encode())

    def parts(self, name: str, column: str, values: Sequence[int]) -> DataFrame:
        """The rows of some of a table's folders; no other folder is listed."""
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/{column}={v}" for v in sorted(values)])


@contextmanager
def _sorted_groups(spark: SparkSession) -> Iterator[None]:
    """Lists are gathered from sorted rows while a table is written: one sort, which spills, where a hash table would sort what it cannot hold twice."""
    setting = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _impact(tf: Column, dl: Column, avg: float) -> Column:
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / F.lit(avg)))


class TextIndex(_Kept):
    """R-01, S-16: postings of words in blocks of texts, each with the most that it can add to a score.

    Texts of about one length share blocks, which are made of the length and a hash of the key alone: they need no order
    over the table, are alike in a rerun, and hold about `block` texts whatever their number. A word's block is one row,
    so a word that stands in every text is spread over as many rows, files and tasks as there are blocks; a search reads
    only the folders of its words.
    """

    @classmethod
    def build(cls, chunks: DataFrame, root: str, key: str = "chunk_id", text: str = "text", block: int = 1024, folders: int = 64) -> TextIndex:
        """Keys must differ; rows without a key are left out. Texts without words, and nulls, count only among the number of texts, as in the scan."""
        spark, chunks = chunks.sparkSession, chunks.select(key, text).filter(F.col(key).isNotNull())
        length = lambda dl: F.floor(F.log(dl.cast("double")) / math.log(1.1)).cast("int")
        sizes = chunks.select(F.when(F.col(text).isNotNull(), F.size(R.tokens(F.col(text)))).alias("dl"))
        # One row for each tenth of length, so some 250 at most; null for texts without words.
        groups = sizes.groupBy(F.when(F.col("dl") > 0, length(F.col("dl"))).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count("dl").alias("counted"), F.sum("dl").alias("words")).collect()
        n, counted = sum(g.n for g in groups), sum(g.counted for g in groups)
        facts = {"build": cls.new(root), "key": key, "type": chunks.schema[key].dataType.simpleString(), "n": n, "avg": sum(g.words or 0 for g in groups) / max(counted, 1), "folders_of": folders, "folders": []}
        if blocks := {g.c: -(-g.n // block) for g in groups if g.c is not None}:
            many = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
            words = R.tokens(F.col(text))
            sized = chunks.select(F.col(key).alias("key"), F.col(text).alias("text"), F.size(words).alias("dl")).filter("dl > 0")
            c = length(F.col("dl"))
            at = (c.cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("key"), F.element_at(many, c))).alias("block")
            # The texts themselves are dealt out, a block to a task: they are a small part of their postings, which then are made and grouped where they are.
            dealt = sized.select("key", "text", "dl", at).repartition("block").select("key", "dl", "block", F.sort_array(R.tokens(F.col("text"))).alias("_t"))
            begins = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
            counts = F.transform("_s", lambda i, j: F.struct(F.get("_t", i).alias("term"), (F.coalesce(F.get("_s", j + 1), F.col("dl")) - i).cast("long").alias("tf")))
            rows = dealt.withColumn("_s", begins).select("key", "dl", "block", F.explode(counts).alias("p")).select("p.term", "block", "key", "p.tf", "dl")
            rows = rows.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int")).groupBy("folder", "term", "block").agg(
                F.count(F.lit(1)).alias("n"), F.max(_impact(F.col("tf"), F.col("dl"), facts["avg"])).alias("most"), F.array_sort(F.collect_list(F.struct("key", "tf", "dl"))).alias("held")
            )
            order, place = ["folder", "term", "block"], f"{root}/{facts['build']}"
            with _sorted_groups(spark):
                rows.sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy("folder").parquet(f"{place}/postings")
            heads = spark.read.parquet(f"{place}/postings").select("folder", "term", "block", "n", "most")
            heads.sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy("folder").parquet(f"{place}/heads")
            facts["folders"] = sorted(r.folder for r in spark.read.parquet(f"{place}/heads").select("folder").distinct().collect())
        cls.put(spark, root, facts)
        return cls(spark, root)

    def _of(self, name: str, words: Sequence[str]) -> DataFrame | None:
        """The rows of these words; None where a word's folder is missing, so that no text holds it."""
        at = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(self.facts["folders_of"])).cast("int") for w in words]).first()
        if not set(at) <= set(self.facts["folders"]):
            return None
        return self.parts(name, "folder", sorted(set(at))).filter(F.col("term").isin(*words))

    def terms(self) -> DataFrame:
        """Each word, how many texts hold it, its blocks, and the most it adds to a score before it is weighed."""
        if not self.facts["folders"]:
            return self.spark.createDataFrame([], "term string, df long, blocks long, most double")
        return self.parts("heads", "folder", self.facts["folders"]).groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks"), F.max("most").alias("most"))

    def _weights(self, words: Sequence[str]) -> dict[str, int] | None:
        """How many texts hold each word; None where one has none."""
        heads = self._of("heads", words)
        # One row for each word of the query.
        df = {r.term: r.n for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()} if heads is not None else {}
        return df if len(df) == len(words) else None

    def _idf(self, d: int) -> Column:
        return F.log(1 + (F.lit(self.facts["n"]) - F.lit(d) + 0.5) / (F.lit(d) + 0.5))

    def bounds(self, words: Sequence[str], df: dict[str, int]) -> DataFrame:
        """(block, bound) of the blocks that have every word: no text of the block scores more."""
        weight = F.lit(0.0)
        for w in words:
            weight = F.when(F.col("term") == w, self._idf(df[w])).otherwise(weight)
        by = self._of("heads", words).groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight * F.col("most")).alias("bound"))
        return by.filter(F.col("_n") == len(words)).select("block", "bound")

    def _scored(self, words: Sequence[str], df: dict[str, int], blocks: DataFrame | Sequence[int], allowed: DataFrame | None) -> DataFrame:
        rows = self._of("postings", words)
        rows = rows.join(blocks.select("block"), "block", "left_semi") if isinstance(blocks, DataFrame) else rows.filter(F.col("block").isin(*blocks))
        rows = rows.select("term", F.explode("held").alias("p")).select("term", "p.*")
        texts = rows.groupBy("key", "dl").agg(*[F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"_f{i}") for i, w in enumerate(words)])
        score = F.lit(0.0)
        for i, w in enumerate(words):
            f = F.col(f"_f{i}")
            score = score + self._idf(df[w]) * f * (R.K1 + 1) / (f + R.K1 * (1 - R.B + R.B * F.col("dl") / F.lit(self.facts["avg"])))
        found = texts.select(F.col("key").alias(self.facts["key"]), F.round(score, 6).alias("score")).filter("score is not null")
        return found if allowed is None else found.join(allowed.select(self.facts["key"]), self.facts["key"], "left_semi")

    def kept_blocks(self, words: Sequence[str], df: dict[str, int], k: int | None, allowed: DataFrame | None = None) -> DataFrame:
        """The blocks that can hold one of the k best: those whose bound is not below the k-th score within the FIRST_BLOCKS of the largest bounds."""
        bounds = self.bounds(words, df)
        if k is None:
            return bounds
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
        if not first:
            return bounds
        least = self._scored(words, df, first, allowed).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        return bounds.filter(F.col("bound") + ROUNDING >= F.lit(least.s)) if least.n == k else bounds

    def search(self, query: str, k: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """What `retrieval.bm25` gives for the texts indexed: key, score, rank. allowed: keys that answers must be among; the statistics stay those of all texts."""
        words = R.query_words(query)
        df = self._weights(words) if words else None
        if df is None:
            return self.spark.createDataFrame([], f"`{self.facts['key']}` {self.facts['type']}, score double, rank int")
        blocks = self.kept_blocks(words, df, k, allowed)
        if k is not None:
            named = [r.block for r in blocks.select("block").limit(NAMED_BLOCKS + 1).collect()]
            if len(named) <= NAMED_BLOCKS:
                blocks = named or [-1]
        return R.ranked(self._scored(words, df, blocks, allowed), k, self.facts["key"])


class VectorIndex(_Kept):
    """R-02, S-16: vectors in cells around pivots, each with its distance to the pivot, by which a search leaves out cells and parts of cells.

    The bounds are those of the triangle inequality on vectors of length one, so an answer is that of the scan; where they
    leave nothing out every cell is read. Cells are ranges of files, so a large one is many.
    """

    @classmethod
    def build(cls, chunks: DataFrame, root: str, width: int, key: str = "chunk_id", vector: str = "embedding", cells: int = 64) -> VectorIndex:
        """Vectors that are null, of another width, without length or not finite, and rows without a key, are left out. cells: at most so many pivots, which come to the driver."""
        spark, place = chunks.sparkSession, cls.new(root)
        good = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf)) & F.exists(vector, lambda x: x != 0)
        rows = chunks.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(good).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        # The smallest hashes are an even choice, the same in every run.
        chosen = [r.vector for r in rows.orderBy(F.xxhash64("key"), "key").limit(cells).collect()]
        facts = {"build": place, "key": key, "type": chunks.schema[key].dataType.simpleString(), "width": width, "cells": []}
        if chosen:
            pivots = np.unique(_unit(np.array(chosen)), axis=0)

            def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    v = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                    dot = v @ pivots.T
                    cell = dot.argmax(1)
                    away = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(away), pa.array(cell.astype(np.int32))], ["key", "vector", "away", "cell"])

            dealt = rows.mapInArrow(deal, f"key {facts['type']}, vector array<double>, away double, cell int")
            dealt.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away").write.partitionBy("cell").parquet(f"{root}/{place}/cells")
            held = spark.read.parquet(f"{root}/{place}/cells").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"))
            facts["cells"] = [{"cell": r.cell, "n": r.n, "lo": r.lo, "hi": r.hi, "pivot": pivots[r.cell].tolist()} for r in held.orderBy("cell").collect()]
        cls.put(spark, root, facts)
        return cls(spark, root)

    def _scored(self, cells: dict[int, tuple[float, float]], probe: Sequence[float]) -> DataFrame:
        """Scores in these cells, of vectors whose distance to the pivot lies within the cell's limits."""
        near = F.lit(False)
        for c, (lo, hi) in cells.items():
            near = near | ((F.col("cell") == c) & F.col("away").between(lo, hi))
        rows = self.parts("cells", "cell", list(cells)).filter(near)
        p = F.array(*[F.lit(float(x)) for x in probe])
        return rows.select(F.col("key").alias(self.facts["key"]), F.round(R.cosine(F.col("vector"), p), 6).alias("score"))

    def kept_cells(self, probe: Sequence[float], k: int) -> dict[int, tuple[float, float]]:
        """The cells that can hold one of the k best, and between which distances to the pivot these lie.

        The cells nearest to the probe that have k vectors give a score that the k best reach.
        """
        q = _unit(np.array([probe], float))[0]
        away = {c["cell"]: float(np.sqrt(((np.array(c["pivot"]) - q) ** 2).sum())) for c in self.facts["cells"]}
        first, n = {}, 0
        for c in sorted(self.facts["cells"], key=lambda c: away[c["cell"]]):
            if n >= k:
                break
            first[c["cell"]], n = (c["lo"], c["hi"]), n + c["n"]
        if n < k:
            return first
        least = self._scored(first, probe).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("s")).first().s
        reach = math.sqrt(max(0.0, 2 - 2 * (least - ROUNDING))) + 1e-9
        limits = {c["cell"]: (max(c["lo"], away[c["cell"]] - reach), min(c["hi"], away[c["cell"]] + reach)) for c in self.facts["cells"]}
        return {c: (lo, hi) for c, (lo, hi) in limits.items() if lo <= hi}

    def search(self, probe: Sequence[float], k: int) -> DataFrame:
        """What `retrieval.vector_search` gives for the vectors indexed: key, score, rank. A probe of another width, without length or not finite finds nothing."""
        finite = len(probe) == self.facts["width"] and all(map(math.isfinite, probe)) and any(probe)
        if not finite or not self.facts["cells"] or k < 1:
            return self.spark.createDataFrame([], f"`{self.facts['key']}` {self.facts['type']}, score double, rank int")
        return R.ranked(self._scored(self.kept_cells(probe, k), probe), k, self.facts["key"])


def _unit(v: np.ndarray) -> np.ndarray:
    # By the largest component first, so that squares of very large or small ones stay finite.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))
