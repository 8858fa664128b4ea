"""Retrieval: BM25, exact cosine, weighted fusion, integrity and budgets.

Scores are made by aggregates and every limit is a TakeOrdered, so nothing but the answer reaches one task. Ranks over
a whole table come from range partitions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut

K1, B, RRF_K = 1.2, 0.75, 60
NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def query_words(query: str) -> list[str]:
    """The different words of a query, in its order."""
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def chunk_filters(chunks: DataFrame, systems: Sequence[str] = (), since: datetime | None = None, until: datetime | None = None, excluded: Sequence[str] | DataFrame = ()) -> DataFrame:
    """P-04 and J-07: bounds are inclusive, and a bound leaves rows without a time out. excluded: a few ids, or a table of chunk_id."""
    if systems:
        chunks = chunks.filter(F.col("source_system").isin(*systems))
    if since is not None:
        chunks = chunks.filter(F.col("event_time_utc") >= F.lit(since))
    if until is not None:
        chunks = chunks.filter(F.col("event_time_utc") <= F.lit(until))
    if isinstance(excluded, DataFrame):
        return chunks.join(excluded.select("chunk_id"), "chunk_id", "left_anti")
    return chunks.filter(~F.col("chunk_id").isin(*excluded)) if excluded else chunks


def with_records(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """J-01, P-09: chunks (record_id, char_start, char_end, chunk) with their records (record_id, text, ...); sound: whether the chunk is the slice that it says."""
    joined = chunks.join(records.withColumnRenamed("text", "record_text"), "record_id")
    return joined.withColumn("sound", F.substring("record_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("chunk"))


def bm25(chunks: DataFrame, query: str, k: int | None = None, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """R-01: key, score, rank of the chunks that hold every word of the query.

    Only the query's words are counted, in one pass over the texts and without arrays of words: a text is searched for
    each word, and only where it stands its places are taken out and told by the length that is lost. Over all chunks the
    mean length and each word's document frequency are one row, joined by broadcast.
    """
    words = query_words(query)
    if not words:
        return chunks.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    t = chunks.select(key, F.lower(text).alias("_t"))
    lost = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    of = lambda w: F.when(F.col("_t").contains(w), (lost(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])") / len(w)).cast("int")).when(F.col("_t").isNotNull(), 0)
    # Each word becomes one sign, and all else goes.
    size = F.length(F.regexp_replace(F.regexp_replace("_t", r"[\p{L}\p{N}]+", "x"), "[^x]+", ""))
    counted = t.select(key, size.alias("_dl"), *[of(w).alias(f"_f{i}") for i, w in enumerate(words)])
    # One row of so many numbers as the query has words.
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(words))])
    hits = counted.filter(" and ".join(f"_f{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        f = F.col(f"_f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return ranked(hits.select(key, F.round(score, 6).alias("score")), k, key)


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1, 2, ... over a whole table in an order without ties, and no task holds it: each range of the order numbers its own rows from what the ranges before it have."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # One row for each partition comes to the driver.
    counts, before, at = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}, [], 0
    for part in sorted(counts):
        before.append((part, at))
        at += counts[part]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _start long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(starts, "_part").withColumn(name, (F.col("_start") + own).cast("int")).drop("_part", "_start")


def ranked(scored: DataFrame, k: int | None, key: str = "chunk_id") -> DataFrame:
    """W-01, O-01, O-02: the k best by score, ties by key, with ranks from 1. One task sees k rows; without a k the ranks come from range partitions."""
    if k is None:
        return numbered(scored, [F.desc("score"), F.col(key)])
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a vector without length."""
    double = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: double(x) * double(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + double(x) * double(x)))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def vector_search(chunks: DataFrame, probe: Sequence[float], k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """R-02, P-06: the k most alike by exact cosine; the probe is a literal of the plan."""
    p = F.array(*[F.lit(float(x)) for x in probe])
    scored = chunks.filter(F.col(vector).isNotNull() & (F.size(vector) == len(probe))).select(key, F.round(cosine(F.col(vector), p), 6).alias("score"))
    return ranked(scored.filter("score is not null"), k, key)


def checked_weights(weights: dict[str, float], k: int, limit: int) -> None:
    if k < 1 or limit < 1 or any(w < 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must not be negative nor all zero; k and limit start at 1")


def fuse(rankings: dict[str, DataFrame], weights: dict[str, float], limit: int, k: int = RRF_K, key: str = "chunk_id", page: int | None = 1000) -> DataFrame:
    """R-04, A-07, A-08, W-02, J-09, O-03: reciprocal rank fusion of rankings (key, rank), one sum per chunk.

    Repeated chunks of a ranking count by their best rank, and ranks are made dense again before they are summed. What
    is fused are pages, each ranking's best `page` chunks; with None whole rankings are, numbered by range partitions.
    """
    checked_weights(weights, k, limit)
    parts = None
    for name in sorted(rankings):
        best = rankings[name].groupBy(key).agg(F.min("rank").alias("_r"))
        if page is None:
            dense = numbered(best, ["_r", key])
        else:
            dense = best.orderBy("_r", key).limit(page).withColumn("rank", F.row_number().over(Window.orderBy("_r", key)))
        part = dense.select(key, F.lit(name).alias("modality"), "rank", (F.lit(float(weights[name])) / (k + F.col("rank"))).alias("weighted"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(key).agg(F.round(F.sum(F.col("weighted").cast("decimal(38,18)")).cast("double"), 9).alias("score"), F.array_sort(F.collect_list(F.struct("modality", "rank"))).alias("contributions"))
    return ranked(fused, limit, key)


def modality_problems(candidates: DataFrame, modality: str, excluded: Sequence[str] = ()) -> DataFrame:
    """R-05: chunks of another modality, excluded ones, and those whose reference names another record."""
    problem = (
        F.when(F.col("modality") != modality, "wrong_modality").when(F.col("chunk_id").isin(*excluded) if excluded else F.lit(False), "excluded_chunk")
        .when(~F.col("source_ref.record_id").eqNullSafe(F.col("record_id")), "reference_mismatch")
    )
    return candidates.withColumn("problem", problem).filter("problem is not null")


def disagreements(lexical: DataFrame, vector: DataFrame, columns: Sequence[str], key: str = "chunk_id") -> DataFrame:
    """J-09: chunks that both modalities found but describe differently."""
    other = vector.select(key, F.struct(*columns).alias("_v"))
    return lexical.select(key, F.struct(*columns).alias("_l")).join(other, key).filter(~F.col("_l").eqNullSafe(F.col("_v"))).select(key)


class RetrievalSession:
    """R-03, R-06, R-08: a bounded loop over hybrid retrievals; what was retrieved is left out of later attempts."""

    def __init__(self, lexical, vector, weights: dict[str, float], attempts: int = 3, most: int = 20, seen: Sequence[str] = ()) -> None:
        self.lexical, self.vector, self.weights, self.attempts, self.most = lexical, vector, weights, attempts, most
        self.seen, self.used, self.warnings = set(seen), set(), []

    def retrieve(self, query: str, top_k: int, **filters) -> DataFrame | None:
        from ..functions.scalar import query_fingerprint

        mark = query_fingerprint(query, filters.get("systems"), filters.get("since"), filters.get("until"))
        if len(self.used) >= self.attempts or mark in self.used:
            self.warnings.append("attempts_exhausted" if mark not in self.used else "repeated_query")
            return None
        self.used.add(mark)
        k, found = min(top_k, self.most), {}
        for name, search in (("bm25", self.lexical), ("vector", self.vector)):
            try:
                side = search(query, k, sorted(self.seen), **filters).limit(k)
                found[name] = side.sparkSession.createDataFrame(side.collect(), side.schema)  # k rows, run here so that its failure shows here
            except Exception as e:  # noqa: BLE001 - a failing side leaves the other's answer
                self.warnings.append(f"{name}_unavailable")
                last = e
        if not found:
            raise RuntimeError("both sides failed") from last
        out = fuse(found, {n: self.weights[n] for n in found}, k)
        self.seen |= {r.chunk_id for r in out.select("chunk_id").collect()}  # at most `most` ids
        return out


def byte_budget(rows: DataFrame, size: Column, max_bytes: int, max_rows: int, order: Sequence[Column | str]) -> DataFrame:
    """A-19, R-07: the rows of the order's prefix whose sizes and number stay within the budget."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.orderBy(*order).limit(max_rows)  # no later row is within the budget, so one task sees so many
    return rows.withColumn("_sum", F.sum(size).over(w)).withColumn("_row", F.count(F.lit(1)).over(w)).filter((F.col("_sum") <= max_bytes) & (F.col("_row") <= max_rows)).drop("_sum", "_row")


def outcome(selected: Sequence[str], retrieved: Sequence[str], sufficient: bool, most: int = 40) -> dict:
    """R-07, Q-21, U-02, U-03: what was chosen out of what was found, in order, and the warnings."""
    kept = sorted(set(selected) & set(retrieved))
    warnings = ["unknown_selection"] if set(selected) - set(retrieved) else []
    if sufficient and not kept:
        warnings.append("retrieval_incomplete")
    if len(kept) > most:
        warnings.append("evidence_capped")
    return {"selected": kept[:most], "sufficient": sufficient and bool(kept), "warnings": list(dict.fromkeys(warnings))[:16]}
