"""Mixing sources to target weights: words per source, repetition rates, and a hash-seeded copy for the fraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, small

#: Sources are broadcast up to this number; beyond it documents are joined with them by shuffling on salted keys.
BROADCAST_SOURCES, SALTS = 100_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Number of words; null counts as none. Each word shrinks to one letter, which takes no array of words."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def _summed(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """rows with before_n and before_<column>: how many rows, and the sums of columns, come before in an order without ties.

    Each range of the order adds up its own rows; what the ranges before it have is one row for each range. So sources
    may be as many as they like: no task holds them all.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = sorted(map(tuple, dealt.groupBy("part").agg(F.count(F.lit(1)), *[F.sum(c) for c in sums]).collect()))
    names, starts, held = ["n", *sums], [], [0] * (len(sums) + 1)
    for part, *add in totals:
        starts.append((part, *held))
        held = [x + y for x, y in zip(held, add, strict=True)]
    # As Arrow the rows come with the plan; a list would be read by Python workers of another kind, which stay beside those of the UDFs.
    schema = pa.schema([("part", pa.int32()), *[(f"start_{c}", pa.int64()) for c in names]])
    start = F.broadcast(rows.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array([s[i] for s in starts], t) for i, t in enumerate(schema.types)], schema=schema)))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {"n": F.count(F.lit(1)).over(inside)} | {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
    return dealt.join(start, "part").select(*rows.columns, *[(F.col(f"start_{c}") + own[c]).alias(f"before_{c}") for c in names])


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target, rate for documents with source and size.

    Sources in the order of their code points, null last, weigh the cycle's numbers in turn and share the sum of all
    sizes; no target is above `most` times its source's size. The excess is shared by weight among the others until
    none is above, which is the level L with sum(min(most * size, L * weight)) = sum(size): sources are taken by
    most * size / weight, and the first whose prefix leaves a level at or below its own ratio ends the capped ones.
    A source of size 0 gets target 0 and rate 0, and an empty table gives an empty result.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    place = [F.col("source").isNull(), F.col("source").cast("binary")]
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("before_n") % len(cycle) + 1).cast("int")).cast("long")
    per = _summed(per, place, []).select("source", "source_size", weight.alias("weight"))
    per = cut(_summed(per, [F.col("source_size").cast("double") / F.col("weight"), *place], ["source_size", "weight"]))
    total, weights = per.agg(F.sum("source_size"), F.sum("weight")).first()
    used, left, rest = F.col("before_weight"), F.lit(total or 0) - most * F.col("before_source_size"), F.lit(weights or 0) - F.col("before_weight")
    ends = (left * F.col("weight")).cast("double") <= (most * F.col("source_size") * rest).cast("double")
    # One row comes to the driver: where the capped sources end.
    level = per.filter(ends).agg(F.min(F.struct(used.alias("used"), left.alias("left"), rest.alias("rest"))).alias("level")).first().level
    cap = (most * F.col("source_size")).cast("double")
    share = F.lit(level.left).cast("double") * F.col("weight") / F.lit(level.rest) if level else cap
    target = F.when(used < F.lit(level.used), cap).otherwise(F.least(cap, share)) if level else cap
    per = per.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("rate", F.least(rate, F.lit(float(most))))


def copies(rate, doc_id, seed: int = 7):
    """floor(rate) copies and one more with the fraction's probability, decided by a hash of the id alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary"))
    chance = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_rates(docs: DataFrame, most: int = 3) -> DataFrame:
    """row (a row of `docs`, whole), size, source_size, target and copies.

    Rows are carried as one struct, so no name of a column of `docs` is in the way. Null text has size 0, a null source
    is a source of its own, rows of one doc_id and source get equal numbers of copies, and an empty table stays empty.
    """
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), word_count(docs["text"]).alias("size"))
    source, doc_id = F.col("row")["source"], F.col("row")["doc_id"]
    per = cut(source_targets(sized.select(source.alias("source"), "size"), most=most))
    if small(per, BROADCAST_SOURCES):
        out = sized.join(F.broadcast(per), source.eqNullSafe(F.col("source")))
    else:
        spread = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = sized.withColumn("key", F.pmod(F.xxhash64(doc_id, F.col("row")["text"]), F.lit(SALTS)))
        out = salted.join(spread, source.eqNullSafe(F.col("source")) & (F.col("key") == F.col("salt")))
    return out.select("row", "size", "source_size", "target", copies(F.col("rate"), doc_id).alias("copies"))


def mixed(docs: DataFrame, most: int = 3) -> DataFrame:
    """The mix itself: each row of `docs`, with its columns, as many times as its source's rate says.

    Nulls, repeated rows, empty tables and other columns: as `mix_rates`; a text of any length is one row.
    """
    out = mix_rates(docs, most).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    rates = mix_rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rates.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP7_SQL = r"""
with d as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size from documents
), p as (select source, sum(size)::bigint as s from d group by 1
), w as (select *, ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::bigint as w from p
), o as (
  select *, coalesce(sum(s) over x, 0) as capped, coalesce(sum(w) over x, 0) as used, sum(s) over () as all_s, sum(w) over () as all_w
  from w window x as (order by s / w::double, source is null, encode(source) rows between unbounded preceding and 1 preceding)
), l as (
  select used as cut, (all_s - 3 * capped)::double as left_s, (all_w - used)::double as left_w from o
  where (all_s - 3 * capped)::double * w <= (3 * s * (all_w - used))::double order by used limit 1
), t as (
  select source, s, case when s = 0 then 0.0 when used < cut then 3.0 * s else least(3.0 * s, left_s * w / left_w) end::double as target from o, l
), r as (select *, case when s = 0 then 0.0 else least(3.0, target / s) end::double as rate from t
), c as (
  select d.*, r.s, r.target, (floor(rate) + case when ('0x' || substr(md5('7' || coalesce(':' || doc_id, '')), 1, 13))::bigint / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end)::bigint as copies
  from d join r on d.source is not distinct from r.source
)
select doc_id, size::bigint as size, s as source_size, target, size::bigint * copies as taken, copies from c
"""
