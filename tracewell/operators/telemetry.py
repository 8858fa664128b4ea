"""Telemetry rows: pipelines of attributes, token usage, error classes, shape checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of failures that may pass.
TRANSIENT = ["throttled", "timeout", "unavailable", "connection_reset", "rate_limited", "server_error"]


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], *keys: str) -> DataFrame:
    """A-21: rows by bucket: 0 up to the first bound (which belongs to it), then up to each next one, and one beyond the last.

    Buckets without rows are left out, and so are null values; NaN counts beyond the last bound. Bounds must rise.
    """
    if list(bounds) != sorted(set(bounds)):
        raise ValueError("bounds must rise")
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col(value)))
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def attribute_pipeline(spans: DataFrame, drop: Sequence[str] = (), rename: dict[str, str] | None = None, require: str | None = None) -> DataFrame:
    """L-02: a branch of a pipeline over a map column `attributes`: keys dropped, keys renamed, rows without a key left out."""
    a = F.map_filter("attributes", lambda k, _: ~k.isin(*drop)) if drop else F.col("attributes")
    for old, new in (rename or {}).items():
        a = F.transform_keys(a, _renamer(old, new))
    out = spans.withColumn("attributes", a)
    return out.filter(F.map_contains_key("attributes", require)) if require else out


def _renamer(old: str, new: str):
    return lambda k, _: F.when(k == old, F.lit(new)).otherwise(k)


def token_usage(usage: Column) -> Column:
    """L-03: counters under one name, whichever alias the provider gave."""
    get = lambda *names: F.coalesce(*[F.try_element_at(usage, F.lit(n)) for n in names], F.lit(0).cast("bigint"))
    return F.struct(get("input", "prompt_tokens").alias("input"), get("output", "completion_tokens").alias("output"), get("cache_read").alias("cache_read"), get("cache_write", "cache_creation").alias("cache_write"))


def error_class(code: Column) -> Column:
    """L-04: what is not known to pass is permanent."""
    return F.when(code.isin(*TRANSIENT), "transient").otherwise("permanent")


def total_problems(records: DataFrame, totals: dict[str, int] | DataFrame) -> DataFrame:
    """T-01: sources whose number of records is not what the manifest says; totals: by source, or a table of source_system and want."""
    have = records.groupBy("source_system").agg(F.count(F.lit(1)).alias("n"))
    want = totals if isinstance(totals, DataFrame) else records.sparkSession.createDataFrame(sorted(totals.items()), "source_system string, want long")
    return want.join(have, "source_system", "full_outer").filter(~F.col("n").eqNullSafe(F.col("want")))
