"""Statements over the three read views of the driver's tables, as the policy gate lets them through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table
from ..sources.store import read_view
from . import gate
from .provenance import bound_to_one_view


def typed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as transactions, customers as accounts, events as communications."""
    o, c, e = (table(spark, d, n) for n in ("orders", "customer", "events"))
    text = lambda x: F.col(x).cast("string")
    none = F.lit(None).cast("string")
    minor = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    transactions = o.select(
        F.concat(F.lit("bank:"), text("o_orderkey")).alias("record_id"), text("o_orderkey").alias("txn_id"), F.col("o_orderdate").cast("timestamp").alias("booking_ts_utc"), F.col("o_orderdate").cast("date").alias("value_date"),
        text("o_custkey").alias("debtor_iban"), none.alias("debtor_name"), (F.col("o_custkey") % 10).cast("string").alias("creditor_iban"), none.alias("creditor_name"), minor.alias("amount_minor"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount_text"), F.lit("EUR").alias("currency"), F.when(F.col("o_orderstatus") == "F", "booked").otherwise("pending").alias("status"), F.col("o_orderpriority").alias("remittance_info"),
    )
    accounts = c.select(
        F.concat(F.lit("bank:A"), text("c_custkey")).alias("record_id"), text("c_custkey").alias("account_id"), text("c_custkey").alias("iban"), F.col("c_name").alias("holder_name"),
        F.when(F.col("c_custkey") % 3 != 0, "person").otherwise("trust").alias("holder_type"), none.alias("bic"), F.lit(None).cast("date").alias("opened_date"),
    )
    communications = e.select(
        F.concat(F.lit("cdr:"), text("event_id")).alias("record_id"), F.when(F.col("event_type") == "signup", "email").otherwise("call").alias("channel"), F.lit("out").alias("direction"), text("user_id").alias("from_endpoint"),
        (F.col("user_id") % 50).cast("string").alias("to_endpoint"), F.col("ts").cast("timestamp").alias("event_time_utc"), text("ts").alias("original_time"), F.lit(None).cast("int").alias("duration_s"), none.alias("device_id"),
    )
    return {"transactions": transactions, "accounts": accounts, "communications": communications}


def records(tables: dict[str, DataFrame]) -> DataFrame:
    """The records of all typed rows, told by their ids."""
    ids = None
    for t in tables.values():
        ids = t.select("record_id") if ids is None else ids.unionByName(t.select("record_id"))
    system = F.substring_index("record_id", ":", 1)
    return ids.select("record_id", system.alias("source_system"), F.substring_index("record_id", ":", -1).alias("source_record_id"), F.concat(system, F.lit(".raw")).alias("source_path"), F.sha2("record_id", 256).alias("content_hash"))


def views(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    tables = typed(spark, d)
    every = records(tables)
    return {f"{n}_v1": read_view(t, every) for n, t in tables.items()}


def register(spark: SparkSession, d: str) -> None:
    """The views, and the records that their results are held against."""
    gate.register_views(views(spark, d), records(typed(spark, d)))


def parameters(*values: object) -> list[gate.Parameter]:
    kinds = {bool: "boolean", int: "integer", str: "text", list: "text[]"}
    return [gate.Parameter(i, kinds[type(v)], v) for i, v in enumerate(values, 1)]


def gated(spark: SparkSession, d: str, sql: str, *values: object) -> DataFrame:
    """The statement's rows; one that breaks a rule of the policy is an error."""
    register(spark, d)
    verdict = gate.validate(spark, sql, parameters(*values))
    if not verdict.ok:
        raise ValueError(f"{verdict.codes}: {sql}")
    df = gate.bound(spark, verdict, parameters(*values))
    if not bound_to_one_view(df, gate.NAMESPACE):
        raise ValueError(f"provenance of more than one view: {sql}")
    return df
