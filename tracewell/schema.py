"""The evidence model: schemas, ontology and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCATOR = "struct<kind:string,field:string,char_start:int,char_end:int,quote:string>"
SOURCE_REF = f"struct<record_id:string,locator:{LOCATOR}>"
RECORDS = "record_id string, source_system string, source_record_id string, record_type string, source_path string, event_time_utc timestamp, original_time string, text string, payload string, content_hash string"
ENTITIES = f"entity_id string, entity_type string, label string, normalized_key string, source_refs array<{SOURCE_REF}>"
RELATIONSHIPS = f"relationship_id string, subject_id string, predicate string, object_id string, status string, method string, occurred_at timestamp, attributes string, source_record_id string, source_refs array<{SOURCE_REF}>"
TRANSACTIONS = "record_id string, txn_id string, booking_ts_utc timestamp, value_date date, debtor_iban string, debtor_name string, creditor_iban string, creditor_name string, amount_minor bigint, amount_text string, currency string, status string, remittance_info string"
ACCOUNTS = "record_id string, account_id string, iban string, holder_name string, holder_type string, bic string, opened_date date"
COMMUNICATIONS = "record_id string, channel string, direction string, from_endpoint string, to_endpoint string, event_time_utc timestamp, original_time string, duration_s int, device_id string"
CHUNKS = "chunk_id string, record_id string, chunk_index int, char_start int, char_end int, text string, embedding array<float>"

# The closed world of types and of what may relate to what.
ENTITY_TYPES = "PERSON ORGANIZATION DEVICE FINANCIAL_ACCOUNT VESSEL PHONE EMAIL_ADDRESS TRANSACTION LOCATION INVOICE_REF".split()
KEYED_TYPES = "PHONE EMAIL_ADDRESS FINANCIAL_ACCOUNT DEVICE TRANSACTION INVOICE_REF VESSEL".split()
MODEL_TYPES = "PERSON ORGANIZATION LOCATION".split()
MODEL_PREDICATES = "USES ASSOCIATED_WITH DIRECTOR_OF KIN_OF".split()
ENDPOINTS = [
    ("USES", "PERSON", "PHONE"), ("USES", "PERSON", "DEVICE"), ("ASSOCIATED_WITH", "PERSON", "ORGANIZATION"), ("DIRECTOR_OF", "PERSON", "ORGANIZATION"),
    ("KIN_OF", "PERSON", "PERSON"), ("HELD_BY", "FINANCIAL_ACCOUNT", "PERSON"), ("HELD_BY", "FINANCIAL_ACCOUNT", "ORGANIZATION"), ("COMMUNICATED_WITH", "PHONE", "PHONE"),
    ("COMMUNICATED_WITH", "EMAIL_ADDRESS", "EMAIL_ADDRESS"), ("TRANSFERRED_TO", "FINANCIAL_ACCOUNT", "FINANCIAL_ACCOUNT"), ("REFERENCES", "TRANSACTION", "INVOICE_REF"),
]


def ontology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENDPOINTS, "predicate string, subject_type string, object_type string")


def endpoint_types_allowed(predicate: Column, subject_type: Column, object_type: Column) -> Column:
    """P-20 as a predicate: the ontology is a fixed list of eleven triples, so no join is needed."""
    return F.concat_ws("|", predicate, subject_type, object_type).isin(["|".join(e) for e in ENDPOINTS])


def field_locator(field: Column | str) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    null = F.lit(None)
    return F.struct(F.lit("field").alias("kind"), field.alias("field"), null.cast("int").alias("char_start"), null.cast("int").alias("char_end"), null.cast("string").alias("quote"))


def span_locator(field: Column | str, start: Column, end: Column, quote: Column) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit("text_span").alias("kind"), field.alias("field"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), quote.alias("quote"))


def source_ref(record: Column, locator: Column) -> Column:
    return F.struct(record.alias("record_id"), locator.alias("locator"))


def locator_valid(loc: Column) -> Column:
    """1.3: a span starts at 0 or later, ends after its start and is as long as its quote; a field locator has a field."""
    span = (loc["char_start"] >= 0) & (loc["char_end"] > loc["char_start"]) & (F.length(loc["quote"]) == loc["char_end"] - loc["char_start"])
    return F.coalesce(F.when(loc["kind"] == "text_span", span).when(loc["kind"] == "field", F.length(loc["field"]) > 0), F.lit(False))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """1.5: keys that stand more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_keys(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """1.5, J-15: rows whose reference has no parent."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")


def draft_violations(entities: DataFrame) -> DataFrame:
    """X-11 for entities: keyed types need a key, actors a scope and no key, and each needs a source."""
    keyed = F.col("entity_type").isin(KEYED_TYPES)
    found = F.array_compact(
        F.array(
            F.when(~F.col("entity_type").isin(ENTITY_TYPES), F.lit("unknown_type")), F.when(keyed & F.col("normalized_key").isNull(), F.lit("missing_key")),
            F.when(~keyed & F.col("normalized_key").isNotNull(), F.lit("unexpected_key")), F.when(~keyed & F.col("scope").isNull(), F.lit("missing_scope")),
            F.when(F.coalesce(F.size("source_refs"), F.lit(0)) < 1, F.lit("missing_source")),
        )
    )
    return entities.withColumn("violations", found)


def relationship_violations(edges: DataFrame) -> DataFrame:
    """X-11 and 1.4 for relationships: allowed endpoints, and who may confirm what."""
    found = F.array_compact(
        F.array(
            F.when(~endpoint_types_allowed(F.col("predicate"), F.col("subject_type"), F.col("object_type")), F.lit("endpoint_types")),
            F.when((F.col("method") == "llm") & (F.col("status") != "proposed"), F.lit("model_must_propose")),
            F.when((F.col("status") == "confirmed") & (F.col("method") != "deterministic"), F.lit("confirmed_needs_rule")),
        )
    )
    return edges.withColumn("violations", found)


def schema_differences(df: DataFrame, ddl: str) -> dict[str, list[str]]:
    """S-19: columns that are missing, or of another type, against a schema."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl)}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return {"missing": sorted(set(want) - set(have)), "different": sorted(c for c in want if c in have and want[c] != have[c])}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A-06: name and rows of each table, in one job."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in sorted(tables.items())])
