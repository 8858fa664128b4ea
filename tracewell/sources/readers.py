"""Readers of an edition's raw sources. Files are only ever opened by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import content_hash, date_to_utc, money_to_minor_units, normalize_email, normalize_iban, normalize_phone, record_id, rfc2822_to_utc, to_utc

ORDER = ["cdr", "extraction", "email", "bank", "docs"]
EXCLUDED = ("ground_truth", "expected", "quarantine", "fixtures")
PROSE = ("document", "email", "extraction_message")
CDR = "record_id string, seq int, record_type string, subscriber_msisdn string, calling_msisdn string, called_msisdn string, imei string, cell_id string, ts_local string, duration_s int, sms_len int, source_version string"
MESSAGE = "msg_id string, imei string, subscriber_msisdn string, direction string, peer string, app string, ts_utc string, body string, source_version string"
ACCOUNT = ["account_id", "iban", "holder_name", "holder_type", "bic", "opened_date", "source_version"]
TRANSACTION = ["txn_id", "booking_ts_utc", "value_date", "debtor_name", "debtor_iban", "debtor_bic", "creditor_name", "creditor_iban", "creditor_bic", "amount_text", "currency", "status", "remittance_info", "source_version"]


@dataclass
class SourceBatch:
    """What a source gives: its records and its typed rows; each has source_ord, so that unions keep the order."""

    records: DataFrame
    communications: DataFrame | None = None
    accounts: DataFrame | None = None
    transactions: DataFrame | None = None


def mapped(value: Column, table: dict[str, str], what: str) -> Column:
    """A lookup in which an unknown value is an error."""
    out = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null"))))
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def envelope(df: DataFrame, system: str, local: str, kind: str, when: Column, original: Column, text: Column, normalized: dict[str, Column], raw: list[str]) -> DataFrame:
    """P-01, T-18: the ten columns of a record; the payload keeps the raw fields and what was made of them."""
    payload = F.to_json(F.struct(*raw, F.struct(*[c.alias(n) for n, c in normalized.items()]).alias("normalized")))
    return df.select(
        record_id(F.lit(system), F.col(local)).alias("record_id"), F.lit(system).alias("source_system"), F.col(local).alias("source_record_id"), F.lit(kind).alias("record_type"), F.col("_path").alias("source_path"),
        when.alias("event_time_utc"), original.alias("original_time"), text.alias("text"), payload.alias("payload"), content_hash(**{c: F.col(c) for c in raw}).alias("content_hash"), F.lit(ORDER.index(system)).alias("source_ord"),
    )


def is_prose(df: DataFrame) -> DataFrame:
    """P-03."""
    return df.filter(F.col("record_type").isin(*PROSE) & (F.length("text") > 0))


def _comms(df: DataFrame, system: str, local: str, channel: Column, direction: Column, sender: Column, receiver: Column, when: Column, original: str, duration: Column, device: Column) -> DataFrame:
    """P-02."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return df.select(record_id(F.lit(system), F.col(local)).alias("record_id"), channel.alias("channel"), direction.alias("direction"), sender.alias("from_endpoint"), receiver.alias("to_endpoint"), when.alias("event_time_utc"), F.col(original).alias("original_time"), duration.cast("int").alias("duration_s"), blank(device).alias("device_id"))


def read_cdr(spark: SparkSession, path: str) -> SourceBatch:
    """S-01: calls and short messages from CSV; an unknown kind is an error, blank devices and durations are null."""
    df = spark.read.csv(path, header=True, schema=CDR).withColumn("_path", F.col("_metadata.file_path"))
    kind = F.col("record_type")
    channel = mapped(kind, {"MOC": "call", "MTC": "call", "SMS-MO": "sms", "SMS-MT": "sms"}, "record_type")
    direction = mapped(kind, {"MOC": "out", "SMS-MO": "out", "MTC": "in", "SMS-MT": "in"}, "record_type")
    when, a, b = to_utc("ts_local"), normalize_phone("calling_msisdn"), normalize_phone("called_msisdn")
    raw = [c for c in df.columns if c != "_path"]
    records = envelope(df, "cdr", "record_id", "cdr", when, F.col("ts_local"), F.lit(None).cast("string"), {"from": a, "to": b, "channel": channel, "direction": direction}, raw)
    return SourceBatch(records, _comms(df, "cdr", "record_id", channel, direction, a, b, when, "ts_local", F.col("duration_s"), F.col("imei")))


def read_messages(spark: SparkSession, path: str) -> SourceBatch:
    """S-02: a device's messages from JSON lines; the direction tells who sent."""
    df = spark.read.json(path, schema=MESSAGE).filter("msg_id is not null").withColumn("_path", F.col("_metadata.file_path"))
    mine, peer, out = normalize_phone("subscriber_msisdn"), normalize_phone("peer"), F.col("direction") == "out"
    a, b = F.when(out, mine).otherwise(peer), F.when(out, peer).otherwise(mine)
    when = to_utc("ts_utc")
    records = envelope(df, "extraction", "msg_id", "extraction_message", when, F.col("ts_utc"), F.col("body"), {"from": a, "to": b}, [c for c in df.columns if c != "_path"])
    return SourceBatch(records, _comms(df, "extraction", "msg_id", F.col("app"), F.col("direction"), a, b, when, "ts_utc", F.lit(None), F.col("imei")))


def read_mail(spark: SparkSession, path: str, glob: str = "*.eml") -> SourceBatch:
    """S-03: messages of RFC 822, one a file; five headers and one part of plain text are required."""
    import email
    from email import policy

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                m = email.message_from_bytes(raw, policy=policy.compat32)
                need = ["From", "To", "Date", "Subject", "X-Source-Record-ID"]
                lacking = [h for h in need if not m.get(h)]
                if lacking or m.is_multipart() or m.get_content_type() != "text/plain":
                    raise ValueError(f"email_header_error in {p}: {lacking or m.get_content_type()}")
                body = m.get_payload(decode=True).decode(m.get_content_charset() or "utf-8").rstrip("\r\n")
                rows.append((p, *[str(m[h]) for h in need], m.get("X-Source-Version"), body))
            yield pd.DataFrame(rows, columns=["_path", "sender", "receiver", "date", "subject", "local_id", "source_version", "body"])

    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    df = df.mapInPandas(parse, "_path string, sender string, receiver string, date string, subject string, local_id string, source_version string, body string")
    bare = lambda c: normalize_email(F.regexp_extract(F.col(c), r"([^\s<>]+@[^\s<>]+)", 1))
    when = rfc2822_to_utc("date")
    text = F.concat(F.col("subject"), F.lit("\n\n"), F.col("body"))
    records = envelope(df, "email", "local_id", "email", when, F.col("date"), text, {"from": bare("sender"), "to": bare("receiver")}, [c for c in df.columns if c != "_path"])
    return SourceBatch(records, _comms(df, "email", "local_id", F.lit("email"), F.lit(None).cast("string"), bare("sender"), bare("receiver"), when, "date", F.lit(None), F.lit(None).cast("string")))


TUPLE = r"\((?:[^'()]|'(?:[^']|'')*')*\)"
VALUE = r"'(?:[^']|'')*'|[^,'\s()]+"


def insert_rows(script: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """S-04: rows of a table's INSERT statements in order, by pattern alone: nothing of the script is run."""
    body = F.regexp_extract_all("value", F.lit(rf"(?is)INSERT\s+INTO\s+(?:\w+\.)?{target}\b[^;]*?VALUES\s*((?:\s*,?\s*{TUPLE})+)\s*;"), F.lit(1))
    rows = script.select("_path", F.posexplode(F.flatten(F.transform(body, lambda s: F.regexp_extract_all(s, F.lit(TUPLE), F.lit(0))))).alias("ordinal", "t"))
    values = F.regexp_extract_all(F.expr("substring(t, 2, length(t) - 2)"), F.lit(VALUE), F.lit(0))
    clean = F.transform(values, lambda v: F.when(F.upper(v) == "NULL", F.lit(None)).when(v.startswith("'"), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))).otherwise(v))
    rows = rows.withColumn("v", clean)
    return rows.select("_path", "ordinal", *[F.try_element_at("v", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def read_bank(spark: SparkSession, path: str) -> SourceBatch:
    """S-04: accounts and transactions of a bank's SQL script, in insertion order."""
    script = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    a, t = insert_rows(script, "accounts", ACCOUNT), insert_rows(script, "transactions", TRANSACTION)
    opened, booked = F.to_date("opened_date"), to_utc(F.regexp_replace("booking_ts_utc", " ", "T"))
    minor = money_to_minor_units("amount_text", "currency")
    iban, debtor, creditor = normalize_iban("iban"), normalize_iban("debtor_iban"), normalize_iban("creditor_iban")
    none = F.lit(None).cast("string")
    records = envelope(a, "bank", "account_id", "account", date_to_utc("opened_date"), F.col("opened_date"), none, {"iban": iban}, ACCOUNT)
    records = records.unionByName(envelope(t, "bank", "txn_id", "transaction", booked, F.col("booking_ts_utc"), F.col("remittance_info"), {"debtor_iban": debtor, "creditor_iban": creditor, "amount_minor": minor}, TRANSACTION))
    accounts = a.select(record_id(F.lit("bank"), F.col("account_id")).alias("record_id"), "account_id", iban.alias("iban"), "holder_name", "holder_type", "bic", opened.alias("opened_date"))
    moved = t.select(record_id(F.lit("bank"), F.col("txn_id")).alias("record_id"), "txn_id", booked.alias("booking_ts_utc"), F.to_date("value_date").alias("value_date"), debtor.alias("debtor_iban"), "debtor_name", creditor.alias("creditor_iban"), "creditor_name", minor.alias("amount_minor"), "amount_text", "currency", "status", "remittance_info")
    return SourceBatch(records, accounts=accounts, transactions=moved)


def front_matter(value: Column) -> tuple[Column, Column]:
    """S-05: fields and body of a text that begins with a block between two lines of three hyphens; without a closed block an error."""
    form = r"(?s)^---\n(.*?)\n---\n(.*)$"
    head = F.when(value.rlike(form), F.regexp_extract(value, form, 1)).otherwise(F.raise_error(F.lit("unsupported_format: no front matter")))
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\w+\s*:"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(x.substr(F.length(F.substring_index(x, ":", 1)) + 2, F.length(x))), "^[\"']|[\"']$", "").alias("value"))
    return F.map_from_entries(F.transform(pairs, entry)), F.regexp_replace(F.regexp_extract(value, form, 2), "^\n+", "")


def read_documents(spark: SparkSession, path: str, glob: str = "*.md") -> SourceBatch:
    """S-05: Markdown with front matter; the id is document_id, or the file's stem."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select("value", F.col("_metadata.file_path").alias("_path"))
    fields, body = front_matter(F.col("value"))
    df = df.select("_path", fields.alias("f"), body.alias("body"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    raw = ["document_id", "document_date", "genre", "source_reliability", "source_version"]
    df = df.select("_path", "body", *[get(k).alias(k) for k in raw]).withColumn("document_id", F.coalesce("document_id", F.regexp_extract("_path", r"([^/]+)\.md$", 1)))
    return SourceBatch(envelope(df, "docs", "document_id", "document", date_to_utc("document_date"), F.col("document_date"), F.col("body"), {"date": F.col("document_date")}, raw))


READERS = {"cdr": (read_cdr, "cdr.csv"), "extraction": (read_messages, "extraction.jsonl"), "email": (read_mail, "emails"), "bank": (read_bank, "bank.sql"), "docs": (read_documents, "docs")}


def read_manifest(spark: SparkSession, path: str) -> dict:
    """S-06."""
    row = spark.read.json(path, multiLine=True).first()
    m = row.asDict(recursive=True) if row else {}
    totals = m.get("source_totals")
    if not isinstance(m.get("dataset_version"), str) or not isinstance(m.get("language"), str) or not isinstance(totals, dict) or not all(type(v) is int for v in totals.values()):
        raise ValueError("manifest: dataset_version, language and whole source_totals are required")
    return m


def edition_files(spark: SparkSession, root: str, edition: str) -> DataFrame:
    """S-07, S-09: raw files of an edition with their digests; odd names are errors, and so is an edition without any."""
    if not re.fullmatch(r"[a-z0-9_-]+", edition):
        raise ValueError("edition name")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{edition}/raw")
    name = F.regexp_extract("path", rf"/{edition}/raw/(.*)$", 1)
    bad = name.contains("..") | name.contains("\\") | (name == "")
    out = files.select(F.when(bad, F.raise_error(F.concat(F.lit("path outside the edition: "), F.col("path")))).otherwise(name).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    return out.filter(~F.coalesce(F.split("name", "/")[0].isin(*EXCLUDED), F.lit(False)))


def read_edition(spark: SparkSession, raw: str, sources: list[str] | None = None) -> dict[str, DataFrame]:
    """S-08: all sources in the fixed order, united; an unknown one is an error."""
    if unknown := set(sources or []) - set(ORDER):
        raise KeyError(f"unknown sources: {sorted(unknown)}")
    batches = [READERS[s][0](spark, f"{raw}/{READERS[s][1]}") for s in ORDER if sources is None or s in sources]
    unite = lambda name: [getattr(b, name) for b in batches if getattr(b, name) is not None]
    return {n: reduce(DataFrame.unionByName, parts) for n in ("records", "communications", "accounts", "transactions") if (parts := unite(n))}
