"""Scalar functions on columns: normalisation, identities, hashes, check digits.

A value that a rule rejects becomes null, never an exception: quarantine (T-17) tells the reasons.
"""

from __future__ import annotations

import hashlib
import json
import random
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: decimal places of the currencies.
CURRENCY_SCALE = {"EUR": 2, "USD": 2, "GBP": 2, "CHF": 2, "JPY": 0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_phone(c: Column | str) -> Column:
    """F-01: digits without a leading 00; ten digits from 2 or 6 get the country's 30; 11 to 15 digits stand as they are."""
    d = F.regexp_replace(F.regexp_replace(_col(c), r"\D", ""), "^00", "")
    return F.when(d.rlike("^[26][0-9]{9}$"), F.concat(F.lit("30"), d)).when(d.rlike("^[0-9]{11,15}$"), d)


def normalize_email(c: Column | str) -> Column:
    """F-02: trimmed and lower-cased, with an @. (Full case folding differs for a few letters such as sharp s.)"""
    e = F.lower(F.trim(_col(c)))
    return F.when(e.contains("@"), e)


def normalize_iban(c: Column | str) -> Column:
    """F-03: no white space, upper case, at least 15 signs, two letters first."""
    i = F.upper(F.regexp_replace(_col(c), r"\s", ""))
    return F.when((F.length(i) >= 15) & i.rlike(r"^\p{L}{2}"), i)


def normalize_imei(c: Column | str) -> Column:
    """F-04: exactly 15 digits after everything else is removed."""
    d = F.regexp_replace(_col(c), r"\D", "")
    return F.when(F.length(d) == 15, d)


def normalize_invoice_ref(c: Column | str) -> Column:
    """F-05."""
    return F.upper(F.regexp_replace(_col(c), r"\s", ""))


def money_to_minor_units(amount: Column | str, currency: Column | str) -> Column:
    """F-06: exact minor units of an amount in text; unknown currencies and excess decimal places are null.

    Digits are moved as text, so no value is ever rounded.
    """
    a = F.replace(F.trim(_col(amount)), F.lit(","), F.lit(""))
    scale = F.lit(None).cast("int")
    for code, places in CURRENCY_SCALE.items():
        scale = F.when(_col(currency) == code, places).otherwise(scale)
    plain = a.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$|^[+-]?\.[0-9]+$")
    whole = F.regexp_replace(F.regexp_replace(a, r"\..*$", ""), "[+-]", "")
    part = F.regexp_replace(F.regexp_extract(a, r"\.([0-9]*)$", 1), "0+$", "")
    digits = F.concat(whole, F.rpad(part, scale, "0")).try_cast("bigint")
    return F.when(plain & (F.length(part) <= scale), F.when(a.startswith("-"), -digits).otherwise(digits))


def to_utc(c: Column | str) -> Column:
    """F-07: an ISO-8601 instant; without an offset it is rejected."""
    return F.when(_col(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), _col(c).try_cast("timestamp"))


def rfc2822_to_utc(c: Column | str) -> Column:
    """F-08: an e-mail's Date header; the weekday is not read."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    return F.try_to_timestamp(F.regexp_replace(bare, "GMT$|UT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))


def date_to_utc(c: Column | str) -> Column:
    """F-09: an ISO date as its midnight in UTC."""
    return F.when(_col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), _col(c).try_cast("date")).cast("timestamp")


def label_slug(c: Column | str) -> Column:
    """F-10: lower case, each run of other signs than a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def record_id(system: Column | str, local: Column | str) -> Column:
    """F-11."""
    return F.concat_ws(":", _col(system), _col(local))


def entity_id(entity_type: Column, key: Column, scope: Column, label: Column) -> Column:
    """F-11: TYPE:key for keyed types, else TYPE:record:slug, so that names alone never merge actors."""
    return F.when(key.isNotNull(), F.concat_ws(":", entity_type, key)).otherwise(F.concat_ws(":", entity_type, scope, label_slug(label)))


def relationship_id(subject: Column, predicate: Column, obj: Column, source_record: Column) -> Column:
    """F-11: the first 32 hex digits of a hash of the four parts."""
    return F.substring(F.sha2(F.concat_ws("|", subject, predicate, obj, source_record), 256), 1, 32)


def chunk_id(record: Column, start: Column, end: Column) -> Column:
    """F-11."""
    return F.concat(record, F.lit("#"), start.cast("string"), F.lit("-"), end.cast("string"))


def content_hash(**fields: Column) -> Column:
    """F-12: a digest of the fields as JSON with sorted names, in raw UTF-8; nulls are written."""
    packed = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)


def line_hash(*columns: Column) -> Column:
    """F-13: a digest of an ordered row as a JSON array and a line feed."""
    return F.sha2(F.concat(F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"}), F.lit("\n")), 256)


def canonical_json(value: Any, ascii_only: bool = False) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, default=str)


def fingerprint(value: Any, ascii_only: bool = False) -> str:
    """F-14 and F-15 on the driver: a digest of canonical JSON, raw or ASCII-escaped."""
    return hashlib.sha256(canonical_json(value, ascii_only).encode()).hexdigest()


def query_fingerprint(query: str, sources: list[str] | None = None, since: datetime | None = None, until: datetime | None = None) -> str:
    """F-16: the query's words, the sources as a sorted set and the bounds; how many rows are asked for plays no part."""
    stamp = lambda t: t.isoformat() if t else None
    return fingerprint({"query": " ".join(query.split()).casefold(), "sources": sorted(set(sources or [])), "from": stamp(since), "to": stamp(until)})


def run_fingerprint(manifest: bytes, *parts: str | int) -> str:
    """F-17: a digest of the manifest's digest and the settings that shape a run's output."""
    return hashlib.sha256("\0".join([hashlib.sha256(manifest).hexdigest(), *map(str, parts)]).encode()).hexdigest()


def stable_id(*parts: Column) -> Column:
    """F-18: the first 32 hex digits of a digest of parts with NUL between them."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def luhn_check_digit(c: Column | str) -> Column:
    """F-19: the digit that completes 14; every second one counts twice."""
    d = _col(c)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i + 1, F.lit(1)).try_cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(13)), F.lit(0), add)
    return F.when(d.rlike("^[0-9]{14}$"), (10 - total % 10) % 10)


def iban_mod97(c: Column | str) -> Column:
    """F-20: the remainder of the rearranged number; 1 for a valid IBAN. Carried from sign to sign, so any length fits."""
    i = F.upper(F.regexp_replace(_col(c), r"\s", ""))
    turned = F.concat(F.substring(i, F.lit(5), F.length(i)), F.substring(i, 1, 4))

    def step(a: Column, s: Column) -> Column:
        digit = s.between("0", "9")
        return F.when(s == "", a).otherwise((a * F.when(digit, 10).otherwise(100) + F.ascii(s) - F.when(digit, 48).otherwise(55)) % 97)

    return F.when(i.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.aggregate(F.split(turned, ""), F.lit(0), step))


def delimited(text: Column, suspicious: Column, limit: int = 32_768) -> Column:
    """F-22: text between tags that say whether it is suspicious, with the tags within the limit and a mark where it was cut."""
    label = F.when(suspicious, "untrusted_evidence").otherwise("evidence")
    mark = "\n[trimmed]"
    room = F.lit(limit) - 2 * F.length(label) - 5
    cut = F.when(F.length(text) > room, F.concat(F.substring(text, F.lit(1), room - len(mark)), F.lit(mark))).otherwise(text)
    return F.concat(F.lit("<"), label, F.lit(">"), cut, F.lit("</"), label, F.lit(">"))


def visible_text(content: Column, fields: Column) -> Column:
    """F-23: the content and a line for each field."""
    lines = F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), f["value"].cast("string")))
    return F.array_join(F.filter(F.concat(F.array(content), lines), lambda x: x.isNotNull()), "\n")


def backoff_delay(attempt: int, initial: float, factor: float, most: float, jitter: bool = False, rng: random.Random | None = None) -> float:
    """F-24."""
    delay = min(most, initial * factor ** (attempt - 1))
    return delay * (0.5 + (rng or random).random() / 2) if jitter else delay


def finite_vector(c: Column | str) -> Column:
    """F-25: not empty and every component finite."""
    v = _col(c)
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def nested_value(payload: Column | str, path: str) -> Column:
    """F-26: the value at a dotted path of a JSON text."""
    return F.get_json_object(_col(payload), "$." + path)


def network_roles(direction: Column, subscriber: Column, peer: Column) -> Column:
    """F-29: who sent and who received, by the device's direction."""
    out = direction == "out"
    return F.struct(F.when(out, subscriber).otherwise(peer).alias("sender"), F.when(out, peer).otherwise(subscriber).alias("receiver"))


def render_hop(left: Column, right: Column, predicate: Column, status: Column, edge: Column, forward: Column) -> Column:
    """F-30: one hop as text; the arrow shows the edge's own direction."""
    inner = F.format_string("[%s; %s; id=%s]", predicate, status, edge)
    return F.when(forward, F.concat(left, F.lit(" -"), inner, F.lit("-> "), right)).otherwise(F.concat(left, F.lit(" <-"), inner, F.lit("- "), right))


def minor_division(a: Column, b: Column) -> Column:
    """F-27: whole-number division cuts toward zero in the policy's dialect."""
    return F.when(b != 0, F.try_divide(a - F.try_mod(a, b), b).cast("bigint"))
