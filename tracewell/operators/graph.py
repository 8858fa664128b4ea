"""Entities and relationships from records, candidate validation, and bounded path search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.scalar import label_slug, relationship_id
from ..functions.text import grounded, identifier_key
from ..plans.lineage import cut


def united_refs(drafts: DataFrame, key: str) -> DataFrame:
    """key, source_refs: distinct references in first-seen order.

    Repeated references meet in a pre-aggregated minimum first, so what is gathered for a hot key is its result and no more.
    """
    first = drafts.select(key, "seq", F.posexplode("source_refs").alias("_p", "_ref")).groupBy(key, "_ref").agg(F.min(F.struct("seq", "_p")).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ref"))), lambda x: x["_ref"]).alias("source_refs"))


def merged_entities(drafts: DataFrame) -> DataFrame:
    """A-01, A-02: one row per entity_id; the first draft by seq gives label, type and key, references unite in first-seen order."""
    first = drafts.groupBy("entity_id").agg(F.min(F.struct("seq", "entity_type", "label", "normalized_key")).alias("_f"), F.count(F.lit(1)).alias("mentions"))
    out = first.join(united_refs(drafts, "entity_id"), "entity_id", "left")
    refs = F.coalesce("source_refs", F.array().cast(drafts.schema["source_refs"].dataType))
    return out.select("entity_id", "_f.entity_type", "_f.label", "_f.normalized_key", refs.alias("source_refs"), "mentions")


def merged_relationships(drafts: DataFrame) -> DataFrame:
    """A-03: one row per relationship_id, the first by seq, with the references of all."""
    others = [c for c in drafts.columns if c not in ("relationship_id", "source_refs", "seq")]
    first = drafts.groupBy("relationship_id").agg(*[F.min_by(c, "seq").alias(c) for c in others])
    refs = F.coalesce("source_refs", F.array().cast(drafts.schema["source_refs"].dataType))
    return first.join(united_refs(drafts, "relationship_id"), "relationship_id", "left").withColumn("source_refs", refs)


def _entity(kind: Column, key: Column, label: Column, record: Column, field: str, seq: Column) -> Column:
    """An entity draft of a keyed type, or scoped to its record where the key is null."""
    from ..functions.scalar import entity_id

    return F.struct(entity_id(kind, key, record, label).alias("entity_id"), kind.alias("entity_type"), label.alias("label"), key.alias("normalized_key"), F.array(S.source_ref(record, S.field_locator(field))).alias("source_refs"), seq.alias("seq"))


def communication_edges(comms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X-08: both endpoints (and the device, without an edge) and who communicated with whom."""
    kind = F.when(F.col("channel") == "email", "EMAIL_ADDRESS").otherwise("PHONE")
    r, seq = F.col("record_id"), F.col("record_id")
    ends = F.array(_entity(kind, F.col("from_endpoint"), F.col("from_endpoint"), r, "from_endpoint", seq), _entity(kind, F.col("to_endpoint"), F.col("to_endpoint"), r, "to_endpoint", seq), F.when(F.col("device_id").isNotNull(), _entity(F.lit("DEVICE"), F.col("device_id"), F.col("device_id"), r, "device_id", seq)))
    entities = comms.select(F.explode(F.array_compact(ends)).alias("e")).select("e.*")
    subject, obj = F.concat_ws(":", kind, "from_endpoint"), F.concat_ws(":", kind, "to_endpoint")
    edges = comms.select(
        relationship_id(subject, F.lit("COMMUNICATED_WITH"), obj, r).alias("relationship_id"), subject.alias("subject_id"), F.lit("COMMUNICATED_WITH").alias("predicate"), obj.alias("object_id"),
        F.lit("confirmed").alias("status"), F.lit("deterministic").alias("method"), F.col("event_time_utc").alias("occurred_at"), F.to_json(F.struct("channel", "direction")).alias("attributes"), r.alias("source_record_id"),
        F.array(S.source_ref(r, S.field_locator("from_endpoint")), S.source_ref(r, S.field_locator("to_endpoint"))).alias("source_refs"), seq.alias("seq"),
    )
    return entities, edges


def _edge(subject: Column, predicate: str, obj: Column, at: Column, attributes: Column, record: Column, fields: Sequence[str]) -> list[Column]:
    refs = F.array(*[S.source_ref(record, S.field_locator(f)) for f in fields])
    return [
        relationship_id(subject, F.lit(predicate), obj, record).alias("relationship_id"), subject.alias("subject_id"), F.lit(predicate).alias("predicate"), obj.alias("object_id"), F.lit("confirmed").alias("status"),
        F.lit("deterministic").alias("method"), at.alias("occurred_at"), attributes.alias("attributes"), record.alias("source_record_id"), refs.alias("source_refs"), record.alias("seq"),
    ]


def account_edges(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X-09: the account, and who holds it where a holder of a known type is named."""
    r = F.col("record_id")
    holder = F.col("holder_name").isNotNull() & F.col("holder_type").isin("person", "organization")
    kind = F.upper("holder_type")
    both = F.array(_entity(F.lit("FINANCIAL_ACCOUNT"), F.col("iban"), F.col("iban"), r, "iban", r), F.when(holder, _entity(kind, F.lit(None).cast("string"), F.col("holder_name"), r, "holder_name", r)))
    entities = accounts.select(F.explode(F.array_compact(both)).alias("e")).select("e.*")
    obj = F.concat_ws(":", kind, r, label_slug("holder_name"))
    edges = accounts.filter(holder).select(*_edge(F.concat(F.lit("FINANCIAL_ACCOUNT:"), "iban"), "HELD_BY", obj, F.col("opened_date").cast("timestamp"), F.to_json(F.struct("account_id")), r, ["iban", "holder_name"]))
    return entities, edges


def transaction_edges(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X-10: transfers between accounts, and the invoices that a remittance names. Only the JVM is needed for those."""
    r = F.col("record_id")
    account = lambda c: F.concat(F.lit("FINANCIAL_ACCOUNT:"), F.col(c))
    refs = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("remittance_info", F.lit("")), F.lit(r"(?i)\bINV-\d{3,8}\b"), F.lit(0)), F.upper))
    t = transactions.withColumn("_inv", refs)
    ends = F.array(_entity(F.lit("FINANCIAL_ACCOUNT"), F.col("debtor_iban"), F.col("debtor_iban"), r, "debtor_iban", r), _entity(F.lit("FINANCIAL_ACCOUNT"), F.col("creditor_iban"), F.col("creditor_iban"), r, "creditor_iban", r), _entity(F.lit("TRANSACTION"), F.col("txn_id"), F.col("txn_id"), r, "txn_id", r))
    invoices = F.transform("_inv", lambda i: _entity(F.lit("INVOICE_REF"), i, i, r, "remittance_info", r))
    entities = t.select(F.explode(F.concat(ends, invoices)).alias("e")).select("e.*")
    moved = t.select(*_edge(account("debtor_iban"), "TRANSFERRED_TO", account("creditor_iban"), F.col("booking_ts_utc"), F.to_json(F.struct("txn_id", "amount_minor", "currency")), r, ["debtor_iban", "creditor_iban"]))
    named = t.withColumn("_i", F.explode("_inv")).select(*_edge(F.concat(F.lit("TRANSACTION:"), "txn_id"), "REFERENCES", F.concat(F.lit("INVOICE_REF:"), "_i"), F.col("booking_ts_utc"), F.to_json(F.struct("txn_id")), r, ["remittance_info"]))
    return entities, moved.unionByName(named)


def identifier_entities(spans: DataFrame, offset: Column | int = 0) -> DataFrame:
    """X-07: an entity for each identifier span of prose, shifted by where its chunk starts."""
    shift = F.lit(offset) if isinstance(offset, int) else offset
    ref = F.array(S.source_ref(F.col("record_id"), S.span_locator("text", F.col("char_start") + shift, F.col("char_end") + shift, F.col("raw"))))
    return spans.select(F.concat_ws(":", "entity_type", "identifier").alias("entity_id"), "entity_type", F.col("raw").alias("label"), F.col("identifier").alias("normalized_key"), ref.alias("source_refs"), F.struct("record_id", "char_start").alias("seq"))


def entity_outcomes(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """X-04, X-05, X-12: outcome of each candidate (chunk_id, seq, chunk, entity_type, quote, char_start, char_end).

    In this order: the span must stand in the text, must not hold an identifier that a rule owns, and the type must be one
    that a model may propose. spans: chunk_id and raw of the rules' identifiers.
    """
    owned = spans.groupBy("chunk_id").agg(F.collect_set("raw").alias("_owned"))
    c = candidates.join(owned, "chunk_id", "left").withColumn("span", grounded(F.col("chunk"), F.col("quote"), F.col("char_start"), F.col("char_end")))
    covered = F.coalesce(F.exists("_owned", lambda r: F.col("quote").contains(r)), F.lit(False))
    result = F.when(F.col("span").isNull(), "rejected_span").when(covered, "superseded_by_rule").when(~F.col("entity_type").isin(S.MODEL_TYPES), "rejected_type").otherwise("accepted")
    return c.withColumn("outcome", result).drop("_owned")


def resolved_endpoint(candidates: DataFrame, entities: DataFrame, kind: str, text: str, out: str) -> DataFrame:
    """J-10: the entity that an endpoint names: by its identifier's key, else by its label's slug, else by an alias's; labels before aliases, first seen first."""
    key = identifier_key(F.col(kind), F.col(text))
    labels = entities.select(F.col("chunk_id").alias("_c"), F.col("entity_type").alias("_t"), label_slug("label").alias("_s"), F.lit(0).alias("_p"), "seq", "entity_id")
    aliases = entities.select("chunk_id", "entity_type", F.explode("aliases").alias("a"), "seq", "entity_id").select(F.col("chunk_id").alias("_c"), F.col("entity_type").alias("_t"), label_slug("a").alias("_s"), F.lit(1).alias("_p"), "seq", "entity_id")
    known = labels.unionByName(aliases).groupBy("_c", "_t", "_s").agg(F.min_by("entity_id", F.struct("_p", "seq")).alias("_e"))
    joined = candidates.join(known, (F.col("chunk_id") == F.col("_c")) & (F.col(kind) == F.col("_t")) & (label_slug(text) == F.col("_s")), "left")
    return joined.withColumn(out, F.coalesce(F.when(key.isNotNull(), F.concat_ws(":", F.col(kind), key)), F.col("_e"))).drop("_c", "_t", "_s", "_e")


def relationship_outcomes(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """X-06: span, then predicate and endpoint types, then both endpoints known and different; repeated ones are dropped, not counted."""
    c = resolved_endpoint(resolved_endpoint(candidates, entities, "subject_type", "subject", "subject_id"), entities, "object_type", "object", "object_id")
    c = c.withColumn("span", grounded(F.col("chunk"), F.col("quote"), F.col("char_start"), F.col("char_end")))
    allowed = F.col("predicate").isin(S.MODEL_PREDICATES) & S.endpoint_types_allowed(F.col("predicate"), F.col("subject_type"), F.col("object_type"))
    ends = F.col("subject_id").isNotNull() & F.col("object_id").isNotNull() & (F.col("subject_id") != F.col("object_id"))
    result = F.when(F.col("span").isNull(), "rejected_span").when(~allowed, "rejected_type").when(~ends, "rejected_endpoint").otherwise("accepted")
    c = c.withColumn("outcome", F.coalesce(result, F.lit("rejected_endpoint"))).withColumn("relationship_id", relationship_id(F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("chunk_id")))
    first = c.filter("outcome = 'accepted'").groupBy("relationship_id").agg(F.min("seq").alias("seq"))
    kept = c.filter("outcome = 'accepted'").join(first, ["relationship_id", "seq"], "left_semi")
    return c.filter("outcome <> 'accepted'").unionByName(kept)


def outcome_counts(*outcomes: tuple[str, DataFrame]) -> DataFrame:
    """A-04."""
    parts = [o.select(F.lit(kind).alias("kind"), "outcome") for kind, o in outcomes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def alias_union(accepted: DataFrame, aliases: DataFrame) -> DataFrame:
    """J-11: aliases proposed for an accepted (type, label), united in first-seen order."""
    order = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "aliases"))), lambda x: x["aliases"])))
    return accepted.join(aliases.groupBy("entity_type", "label").agg(order.alias("all_aliases")), ["entity_type", "label"], "left")


def edge_filters(edges: DataFrame, statuses: Sequence[str] = (), predicates: Sequence[str] = (), since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """P-05: empty lists let all through; a time bound leaves edges without a time out."""
    if statuses:
        edges = edges.filter(F.col("status").isin(*statuses))
    if predicates:
        edges = edges.filter(F.col("predicate").isin(*predicates))
    if since is not None:
        edges = edges.filter(F.col("occurred_at") >= F.lit(since))
    if until is not None:
        edges = edges.filter(F.col("occurred_at") <= F.lit(until))
    return edges


def touching(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """J-05: edges with either end in the frontier (id): two equi-joins and a distinct, never a join on OR."""
    f = frontier.select(F.col("id").alias("_f")).distinct()
    a = edges.join(f, edges.subject_id == F.col("_f"), "left_semi")
    b = edges.join(f, edges.object_id == F.col("_f"), "left_semi")
    return a.unionByName(b).dropDuplicates(["relationship_id"])


def resolving(items: DataFrame, key: str, records: DataFrame) -> DataFrame:
    """P-07, P-08, J-08, S-17: items all of whose source_refs resolve; one bad reference drops the item."""
    refs = items.select(key, F.explode("source_refs").alias("_ref")).select(key, F.col("_ref.record_id").alias("record_id"), F.col("_ref.locator").alias("_loc"))
    text = records.select("record_id", F.col("text").alias("_text"), F.col("payload").alias("_payload"))
    ok = refs.join(text, "record_id", "left").withColumn("_ok", locator_resolves(F.col("_loc"), F.col("_text"), F.col("_payload")))
    good = ok.groupBy(key).agg(F.every("_ok").alias("_all")).filter("_all").select(key)
    return items.join(good, key, "left_semi")


def locator_resolves(loc: Column, text: Column, payload: Column) -> Column:
    """P-07: a known field; a span must be the slice of the text or of a string of the payload."""
    path = F.concat(F.lit("$."), loc["field"])
    value = F.when(loc["field"] == "text", text).otherwise(F.try_variant_get(F.try_parse_json(payload), path, "string"))
    slice_ = F.substring(value, loc["char_start"] + 1, loc["char_end"] - loc["char_start"]) == loc["quote"]
    known = loc["field"].isin("text", "payload") | F.array_contains(F.json_object_keys(payload), loc["field"])
    return F.coalesce(F.when(loc["kind"] == "field", known).when(loc["kind"] == "text_span", slice_ & S.locator_valid(loc)), F.lit(False))


@dataclass(frozen=True)
class Limits:
    """G-01: the effective limits are the smaller of what is asked and what the server allows."""

    depth: int = 4
    paths: int = 50
    nodes: int = 100
    edges: int = 200
    rows: int = 256

    def capped(self, asked: Limits) -> tuple[Limits, bool]:
        names = ("depth", "paths", "nodes", "edges", "rows")
        new = Limits(*[min(getattr(self, n), getattr(asked, n)) for n in names])
        return new, new != asked


@dataclass
class Connections:
    """paths (nodes, edges: arrays of ids), the nodes and edges that they use, warnings, and rows taken from the budget."""

    paths: DataFrame
    nodes: DataFrame
    edges: DataFrame
    warnings: list[str]
    rows: int


def _first(df: DataFrame, key: str, n: int) -> DataFrame:
    """O-05: the n first rows by id, cut off from what they came from."""
    return cut(df.orderBy(key).limit(max(n, 0)))


def _longer(active: DataFrame, hop: DataFrame, known: DataFrame) -> DataFrame:
    """G-05: each path with each edge at its tip that leads to a known node not yet in it; before_*: the path it came from."""
    ways = hop.select(F.col("subject_id").alias("_tip"), F.col("object_id").alias("_to"), "relationship_id").unionByName(hop.select(F.col("object_id").alias("_tip"), F.col("subject_id").alias("_to"), "relationship_id"))
    ends = known.select(F.col("entity_id").alias("_to"), F.col("entity_type").alias("to_type"))
    grown = active.join(ways, F.element_at("nodes", -1) == F.col("_tip")).filter(~F.array_contains("nodes", F.col("_to"))).join(ends, "_to")
    return grown.select(F.col("nodes").alias("before_nodes"), F.col("edges").alias("before_edges"), "relationship_id", "to_type", F.array_append("nodes", F.col("_to")).alias("nodes"), F.array_append("edges", F.col("relationship_id")).alias("edges")).distinct()


_ORDER = ["before_nodes", "before_edges", "relationship_id"]


def _within_edges(grown: DataFrame, used: DataFrame | None, room: int) -> DataFrame:
    """The edge cap: in order, rows up to the one that uses the last edge for which there is room."""
    new = grown if used is None else grown.join(used, "relationship_id", "left_anti")
    if new.select("relationship_id").distinct().count() < room:
        return grown
    # No more rows than the caps let through: a page, so one task may number them.
    placed = grown.withColumn("_place", F.row_number().over(Window.orderBy(*_ORDER)))
    fresh = placed if used is None else placed.join(used, "relationship_id", "left_anti")
    last = fresh.groupBy("relationship_id").agg(F.min("_place").alias("_place")).orderBy("_place").limit(room).agg(F.max("_place")).first()[0]
    return placed.filter(F.col("_place") <= last).drop("_place")


def find_connections(nodes: DataFrame, edges: DataFrame, seeds: Sequence[str], limits: Limits, server: Limits | None = None, targets: Sequence[str] = ()) -> Connections:
    """G-01 to G-10, O-05: simple undirected paths from the seeds, hop by hop, within limits on everything.

    A hop is three joins: edges at the tips of the paths, nodes at their other ends, and paths with both. Each cap is the
    first so many rows by id, or by path and edge, of a join, and a hop's rows are cut off from the tables they came from,
    so what the next hop works on is bounded by the limits whatever the graph. Only counts come to the driver.
    """
    limits, was_capped = (server or Limits()).capped(limits)
    known = _first(nodes.filter(F.col("entity_id").isin(*sorted(set(seeds)))), "entity_id", min(limits.rows, limits.nodes))
    held = known.count()
    left, active = limits.rows - held, known.select(F.array("entity_id").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    used, hops, found, n_used, n_found = None, edges.limit(0), active.limit(0), 0, 0
    for _ in range(limits.depth):
        room = min(left, limits.edges - n_used)
        if room <= 0 or n_found >= limits.paths or active.isEmpty():
            break
        hop = _first(touching(edges, active.select(F.element_at("nodes", -1).alias("id"))), "relationship_id", room)
        left -= hop.count()
        ends = hop.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
        more = _first(nodes.join(ends, "entity_id", "left_semi").join(known.select("entity_id"), "entity_id", "left_anti"), "entity_id", min(left, limits.nodes - held))
        n_more = more.count()
        left, held, known = left - n_more, held + n_more, known.unionByName(more)
        grown = cut(_within_edges(_longer(active, hop, known), used, limits.edges - n_used))
        hits = grown.filter(F.col("to_type").isin(*targets)) if targets else grown
        found = cut(found.unionByName(hits.orderBy(*_ORDER).limit(limits.paths - n_found).select("nodes", "edges")))
        seen = grown.select("relationship_id")
        used = cut((seen if used is None else used.unionByName(seen)).distinct())
        n_found, n_used, hops, active = found.count(), used.count(), hops.unionByName(hop), grown.select("nodes", "edges")
    warnings = ["graph_limits_capped"] * was_capped + ["graph_row_limit_reached"] * (left <= 0) + ["no_support"] * (n_found == 0)
    of = lambda df, key, ids: df.join(found.select(F.explode(ids).alias(key)).distinct(), key, "left_semi").dropDuplicates([key])
    return Connections(found, of(known, "entity_id", "nodes"), of(hops, "relationship_id", "edges"), warnings, limits.rows - left)


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """G-05 without caps: nodes and edges of every simple path up to a depth, as joins; the paths grow with the answer."""
    both = edges.select(F.col("subject_id").alias("_from"), F.col("object_id").alias("_to"), "relationship_id").unionByName(edges.select(F.col("object_id").alias("_from"), F.col("subject_id").alias("_to"), "relationship_id"))
    at = seeds.select(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    out = None
    for _ in range(depth):
        at = at.join(both, F.element_at("nodes", -1) == F.col("_from")).filter(~F.array_contains("nodes", F.col("_to"))).select(F.array_append("nodes", F.col("_to")).alias("nodes"), F.array_append("edges", F.col("relationship_id")).alias("edges"))
        out = at if out is None else out.unionByName(at)
    return out


def path_status(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """G-08: a path is proposed if any of its edges is."""
    one = paths.select("nodes", "edges", F.explode("edges").alias("relationship_id")).join(edges.select("relationship_id", "status"), "relationship_id")
    return one.groupBy("nodes", "edges").agg(F.when(F.max(F.col("status") == "proposed"), "proposed").otherwise("confirmed").alias("status"))


def seed_id(channel: Column, endpoint: Column) -> Column:
    """G-11: endpoints of every channel but e-mail are phones."""
    return F.when(channel == "email", F.concat(F.lit("EMAIL_ADDRESS:"), endpoint)).otherwise(F.concat(F.lit("PHONE:"), endpoint))
