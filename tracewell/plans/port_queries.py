"""Queries of the model ports, with stub clients whose answers SQL can tell, and of walks of any length."""

from __future__ import annotations

import hashlib
import re
import threading

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ports
from ..operators import rules as T
from ..registry import query, table

QUICK = ports.Policy(in_flight=4, attempts=3, pause=0.001, longest=0.01)


class StubEmbedder:
    """Eight numbers from a text's digest; the first call for a digest that begins with 0 is throttled, one that begins with f comes too short."""

    def __init__(self) -> None:
        self.mine = threading.local()

    def __call__(self, row: dict) -> list[float]:
        digest = hashlib.md5(row["text"].encode()).hexdigest()
        if digest[0] == "0" and getattr(self.mine, "refused", None) != digest:
            self.mine.refused = digest
            raise ports.PortError("throttled")
        self.mine.refused = None
        return [int(digest[i : i + 2], 16) for i in range(0, 14 if digest[0] == "f" else 16, 2)]


class StubEntities:
    """The first word with a capital as a person, and the same as a phone, which no model may propose."""

    def __call__(self, row: dict) -> list[dict]:
        m = re.search("[A-Z][a-z]+", row["text"])
        return [{"entity_type": t, "quote": m[0], "char_start": m.start(), "char_end": m.end(), "aliases": []} for t in ("PERSON", "PHONE")] if m else []


class StubRelationships:
    """The first two known entities as kin, quoted where the first one stands."""

    def __call__(self, row: dict) -> list[dict]:
        names = [k["text"] for k in row["known"]][:2]
        if len(names) < 2:
            return []
        at = row["text"].index(names[0])
        return [{"subject_type": "PERSON", "subject": names[0], "predicate": "KIN_OF", "object_type": "PERSON", "object": names[1], "quote": names[0], "char_start": at, "char_end": at + len(names[0])}]


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")


@query("port_embedder", "with m as (select cast(doc_id as varchar) as chunk_id, md5(text) as h from documents) select chunk_id, case when h is null then 'skipped' when h like 'f%' then 'permanent' else 'ok' end as outcome, case when h is null then 0 when h like '0%' then 2 else 1 end as attempts, case when h is null then null when h like 'f%' then 'wrong_width' end as code, case when h not like 'f%' then cast(('0x' || substr(h, 1, 2)) as int) end as first from m")
def port_embedder(spark, d):
    got = ports.embedded(_chunks(spark, d), StubEmbedder, 8, QUICK)
    return got.select("chunk_id", "call.outcome", "call.attempts", "call.code", F.get("embedding", F.lit(0)).cast("int").alias("first"))


@query("port_entity_extractor", "with m as (select cast(doc_id as varchar) as chunk_id, regexp_extract(text, '[A-Z][a-z]+') as quote from documents) select chunk_id, unnest([0, 1])::int as seq, quote, unnest(['accepted', 'rejected_type']) as outcome from m where quote <> ''")
def port_entity_extractor(spark, d):
    found, _ = ports.entity_candidates(_chunks(spark, d), StubEntities, QUICK)
    none = spark.createDataFrame([], "chunk_id string, raw string")
    return G.entity_outcomes(found, none).select("chunk_id", "seq", "quote", "outcome")


@query("port_relationship_extractor", "with m as (select cast(doc_id as varchar) as chunk_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')[1:2])) as w from documents) select chunk_id, w[1] as subject, w[2] as object, 'accepted' as outcome from m where len(w) = 2")
def port_relationship_extractor(spark, d):
    chunks = _chunks(spark, d)
    words = chunks.select("chunk_id", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)")), 1, 2)).alias("seq", "label"))
    known = words.select("chunk_id", "seq", "label", F.lit("PERSON").alias("entity_type"), F.array().cast("array<string>").alias("aliases"), F.concat(F.lit("PERSON:"), F.lower("label")).alias("entity_id"))
    found, _ = ports.relationship_candidates(chunks, known, StubRelationships, QUICK)
    return G.relationship_outcomes(found, known).select("chunk_id", "subject", "object", "outcome")


_EDGES = "select 'c' || c_custkey as parent, 'c' || (c_custkey + 1) as child from customer where c_custkey % 500 <> 499 union all select 'c' || o_custkey, 'o' || o_orderkey from orders"


@query("t13_deep_walks", f"with recursive e as ({_EDGES}), r as (select 'c0' as id union select e.child from r join e on e.parent = r.id), n as (select 'c' || c_custkey as id from customer union all select 'o' || o_orderkey from orders) select 'unreachable' as problem, id as node_id from n where id not in (select id from r)")
def t13b(spark, d):
    """Customers in chains of 500 with their orders: what the first one does not reach."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    key = F.col("c_custkey")
    edges = c.filter(key % 500 != 499).select(name("c", key).alias("parent"), name("c", key + 1).alias("child"))
    edges = edges.unionByName(o.select(name("c", F.col("o_custkey")).alias("parent"), name("o", F.col("o_orderkey")).alias("child")))
    nodes = c.select(name("c", key).alias("node_id")).unionByName(o.select(name("o", F.col("o_orderkey")).alias("node_id"))).withColumn("kind", F.lit("source_ref"))
    return T.dag_problems(nodes, edges, "c0").filter("problem = 'unreachable'")
