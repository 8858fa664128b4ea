"""Queries of graph, rules, gate, state and streaming operators on the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import graph as G
from ..operators import rules as T
from ..operators import state as M
from ..registry import query, table
from ..streaming import events as N
from . import gate


# --- graph ---
def _graph(spark, d):
    """Customers, suppliers, nations and regions as entities; who lies where as relationships."""
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    parts = [("customer", "CUSTOMER", "c_custkey", "NATION", "c_nationkey"), ("supplier", "SUPPLIER", "s_suppkey", "NATION", "s_nationkey"), ("nation", "NATION", "n_nationkey", "REGION", "n_regionkey")]
    edges, nodes = None, table(spark, d, "region").select(name("REGION", "r_regionkey").alias("entity_id"), F.lit("REGION").alias("entity_type"))
    for t, a, ka, b, kb in parts:
        df = table(spark, d, t)
        e = df.select(F.concat(F.lit(f"{a}-"), F.col(ka).cast("string")).alias("relationship_id"), name(a, ka).alias("subject_id"), F.lit("IN").alias("predicate"), name(b, kb).alias("object_id"), F.when(F.col(ka) % 5 == 0, "proposed").otherwise("confirmed").alias("status"))
        edges = e if edges is None else edges.unionByName(e)
        nodes = nodes.unionByName(df.select(name(a, ka).alias("entity_id"), F.lit(a).alias("entity_type")))
    return nodes, edges


_EDGES = """edges as (select concat('CUSTOMER-', c_custkey) as id, concat('CUSTOMER:', c_custkey) as s, concat('NATION:', c_nationkey) as o, c_custkey % 5 = 0 as p from customer
union all select concat('SUPPLIER-', s_suppkey), concat('SUPPLIER:', s_suppkey), concat('NATION:', s_nationkey), s_suppkey % 5 = 0 from supplier
union all select concat('NATION-', n_nationkey), concat('NATION:', n_nationkey), concat('REGION:', n_regionkey), n_nationkey % 5 = 0 from nation),
both_ways as (select id, s as a, o as b, p from edges union all select id, o, s, p from edges),
paths(nodes, ids, p) as (select ['SUPPLIER:7'], []::varchar[], false union all
select list_append(paths.nodes, b), list_append(ids, id), paths.p or both_ways.p from paths join both_ways on a = paths.nodes[len(paths.nodes)] where not list_contains(paths.nodes, b) and len(ids) < 2)"""


@query("g05_simple_paths", f"with recursive {_EDGES} select array_to_string(nodes, ' ') as nodes, array_to_string(ids, ' ') as edges from paths where len(ids) > 0")
def g05(spark, d):
    _, edges = _graph(spark, d)
    p = G.simple_paths(edges, spark.createDataFrame([("SUPPLIER:7",)], "id string"), 2)
    return p.select(F.array_join("nodes", " ").alias("nodes"), F.array_join("edges", " ").alias("edges"))


@query("g06_terminal_types", f"with recursive {_EDGES} select array_to_string(nodes, ' ') as nodes from paths where len(ids) > 0 and nodes[len(nodes)] like 'REGION:%'")
def g06(spark, d):
    _, edges = _graph(spark, d)
    p = G.simple_paths(edges, spark.createDataFrame([("SUPPLIER:7",)], "id string"), 2)
    return p.filter(F.element_at("nodes", -1).startswith("REGION:")).select(F.array_join("nodes", " ").alias("nodes"))


@query("g07_supported_subgraph", f"with recursive {_EDGES} select distinct unnest(ids) as relationship_id from paths")
def g07(spark, d):
    _, edges = _graph(spark, d)
    p = G.simple_paths(edges, spark.createDataFrame([("SUPPLIER:7",)], "id string"), 2)
    return p.select(F.explode("edges").alias("relationship_id")).distinct()


@query("g08_path_status", f"with recursive {_EDGES} select array_to_string(ids, ' ') as edges, case when p then 'proposed' else 'confirmed' end as status from paths where len(ids) > 0")
def g08(spark, d):
    _, edges = _graph(spark, d)
    p = G.simple_paths(edges, spark.createDataFrame([("SUPPLIER:7",)], "id string"), 2)
    return G.path_status(p, edges).select(F.array_join("edges", " ").alias("edges"), "status")


_CAPPED = """with """ + _EDGES.split("both_ways as")[0].rstrip().rstrip(",") + """, nodes as (select 'CUSTOMER:' || c_custkey as n from customer union all select 'SUPPLIER:' || s_suppkey from supplier union all select 'NATION:' || n_nationkey from nation union all select 'REGION:' || r_regionkey from region),
h1 as (select * from edges where s = 'SUPPLIER:7' or o = 'SUPPLIER:7' order by id limit 199), n1 as (select distinct x as n from (select s as x from h1 union all select o from h1) join nodes on n = x where x <> 'SUPPLIER:7' order by 1 limit 99),
h2 as (select * from edges where s in (select n from n1) or o in (select n from n1) order by id limit least(199, 255 - (select count(*) from h1) - (select count(*) from n1))),
n2 as (select distinct x as n from (select s as x from h2 union all select o from h2) join nodes on n = x where x <> 'SUPPLIER:7' and x not in (select n from n1) order by 1 limit greatest(0, least(99 - (select count(*) from n1), 255 - (select count(*) from h1) - (select count(*) from n1) - (select count(*) from h2)))),
w as (select id, s as a, o as b, p from h2 union all select id, o, s, p from h2),
p as (select 'SUPPLIER:7 ' || n1.n || ' ' || b as nodes, h1.id || ' ' || w.id as edges, w.id as last, h1.id as first, n1.n as mid, b from h1 join n1 on n1.n = case when h1.s = 'SUPPLIER:7' then h1.o else h1.s end join w on w.a = n1.n join n2 on n2.n = w.b),
found as (select * from p where b like 'REGION:%' or b like 'CUSTOMER:%' order by mid, first, last limit 40),
taken as (select 1 + (select count(*) from h1) + (select count(*) from n1) + (select count(*) from h2) + (select count(*) from n2) as rows)"""


def _connections(spark, d):
    nodes, edges = _graph(spark, d)
    return G.find_connections(nodes, edges, ["SUPPLIER:7", "gone"], G.Limits(depth=2, paths=40), targets=["REGION", "CUSTOMER"])


@query("g01_find_connections", f"{_CAPPED} select nodes, edges from found")
def g01(spark, d):
    """G-01 to G-06, O-05: the capped search; tests hold its caps against a search of one row at a time."""
    return _connections(spark, d).paths.select(F.array_join("nodes", " ").alias("nodes"), F.array_join("edges", " ").alias("edges"))


@query("g02_seeds", "select 'SUPPLIER:' || s_suppkey as entity_id from supplier where s_suppkey in (1, 7) order by 1 limit 1")
def g02(spark, d):
    """G-02, G-04: known seeds in order, within the limit of nodes."""
    nodes, edges = _graph(spark, d)
    found = G.find_connections(nodes, edges, ["SUPPLIER:7", "gone", "SUPPLIER:1"], G.Limits(depth=1, nodes=1))
    return spark.createDataFrame([("SUPPLIER:1",)] if found.rows == 2 else [], "entity_id string")


@query("g03_hop_edges", f"{_CAPPED} select distinct unnest(string_split(edges, ' ')) as relationship_id from found")
def g03(spark, d):
    """G-03, G-07: the edges that the kept paths use."""
    return _connections(spark, d).edges.select("relationship_id")


@query("g04_hop_nodes", f"{_CAPPED} select distinct unnest(string_split(nodes, ' ')) as entity_id from found")
def g04(spark, d):
    return _connections(spark, d).nodes.select("entity_id")


@query("g09_row_warnings", "select 'graph_limits_capped' as warning union all select 'graph_row_limit_reached'")
def g09(spark, d):
    """A budget of three rows ends with the seed, its edge and the nation; more paths than the server allows are asked for."""
    nodes, edges = _graph(spark, d)
    found = G.find_connections(nodes, edges, ["SUPPLIER:7"], G.Limits(depth=3, rows=3, paths=99))
    return spark.createDataFrame([(w,) for w in found.warnings], "warning string")


@query("g10_consumption", f"{_CAPPED} select rows, (select count(*) from found) as paths from taken")
def g10(spark, d):
    found = _connections(spark, d)
    return spark.createDataFrame([(found.rows, found.paths.count())], "rows long, paths long")


@query("o05_row_limits", "select relationship_id from (select 'CUSTOMER-' || c_custkey as relationship_id from customer union all select 'SUPPLIER-' || s_suppkey from supplier) order by 1 limit 9")
def o05(spark, d):
    """The first rows by id of a hop."""
    nodes, edges = _graph(spark, d)
    return G._first(edges.filter("object_id like 'NATION:%'"), "relationship_id", 9).select("relationship_id")


@query("o06_sorted_paths", f"{_CAPPED} select cast(row_number() over (order by string_split(edges, ' '), string_split(nodes, ' ')) as int) as place, edges from found")
def o06(spark, d):
    from ..operators.retrieval import numbered

    return numbered(_connections(spark, d).paths, ["edges", "nodes"], "place").select("place", F.array_join("edges", " ").alias("edges"))


@query("g11_seed_ids", "select event_id, case when event_type = 'signup' then concat('EMAIL_ADDRESS:', user_id) else concat('PHONE:', user_id) end as seed from events")
def g11(spark, d):
    channel = F.when(F.col("event_type") == "signup", "email").otherwise("call")
    return table(spark, d, "events").select("event_id", G.seed_id(channel, F.col("user_id").cast("string")).alias("seed"))


@query("p05_edge_filters", "select event_id from events where event_type in ('click', 'view') and ts >= timestamp '2024-01-05 00:00:00'")
def p05(spark, d):
    e = table(spark, d, "events").select("event_id", F.lit("confirmed").alias("status"), F.col("event_type").alias("predicate"), F.col("ts").cast("timestamp").alias("occurred_at"))
    return G.edge_filters(e, ["confirmed"], ["click", "view"], since=datetime(2024, 1, 5)).select("event_id")


def _comms(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("cdr:"), F.col("event_id").cast("string")).alias("record_id"), F.when(F.col("event_type") == "signup", "email").otherwise("call").alias("channel"), F.lit("out").alias("direction"), F.col("user_id").cast("string").alias("from_endpoint"), (F.col("user_id") % 50).cast("string").alias("to_endpoint"), F.col("ts").cast("timestamp").alias("event_time_utc"), F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("string")).alias("device_id"))


@query("x08_communication_edges", """with k as (select *, case when event_type = 'signup' then 'EMAIL_ADDRESS' else 'PHONE' end as t from events)
select concat(t, ':', user_id) as subject_id, concat(t, ':', user_id % 50) as object_id, substr(sha256(concat(t, ':', user_id, '|COMMUNICATED_WITH|', t, ':', user_id % 50, '|cdr:', event_id)), 1, 32) as relationship_id from k""")
def x08(spark, d):
    return G.communication_edges(_comms(spark, d))[1].select("subject_id", "object_id", "relationship_id")


@query("x08_communication_entities", """with k as (select *, case when event_type = 'signup' then 'EMAIL_ADDRESS' else 'PHONE' end as t from events),
e as (select concat(t, ':', user_id) as entity_id from k union all select concat(t, ':', user_id % 50) from k union all select concat('DEVICE:', event_id) from k where event_id % 4 = 0)
select entity_id, count(*) as mentions from e group by 1""")
def x08b(spark, d):
    return G.merged_entities(G.communication_edges(_comms(spark, d))[0]).select("entity_id", "mentions")


@query("x09_account_edges", "select concat('FINANCIAL_ACCOUNT:', c_custkey) as subject_id, concat('PERSON:bank:', c_custkey, ':', regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) as object_id from customer where c_custkey % 3 <> 0")
def x09(spark, d):
    c = table(spark, d, "customer")
    a = c.select(F.concat(F.lit("bank:"), F.col("c_custkey").cast("string")).alias("record_id"), F.col("c_custkey").cast("string").alias("account_id"), F.col("c_custkey").cast("string").alias("iban"), F.col("c_name").alias("holder_name"), F.when(F.col("c_custkey") % 3 != 0, "person").otherwise("trust").alias("holder_type"), F.lit(None).cast("date").alias("opened_date"))
    return G.account_edges(a)[1].select("subject_id", "object_id")


def _transactions(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("bank:"), F.col("o_orderkey").cast("string")).alias("record_id"), F.col("o_orderkey").cast("string").alias("txn_id"), F.col("o_orderdate").cast("timestamp").alias("booking_ts_utc"), F.col("o_custkey").cast("string").alias("debtor_iban"), (F.col("o_custkey") % 10).cast("string").alias("creditor_iban"),
        (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("amount_minor"), F.lit("EUR").alias("currency"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("pays inv-"), F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit(" and INV-1234"))).alias("remittance_info"),
    )


@query("x10_transaction_edges", """select concat('FINANCIAL_ACCOUNT:', o_custkey) as subject_id, 'TRANSFERRED_TO' as predicate, concat('FINANCIAL_ACCOUNT:', o_custkey % 10) as object_id from orders
union all select concat('TRANSACTION:', o_orderkey), 'REFERENCES', unnest(list_distinct([concat('INVOICE_REF:INV-', lpad(cast(o_custkey as string), 4, '0')), 'INVOICE_REF:INV-1234'])) from orders where o_orderkey % 5 = 0""")
def x10(spark, d):
    return G.transaction_edges(_transactions(spark, d))[1].select("subject_id", "predicate", "object_id")


@query("x05_entity_outcomes", """select doc_id, case when doc_id % 4 = 0 then 'rejected_span' when doc_id % 4 = 1 then 'superseded_by_rule' when doc_id % 4 = 2 then 'rejected_type' else 'accepted' end as outcome from documents where length(text) > 40""")
def x05(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text") > 40).select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("Mail a@b.example about it. "), "text").alias("chunk"))
    kind = F.col("doc_id") % 4
    quote = F.when(kind == 0, F.lit("\u0001nowhere")).when(kind == 1, F.lit("a@b.example about")).otherwise(F.substring("chunk", 28, 8))
    c = docs.select("doc_id", "chunk_id", "chunk", F.lit(0).alias("seq"), F.when(kind == 2, "VESSEL").otherwise("PERSON").alias("entity_type"), quote.alias("quote"), F.lit(-1).alias("char_start"), F.lit(-1).alias("char_end"))
    spans = docs.select("chunk_id", F.lit("a@b.example").alias("raw"))
    return G.entity_outcomes(c, spans).select("doc_id", "outcome")


@query("x06_relationship_outcomes", """select n_nationkey, case when n_nationkey % 4 = 0 then 'rejected_span' when n_nationkey % 4 = 1 then 'rejected_type' when n_nationkey % 4 = 2 then 'rejected_endpoint' else 'accepted' end as outcome from nation""")
def x06(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("chunk_id"), F.concat(F.lit("Ann works for "), "n_name").alias("chunk"))
    k = F.col("n_nationkey") % 4
    c = n.select("n_nationkey", "chunk_id", "chunk", F.lit(0).alias("seq"), F.lit("PERSON").alias("subject_type"), F.lit("ann").alias("subject"), F.when(k == 1, "HELD_BY").otherwise("ASSOCIATED_WITH").alias("predicate"), F.lit("ORGANIZATION").alias("object_type"), F.when(k == 2, "Nobody").otherwise(F.col("chunk_id")).alias("object"), F.when(k == 0, "absent words").otherwise("works for").alias("quote"), F.lit(-1).alias("char_start"), F.lit(-1).alias("char_end"))
    none = F.array().cast("array<string>")
    person = n.select("chunk_id", F.lit("PERSON").alias("entity_type"), F.lit("Ann").alias("label"), none.alias("aliases"), F.lit(0).alias("seq"), F.concat(F.lit("PERSON:"), "chunk_id").alias("entity_id"))
    org = n.select("chunk_id", F.lit("ORGANIZATION").alias("entity_type"), F.lit("The Land").alias("label"), F.array("chunk_id").alias("aliases"), F.lit(1).alias("seq"), F.concat(F.lit("ORGANIZATION:"), "chunk_id").alias("entity_id"))
    return G.relationship_outcomes(c, person.unionByName(org)).select("n_nationkey", "outcome")


@query("p08_reference_resolution", "select n_nationkey from nation where n_nationkey % 3 <> 0")
def p08(spark, d):
    n = table(spark, d, "nation")
    record = F.concat(F.lit("docs:"), F.col("n_nationkey").cast("string"))
    records = n.select(record.alias("record_id"), F.concat(F.lit("The land of "), "n_name").alias("text"), F.to_json(F.struct("n_name")).alias("payload"))
    quote = F.when(F.col("n_nationkey") % 3 == 0, F.lit("xx")).otherwise(F.substring("n_name", 1, 2))
    refs = F.array(S.source_ref(record, S.field_locator("n_name")), S.source_ref(record, S.span_locator("text", F.lit(12), F.lit(14), quote)))
    return G.resolving(n.select("n_nationkey", refs.alias("source_refs")), "n_nationkey", records).select("n_nationkey")


# --- rules ---
@query("j12_reconciliation", """with m as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'click'), c as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'view'),
p as (select m.event_id as m, c.event_id as c from m join c on m.user_id = c.user_id and abs(m.us - c.us) <= 3600000000), g as (select m, count(distinct c) as n from p group by 1)
select cast(m.event_id as string) as msg_id, cast(coalesce(n, 0) as int) as candidates, case when n is null then 'unmatched' when n = 1 then 'same_event' else 'abstain' end as outcome from m left join g on g.m = m.event_id""")
def j12(spark, d):
    e = table(spark, d, "events")
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select(F.col("event_id").cast("string").alias(name), F.col("user_id").alias("sender"), F.col("user_id").alias("receiver"), F.lit("i").alias("imei"), F.lit(None).cast("string").alias("subscriber"), F.col("ts").cast("timestamp").alias("ts"))
    return T.reconciliation(side("click", "msg_id"), side("view", "cdr_id"), 3600).select("msg_id", F.size("candidates").alias("candidates"), "outcome")


@query("j13_comms_before_transfer", """with t as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'purchase' and value >= 50), e as (select event_id, user_id, epoch_us(ts) as us from events where event_type <> 'purchase')
select cast(t.event_id as string) as txn_id, count(distinct e.event_id) as events from t join e using (user_id) where e.us < t.us and t.us - e.us <= 86400000000 group by 1 having count(distinct e.event_id) >= 2""")
def j13(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a, b = F.col("user_id").cast("string").alias("a"), F.lit("hub").alias("b")
    t = e.filter("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("txn_id"), a, b, (F.col("value") * 100).alias("amount_minor"), "ts")
    return T.before_transfer(t, e.filter("event_type <> 'purchase'").select(F.col("event_id").alias("event_id"), b.alias("a"), F.col("user_id").cast("string").alias("b"), "ts"), minor=5000)


@query("j14_contact_window", "select event_id from events where user_id = 5 and ts < timestamp '2024-01-20 00:00:00' and ts >= timestamp '2024-01-18 00:00:00'")
def j14(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("from_endpoint"), F.lit("x").alias("to_endpoint"))
    return T.contacts_before(e, "5", F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("event_id")


@query("j16_approximate_reference", """with t as (select o_orderkey as k, cast(o_orderdate as date) as day, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as a, o_custkey as c from orders),
m as (select k, day + 1 as day, a + 10000 as a, case when k % 2 = 0 then c end as c from t where k % 100 = 1 or k % 100 = 2),
p as (select m.k, count(distinct t.k) as n from m join t on abs(date_diff('day', m.day, t.day)) <= 1 and abs(m.a - t.a) <= 50000 and (m.c is null or m.c = t.c) group by 1)
select cast(m.k as string) as mention_id, case when n is null then 'none' when n > 1 and m.c is null then 'abstain' else 'candidate' end as outcome from m left join p on p.k = m.k""")
def j16(spark, d):
    o = table(spark, d, "orders")
    t = o.select(F.col("o_orderkey").cast("string").alias("txn_id"), "o_orderkey", F.lit("EUR").alias("currency"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("amount_minor"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").cast("string").alias("counterparty"))
    m = t.filter("o_orderkey % 100 in (1, 2)").select(F.col("txn_id").alias("mention_id"), "currency", (F.col("amount_minor") + 10000).alias("amount_minor"), F.date_add("day", 1).alias("day"), F.when(F.col("o_orderkey") % 2 == 0, F.col("counterparty")).alias("counterparty"))
    return T.approximate_reference(m, t).select("mention_id", "outcome")


@query("t07_canonical_events", "select event_id, case when event_id % 10 = 0 then concat('e:', event_id) when event_id % 10 = 1 then concat('e:', event_id - 1) else cast(event_id as string) end as canonical from events")
def t07(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("record_id"), F.col("event_id").alias("n"))
    pairs = e.filter("n % 10 = 0").select(F.col("record_id").alias("msg_id"), (F.col("n") + 1).cast("string").alias("cdr_id"), F.concat(F.lit("e:"), "record_id").alias("event_id"))
    return T.canonical_events(e, pairs).select(F.col("n").alias("event_id"), F.col("event_id").alias("canonical"))


@query("a13_mention_counts", "select concat('PHONE:', user_id) as entity_id, count(*) as n from events where event_type <> 'view' group by 1")
def a13(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("PHONE:"), F.col("user_id").cast("string")).alias("entity_id"), F.when(F.col("event_type") == "view", "PERSON").otherwise("PHONE").alias("entity_type"))
    return T.mention_counts(e)


@query("a14_activity", "select endpoint, count(*) as n from (select distinct event_id, unnest([user_id, user_id % 50]) as endpoint from events) group by 1 having count(*) >= 3")
def a14(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("from_endpoint"), (F.col("user_id") % 50).alias("to_endpoint"))
    return T.activity(e)


_BDAY = "5 * cast(floor(date_diff('day', date '1969-12-29', day) / 7.0) as bigint) + least(date_diff('day', date '1969-12-29', day) % 7, 4)"


@query("a15_structuring", f"""with t as (select o_custkey, cast(o_orderdate as date) as day from orders where o_totalprice >= 90000 and o_totalprice < 100000),
b as (select o_custkey, {_BDAY} as bday, count(*) as n from t group by 1, 2)
select * from (select o_custkey, bday, cast(sum(n) over w as bigint) as payments from b window w as (partition by o_custkey order by bday range between 299 preceding and current row)) where payments >= 2""")
def a15(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("amount_minor"), F.lit("EUR").alias("currency"), F.lit("booked").alias("status"))
    return T.structuring(o, "o_custkey", days=300, least=2, lower=9_000_000, upper=10_000_000, each_day=False).select("o_custkey", "bday", "payments")


@query("w07_business_days", f"select o_orderkey, {_BDAY} as bday from (select o_orderkey, cast(o_orderdate as date) as day from orders)")
def w07(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.business_day(F.col("o_orderdate").cast("date")).alias("bday"))


@query("a20_identity_score", """with f as (select s_suppkey, (s_suppkey % 11) / 10.0 as a, s_suppkey % 2 as b, s_suppkey % 3 as c, (s_suppkey % 5) / 4.0 as t from supplier),
s as (select *, round(least(1.0::double, greatest(0.0::double, 0.45::double * a + 0.3::double * b + 0.15::double * c + 0.1::double * t)), 6) as score from f)
select s_suppkey, score, case when s_suppkey % 17 = 0 then 'never' when score >= 0.9 and c >= 2 then 'auto' when score >= 0.65 then 'review' else 'none' end as decision from s""")
def a20(spark, d):
    k = F.col("s_suppkey")
    no = F.lit(False)
    f = table(spark, d, "supplier").select("s_suppkey", ((k % 11) / 10).alias("name_similarity"), (k % 2).alias("alias_assertion"), (k % 3).alias("corroboration"), ((k % 5) / 4).alias("temporal_context"), no.alias("same_asset"), (k % 17 == 0).alias("shared_phone_or_iban_only"), no.alias("conflict"), no.alias("cross_script_name_only"), (k % 3).alias("corroborators"))
    return T.identity_score(f).select("s_suppkey", "score", "decision")


@query("t02_cdr_checks", "select event_id, case when event_type = 'click' and value >= 50 then 'sms_duration' when event_type <> 'click' and not (cast(floor(value) as int) between 20 and 900) then 'call_duration' end as problem from events where (event_type = 'click' and value >= 50) or (event_type <> 'click' and not (cast(floor(value) as int) between 20 and 900))")
def t02(spark, d):
    sms = F.col("event_type") == "click"
    duration = F.when(~sms | (F.col("value") >= 50), F.floor("value").cast("int"))
    c = table(spark, d, "events").select("event_id", F.when(sms, "SMS-MO").otherwise("MOC").alias("record_type"), F.lit(None).cast("string").alias("imei"), F.lit("2026-01-01T00:00:00+02:00").alias("ts_local"), duration.alias("duration_s"))
    return T.cdr_problems(c).select("event_id", F.col("problems")[0].alias("problem"))


@query("t03_bank_checks", """select 'iban' as problem, cast(c_custkey as string) as id from customer where c_custkey % 2 = 0
union all select distinct 'unknown_account', cast(o_orderkey as string) from orders where o_custkey % 7 = 0 or o_custkey not in (select c_custkey from customer)
union all select 'amount', cast(o_orderkey as string) from orders where o_orderkey % 9 = 0""")
def t03(spark, d):
    from ..functions.scalar import iban_mod97

    body = F.lpad(F.col("c_custkey").cast("string"), 25, "0")
    check = F.lpad((98 - iban_mod97(F.concat(F.lit("GR00"), body))).cast("string"), 2, "0")
    wrong = F.lpad(((98 - iban_mod97(F.concat(F.lit("GR00"), body)) + 1) % 97).cast("string"), 2, "0")
    iban = lambda ok: F.concat(F.lit("GR"), F.when(ok, check).otherwise(wrong), body)
    accounts = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), "c_custkey", iban(F.col("c_custkey") % 2 != 0).alias("iban"))
    o = table(spark, d, "orders").join(accounts.select(F.col("c_custkey").alias("o_custkey"), "iban"), "o_custkey", "left")
    known = F.coalesce(F.when(F.col("o_custkey") % 7 != 0, F.col("iban")), F.lit("XX"))
    t = o.select(F.col("o_orderkey").cast("string").alias("txn_id"), known.alias("debtor_iban"), known.alias("creditor_iban"), F.when(F.col("o_orderkey") % 9 == 0, "1.5").otherwise("1.50").alias("amount_text"))
    return T.bank_problems(accounts.drop("c_custkey"), t)


@query("t09_resolution_decisions", "select n_regionkey as entity_id, array_to_string(list(n_name order by n_name), ',') as mentions, case when bool_or(n_nationkey % 10 = 0) then 'proposed' else 'confirmed' end as status from nation group by 1")
def t09(spark, d):
    m = table(spark, d, "nation").select(F.col("n_regionkey").alias("entity_id"), F.col("n_name").alias("mention_id"), F.when(F.col("n_nationkey") % 10 == 0, "proposed").otherwise("confirmed").alias("status"))
    return T.resolution_decisions(m).select("entity_id", F.array_join("mention_ids", ",").alias("mentions"), "status")


@query("t10_forbidden_merges", "select a.n_name as a, b.n_name as b, a.n_regionkey as entity_id from nation a join nation b on b.n_nationkey = a.n_nationkey + 5 and a.n_regionkey = b.n_regionkey")
def t10(spark, d):
    n = table(spark, d, "nation")
    decisions = n.groupBy(F.col("n_regionkey").alias("entity_id")).agg(F.collect_set("n_name").alias("mention_ids"))
    pairs = n.select(F.col("n_name").alias("a"), (F.col("n_nationkey") + 5).alias("n_nationkey")).join(n.select(F.col("n_name").alias("b"), "n_nationkey"), "n_nationkey").select("a", "b")
    return T.forbidden_merges(decisions, pairs)


@query("t11_valid_assertions", "select e.event_id from events e join (select user_id, min(ts) as f, max(ts) as t from events where event_type = 'signup' group by 1) a using (user_id) where e.ts >= a.f and e.ts < a.t")
def t11(spark, d):
    e = table(spark, d, "events")
    a = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("valid_from"), F.max("ts").alias("valid_to"))
    return T.valid_at(a, e.select("event_id", "user_id", "ts"), "user_id").select("event_id")


@query("t12_source_ref_ids", "select n_nationkey, concat('src:v1:', sha256(n_name)) as ref from nation")
def t12(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.source_ref_id(F.lit("v1"), F.col("n_name")).alias("ref"))


@query("t14_provenance_dag", """select concat('result:', r_regionkey) as parent, 'policy:v1' as child from region union select concat('result:', n_regionkey), concat('record:', n_nationkey) from nation union select concat('record:', n_nationkey), concat('src:v1:', sha256(n_name)) from nation""")
def t14(spark, d):
    n = table(spark, d, "nation")
    results = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("result_id"), F.lit("v1").alias("policy_version"))
    support = n.select(F.col("n_regionkey").cast("string").alias("result_id"), F.col("n_nationkey").cast("string").alias("record_id"))
    refs = n.select(F.col("n_nationkey").cast("string").alias("record_id"), T.source_ref_id(F.lit("v1"), F.col("n_name")).alias("source_ref_id"))
    return T.provenance_dag(results, support, refs)[1]


@query("t15_screening_outcomes", "select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 400000) as fired from customer")
def t15(spark, d):
    fired = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    expected = table(spark, d, "customer").select("c_custkey", F.lit(True).alias("must_fire"))
    return T.screening_outcomes(fired, expected, "c_custkey").select("c_custkey", "fired")


@query("t17_quarantine", "select o_orderkey, case when o_orderkey % 5 = 0 then 'unsupported_format' when o_orderkey % 5 = 1 then 'timestamp_parse_error' when o_orderkey % 5 = 2 then 'iban_checksum_error' when o_orderkey % 5 = 3 then 'currency_scale_error' end as outcome from orders")
def t17(spark, d):
    k = F.col("o_orderkey") % 5
    return table(spark, d, "orders").select("o_orderkey", T.quarantine_outcome(F.lit("transaction"), k != 1, k != 2, k != 3, F.lit(True), k != 0).alias("outcome"))


@query("t17_conflicts", "select p_partkey as record_id, 'conflict_no_overwrite' as outcome from part where p_partkey % 8 = 0")
def t17b(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.sha2("p_name", 256).alias("content_hash"))
    new = p.withColumn("content_hash", F.when(F.col("record_id") % 8 == 0, F.lit("z")).otherwise(F.col("content_hash")))
    return T.conflicts(p, new).select("record_id", "outcome")


# --- gate ---
GOOD = "SELECT t.record_id, t.content_hash, t.source_refs, t.amount_minor FROM agent_read.transactions_v1 AS t WHERE t.amount_minor >= $1 AND t.currency = $2 ORDER BY t.record_id LIMIT $3"
# Statements and the first rule that each meets.
STATEMENTS = [
    (GOOD, "ok"), ("SELECT record_id -- x\nFROM agent_read.accounts_v1", "comments_not_allowed"), ("SELECT record_id FROM WHERE (", "parse_failed"), ("SELECT record_id FROM agent_read.accounts_v1; SELECT iban FROM agent_read.accounts_v1", "statement_count"),
    ("DELETE FROM agent_read.accounts_v1", "select_required"), ("SELECT record_id, content_hash, source_refs FROM agent_read.accounts_v1 WHERE iban = 'X'", "unknown_ast_node"), ("SELECT record_id FROM agent_read.accounts_v1 UNION SELECT record_id FROM agent_read.transactions_v1", "set_operation"),
    ("VALUES (1)", "values_query"), ("SELECT record_id FROM agent_read.accounts_v1 FOR UPDATE", "row_lock"), ("SELECT record_id INTO t FROM agent_read.accounts_v1", "select_into"), ("SELECT record_id, content_hash, source_refs FROM records", "relation_not_allowed"),
    ("SELECT * FROM agent_read.accounts_v1", "star_not_allowed"), ("SELECT record_id, content_hash, source_refs, secret FROM agent_read.accounts_v1", "column_not_allowed"), ("SELECT record_id, content_hash, source_refs, sha2(iban, $1) AS h FROM agent_read.accounts_v1", "function_not_allowed"),
    ("SELECT iban FROM agent_read.accounts_v1", "provenance_required"), ("SELECT record_id, content_hash, source_refs FROM agent_read.accounts_v1 WHERE iban = $2", "parameter_mismatch"), ("WITH RECURSIVE r AS (SELECT record_id FROM agent_read.accounts_v1) SELECT record_id FROM r", "recursive_cte"),
    ("SELECT record_id, content_hash, source_refs FROM agent_read.accounts_v1 WHERE iban RLIKE $1", "operator_not_allowed"), ("SELECT record_id, content_hash, source_refs, CAST(iban AS binary) AS b FROM agent_read.accounts_v1", "cast_not_allowed"),
    # A-18, W-09, U-04: no grouping sets; windows only of the allowed aggregates; no set operations.
    ("SELECT currency, sum(amount_minor) AS s FROM agent_read.transactions_v1 GROUP BY ROLLUP(currency)", "unknown_ast_node"), ("SELECT record_id, content_hash, source_refs, row_number() OVER (ORDER BY record_id) AS n FROM agent_read.transactions_v1", "function_not_allowed"),
    ("SELECT record_id, content_hash, source_refs, sum(amount_minor) OVER (PARTITION BY currency) AS s FROM agent_read.transactions_v1", "ok"), ("SELECT record_id FROM agent_read.accounts_v1 INTERSECT SELECT record_id FROM agent_read.transactions_v1", "set_operation"), ("SELECT record_id FROM agent_read.accounts_v1 EXCEPT SELECT record_id FROM agent_read.transactions_v1", "set_operation"),
]


@query("q01_policy_gate", " union all ".join(f"select {i} as id, '{c}' as code" for i, (_, c) in enumerate(STATEMENTS)))
def q01(spark, d):
    """Q-01 to Q-16, A-18, W-09, U-04: the first rule that each statement breaks."""
    kinds = [gate.Parameter(1, "integer", 5), gate.Parameter(2, "text", "EUR"), gate.Parameter(3, "integer", 10)]
    rows = []
    for i, (sql, _) in enumerate(STATEMENTS):
        n = 3 if i == 0 else 1 if "$" in sql else 0
        v = gate.validate(spark, sql, kinds[:n])
        rows.append((i, v.codes[0] if v.codes else "ok"))
    return spark.createDataFrame(rows, "id int, code string")


def _bank_views(spark, d):
    t = _transactions(spark, d).withColumns({"value_date": F.lit(None).cast("date"), "debtor_name": F.lit("d"), "creditor_name": F.lit("c"), "amount_text": F.col("amount_minor").cast("string"), "status": F.lit("booked")})
    r = t.select("record_id", F.lit("bank").alias("source_system"), F.col("txn_id").alias("source_record_id"), F.lit("bank.sql").alias("source_path"), F.sha2("txn_id", 256).alias("content_hash"))
    from ..sources.store import read_view

    return r, read_view(t, r)


@query("q17_guarded_select", "select concat('bank:', o_orderkey) as record_id, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as amount_minor from orders where cast(o_totalprice as decimal(18,2)) * 100 >= 40000000 order by 1 limit 15")
def q17(spark, d):
    _, view = _bank_views(spark, d)
    gate.register_views({"transactions_v1": view})
    parameters = [gate.Parameter(1, "integer", 40_000_000), gate.Parameter(2, "text", "EUR"), gate.Parameter(3, "integer", 15)]
    return gate.bound(spark, gate.validate(spark, GOOD, parameters), parameters).select("record_id", "amount_minor")


@query("q18_provenance_failures", "select concat('bank:', o_orderkey) as record_id from orders where o_orderkey % 11 = 0")
def q18(spark, d):
    records, view = _bank_views(spark, d)
    bad = F.substring("record_id", 6, 20).cast("bigint") % 11 == 0
    return gate.provenance_failures(view.withColumn("content_hash", F.when(bad, "0").otherwise(F.col("content_hash"))), records)


_SAID = {
    "transactions_v1": "record_id source_system source_record_id source_path content_hash source_refs txn_id booking_ts_utc value_date debtor_iban debtor_name creditor_iban creditor_name amount_minor amount_text currency status remittance_info",
    "accounts_v1": "record_id source_system source_record_id source_path content_hash source_refs account_id iban holder_name holder_type bic opened_date",
    "communications_v1": "record_id source_system source_record_id source_path content_hash source_refs channel direction from_endpoint to_endpoint event_time_utc original_time duration_s device_id",
}


@query("q22_schema", " union all ".join(f"select 'agent_read.{v}' as view_name, '{c}' as column_name, true as selectable" for v, cs in _SAID.items() for c in cs.split()))
def q22(spark, d):
    """What a model is told of the views, and that each column told is one that a statement may select and that the view has."""
    from .gated import views

    tables, rows = views(spark, d), []
    for name, columns in gate.describe()["views"].items():
        for c in columns:
            verdict = gate.validate(spark, f"SELECT record_id, content_hash, source_refs, {c} AS x FROM {name}")
            rows.append((name, c, verdict.ok and c in tables[name.split(".")[1]].columns))
    return spark.createDataFrame(rows, "view_name string, column_name string, selectable boolean")


# --- state ---
def _messages(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("thread_id"), F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("turn").alias("sequence"), "role", F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, "running").otherwise("completed").alias("status"))


@query("m01_upsert_evidence", """with i as (select conv_id as thread_id, concat('e', turn) as evidence_id, min(turn) as sequence from conversations where role = 'user' group by 1, 2), n as (select distinct conv_id as thread_id, concat('n', turn) as evidence_id from conversations),
m as (select thread_id, max(sequence) as last from i group by 1), f as (select n.thread_id, n.evidence_id, coalesce(last, 0) + row_number() over (partition by n.thread_id order by n.evidence_id) as sequence from n left join m using (thread_id)),
u as (select * from i union all select * from f) select thread_id, evidence_id, cast(sequence as bigint) as sequence from (select *, row_number() over (partition by thread_id order by sequence desc, evidence_id desc) as k from u) where k <= 4""")
def m01(spark, d):
    c = table(spark, d, "conversations")
    index = c.filter("role = 'user'").groupBy(F.col("conv_id").alias("thread_id"), F.concat(F.lit("e"), F.col("turn").cast("string")).alias("evidence_id")).agg(F.min("turn").alias("sequence")).withColumn("display", F.lit("x"))
    new = c.select(F.col("conv_id").alias("thread_id"), F.concat(F.lit("n"), F.col("turn").cast("string")).alias("evidence_id"), F.lit("y").alias("display")).distinct()
    return M.upsert_cards(index, new, 4, F.lit(False)).select("thread_id", "evidence_id", "sequence")


@query("m02_merge_indexes", "select n_regionkey as thread_id, n_name as evidence_id, cast(max(s - n) over (partition by n_regionkey order by n rows unbounded preceding) + n as bigint) as sequence from (select n_regionkey, n_name, n_nationkey // 4 as s, row_number() over (partition by n_regionkey order by n_nationkey // 4, n_name) as n from nation)")
def m02(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("thread_id"), F.col("n_name").alias("evidence_id"), F.floor(F.col("n_nationkey") / 4).alias("sequence"))
    return M.merge_indexes(n, n.filter("sequence > 1").withColumn("sequence", F.col("sequence") + 3), 99, F.lit(False))


@query("m03_violations", """select a.answer_id, v.violation from (select c_custkey as answer_id from customer) a, (values (1, 'answer_too_long'), (2, 'unknown_evidence_ids:nope'), (3, 'missing_provenance'), (4, 'unqualified_proposed:c'), (5, 'uncited_material_claim:c'), (6, 'absence_claim_from_incomplete_coverage'), (7, 'no_material_claims')) v(k, violation) where a.answer_id % 8 = v.k""")
def m03(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("answer_id"), (F.col("c_custkey") % 8).alias("k"))
    k = F.col("k")
    answers = c.select("answer_id", F.when(k == 1, F.repeat(F.lit("x"), 16_001)).when(k == 6, "There is no record of it.").when(k == 7, "It cost 5.").otherwise("Fine.").alias("answer"), (k == 6).alias("coverage_incomplete"))
    ids = F.when(k == 2, F.array(F.lit("nope"))).when(k == 3, F.array(F.lit("bare"))).when(k == 4, F.array(F.lit("prop"))).when(k == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("good")))
    claims = c.filter("k <> 7").select("answer_id", F.lit("c").alias("claim_id"), F.lit("verified").alias("kind"), F.lit(True).alias("material"), F.lit("t").alias("text"), ids.alias("evidence_ids"))
    cards = spark.createDataFrame([("good", "confirmed", ["r"], "h"), ("prop", "proposed", ["r"], "h"), ("bare", "confirmed", [], "h")], "evidence_id string, status string, source_refs array<string>, content_hash string")
    return M.violations(answers, claims, cards)


@query("m06_commit_turn", "select conv_id, turn, role, case when conv_id = 1 and turn = 0 then 'failed' when conv_id = 1 and turn % 3 = 0 then 'interrupted' when turn % 3 = 0 then 'running' else 'completed' end as status from conversations")
def m06(spark, d):
    return M.commit_turn(_messages(spark, d), "1", "1-0", "failed").select(F.col("thread_id").alias("conv_id"), F.col("sequence").alias("turn"), "role", "status")


@query("m08_request_resolution", """with u as (select conv_id, turn, max(text) as t, case when turn % 3 = 0 then 'running' else 'completed' end as s from conversations where role = 'user' group by 1, 2, 4), n as (select conv_id, count(distinct turn) as n from conversations group by 1)
select conv_id, turn, case when turn % 2 = 1 then 'conflict' when s = 'completed' then 'replay_completed' else 'resume' end as action from u
union all select conv_id, 99, case when n >= 3 then 'full' else 'new' end from n""")
def m08(spark, d):
    m = _messages(spark, d)
    again = m.filter("role = 'user'").groupBy("thread_id", "request_id", "sequence").agg(F.max("content").alias("content")).withColumn("content", F.when(F.col("sequence") % 2 == 1, F.lit("other")).otherwise(F.col("content")))
    fresh = m.select("thread_id").distinct().select("thread_id", F.concat(F.col("thread_id").cast("string"), F.lit("-99")).alias("request_id"), F.lit(99).cast("bigint").alias("sequence"), F.lit("q").alias("content"))
    return M.request_resolution(again.unionByName(fresh), m, 3).select(F.col("thread_id").alias("conv_id"), F.col("sequence").alias("turn"), "action")


@query("m09_status_overlay", "select conv_id, turn, role, case when turn % 3 <> 0 then 'completed' when conv_id % 2 = 0 then 'running' else 'interrupted' end as status from conversations")
def m09(spark, d):
    m = _messages(spark, d)
    return M.overlay_status(m, m.filter("thread_id % 2 = 0").select("thread_id")).select(F.col("thread_id").alias("conv_id"), F.col("sequence").alias("turn"), "role", "status")


@query("j20_citations", "select c_custkey as claim_id, concat('e', n_nationkey) as evidence_id, r as source_ref from customer join nation on c_nationkey = n_nationkey, (select unnest(['a', 'b']) as r)")
def j20(spark, d):
    claims = table(spark, d, "customer").select(F.col("c_custkey").alias("claim_id"), F.array(F.concat(F.lit("e"), F.col("c_nationkey").cast("string")), F.lit("gone")).alias("evidence_ids"))
    cards = table(spark, d, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("evidence_id"), F.array(F.lit("a"), F.lit("b")).alias("source_refs"))
    return M.citations(claims, cards)


@query("j21_verdicts", "select p_partkey as claim_id, case p_partkey % 4 when 0 then 'missing_verdict' when 1 then 'duplicate_verdict' when 2 then 'unsupported' end as problem from part where p_partkey % 4 <> 3 union all select -1, 'unknown_claim'")
def j21(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"))
    v = p.filter("claim_id % 4 <> 0").select("claim_id", (F.col("claim_id") % 4 != 2).alias("supported"))
    v = v.unionByName(v.filter("claim_id % 4 = 1")).unionByName(spark.createDataFrame([(-1, True)], "claim_id long, supported boolean"))
    return M.verdict_problems(p, v)


@query("p19_coverage", "select user_id as turn_id, bool_or(event_type = 'error') as incomplete from events group by 1")
def p19(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("turn_id"), F.when(F.col("event_type") == "error", "partial").otherwise("complete").alias("status"))
    return M.coverage_incomplete(e)


@query("m12_acceptance", "select p_partkey, case when p_partkey % 2 = 0 and p_partkey % 3 = 0 then 'continue' when p_partkey % 3 = 0 then case when p_partkey % 5 < 1 then 'repair' else 'grounding_failed' end when p_partkey % 7 = 0 then 'transient_exhausted' else 'accepted' end as step from part")
def m12(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", M.acceptance(k % 2 == 0, k % 3 != 0, F.lit(0), k % 5, k % 7 == 0).alias("step"))


# --- streaming, on batches: tests run the same functions on streams ---
@query("n01_lifecycle", """with a as (select conv_id, turn, max(text) as t from conversations where role = 'assistant' group by 1, 2)
select conv_id, turn, 0 as position, 'started' as event, '' as data from a union all
select conv_id, turn, cast(i + 1 as int), 'delta', substr(t, i * 512 + 1, 512) from (select *, unnest(range(0, cast(ceil(length(t) / 512.0) as bigint))) as i from a) union all
select conv_id, turn, cast(ceil(length(t) / 512.0) as int) + 1, 'completed', '' from a""")
def n01(spark, d):
    a = table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.max("text").alias("answer"))
    return N.lifecycle(a.select(F.struct("conv_id", "turn").alias("turn_id"), "answer", F.lit("completed").alias("status"))).select("turn_id.conv_id", "turn_id.turn", "position", "event", "data")


@query("n02_answer_slices", "select conv_id, turn, role, cast(ceil(length(text) / 100.0) as int) as pieces from conversations")
def n02(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.size(X.sliced(F.col("text"), 100)).alias("pieces"))


@query("n08_tumbling_counts", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def n08(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return N.tumbling_counts(e, "ts", "1 hour", "10 minutes", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("n08_session_counts", """with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from l)
select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, count(*) as n from s group by user_id, k""")
def n08b(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return N.session_counts(e, "ts", "6 hours", "1 day", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("n09_terminal_events", "select p_partkey as turn_id, case when p_partkey % 4 = 0 then 'failed' when p_partkey % 4 = 1 then 'persistence_failed' else 'completed' end as event from part")
def n09(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("turn_id"), F.col("p_partkey").alias("request_id"), F.when(F.col("p_partkey") % 4 == 0, "failed").otherwise("completed").alias("outcome"), F.lit(False).alias("replayed"))
    m = p.filter("turn_id % 4 <> 1").select("turn_id", "request_id", F.lit("assistant").alias("role"), F.lit("completed").alias("status"))
    return N.terminal_events(p, m).select("turn_id", "event")


@query("n10_progress", "select event_id, 'searching' as phase from events where event_type = 'click'")
def n10(spark, d):
    return N.progress(table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "search_evidence").otherwise("other").alias("node"))).select("event_id", "phase")


@query("n11_sse_frames", "select n_nationkey, 2 as frames, 'delta' as first, n_name as data from nation")
def n11(spark, d):
    text = F.concat(F.lit(": hi\r\nevent: delta\r\ndata: "), "n_name", F.lit("\r\n\r\nevent: completed\ndata: x\n\nevent: cut"))
    return table(spark, d, "nation").select("n_nationkey", N.sse_frames(text).alias("f")).select("n_nationkey", F.size("f").alias("frames"), F.col("f")[0]["event"].alias("first"), F.col("f")[0]["data"].alias("data"))


@query("n12_reassembled", "select conv_id, case when count(*) = max(turn) + 1 and count(distinct turn) = count(*) then string_agg(role, '' order by turn) end as answer from conversations group by 1")
def n12(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("position"), F.col("role").alias("data"))
    return N.reassembled(c).select(F.col("turn_id").alias("conv_id"), "answer")


@query("n13_page_merge", "select n_nationkey as id, case when n_nationkey % 2 = 0 then 'page' else 'old' end as v from nation")
def n13(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("old").alias("v"))
    return M.merge_pages(n, n.filter("id % 2 = 0").withColumn("v", F.lit("page")), "id", last_wins=True)


@query("n14_thread_deletion", "select conv_id as thread_id, turn from conversations where conv_id <> 3")
def n14(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), "turn")
    return N.without_thread({"messages": c}, "3", busy=False)["messages"]

