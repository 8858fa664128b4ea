"""Queries of sources, sinks, sessions, limits, fingerprints and provenance on the driver's tables.

Sources and sinks are written from the tables into a folder of their own below the shared one, and read back.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as C
from ..functions import text as X
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import rules as T
from ..operators import state as M
from ..registry import query, table
from ..sources import readers, store
from ..streaming import events as N
from . import gate
from .gated import gated, parameters, records, register, typed, views
from .lineage import new_folder
from .provenance import bound_to_one_view


def _text(c):
    return F.col(c).cast("string")


# --- S-01 to S-09: files of the driver's tables ---
_KIND = {"click": "MOC", "view": "MTC", "purchase": "SMS-MO"}


def _write_cdr(spark, d, path):
    e = table(spark, d, "events")
    kind = F.lit("SMS-MT")
    for k, v in _KIND.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    phone = lambda c: F.concat(F.lit("+30 697 "), F.lpad(c.cast("string"), 7, "0"))
    rows = e.select(
        _text("event_id").alias("record_id"), F.col("event_id").cast("int").alias("seq"), kind.alias("record_type"), phone(F.col("user_id")).alias("subscriber_msisdn"), phone(F.col("user_id")).alias("calling_msisdn"), phone(F.col("user_id") % 50).alias("called_msisdn"),
        F.when(F.col("event_id") % 4 == 0, F.lpad(_text("event_id"), 15, "3")).alias("imei"), F.lit("c").alias("cell_id"), F.lit("2026-01-05T10:00:00+02:00").alias("ts_local"), F.when(kind.startswith("M"), 60).alias("duration_s"), F.lit(None).cast("int").alias("sms_len"), F.lit("v").alias("source_version"),
    )
    rows.write.csv(path, header=True)


@query("s01_cdr_files", """select concat('cdr:', event_id) as record_id, case when event_type in ('click', 'view') then 'call' else 'sms' end as channel, case when event_type in ('click', 'purchase') then 'out' else 'in' end as direction, concat('30697', lpad(user_id::varchar, 7, '0')) as from_endpoint, concat('30697', lpad((user_id % 50)::varchar, 7, '0')) as to_endpoint,
case when event_id % 4 = 0 then lpad(event_id::varchar, 15, '3') end as device_id, case when event_type in ('click', 'view') then 60 end as duration_s, epoch_us(timestamp '2026-01-05 08:00:00') as us from events""")
def s01(spark, d):
    path = new_folder(spark, "cdr")
    _write_cdr(spark, d, path)
    return readers.read_cdr(spark, path).communications.select("record_id", "channel", "direction", "from_endpoint", "to_endpoint", "device_id", "duration_s", F.unix_micros("event_time_utc").alias("us"))


def _write_messages(spark, d, path):
    c = table(spark, d, "conversations")
    c.select(
        F.concat_ws("-", "conv_id", "turn", "role").alias("msg_id"), F.lit("490154203237518").alias("imei"), F.concat(F.lit("69"), F.lpad(_text("conv_id"), 8, "0")).alias("subscriber_msisdn"), F.when(F.col("role") == "user", "out").otherwise("in").alias("direction"),
        F.concat(F.lit("0030210"), F.lpad(_text("turn"), 7, "0")).alias("peer"), F.lit("signal").alias("app"), F.lit("2026-01-05T10:00:00Z").alias("ts_utc"), F.col("text").alias("body"), F.lit("v").alias("source_version"),
    ).write.json(path)


@query("s02_message_files", """select concat('extraction:', conv_id, '-', turn, '-', role) as record_id, case when role = 'user' then concat('3069', lpad(conv_id::varchar, 8, '0')) else concat('30210', lpad(turn::varchar, 7, '0')) end as from_endpoint,
case when role = 'user' then concat('30210', lpad(turn::varchar, 7, '0')) else concat('3069', lpad(conv_id::varchar, 8, '0')) end as to_endpoint, md5(text) as digest from conversations""")
def s02(spark, d):
    path = new_folder(spark, "messages")
    _write_messages(spark, d, path)
    batch = readers.read_messages(spark, path)
    return batch.communications.join(batch.records.select("record_id", "text"), "record_id").select("record_id", "from_endpoint", "to_endpoint", F.md5(F.col("text").cast("binary")).alias("digest"))


def _write_mail(spark, d, path):
    # 25 nations, a file each.
    for r in table(spark, d, "nation").collect():
        head = {"From": f"Ann <A{r.n_nationkey}@Mail.example>", "To": f"b{r.n_regionkey}@mail.example", "Date": "Mon, 5 Jan 2026 10:00:00 +0200", "Subject": r.n_name, "X-Source-Record-ID": f"m{r.n_nationkey}"}
        body = "\n".join(f"{k}: {v}" for k, v in head.items()) + f"\n\nAbout {r.n_name}.\n\n"
        store.write_file(spark, f"{path}/{r.n_nationkey}.eml", body.encode())


@query("s03_mail_files", "select concat('email:m', n_nationkey) as record_id, concat('a', n_nationkey, '@mail.example') as from_endpoint, concat('b', n_regionkey, '@mail.example') as to_endpoint, concat(n_name, chr(10), chr(10), 'About ', n_name, '.') as text, epoch_us(timestamp '2026-01-05 08:00:00') as us from nation")
def s03(spark, d):
    path = new_folder(spark, "mail")
    _write_mail(spark, d, path)
    batch = readers.read_mail(spark, path)
    return batch.communications.join(batch.records.select("record_id", "text"), "record_id").select("record_id", "from_endpoint", "to_endpoint", "text", F.unix_micros("event_time_utc").alias("us"))


def _write_bank(spark, d, path):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    a = c.select(_text("c_custkey").alias("account_id"), F.concat(F.lit("gr16 "), F.lpad(_text("c_custkey"), 20, "0")).alias("iban"), F.concat(F.lit("O'"), "c_name").alias("holder_name"), F.lit("person").alias("holder_type"), F.lit(None).cast("string").alias("bic"), F.lit("2020-01-02").alias("opened_date"), F.lit("v").alias("source_version"))
    none = F.lit(None).cast("string")
    t = s.select(
        _text("s_suppkey").alias("txn_id"), F.lit("2026-01-05T10:00:00Z").alias("booking_ts_utc"), F.lit("2026-01-06").alias("value_date"), F.col("s_name").alias("debtor_name"), F.concat(F.lit("GR16"), F.lpad(_text("s_suppkey"), 20, "0")).alias("debtor_iban"), none.alias("debtor_bic"), none.alias("creditor_name"), F.lit("GR1600000000000000000000").alias("creditor_iban"), none.alias("creditor_bic"),
        F.abs(F.col("s_acctbal").cast("decimal(18,2)")).cast("string").alias("amount_text"), F.lit("EUR").alias("currency"), F.lit("booked").alias("status"), F.lit("pays (a, b); INV-123").alias("remittance_info"), F.lit("v").alias("source_version"),
    )
    store.insert_statements(a, "accounts").unionByName(store.insert_statements(t, "bank.transactions")).write.text(path)


@query("s04_bank_script", "select concat('bank:', c_custkey) as record_id, concat('GR16', lpad(c_custkey::varchar, 20, '0')) as iban, concat('O''', c_name) as name, null::bigint as amount_minor from customer union all select concat('bank:', s_suppkey), concat('GR16', lpad(s_suppkey::varchar, 20, '0')), s_name, cast(abs(cast(s_acctbal as decimal(18,2))) * 100 as bigint) from supplier")
def s04(spark, d):
    path = new_folder(spark, "bank")
    _write_bank(spark, d, path)
    batch = readers.read_bank(spark, path)
    moved = batch.transactions.select("record_id", F.col("debtor_iban").alias("iban"), F.col("debtor_name").alias("name"), "amount_minor")
    return batch.accounts.select("record_id", "iban", F.col("holder_name").alias("name"), F.lit(None).cast("long").alias("amount_minor")).unionByName(moved)


def _write_documents(spark, d, path):
    for r in table(spark, d, "nation").collect():
        name = f"document_id: D-{r.n_nationkey}\n" if r.n_nationkey % 2 == 0 else ""
        store.write_file(spark, f"{path}/n{r.n_nationkey}.md", f"---\n{name}document_date: 2026-01-05\ngenre: \"note\"\n---\n\n\n# {r.n_name}\n\nText: {r.n_regionkey}\n".encode())


@query("s05_document_files", "select case when n_nationkey % 2 = 0 then concat('docs:D-', n_nationkey) else concat('docs:n', n_nationkey) end as record_id, concat('# ', n_name, chr(10), chr(10), 'Text: ', n_regionkey, chr(10)) as text, epoch_us(timestamp '2026-01-05') as us from nation")
def s05(spark, d):
    path = new_folder(spark, "docs")
    _write_documents(spark, d, path)
    return readers.read_documents(spark, path).records.select("record_id", "text", F.unix_micros("event_time_utc").alias("us"))


@query("s06_manifest", "select 'en' as language, n_name as source, n_regionkey::bigint as total from nation")
def s06(spark, d):
    path = f"{new_folder(spark, 'manifest')}/manifest.json"
    totals = {r.n_name: r.n_regionkey for r in table(spark, d, "nation").collect()}
    store.write_file(spark, path, json.dumps({"dataset_version": "1", "language": "en", "source_totals": totals}, indent=1).encode())
    m = readers.read_manifest(spark, path)
    return spark.createDataFrame([(m["language"], k, v) for k, v in m["source_totals"].items()], "language string, source string, total long")


def _edition(spark, d):
    root = new_folder(spark, "edition")
    for r in table(spark, d, "nation").collect():
        folder = ("docs", "emails", "ground_truth", "expected", "quarantine")[r.n_regionkey % 5]
        store.write_file(spark, f"{root}/en/raw/{folder}/{r.n_nationkey}.txt", r.n_name.encode())
    return readers.edition_files(spark, root, "en")


@query("s07_edition_files", "select concat(['docs', 'emails'][n_regionkey + 1], '/', n_nationkey, '.txt') as name, length(n_name) as length, sha256(n_name) as sha256 from nation where n_regionkey < 2")
def s07(spark, d):
    return _edition(spark, d)


@query("s08_edition", "select 'cdr' as source_system, 0 as source_ord, count(*) as n from events union all select 'extraction', 1, count(*) from conversations union all select 'email', 2, count(*) from nation union all select 'bank', 3, (select count(*) from customer) + (select count(*) from supplier) union all select 'docs', 4, count(*) from nation")
def s08(spark, d):
    """All sources in the fixed order, united."""
    root = new_folder(spark, "sources")
    for write, name in ((_write_cdr, "cdr.csv"), (_write_messages, "extraction.jsonl"), (_write_mail, "emails"), (_write_bank, "bank.sql"), (_write_documents, "docs")):
        write(spark, d, f"{root}/{name}")
    return readers.read_edition(spark, root)["records"].groupBy("source_system", "source_ord").agg(F.count(F.lit(1)).alias("n"))


@query("s09_exclusion", "select n_regionkey as region, count(*) filter (n_regionkey < 2) as ingested from nation group by 1")
def s09(spark, d):
    """What an edition keeps from the runtime is not read."""
    n = table(spark, d, "nation").select("n_regionkey", _text("n_nationkey").alias("key"))
    files = _edition(spark, d).select(F.regexp_extract("name", r"(\d+)\.txt$", 1).alias("key"), F.lit(1).alias("there"))
    return n.join(files, "key", "left").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("there").alias("ingested"))


# --- S-11 to S-20: sinks ---
def _filled(spark, d):
    s, tables = store.Store(spark, new_folder(spark, "store")), typed(spark, d)
    s.upsert("records", records(tables))
    for n, t in tables.items():
        s.upsert(n, t)
    return s


@query("s11_record_sink", "select concat('bank:', o_orderkey) as record_id, case when o_orderkey % 3 = 0 then 'again' when o_orderkey % 7 = 0 then 'more' else 'bank.raw' end as source_path from orders")
def s11(spark, d):
    """Two later upserts, each a batch of its own rows; then the table is compacted."""
    s, r = store.Store(spark, new_folder(spark, "store")), records({"transactions": typed(spark, d)["transactions"]})
    key = F.col("source_record_id").cast("bigint")
    s.upsert("records", r)
    s.upsert("records", r.filter((key % 3 == 0) | (key % 7 == 0)).withColumn("source_path", F.lit("more")))
    s.upsert("records", r.filter(key % 3 == 0).withColumn("source_path", F.lit("again")))
    s.compact("records")
    return s.read("records").select("record_id", "source_path")


@query("s12_chunk_sink", "select concat('docs:', doc_id, '#0-', least(length(text), 4000)) as chunk_id, doc_id % 2 = 0 as embedded from documents where length(text) > 0 and length(text) <= 4000")
def s12(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("docs:"), _text("doc_id")).alias("record_id"), "text", "doc_id").filter(F.length("text") <= 4000)
    chunks = X.chunk_text(docs).withColumn("chunk_id", C.chunk_id(F.col("record_id"), F.col("char_start"), F.col("char_end"))).withColumn("embedding", F.lit(None).cast("array<float>"))
    s = store.Store(spark, new_folder(spark, "store"))
    s.upsert("chunks", chunks)
    even = F.substring_index("record_id", ":", -1).cast("bigint") % 2 == 0
    s.upsert("chunks", chunks.filter(even).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    return s.read("chunks").select("chunk_id", F.col("embedding").isNotNull().alias("embedded"))


@query("s13_graph_sink", "select 'entity' as kind, concat('FINANCIAL_ACCOUNT:', o_custkey) as id, cast(1 + max(o_orderkey % 2) as int) as version from orders group by 2 union all select 'relationship', concat('r', o_orderkey), cast(1 + o_orderkey % 2 as int) from orders")
def s13(spark, d):
    o = table(spark, d, "orders")
    s = store.Store(spark, new_folder(spark, "store"))
    for version in (1, 2):
        rows = o.filter(F.col("o_orderkey") % 2 >= version - 1)
        s.upsert("entities", rows.select(F.concat(F.lit("FINANCIAL_ACCOUNT:"), _text("o_custkey")).alias("entity_id"), F.lit(version).alias("version")).distinct())
        s.upsert("relationships", rows.select(F.concat(F.lit("r"), _text("o_orderkey")).alias("relationship_id"), F.lit(version).alias("version")))
    entities = s.read("entities").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), "version")
    return entities.unionByName(s.read("relationships").select(F.lit("relationship").alias("kind"), F.col("relationship_id").alias("id"), "version"))


@query("s14_run_ledger", "select r_name as fingerprint, case when r_regionkey % 3 = 0 then 'completed' when r_regionkey % 3 = 1 then 'failed' else 'running' end as outcome, r_regionkey % 3 = 0 as done from region")
def s14(spark, d):
    ledger, rows = store.Ledger(spark, new_folder(spark, "ledger")), []
    for r in table(spark, d, "region").collect():
        run = ledger.start(r.r_name)
        if r.r_regionkey % 3 == 0:
            ledger.complete(run, r.r_name, {"records": 1})
        elif r.r_regionkey % 3 == 1:
            ledger.fail(run, r.r_name)
        rows.append((r.r_name, ledger.has_completed(r.r_name)))
    return ledger.latest().join(spark.createDataFrame(rows, "fingerprint string, done boolean"), "fingerprint").select("fingerprint", "outcome", "done")


@query("s15_receipts", "select r_name as edition, case when r_regionkey % 2 = 0 then r_regionkey::bigint end as records from region")
def s15(spark, d):
    """Malformed and absent receipts count as none; a second write replaces the first."""
    root, rows = new_folder(spark, "receipts"), []
    for r in table(spark, d, "region").collect():
        path = f"{root}/{r.r_name}.json"
        if r.r_regionkey % 2 == 0:
            store.write_receipt(path, {"records": -1}, spark)
            store.write_receipt(path, {"records": r.r_regionkey}, spark)
        elif r.r_regionkey == 1:
            store.write_file(spark, path, b"{broken")
        got = store.read_receipt(path, spark)
        rows.append((r.r_name, got["records"] if got else None))
    return spark.createDataFrame(rows, "edition string, records long")


@query("s19_schema_check", "select 'missing' as problem, 'original_time' as name union all select 'missing', 'device_id' union all select 'different', 'duration_s'")
def s19(spark, d):
    t = typed(spark, d)["communications"].drop("original_time", "device_id").withColumn("duration_s", _text("duration_s"))
    return spark.createDataFrame([(k, c) for k, cs in S.schema_differences(t, S.COMMUNICATIONS).items() for c in cs], "problem string, name string")


@query("s20_checkpoint_scan", "select conv_id as thread_id, max(turn) as newest from conversations where turn % 3 <> 2 group by 1")
def s20(spark, d):
    """Every third state is unreadable and passed over."""
    c = table(spark, d, "conversations").filter("role is not null")
    state = F.when(F.col("turn") % 3 == 2, F.lit("{cut off")).otherwise(F.to_json(F.struct("turn")))
    states = c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("ts"), state.alias("state"), F.lit(0).alias("seq"))
    return M.newest_checkpoints(states).select("thread_id", F.get_json_object("state", "$.turn").cast("bigint").alias("newest"))


def _view(name):
    def run(spark, d):
        _filled(spark, d).views()
        return spark.table(name).select("record_id", "source_system", "content_hash", F.col("source_refs")[0]["record_id"].alias("ref"), F.col("source_refs")[0]["locator"]["field"].alias("field"))

    return run


for _id, _name, _key, _of in (("j02_transaction_view", "transactions_v1", "concat('bank:', o_orderkey)", "orders"), ("j03_account_view", "accounts_v1", "concat('bank:A', c_custkey)", "customer"), ("j04_communication_view", "communications_v1", "concat('cdr:', event_id)", "events")):
    query(_id, f"select k as record_id, split_part(k, ':', 1) as source_system, sha256(k) as content_hash, k as ref, 'payload' as field from (select {_key} as k from {_of})")(_view(_name))


# --- the policy gate on real statements ---
def _ran(spark, d, sql, *values, **limits):
    register(spark, d)
    verdict = gate.validate(spark, sql, parameters(*values))
    return gate.execute(spark, verdict, parameters(*values), timeout_s=120, **limits)


@query("p11_row_fields", "select concat('bank:A', c_custkey) as record_id, 'holder_name,iban,record_id' as names from customer where c_custkey % 10 = 3 order by 1 limit 20")
def p11(spark, d):
    """Fields in the order of their names, without the metadata."""
    out = _ran(spark, d, "SELECT record_id, content_hash, source_refs, iban, holder_name FROM agent_read.accounts_v1 WHERE iban LIKE $1 ORDER BY record_id LIMIT $2", "%3", 20)
    return spark.createDataFrame([(e["fields"]["record_id"], ",".join(e["fields"])) for e in gate.row_evidence(out["rows"])], "record_id string, names string")


@query("p12_projection", "select concat('bank:', o_orderkey) as record_id, case when o_orderstatus = 'F' then 'booked' else 'open' end as s, coalesce(null, o_custkey::varchar) as c, o_orderstatus = 'F' and not (o_custkey % 10 = 3) as b, false as n, o_custkey::int as i from orders")
def p12(spark, d):
    sql = "SELECT record_id, content_hash, source_refs, CASE WHEN status = $1 THEN status ELSE $2 END AS s, coalesce(debtor_name, debtor_iban) AS c, status = $1 AND NOT (creditor_iban = $3) AS b, debtor_iban IS NULL AS n, CAST(debtor_iban AS int) AS i FROM agent_read.transactions_v1"
    return gated(spark, d, sql, "booked", "open", "3").select("record_id", "s", "c", "b", "n", "i")


_COLUMNS = {"transactions_v1": ["amount_minor", "currency", "iban"], "accounts_v1": ["iban", "holder_name", "amount_minor"], "communications_v1": ["channel", "currency"]}


@query("p14_allowed_columns", "select 'transactions_v1' as v, unnest(['amount_minor', 'currency', 'iban']) as c, unnest([true, true, false]) as ok union all select 'accounts_v1', unnest(['iban', 'holder_name', 'amount_minor']), unnest([true, true, false]) union all select 'communications_v1', unnest(['channel', 'currency']), unnest([true, false])")
def p14(spark, d):
    """A column with its view's alias must be one of that view's."""
    told = lambda v, c: gate.validate(spark, f"SELECT t.record_id, t.content_hash, t.source_refs, t.{c} FROM agent_read.{v} AS t").codes
    return spark.createDataFrame([(v, c, told(v, c) == []) for v, cs in _COLUMNS.items() for c in cs], "v string, c string, ok boolean")


@query("p15_provenance_rule", "select unnest(['as is', 'renamed', 'lacking', 'inside only']) as form, unnest([true, false, false, false]) as ok")
def p15(spark, d):
    forms = {"as is": "SELECT record_id, content_hash, source_refs FROM agent_read.accounts_v1", "renamed": "SELECT record_id AS r, content_hash, source_refs FROM agent_read.accounts_v1", "lacking": "SELECT record_id, iban FROM agent_read.accounts_v1", "inside only": "WITH a AS (SELECT record_id, content_hash, source_refs FROM agent_read.accounts_v1) SELECT a.record_id FROM a"}
    return spark.createDataFrame([(f, gate.validate(spark, q).codes != ["provenance_required"]) for f, q in forms.items()], "form string, ok boolean")


@query("o04_limit_wrap", "select least(count(*), 30) as rows, count(*) > 30 as truncated from orders where cast(o_totalprice as decimal(18,2)) * 100 >= 20000000")
def o04(spark, d):
    out = _ran(spark, d, "SELECT record_id, content_hash, source_refs FROM agent_read.transactions_v1 WHERE amount_minor >= $1", 20_000_000, max_rows=30)
    return spark.createDataFrame([(len(out["rows"]), out["truncated"])], "rows long, truncated boolean")


@query("o10_policy_order", "select concat('bank:', o_orderkey) as record_id, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as amount_minor from orders order by 2 desc, 1 limit 12 offset 5")
def o10(spark, d):
    return gated(spark, d, "SELECT record_id, content_hash, source_refs, amount_minor FROM agent_read.transactions_v1 ORDER BY amount_minor DESC, record_id LIMIT $1 OFFSET $2", 12, 5).select("record_id", "amount_minor")


@query("q19_row_evidence", "select concat('row:bank:A', c_custkey, ':', substr(sha256(concat('{\"iban\":\"', c_custkey, '\",\"record_id\":\"bank:A', c_custkey, '\"}')), 1, 24)) as evidence_id from customer where c_custkey % 10 = 7 order by 1 limit 25")
def q19(spark, d):
    out = _ran(spark, d, "SELECT record_id, content_hash, source_refs, iban FROM agent_read.accounts_v1 WHERE iban LIKE $1", "%7", max_rows=200_000, max_bytes=1 << 30)
    ids = sorted(e["evidence_id"] for e in gate.row_evidence(out["rows"]))[:25]
    return spark.createDataFrame([(i,) for i in ids], "evidence_id string")


@query("q20_attempts", "select unnest([0, 1, 2, 3]) as n, unnest(['admitted', 'repeated_plan', 'rejected', 'attempts_exhausted']) as told")
def q20(spark, d):
    good, bad = "SELECT record_id, content_hash, source_refs FROM agent_read.accounts_v1", "SELECT iban FROM agent_read.accounts_v1"
    session = gate.QuerySession()
    return spark.createDataFrame([(i, session.admit(gate.validate(spark, q))) for i, q in enumerate((good, good + " ", bad, good))], "n int, told string")


@query("q21_outcome", "select concat('bank:', o_orderkey) as record_id from orders where cast(o_totalprice as decimal(18,2)) * 100 >= 40000000 and o_orderkey % 2 = 0 order by 1 limit 10")
def q21(spark, d):
    """What was chosen out of the returned rows, at most so many, in order."""
    rows = gated(spark, d, "SELECT record_id, content_hash, source_refs, txn_id FROM agent_read.transactions_v1 WHERE amount_minor >= $1 ORDER BY record_id LIMIT $2", 40_000_000, 1 << 20).select("record_id", "txn_id").collect()
    found = R.outcome([r.record_id for r in rows if int(r.txn_id) % 2 == 0] + ["bank:none"], [r.record_id for r in rows], True, most=10)
    return spark.createDataFrame([(i,) for i in found["selected"]], "record_id string")


@query("q23_failures", "select unnest(['empty', 'schema', 'fine']) as statement, unnest(['empty', 'schema', null]) as failure")
def q23(spark, d):
    base = "SELECT record_id, content_hash, source_refs FROM agent_read.accounts_v1"
    ran = {"empty": _ran(spark, d, f"{base} WHERE iban = $1", "none"), "fine": _ran(spark, d, f"{base} ORDER BY record_id LIMIT $1", 3)}
    gate.register_views({"accounts_v1": views(spark, d)["accounts_v1"].drop("iban")})
    verdict = gate.validate(spark, f"{base} WHERE iban = $1", parameters("5"))
    ran["schema"] = gate.execute(spark, verdict, parameters("5"), timeout_s=120)
    gate.register_views(views(spark, d))
    return spark.createDataFrame([(n, str(r["failure"]) if r["failure"] else None) for n, r in ran.items()], "statement string, failure string")


# --- retrieval sessions ---
def _session(spark, d, vector_fails):
    """Orders as chunks: the lexical side ranks by price, the vector side by key."""
    o = table(spark, d, "orders").select(_text("o_orderkey").alias("chunk_id"), "o_totalprice", "o_orderkey")

    def lexical(query, k, seen, **_):
        return R.ranked(R.chunk_filters(o, excluded=seen).select("chunk_id", F.col("o_totalprice").alias("score")), k)

    def vector(query, k, seen, **_):
        # It fails when it is run, not when it is planned.
        score = F.raise_error(F.lit("vector side is down")).cast("double") if vector_fails else -F.col("o_orderkey").cast("double")
        return R.ranked(R.chunk_filters(o, excluded=seen).select("chunk_id", score.alias("score")), k)

    return R.RetrievalSession(lexical, vector, {"bm25": 0.5, "vector": 0.5}, most=20)


_PRICE = "(select o_orderkey::varchar as k, row_number() over (order by o_totalprice desc, o_orderkey::varchar) as r from orders)"


@query("r03_partial_retrieval", f"select k as chunk_id, cast(r as int) as rank, 'vector_unavailable' as warning from {_PRICE} where r <= 8")
def r03(spark, d):
    """One side fails while it runs: the other's answer stands, with a warning."""
    session = _session(spark, d, True)
    out = session.retrieve("q", 8)
    return out.select("chunk_id", "rank", F.lit(",".join(session.warnings)).alias("warning"))


@query("r06_session", f"select case when r <= 5 then 1 else 2 end as attempt, k as chunk_id from {_PRICE} where r <= 10 union all select 3, 'repeated_query' union all select 5, 'attempts_exhausted'")
def r06(spark, d):
    """A second attempt leaves out what the first found; a repeated query and a fourth attempt give nothing."""
    session, rows = _session(spark, d, True), []
    for attempt, q in ((1, "a"), (2, "b"), (3, " B "), (4, "c"), (5, "d")):
        out = session.retrieve(q, 5)
        rows += [(attempt, session.warnings[-1])] if out is None else [(attempt, r.chunk_id) for r in out.collect() if attempt < 3]
    return spark.createDataFrame(rows, "attempt int, chunk_id string")


@query("r07_outcome", "select 'n' || n_nationkey as id from nation where n_nationkey in (3, 4, 5) union all select 'unknown_selection' union all select 'evidence_capped'")
def r07(spark, d):
    ids = [f"n{r.n_nationkey}" for r in table(spark, d, "nation").collect()]
    out = R.outcome(["n3", "n4", "n5", "n6", "x"], ids, True, most=3)
    return spark.createDataFrame([(i,) for i in out["selected"] + out["warnings"]], "id string")


@query("r08_top_k_clamp", f"select k as chunk_id from {_PRICE} where r <= 20")
def r08(spark, d):
    """A thousand are asked for, twenty allowed."""
    return _session(spark, d, True).retrieve("q", 1000).select("chunk_id")


@query("o02_vector_top_k", "with p as (select embedding::double[] as p from embeddings where vec_id = 2), s as (select vec_id, round(list_cosine_similarity(embedding::double[], (select p from p)), 6) as score from embeddings) select vec_id, score, cast(row_number() over (order by score desc, vec_id) as int) as rank from s order by rank limit 7")
def o02(spark, d):
    e = table(spark, d, "embeddings")
    return R.vector_search(e, e.filter("vec_id = 2").first().embedding, 7, key="vec_id")


@query("o03_fused_top_k", f"""with a as (select k, r from {_PRICE} where r <= 20), b as (select o_orderkey::varchar as k, row_number() over (order by o_orderkey) as r from orders order by o_orderkey limit 20),
f as (select k, round(cast(sum(cast(0.5::double / (60 + r) as decimal(38,18))) as double), 9) as score from (select * from a union all select * from b) group by 1)
select k as chunk_id, score, cast(row_number() over (order by score desc, k) as int) as rank from f order by rank limit 20""")
def o03(spark, d):
    return _session(spark, d, False).retrieve("q", 20).select("chunk_id", "score", "rank")


# --- fingerprints ---
@query("f14_fingerprint", "select n_name, sha256(concat('{\"k\":', n_nationkey, ',\"name\":\"é', n_name, '\"}')) as hash from nation")
def f14(spark, d):
    return spark.createDataFrame([(r.n_name, C.fingerprint({"name": "é" + r.n_name, "k": r.n_nationkey})) for r in table(spark, d, "nation").collect()], "n_name string, hash string")


@query("f15_ascii_digest", "select n_name, sha256(concat('{\"k\":[', n_nationkey, ',null],\"name\":\"\\u00e9', n_name, '\"}')) as hash from nation")
def f15(spark, d):
    return spark.createDataFrame([(r.n_name, C.fingerprint({"name": "é" + r.n_name, "k": [r.n_nationkey, None]}, ascii_only=True)) for r in table(spark, d, "nation").collect()], "n_name string, hash string")


@query("f16_query_fingerprint", "select n_name, sha256(concat('{\"from\":\"2026-01-05T00:00:00\",\"query\":\"who paid ', lower(n_name), '\",\"sources\":[\"bank\",\"cdr\"],\"to\":null}')) as hash from nation")
def f16(spark, d):
    from datetime import datetime

    mark = lambda n: C.query_fingerprint(f"  Who\tPAID \n{n} ", ["cdr", "bank", "cdr"], datetime(2026, 1, 5))
    return spark.createDataFrame([(r.n_name, mark(r.n_name)) for r in table(spark, d, "nation").collect()], "n_name string, hash string")


@query("f17_run_fingerprint", "select n_name, sha256(concat(sha256(n_name), chr(0), 'model', chr(0), '4000', chr(0), '200', chr(0), 'v', n_nationkey)) as hash from nation")
def f17(spark, d):
    return spark.createDataFrame([(r.n_name, C.run_fingerprint(r.n_name.encode(), "model", 4000, 200, f"v{r.n_nationkey}")) for r in table(spark, d, "nation").collect()], "n_name string, hash string")


@query("f24_backoff", "select n_nationkey + 1 as attempt, least(30.0, 0.5 * pow(2.0, n_nationkey))::double as delay from nation")
def f24(spark, d):
    return spark.createDataFrame([(r.n_nationkey + 1, float(C.backoff_delay(r.n_nationkey + 1, 0.5, 2.0, 30.0))) for r in table(spark, d, "nation").collect()], "attempt int, delay double")


@query("o09_cursor", "select n_nationkey as id, replace(replace(rtrim(to_base64(encode(concat('{\"v\":1,\"e\":\"threads\",\"k\":[\"', n_name, '\",', n_nationkey, ']}'))), '='), '+', '-'), '/', '_') as cursor, true as same, true as bound from nation")
def o09(spark, d):
    """A cursor gives back its values at its own endpoint and at no other."""
    rows = []
    for r in table(spark, d, "nation").collect():
        cursor = M.encode_cursor("threads", [r.n_name, r.n_nationkey])
        try:
            other = bool(M.decode_cursor("messages", cursor))
        except ValueError:
            other = False
        rows.append((r.n_nationkey, cursor, M.decode_cursor("threads", cursor) == [r.n_name, r.n_nationkey], not other))
    return spark.createDataFrame(rows, "id int, cursor string, same boolean, bound boolean")


# --- identifiers with known places ---
_CALL = "concat('Call 69', lpad(cast(o_custkey as string), 8, '0'), ' or mail U', cast(o_custkey as string), '@x.example about inv-', lpad(cast(o_orderkey as string), 8, '0'), ', device 49015420323751', cast(o_orderkey % 10 as string), '.')"


def _spans(spark, d):
    return X.find_identifiers(table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.expr(_CALL).alias("text")))


_KNOWN = """k as (select o_orderkey as record_id, '69' || lpad(o_custkey::varchar, 8, '0') as p, 'U' || o_custkey || '@x.example' as m, 'inv-' || lpad(o_orderkey::varchar, 8, '0') as i, '49015420323751' || o_orderkey % 10 as v from orders),
s as (select record_id, 5 as s, 'PHONE' as t, p as raw, '30' || p as key from k union all select record_id, 24, 'EMAIL_ADDRESS', m, lower(m) from k union all select record_id, 24 + length(m) + 7, 'INVOICE_REF', i, upper(i) from k union all select record_id, 24 + length(m) + 7 + 12 + 9, 'DEVICE', v, v from k)"""


@query("x01_spans", f"with {_KNOWN} select record_id, s::int as char_start, (s + length(raw))::int as char_end, t as entity_type, raw, key as identifier from s")
def x01b(spark, d):
    return _spans(spark, d)


@query("x07_entities", f"with {_KNOWN} select record_id, t || ':' || key as entity_id, t as entity_type, raw as label, (s + 100)::int as char_start from s")
def x07b(spark, d):
    e = G.identifier_entities(_spans(spark, d), 100)
    return e.select(F.col("source_refs")[0]["record_id"].cast("bigint").alias("record_id"), "entity_id", "entity_type", "label", F.col("source_refs")[0]["locator"]["char_start"].alias("char_start"))


@query("f21_normal_form", "select conv_id, turn, role, concat('fi ', text, ' A1', chr(9), '½?') as text from (select conv_id, turn, role, text from conversations) where text = nfc_normalize(text)".replace("'½?'", "'1⁄2�'"))
def f21b(spark, d):
    """Ligatures, wide letters and fractions take their plain forms; control signs go and NUL shows."""
    c = table(spark, d, "conversations")
    odd = F.concat(F.lit("ﬁ\u0001 "), "text", F.lit(" Ａ１\t\u000b½"), F.lit("\0"))
    return c.select("conv_id", "turn", "role", X.cleaned(odd).alias("text"))


@query("x12_rule_covers_model", "select doc_id, case when doc_id % 2 = 0 then 'superseded_by_rule' else 'accepted' end as outcome from documents where length(text) > 40")
def x12(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text") > 40).select("doc_id", _text("doc_id").alias("chunk_id"), F.concat(F.lit("Mr a@b.example wrote: "), "text").alias("chunk"))
    quote = F.when(F.col("doc_id") % 2 == 0, "Mr a@b.example").otherwise("Mr a@b")
    c = docs.select("doc_id", "chunk_id", "chunk", F.lit(0).alias("seq"), F.lit("PERSON").alias("entity_type"), quote.alias("quote"), F.lit(-1).alias("char_start"), F.lit(-1).alias("char_end"))
    return G.entity_outcomes(c, X.find_identifiers(docs.select("chunk_id", F.substring("chunk", 1, 22).alias("text")), record="chunk_id")).select("doc_id", "outcome")


# --- merges, screens, provenance ---
@query("a02_in_chunk_merge", "select conv_id, role as label, count(*) as mentions from conversations group by 1, 2")
def a02(spark, d):
    """Mentions within a chunk (here a conversation) become one entity each; every one is counted."""
    c = table(spark, d, "conversations")
    drafts = c.select(F.concat_ws("#", "conv_id", "role").alias("entity_id"), F.lit("PERSON").alias("entity_type"), F.col("role").alias("label"), F.lit(None).cast("string").alias("normalized_key"), F.array(S.source_ref(_text("conv_id"), S.field_locator("text"))).alias("source_refs"), F.struct("conv_id", "turn").alias("seq"))
    return G.merged_entities(drafts).filter(F.size("source_refs") == 1).select(F.substring_index("entity_id", "#", 1).cast("bigint").alias("conv_id"), "label", "mentions")


@query("a16_canonical_screen", """with t as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'purchase'), e as (select event_id - event_id % 2 as canonical, user_id, epoch_us(ts) as us from events where event_type <> 'purchase')
select t.event_id::varchar as txn_id, count(distinct canonical) as events from t join e using (user_id) where e.us < t.us and t.us - e.us <= 86400000000 group by 1 having count(distinct canonical) >= 2""")
def a16(spark, d):
    """Two records of one event count once: an even event and the next odd one are the same here."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    every = e.select(_text("event_id").alias("record_id"), "event_id", "event_type", "user_id", "ts")
    pairs = every.filter("event_id % 2 = 0").select(F.col("record_id").alias("msg_id"), (F.col("event_id") + 1).cast("string").alias("cdr_id"), F.concat(F.lit("same:"), "record_id").alias("event_id"))
    canonical = T.canonical_events(every.drop("event_id"), pairs)
    ends = lambda df, key: df.select(key, _text("user_id").alias("a"), F.lit("hub").alias("b"), "ts")
    transfers = ends(every.filter("event_type = 'purchase'").withColumn("txn_id", F.col("record_id")), "txn_id").withColumn("amount_minor", F.lit(1_000_000))
    return T.before_transfer(transfers, ends(canonical.filter("event_type <> 'purchase'"), "event_id"))


@query("t06_abstain", """with m as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'click'), c as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'view'),
p as (select m.event_id as m, count(distinct c.event_id) as n from m join c on m.user_id = c.user_id and abs(m.us - c.us) <= 7200000000 group by 1) select case when n is null then 'unmatched' when n = 1 then 'same_event' else 'abstain' end as outcome, count(*) as n from (select n from m left join p on p.m = m.event_id) group by 1""")
def t06(spark, d):
    """The device differs everywhere, so the subscriber must agree."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select(_text("event_id").alias(name), F.col("user_id").alias("sender"), F.col("user_id").alias("receiver"), F.concat(F.lit(name), _text("event_id")).alias("imei"), _text("user_id").alias("subscriber"), "ts")
    return T.reconciliation(side("click", "msg_id"), side("view", "cdr_id"), 7200).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("t08_mention_resolution", "select 'PHONE:3069' || lpad(o_custkey::varchar, 8, '0') as entity_id, count(*) as mentions, case when max(o_orderkey % 3) = 2 then 'proposed' else 'confirmed' end as status from orders group by o_custkey")
def t08(spark, d):
    """Phones found in texts are mentions; each resolves to its entity, which is no surer than its least sure mention."""
    phones = _spans(spark, d).filter("entity_type = 'PHONE'")
    status = F.when(F.col("record_id") % 3 == 2, "proposed").otherwise("confirmed")
    mentions = phones.select(F.concat_ws(":", "entity_type", "identifier").alias("entity_id"), F.concat_ws("#", "record_id", "char_start").alias("mention_id"), status.alias("status"))
    return T.resolution_decisions(mentions).select("entity_id", F.size("mention_ids").cast("bigint").alias("mentions"), "status")


@query("t13_dag_checks", "select 'open_leaf' as problem, 'n' || n_nationkey as node_id from nation where n_nationkey % 6 = 1 union all select 'unreachable', 'n' || n_nationkey from nation where n_nationkey % 6 = 2 union all select 'missing_node', 'gone' || n_nationkey from nation where n_nationkey % 6 = 3 union all select 'cycle', unnest(['x', 'y']) union all select 'duplicate_node', 'r0'")
def t13(spark, d):
    """Root to regions to nations; some nations are no sources, some hang on nothing, some point to nothing, and x and y to each other."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nation, region, k = F.concat(F.lit("n"), _text("n_nationkey")), F.concat(F.lit("r"), _text("n_regionkey")), F.col("n_nationkey") % 6
    nodes = n.select(nation.alias("node_id"), F.when(k == 1, "record").otherwise("source_ref").alias("kind")).unionByName(r.select(F.concat(F.lit("r"), _text("r_regionkey")).alias("node_id"), F.lit("record").alias("kind")))
    nodes = nodes.unionByName(spark.createDataFrame([("root", "result"), ("x", "record"), ("y", "record"), ("r0", "record")], "node_id string, kind string"))
    edges = n.filter(k != 2).select(region.alias("parent"), nation.alias("child")).unionByName(n.filter(k == 3).select(nation.alias("parent"), F.concat(F.lit("gone"), _text("n_nationkey")).alias("child")))
    edges = edges.unionByName(r.select(F.lit("root").alias("parent"), F.concat(F.lit("r"), _text("r_regionkey")).alias("child"))).unionByName(spark.createDataFrame([("root", "x"), ("x", "y"), ("y", "x")], "parent string, child string"))
    return T.dag_problems(nodes, edges, "root")


@query("t16_golden_questions", "select p_partkey as question, p_partkey % 4 = 0 as fired, (p_partkey % 4 = 0) = (p_partkey % 2 = 0) as passed from part")
def t16(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("question"), (F.col("p_partkey") % 2 == 0).alias("must_fire"))
    return T.screening_outcomes(p.filter("question % 4 = 0"), p, "question").select("question", "fired", "passed")


@query("t18_previews", "select concat('bank:', s_suppkey) as record_id, 'transaction' as record_type, json_object('debtor_iban', 'GR16' || lpad(s_suppkey::varchar, 20, '0'), 'creditor_iban', 'GR1600000000000000000000', 'amount_minor', cast(abs(cast(s_acctbal as decimal(18,2))) * 100 as bigint))::varchar as normalized from supplier")
def t18(spark, d):
    """What a bank's transaction becomes in the envelope."""
    path = new_folder(spark, "bank")
    _write_bank(spark, d, path)
    r = readers.read_bank(spark, path).records.filter("record_type = 'transaction'")
    return r.select("record_id", "record_type", F.get_json_object("payload", "$.normalized").alias("normalized"))


# --- state ---
@query("m04_verified_drafts", "select c_custkey as answer_id, case c_custkey % 3 when 0 then 'missing_verdict' when 1 then 'unsupported' end as problem from customer where c_custkey % 3 <> 2")
def m04(spark, d):
    """A draft's claims after the rules: each needs one verdict that supports it."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("claim_id"))
    verdicts = c.filter("claim_id % 3 <> 0").select("claim_id", (F.col("claim_id") % 3 == 2).alias("supported"))
    return M.verdict_problems(c, verdicts).select(F.col("claim_id").alias("answer_id"), "problem")


@query("m05_projection_rules", "select c_custkey as answer_id, 'unqualified_proposed:f' as violation from customer where c_custkey % 2 = 0 union all select c_custkey, 'absence_claim_from_incomplete_coverage' from customer where c_custkey % 3 = 0")
def m05(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("answer_id"))
    even = F.col("answer_id") % 2 == 0
    claims = c.select("answer_id", F.lit("f").alias("claim_id"), F.lit("verified").alias("kind"), F.lit(True).alias("material"), F.when(F.col("answer_id") % 3 == 0, "There is no record of that.").otherwise("It was paid.").alias("text"), F.array(F.when(even, "p").otherwise("c")).alias("evidence_ids"))
    cards = spark.createDataFrame([("p", "proposed", ["r"], "h"), ("c", "confirmed", ["r"], "h")], "evidence_id string, status string, source_refs array<string>, content_hash string")
    return M.violations(c.select("answer_id", F.lit("Fine.").alias("answer"), F.lit(True).alias("coverage_incomplete")), claims, cards)


@query("m07_abandoned_turns", "select conv_id, turn, role, case when turn % 2 = 1 then 'interrupted' else 'completed' end as status from conversations where conv_id = 2")
def m07(spark, d):
    c = table(spark, d, "conversations").filter("conv_id = 2")
    m = c.select(_text("conv_id").alias("thread_id"), _text("turn").alias("turn_id"), "role", F.when(F.col("turn") % 2 == 1, "running").otherwise("completed").alias("status"))
    return M.commit_turn(m, "2", "0", "completed").select(F.col("thread_id").cast("bigint").alias("conv_id"), F.col("turn_id").cast("bigint").alias("turn"), "role", "status")


@query("m10_thread_locks", "select r_name as thread, unnest(['first', 'first again', 'second', 'after release']) as asks, unnest([null, null, 'q1', null]) as held_by from region")
def m10(spark, d):
    locks, rows = M.ThreadLocks(), []
    for r in table(spark, d, "region").collect():
        t = r.r_name
        rows += [(t, "first", locks.acquire(t, "q1")), (t, "first again", locks.acquire(t, "q1")), (t, "second", locks.acquire(t, "q2"))]
        locks.release(t, "q1")
        rows.append((t, "after release", locks.acquire(t, "q2")))
    return spark.createDataFrame(rows, "thread string, asks string, held_by string")


@query("n03_token_bucket", "select n_nationkey as request, case when n_nationkey < 6 then 0.0 else 1.0 end::double as delay from nation")
def n03(spark, d):
    """Sixty a minute, six at once: at one moment six go, and each later one is told to wait a second."""
    bucket = N.TokenBucket(60)
    return spark.createDataFrame([(k, bucket.delay(0.0)) for k in sorted(r.n_nationkey for r in table(spark, d, "nation").collect())], "request int, delay double")


@query("n04_in_flight", "select n_nationkey as request, n_nationkey < 4 or n_nationkey >= 20 and n_nationkey < 22 as entered from nation")
def n04(spark, d):
    """Four at a time; before the twentieth two leave."""
    gate_, rows = N.InFlight(4), []
    for k in sorted(r.n_nationkey for r in table(spark, d, "nation").collect()):
        if k == 20:
            gate_.leave(), gate_.leave()
        rows.append((k, gate_.try_enter()))
    return spark.createDataFrame(rows, "request int, entered boolean")


@query("n04_bounded_calls", "select conv_id, turn, role, length(text) as n from conversations")
def n04b(spark, d):
    """A call for each row from three tasks at most."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return N.bounded_calls(c, lambda b: b.assign(n=b["text"].str.len())[["conv_id", "turn", "role", "n"]], "conv_id long, turn long, role string, n long", 3)


def _streamed(spark, rows, work, mode):
    """The rows as a stream of files through `work` until all are read, and what came out."""
    source, sink = new_folder(spark, "source"), new_folder(spark, "sink")
    rows.write.parquet(source)
    out = work(spark.readStream.schema(rows.schema).parquet(source))
    keep = lambda batch, n: batch.write.mode("append").parquet(sink)
    out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", new_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query("n05_replays", "select conv_id as thread_id, turn || '' as request_id, max(ts) as at from (select conv_id, turn, timestamp '2026-01-05' as ts from conversations) group by 1, 2")
def n05(spark, d):
    """Each request twice in the stream: one of each stays."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), _text("turn").alias("request_id"), F.lit("2026-01-05").cast("timestamp").alias("at"))
    out = _streamed(spark, c.unionByName(c), lambda s: N.deduplicated(s, "at", "10 minutes"), "append")
    return out.select("thread_id", "request_id", F.col("at").cast("timestamp_ntz").alias("at"))


@query("n08_stream_outcomes", """with m as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'click'), c as (select event_id, user_id, epoch_us(ts) as us from events where event_type = 'view'),
p as (select m.event_id as m, c.event_id as c from m join c on m.user_id = c.user_id and abs(m.us - c.us) <= 3600000000), g as (select m, count(distinct c) as n from p group by 1)
select cast(m.event_id as string) as msg_id, cast(coalesce(n, 0) as int) as candidates, case when n is null then 'unmatched' when n = 1 then 'same_event' else 'abstain' end as outcome from m left join g on g.m = m.event_id""")
def n08_outcomes(spark, d):
    """Clicks and views as two streams; a last row of each, a year later, lets the watermark pass all others."""
    e = table(spark, d, "events").filter("event_type in ('click', 'view')").select(_text("event_id").alias("id"), "event_type", _text("user_id").alias("sender"), F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg((F.max("ts") + F.expr("interval 365 days")).alias("ts")).select(F.lit("last").alias("id"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("event_type"), F.lit("none").alias("sender"), "ts")
    side = lambda s, kind, name: s.filter(F.col("event_type") == kind).select(F.col("id").alias(name), "sender", F.col("sender").alias("receiver"), F.lit("i").alias("imei"), F.lit(None).cast("string").alias("subscriber"), "ts")
    out = _streamed(spark, e.unionByName(last), lambda s: N.stream_outcomes(side(s, "click", "msg_id"), side(s, "view", "cdr_id"), 3600), "append")
    return out.select("msg_id", F.size("candidates").alias("candidates"), "outcome")


@query("n06_thread_totals", "select conv_id || '' as thread_id, cast(sum(length(text)) as bigint) as tokens, count(*) as calls from conversations group by 1")
def n06(spark, d):
    """Totals only grow, so a thread's last ones are its largest."""
    c = table(spark, d, "conversations")
    usage = c.select(_text("conv_id").alias("thread_id"), F.length("text").cast("bigint").alias("tokens"), F.lit(1).cast("bigint").alias("calls"))
    return _streamed(spark, usage, N.thread_totals, "update").groupBy("thread_id").agg(F.max("tokens").alias("tokens"), F.max("calls").alias("calls"))


@query("w10_greedy_steps", "with s as (select conv_id, list(length(text) order by turn, role) as n from conversations group by 1) select conv_id, n[len(n)] as newest, len(n) > 1 and n[len(n)] + n[len(n) - 1] + 4 <= 600 as two from s")
def w10b(spark, d):
    """The newest step stays in any case; the one before it where both fit beside the head."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]).alias("steps"))
    t = M.trimmed_steps(c.select("conv_id", F.lit("head").alias("head"), "steps"), 600)
    last = F.size("steps")
    return t.select("conv_id", F.length(F.element_at("steps", F.element_at("kept", -1))).cast("bigint").alias("newest"), F.coalesce(F.array_contains("kept", last - 1), F.lit(False)).alias("two"))


# --- each rule of the gate, on every view ---
_VIEWS, _KEPT = ["transactions_v1", "accounts_v1", "communications_v1"], "record_id, content_hash, source_refs"
# A statement that breaks one rule, by the rule's id; {v} is a view.
_BROKEN = {
    "q02_parse_failed": (f"SELECT {_KEPT} FROM agent_read.{{v}} WHERE (", "parse_failed"),
    "q03_statement_count": (f"SELECT {_KEPT} FROM agent_read.{{v}}; SELECT {_KEPT} FROM agent_read.{{v}}", "statement_count"),
    "q04_select_required": ("UPDATE agent_read.{v} SET record_id = $1", "select_required"),
    "q05_unknown_node": (f"SELECT {_KEPT} FROM agent_read.{{v}} WHERE record_id = 'a literal'", "unknown_ast_node"),
    "q06_row_lock": (f"SELECT {_KEPT} FROM agent_read.{{v}} FOR SHARE", "row_lock"),
    "q07_recursive_cte": ("WITH RECURSIVE r AS (SELECT record_id FROM agent_read.{v}) SELECT record_id FROM r", "recursive_cte"),
    "q08_cte_scope": (f"SELECT {_KEPT} FROM agent_read.{{v}} WHERE record_id IN (WITH c AS (SELECT record_id FROM agent_read.{{v}}) SELECT record_id FROM c) AND EXISTS (SELECT record_id FROM c)", "relation_not_allowed"),
    "q09_star": ("SELECT t.* FROM agent_read.{v} AS t", "star_not_allowed"),
    "q10_function": (f"SELECT {_KEPT}, md5(record_id) AS h FROM agent_read.{{v}}", "function_not_allowed"),
    "q11_operator": (f"SELECT {_KEPT} FROM agent_read.{{v}} WHERE record_id RLIKE $1", "operator_not_allowed"),
    "q12_cast": (f"SELECT {_KEPT}, CAST(record_id AS binary) AS b FROM agent_read.{{v}}", "cast_not_allowed"),
    "q13_parameters": (f"SELECT {_KEPT} FROM agent_read.{{v}} WHERE record_id = $2", "parameter_mismatch"),
    "q14_provenance": ("SELECT record_id, content_hash FROM agent_read.{v}", "provenance_required"),
    "q15_temporary": (f"SELECT {_KEPT} FROM pg_temp.{{v}}", "temporary_relation"),
    "a18_grouping_sets": (f"SELECT {_KEPT}, count(*) AS n FROM agent_read.{{v}} GROUP BY CUBE (record_id, content_hash, source_refs)", "unknown_ast_node"),
    "u04_set_operations": (f"SELECT {_KEPT} FROM agent_read.{{v}} INTERSECT SELECT {_KEPT} FROM agent_read.{{v}}", "set_operation"),
}


# The rows of each view, as a statement may and does read them.
_READ = {
    "transactions_v1": "select 'bank:' || o_orderkey as record_id, cast(o_custkey as varchar) as of_whom from orders",
    "accounts_v1": "select 'bank:A' || c_custkey, cast(c_custkey as varchar) from customer",
    "communications_v1": "select 'cdr:' || event_id, cast(user_id as varchar) from events",
}
_OWNER = {"transactions_v1": "debtor_iban", "accounts_v1": "iban", "communications_v1": "from_endpoint"}


def _broken(sql):
    """What a caller gets of both statements: of the one that keeps the rules its rows, of the one that breaks one no row but its code."""

    def run(spark, d):
        register(spark, d)
        out = None
        for v in _VIEWS:
            for text in (f"SELECT {_KEPT}, {_OWNER[v]} FROM agent_read.{{v}}", sql):
                verdict = gate.validate(spark, text.format(v=v), parameters(*["x"] * ("$" in text)))
                rows = gate.bound(spark, verdict, []) if verdict.ok else None
                got = rows.select(F.lit(v).alias("view_name"), F.lit("ok").alias("code"), F.col(_OWNER[v]).alias("of_whom")) if rows is not None else spark.table(f"{gate.NAMESPACE}__{v}").limit(0).select(F.lit(v).alias("view_name"), F.lit("").alias("code"), F.lit("").alias("of_whom"))
                told = got.groupBy("view_name", "code").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("of_whom").alias("owners"))
                if rows is None:
                    told = spark.range(1).select(F.lit(v).alias("view_name"), F.lit(verdict.codes[0]).alias("code")).join(got.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("of_whom").alias("owners")))
                out = told if out is None else out.unionByName(told)
        return out

    return run


for _id, (_sql, _code) in _BROKEN.items():
    query(_id, " union all ".join(f"select '{v}' as view_name, 'ok' as code, count(*) as rows, count(distinct of_whom) as owners from ({q}) union all select '{v}', '{_code}', 0, 0" for v, q in zip(_VIEWS, (_READ["transactions_v1"], *[f"select * from ({_READ[x]}) t(record_id, of_whom)" for x in _VIEWS[1:]]), strict=True)))(_broken(_sql))


# Statements that break no rule of the gate's own; whether their provenance is one record's.
_FORGED = [
    ("plain", f"SELECT {_KEPT} FROM agent_read.accounts_v1", True),
    ("renamed within", f"SELECT {_KEPT} FROM (SELECT record_id AS r, content_hash AS h, source_refs AS s FROM agent_read.accounts_v1) AS y (record_id, content_hash, source_refs)", True),
    ("one side of a join", "SELECT t.record_id, t.content_hash, t.source_refs FROM agent_read.transactions_v1 AS t JOIN agent_read.accounts_v1 AS a ON t.debtor_iban = a.iban", True),
    ("grouped", f"SELECT {_KEPT}, count(*) AS n FROM agent_read.accounts_v1 GROUP BY {_KEPT}", True),
    ("both sides of a self-join", f"SELECT {_KEPT} FROM (SELECT b.record_id, a.content_hash, a.source_refs FROM agent_read.accounts_v1 AS a JOIN agent_read.accounts_v1 AS b ON a.holder_type = b.holder_type AND a.iban < b.iban) AS z", False),
    ("two references to one expression", f"WITH c AS (SELECT {_KEPT}, iban FROM agent_read.accounts_v1), e AS (SELECT record_id AS r, iban AS i FROM c), f AS (SELECT content_hash, source_refs, iban FROM c) SELECT {_KEPT} FROM (SELECT r AS record_id, content_hash, source_refs FROM e JOIN f ON i = iban) AS z", False),
    ("two views", "SELECT t.record_id, a.content_hash, a.source_refs FROM agent_read.transactions_v1 AS t JOIN agent_read.accounts_v1 AS a ON t.debtor_iban = a.iban", False),
    ("computed", f"SELECT {_KEPT} FROM (SELECT max(record_id) AS record_id, max(content_hash) AS content_hash, source_refs FROM agent_read.accounts_v1 GROUP BY source_refs) AS z", False),
    ("swapped", f"SELECT {_KEPT} FROM (SELECT content_hash AS record_id, record_id AS content_hash, source_refs FROM agent_read.accounts_v1) AS z", False),
    ("bound", f"SELECT {_KEPT} FROM (SELECT $1 AS record_id, $1 AS content_hash, source_refs FROM agent_read.accounts_v1) AS z", False),
]


@query("q18_forged_provenance", "select 'plain' as form, count(*) as rows from customer union all select 'renamed within', count(*) from customer union all select 'one side of a join', count(*) from orders join customer on o_custkey = c_custkey union all select 'grouped', count(*) from customer")
def q18b(spark, d):
    """Of statements that the gate lets through, only those give rows whose three provenance columns are one view instance's."""
    register(spark, d)
    out = None
    for form, sql, _ in _FORGED:
        values = parameters(*["bank:A1"] * ("$" in sql))
        verdict = gate.validate(spark, sql, values)
        if not verdict.ok:
            raise ValueError(f"{form}: {verdict.codes}")
        df = gate.bound(spark, verdict, values)
        if bound_to_one_view(df, gate.NAMESPACE):
            rows = df.groupBy(F.lit(form).alias("form")).agg(F.count(F.lit(1)).alias("rows"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("q08_cte_scope_kept", "select concat('bank:A', c_custkey) as record_id from customer where c_custkey % 3 <> 0")
def q08b(spark, d):
    """A CTE is known where it is defined, and in the CTEs after it."""
    sql = f"WITH p AS (SELECT {_KEPT}, iban FROM agent_read.accounts_v1 WHERE holder_type = $1), q AS (SELECT {_KEPT} FROM p) SELECT {_KEPT} FROM q"
    return gated(spark, d, sql, "person").select("record_id")


@query("q16_fingerprints", f"select v as view_name, sha256(concat('{{\"parameters\":[[1,\"text\",\"EUR\"]],\"sql\":\"SELECT {_KEPT} FROM agent_read.', v, ' WHERE record_id = :p1\",\"version\":\"1\"}}')) as fingerprint from (select unnest({_VIEWS}) as v)")
def q16(spark, d):
    mark = lambda v: gate.validate(spark, f"SELECT {_KEPT}\n  FROM agent_read.{v}   WHERE record_id = $1 ;", parameters("EUR")).fingerprint
    return spark.createDataFrame([(v, mark(v)) for v in _VIEWS], "view_name string, fingerprint string")


@query("w09_policy_over", "select concat('bank:', o_orderkey) as record_id, cast(sum(a) over (partition by o_custkey order by concat('bank:', o_orderkey) rows unbounded preceding) as bigint) as total, count(*) over (partition by o_custkey) as n from (select *, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as a from orders)")
def w09(spark, d):
    sql = f"SELECT {_KEPT}, sum(amount_minor) OVER (PARTITION BY debtor_iban ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, count(*) OVER (PARTITION BY debtor_iban) AS n FROM agent_read.transactions_v1"
    return gated(spark, d, sql).select("record_id", "total", "n")
