"""Graph, retrieval, rules, gate, state and sources on worked examples."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.operators import graph as G
from tracewell.operators import retrieval as R
from tracewell.operators import rules as T
from tracewell.operators import state as M
from tracewell.plans import gate
from tracewell.plans.rule_queries import GOOD, STATEMENTS
from tracewell.sources import readers, store
from tracewell.streaming import events as N


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fusion_order(spark):
    for flip in (1, -1):
        lex = spark.createDataFrame([("c-1", 1), ("c-2", 2)][::flip], "chunk_id string, rank int")
        vec = spark.createDataFrame([("c-2", 1), ("c-3", 2)][::flip], "chunk_id string, rank int")
        assert [r.chunk_id for r in R.fuse({"bm25": lex, "vector": vec}, {"bm25": 0.6, "vector": 0.4}, 10, 10).orderBy("rank").collect()] == ["c-2", "c-1", "c-3"]
    for bad in ({"bm25": 0.0, "vector": 0.0}, {"bm25": -1.0, "vector": 1.0}):
        with pytest.raises(ValueError):
            R.checked_weights(bad, 60, 10)


def test_bm25_needs_every_word(spark):
    chunks = spark.createDataFrame([("a", "invoice INV-2231 was paid"), ("b", "invoice INV-2237 was paid"), ("c", "nothing"), ("d", None)], "chunk_id string, text string")
    assert [r.chunk_id for r in R.bm25(chunks, "INV-2231", 10).collect()] == ["a"]
    assert R.bm25(chunks, " ", 10).count() == 0


def graph(spark):
    nodes = spark.createDataFrame([("a", "PERSON"), ("b", "PERSON"), ("c", "ORGANIZATION"), ("d", "PERSON")], "entity_id string, entity_type string")
    edges = spark.createDataFrame([("ab", "a", "b", "confirmed"), ("bc", "b", "c", "proposed"), ("ca", "c", "a", "confirmed"), ("bd", "b", "d", "confirmed")], "relationship_id string, subject_id string, object_id string, status string")
    return nodes, edges


def found(c):
    return sorted((tuple(r.nodes), tuple(r.edges)) for r in c.paths.collect())


def test_paths(spark):
    nodes, edges = graph(spark)
    a = G.find_connections(nodes, edges, ["a"], G.Limits(depth=3))
    b = G.find_connections(nodes.orderBy(F.desc("entity_id")), edges.orderBy(F.desc("relationship_id")), ["a"], G.Limits(depth=3))
    assert found(a) == found(b) and (("a", "b", "c"), ("ab", "bc")) in found(a) and all(len(set(n)) == len(n) for n, _ in found(a))
    assert found(a) == sorted((tuple(r.nodes), tuple(r.edges)) for r in G.simple_paths(edges, spark.createDataFrame([("a",)], "id string"), 3).collect())
    only = G.find_connections(nodes, edges, ["a"], G.Limits(depth=2), targets=["ORGANIZATION"])
    assert {p[0] for p in found(only)} == {("a", "b", "c"), ("a", "c")} and "b" in {r.entity_id for r in only.nodes.collect()}
    capped = G.find_connections(nodes.filter("entity_id <> 'b'"), edges.filter("relationship_id <> 'ca'"), ["a"], G.Limits(depth=9))
    assert capped.warnings == ["graph_limits_capped", "no_support"] and not found(capped)


def paths_one_by_one(nodes, edges, seeds, limits, targets):
    """The same search written for one row at a time, as an oracle for the caps."""
    kinds, left = dict(nodes), limits.rows
    held = sorted(set(seeds) & set(kinds))[: min(left, limits.nodes)]
    left, active, used, out = left - len(held), [((s,), ()) for s in held], set(), []
    for _ in range(limits.depth):
        room = min(left, limits.edges - len(used))
        if room <= 0 or len(out) >= limits.paths or not active:
            break
        hop = sorted(e for e in edges if {e[1], e[2]} & {n[-1] for n, _ in active})[:room]
        left -= len(hop)
        more = sorted(({x for e in hop for x in e[1:3]} & set(kinds)) - set(held))[: max(0, min(left, limits.nodes - len(held)))]
        left, held, grown = left - len(more), held + more, []
        for n, e in sorted(active):
            for r, s, o, *_ in hop:
                to = {s: o, o: s}.get(n[-1])
                if to in held and to not in n and len(used) < limits.edges and len(out) < limits.paths:
                    used.add(r)
                    grown.append(((*n, to), (*e, r)))
                    out += [grown[-1]] if not targets or kinds[to] in targets else []
        active = sorted(set(grown))
    return sorted(out), limits.rows - left


@pytest.mark.parametrize("limits", [{}, {"edges": 7}, {"nodes": 5}, {"paths": 6}, {"rows": 14}, {"depth": 4, "edges": 9, "paths": 11, "nodes": 8}])
def test_path_caps(spark, limits):
    import random

    rng = random.Random(3)
    nodes = [(f"n{i}", "AB"[i % 2]) for i in range(9)]
    edges = sorted({(f"e{i:02d}", *rng.sample([n for n, _ in nodes] + ["gone"], 2), "confirmed") for i in range(16)})
    n, e = spark.createDataFrame(nodes, "entity_id string, entity_type string"), spark.createDataFrame(edges, "relationship_id string, subject_id string, object_id string, status string")
    asked = G.Limits(**{"depth": 3} | limits)
    got = G.find_connections(n, e, ["n1", "n4"], asked, targets=["A"])
    assert (found(got), got.rows) == paths_one_by_one(nodes, edges, ["n1", "n4"], asked, ["A"])


def test_structuring_and_windows(spark):
    day = lambda s: datetime.fromisoformat(s).date()
    t = [("A", day("2026-03-06"), 950_000), ("A", day("2026-03-09"), 960_000), ("A", day("2026-03-10"), 970_000), ("B", day("2026-03-06"), 950_000), ("B", day("2026-03-06"), 950_000), ("B", day("2026-03-10"), 950_000), ("C", day("2026-03-06"), 1_000_000)]
    df = spark.createDataFrame([(g, d, m, "EUR", "booked") for g, d, m in t], "g string, day date, amount_minor long, currency string, status string")
    assert [r.g for r in T.structuring(df, "g").collect()] == ["A"]


def test_reconciliation_abstains(spark):
    at = lambda s: datetime(2026, 1, 1, 12, 0, s)
    schema = "string, sender string, receiver string, imei string, subscriber string, ts timestamp"
    m = spark.createDataFrame([("m1", "x", "y", "i", "x", at(0)), ("m2", "p", "q", "i", "p", at(0)), ("m3", "z", "y", "i", "z", at(0))], "msg_id " + schema)
    c = spark.createDataFrame([("c1", "x", "y", "i", "n", datetime(2026, 1, 1, 12, 1, 30)), ("c2", "p", "q", "i", None, at(5)), ("c3", "p", "q", None, "p", at(50)), ("c4", "z", "y", "j", "w", at(1)), ("c5", "x", "y", "i", "x", datetime(2026, 1, 1, 12, 1, 31))], "cdr_id " + schema)
    got = {r.msg_id: (r.candidates, r.outcome) for r in T.reconciliation(m, c).collect()}
    assert got == {"m1": (["c1"], "same_event"), "m2": (["c2", "c3"], "abstain"), "m3": ([], "unmatched")}
    assert T.crosswalk(T.reconciliation(m, c)).first().event_id == "same-event:c1:m1:reconciliation@1"


def test_dag(spark):
    nodes = spark.createDataFrame([("r", "result"), ("a", "record"), ("s", "source_ref"), ("x", "record"), ("y", "record")], "node_id string, kind string")
    edges = spark.createDataFrame([("r", "a"), ("a", "s"), ("x", "y"), ("y", "x")], "parent string, child string")
    assert rows(T.dag_problems(nodes, edges, "r")) == [("cycle", "x"), ("cycle", "y"), ("unreachable", "x"), ("unreachable", "y")]
    assert rows(T.dag_problems(nodes.filter("node_id in ('r', 'a', 's')"), edges.filter("parent in ('r', 'a')"), "r")) == []


@pytest.mark.parametrize(("sql", "code"), STATEMENTS)
def test_gate(spark, sql, code):
    kinds = [gate.Parameter(1, "integer", 5), gate.Parameter(2, "text", "EUR"), gate.Parameter(3, "integer", 10)]
    v = gate.validate(spark, sql, kinds[: 3 if sql == GOOD else 1 if "$" in sql else 0])
    assert (v.codes or ["ok"])[0] == code


def test_gate_runs(spark):
    view = spark.createDataFrame([(f"bank:{i}", "h", ["r"], i, "EUR") for i in range(9)], "record_id string, content_hash string, source_refs array<string>, amount_minor long, currency string")
    gate.register_views({"transactions_v1": view})
    p = [gate.Parameter(1, "integer", 4), gate.Parameter(2, "text", "EUR"), gate.Parameter(3, "integer", 3)]
    v = gate.validate(spark, GOOD, p)
    got = gate.execute(spark, v, p, max_rows=2, timeout_s=60)
    assert [r["record_id"] for r in got["rows"]] == ["bank:4", "bank:5"] and got["truncated"] and got["failure"] is None
    assert next(gate.row_evidence(got["rows"]))["evidence_id"].startswith("row:bank:4:")
    s = gate.QuerySession()
    assert [s.admit(v), s.admit(v), s.admit(gate.Verdict(["x"])), s.admit(v)] == ["admitted", "repeated_plan", "rejected", "attempts_exhausted"]
    with pytest.raises(ValueError):
        gate.Parameter(1, "integer", True).checked()


def test_cte_scope(spark):
    ok = "WITH a AS (SELECT record_id FROM agent_read.accounts_v1) SELECT t.record_id, t.content_hash, t.source_refs FROM agent_read.accounts_v1 t WHERE t.record_id IN (SELECT record_id FROM a)"
    assert gate.validate(spark, ok).ok
    assert gate.validate(spark, "WITH a AS (SELECT record_id FROM b), b AS (SELECT record_id FROM agent_read.accounts_v1) SELECT record_id FROM a").codes[0] == "relation_not_allowed"


def test_state(spark):
    cards = spark.createDataFrame([("t", f"e{i}", i, "x") for i in range(3)], "thread_id string, evidence_id string, sequence long, display string")
    new = spark.createDataFrame([("t", "e1", "zz"), ("t", "n2", "y" * 5000), ("t", "n1", "y")], "thread_id string, evidence_id string, display string")
    got = M.upsert_cards(cards, new, 4, F.col("evidence_id") == "e0").collect()
    assert {(r.evidence_id, r.sequence) for r in got} == {("e0", 0), ("e2", 2), ("n1", 3), ("n2", 4)} and max(len(r.display) for r in got) == 4000
    steps = spark.createDataFrame([("a", "hh", ["aaaa", "bb", "ccccccccc", "d"])], "turn_id string, head string, steps array<string>")
    r = M.trimmed_steps(steps, 9).first()
    assert r.kept == [1, 2, 4] and r.trimmed
    assert M.decode_cursor("x", M.encode_cursor("x", [1, "a"])) == [1, "a"]
    for bad in (lambda: M.decode_cursor("y", M.encode_cursor("x", [1])), lambda: M.decode_cursor("x", "!!")):
        with pytest.raises(ValueError):
            bad()
    locks = M.ThreadLocks()
    assert locks.acquire("t", "r1") is None and locks.acquire("t", "r2") == "r1"
    locks.release("t", "r1")
    assert locks.acquire("t", "r2") is None


def test_history(spark):
    schema = "thread_id string, turn_id string, request_id string, sequence long, role string, content string, status string"
    h = spark.createDataFrame([("t", "1", "r1", 1, "user", "q", "completed"), ("t", "1", "r1", 2, "assistant", "a", "completed")], schema)
    new = spark.createDataFrame([("t", "1", "r1", 1, "user", "q", "running"), ("t", "2", "r2", 3, "user", "q2", "running"), ("t", "9", "r9", 5, "assistant", "no user", "running")], schema)
    assert [r.turn_id for r in M.append_messages(h, new, 9).orderBy("sequence").collect()] == ["1", "1", "2"]
    assert M.append_messages(h, new, 1).count() == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([("r1", "a"), ("r2", "b")], "record_id string, content_hash string")
    assert s.read("records") is None
    for _ in range(2):
        s.upsert("records", batch)
    s.upsert("records", batch.filter("record_id = 'r1'").withColumn("content_hash", F.lit("new")))
    assert rows(s.read("records")) == [("r1", "new"), ("r2", "b")] and rows(s.counts()) == [("records", 2)]
    ledger = store.Ledger(spark, str(tmp_path / "ledger"))
    assert not ledger.has_completed("f")
    run = ledger.start("f")
    assert not ledger.has_completed("f")
    ledger.complete(run, "f", {"records": 2})
    assert ledger.has_completed("f")
    path = str(tmp_path / "receipt.json")
    assert store.read_receipt(path) is None
    store.write_receipt(path, {"f": 1})
    assert store.read_receipt(path) == {"f": 1}


def edition(root):
    raw = root / "raw"
    (raw / "emails").mkdir(parents=True)
    (raw / "docs").mkdir()
    (raw / "cdr.csv").write_text("record_id,seq,record_type,subscriber_msisdn,calling_msisdn,called_msisdn,imei,cell_id,ts_local,duration_s,sms_len,source_version\nc1,1,MOC,+306971234567,+306971234567,+306970000001,490154203237518,k,2026-02-20T09:10:00+02:00,60,,v1\nc2,2,SMS-MT,+306971234567,+306970000001,+306971234567,,k,2026-02-20T09:11:00+02:00,,12,v1\n")
    (raw / "extraction.jsonl").write_text('{"msg_id":"m1","imei":"i","subscriber_msisdn":"+306971234567","direction":"in","peer":"6970000001","app":"signal","ts_utc":"2026-02-20T07:11:00Z","body":"see INV-2231","source_version":"v1"}\n\n')
    (raw / "emails" / "a.eml").write_text("From: Ann <ann@a.example>\nTo: bob@b.example\nDate: Fri, 20 Feb 2026 09:10:00 +0200\nSubject: Hi\nX-Source-Record-ID: e1\nContent-Type: text/plain\n\nBody text\n\n")
    (raw / "bank.sql").write_text("BEGIN;\nINSERT INTO accounts (account_id, iban, holder_name, holder_type, bic, opened_date, source_version) VALUES ('a1', 'GR16 0110 1250 0000 0001 2300 695', 'O''Neil, (Ltd)', 'organization', NULL, '2020-01-02', 'v1'),\n ('a2', 'GB82WEST12345698765432', NULL, NULL, NULL, NULL, 'v1');\nINSERT INTO transactions VALUES ('t1', '2026-02-21T10:00:00Z', '2026-02-21', 'D', 'GB82WEST12345698765432', NULL, 'C', 'GR1601101250000000012300695', NULL, '9800.00', 'EUR', 'booked', 'inv-2231; thanks', 'v1');\nCOMMIT;\n")
    (raw / "docs" / "R-05.md").write_text("---\ndocument_id: R-05\ndocument_date: 2026-02-22\ngenre: report\nsource_version: v1\n---\n\nAbout INV-2231.\n")
    return str(raw)


def test_edition(spark, tmp_path):
    raw = edition(tmp_path / "en")
    e = readers.read_edition(spark, raw)
    assert rows(e["records"].groupBy("source_system").count()) == [("bank", 3), ("cdr", 2), ("docs", 1), ("email", 1), ("extraction", 1)]
    assert e["records"].select("record_id").distinct().count() == 8 and readers.is_prose(e["records"]).count() == 3
    assert rows(e["communications"].select("channel", "direction", "from_endpoint", "to_endpoint"))[0] == ("call", "out", "306971234567", "306970000001")
    assert {r.from_endpoint for r in e["communications"].collect()} == {"306971234567", "306970000001", "ann@a.example"}
    a = e["accounts"].orderBy("account_id").first()
    assert a.holder_name == "O'Neil, (Ltd)" and a.iban == "GR1601101250000000012300695" and a.bic is None
    t = e["transactions"].first()
    assert t.amount_minor == 980_000 and t.remittance_info == "inv-2231; thanks"
    assert rows(G.transaction_edges(e["transactions"])[1].select("predicate", "object_id")) == [("REFERENCES", "INVOICE_REF:INV-2231"), ("TRANSFERRED_TO", "FINANCIAL_ACCOUNT:GR1601101250000000012300695")]
    assert G.account_edges(e["accounts"])[1].count() == 1 and G.communication_edges(e["communications"])[1].count() == 4
    mail = e["records"].filter("source_system = 'email'").first()
    assert mail.text == "Hi\n\nBody text" and mail.event_time_utc is not None
    assert e["records"].filter("record_id = 'docs:R-05'").first().text.strip() == "About INV-2231."
    assert readers.edition_files(spark, str(tmp_path), "en").count() == 5
    with pytest.raises(KeyError):
        readers.read_edition(spark, raw, ["nope"])
    with pytest.raises(ValueError):
        readers.edition_files(spark, str(tmp_path), "../en")


def test_edition_rejects_unknown_kinds(spark, tmp_path):
    raw = edition(tmp_path / "en")
    p = tmp_path / "en" / "raw" / "cdr.csv"
    p.write_text(p.read_text().replace("MOC", "XYZ"))
    with pytest.raises(Exception, match="unknown record_type"):
        readers.read_cdr(spark, raw + "/cdr.csv").records.collect()


def test_ontology(spark):
    assert S.ontology(spark).count() == 11
    e = spark.createDataFrame([("USES", "PERSON", "PHONE", "llm", "proposed"), ("USES", "PHONE", "PERSON", "llm", "confirmed"), ("HELD_BY", "FINANCIAL_ACCOUNT", "PERSON", "llm", "confirmed")], "predicate string, subject_type string, object_type string, method string, status string")
    assert [r.violations for r in S.relationship_violations(e).collect()] == [[], ["endpoint_types", "model_must_propose", "confirmed_needs_rule"], ["model_must_propose", "confirmed_needs_rule"]]


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows_in = [("t1", datetime(2026, 1, 1, 0, m), m, 1) for m in range(0, 50, 7)] + [("t2", datetime(2026, 1, 1, 2, 0), 5, 1)]
    df = spark.createDataFrame(rows_in, "thread_id string, ts timestamp, tokens long, calls long")
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = N.thread_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("totals")) == rows(M.usage_totals(df, ["tokens", "calls"]))
    q = N.tumbling_counts(stream, "ts", "30 minutes", "1 minute", "thread_id").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("windows")) == rows(N.tumbling_counts(df, "ts", "30 minutes", "1 minute", "thread_id"))


def test_token_bucket():
    b = N.TokenBucket(60)
    assert [b.delay(0.0) for _ in range(7)] == [0.0] * 6 + [1.0] and b.delay(1.0) == 0.0


def test_frames(spark):
    df = spark.createDataFrame([(": c\r\nevent: a\r\ndata: 1\r\ndata: 2\r\n\r\ndata: x\n\nevent: cut",)], "t string")
    assert [tuple(f) for f in df.select(N.sse_frames(F.col("t"))).first()[0]] == [("a", "1\n2"), ("message", "x")]
