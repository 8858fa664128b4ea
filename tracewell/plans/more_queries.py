"""Queries of the remaining operators on the driver's tables: envelopes, locators, endpoints, aliases, checkpoints, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import rules as T
from ..operators import state as M
from ..operators import telemetry as L
from ..registry import query, table
from ..sources import readers
from ..streaming import events as N


@query("p01_envelope", "select concat('docs:', n_nationkey) as record_id, 'docs' as source_system, 'document' as record_type, n_name as text, sha256(concat('{\"n_name\":\"', n_name, '\",\"n_regionkey\":', n_regionkey, '}')) as content_hash from nation")
def p01(spark, d):
    n = table(spark, d, "nation").withColumn("local", F.col("n_nationkey").cast("string")).withColumn("_path", F.lit("docs"))
    none = F.lit(None)
    return readers.envelope(n, "docs", "local", "document", none.cast("timestamp"), none.cast("string"), F.col("n_name"), {"name": F.lower("n_name")}, ["n_name", "n_regionkey"]).select("record_id", "source_system", "record_type", "text", "content_hash")


@query("p02_typed_projection", "select concat('cdr:', event_id) as record_id, case when event_type = 'click' then 'call' else 'sms' end as channel, cast(user_id as string) as from_endpoint, cast(user_id % 50 as string) as to_endpoint from events")
def p02(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "click", "MOC").otherwise("SMS-MO").alias("t"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    channel = readers.mapped(F.col("t"), {"MOC": "call", "SMS-MO": "sms"}, "record_type")
    none = F.lit(None).cast("string")
    return readers._comms(e.withColumn("o", none), "cdr", "id", channel, F.lit("out"), F.col("user_id").cast("string"), (F.col("user_id") % 50).cast("string"), F.col("ts"), "o", F.lit(None), none).select("record_id", "channel", "from_endpoint", "to_endpoint")


@query("p06_vectors_present", """with p as (select embedding::double[] as p from embeddings where vec_id = 1), s as (select vec_id, round(list_cosine_similarity(embedding::double[], (select p from p)), 6) as score from embeddings where label % 2 = 0)
select vec_id, score, cast(row_number() over (order by score desc, vec_id) as int) as rank from s order by rank limit 15""")
def p06(spark, d):
    """Vectors that are null are no candidates; of two labels one has none here."""
    e = table(spark, d, "embeddings")
    probe = e.filter("vec_id = 1").first().embedding
    return R.vector_search(e.withColumn("embedding", F.when(F.col("label") % 2 == 0, F.col("embedding"))), probe, 15, key="vec_id")


@query("p07_locators", "select n_nationkey, n_nationkey % 4 in (0, 1) as resolves from nation")
def p07(spark, d):
    k = F.col("n_nationkey") % 4
    loc = F.when(k == 0, S.field_locator("n_name")).when(k == 1, S.span_locator("n_name", F.lit(0), F.lit(2), F.substring("n_name", 1, 2))).when(k == 2, S.field_locator("gone")).otherwise(S.span_locator("text", F.lit(0), F.lit(2), F.lit("??")))
    return table(spark, d, "nation").withColumn("payload", F.to_json(F.struct("n_name"))).select("n_nationkey", G.locator_resolves(loc, F.lit("some text"), F.col("payload")).alias("resolves"))


@query("j08_refs_to_records", "select n_nationkey from nation where n_nationkey % 5 <> 4")
def j08(spark, d):
    """Each nation refers to its region and to itself; every fifth one's own record is not there."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own, region = F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string"))
    refs = F.array(S.source_ref(region, S.field_locator("name")), S.source_ref(own, S.span_locator("text", F.lit(0), F.lit(3), F.substring("n_name", 1, 3))))
    records = n.filter("n_nationkey % 5 <> 4").select(own.alias("record_id"), F.col("n_name").alias("text"), F.to_json(F.struct("n_name")).alias("payload"))
    records = records.unionByName(r.select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("record_id"), F.col("r_name").alias("text"), F.to_json(F.struct(F.col("r_name").alias("name"))).alias("payload")))
    return G.resolving(n.select("n_nationkey", refs.alias("source_refs")), "n_nationkey", records).select("n_nationkey")


@query("j10_endpoint_resolution", "select c_custkey, case when c_custkey % 3 = 0 then concat('PHONE:30697', lpad(cast(c_custkey as string), 7, '0')) when c_custkey % 3 = 1 then concat('PERSON:', c_custkey) end as entity_id from customer")
def j10(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", k.cast("string").alias("chunk_id"), F.when(k % 3 == 0, "PHONE").otherwise("PERSON").alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("697 "), F.lpad(k.cast("string"), 7, "0"))).when(k % 3 == 1, F.upper("c_name")).otherwise("nobody").alias("text"))
    e = table(spark, d, "customer").select(k.cast("string").alias("chunk_id"), F.lit("PERSON").alias("entity_type"), F.lit("Other").alias("label"), F.array("c_name").alias("aliases"), F.lit(0).alias("seq"), F.concat(F.lit("PERSON:"), k.cast("string")).alias("entity_id"))
    return G.resolved_endpoint(c, e, "kind", "text", "entity_id").select("c_custkey", "entity_id")


@query("j11_alias_union", "select n_regionkey, array_to_string(list(n_name order by n_nationkey), ',') as aliases from nation group by 1")
def j11(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.lit("LOCATION").alias("entity_type"), F.col("n_regionkey").cast("string").alias("label"), F.col("n_nationkey").alias("seq"), F.array("n_name", "n_name").alias("aliases"))
    accepted = table(spark, d, "region").select(F.lit("LOCATION").alias("entity_type"), F.col("r_regionkey").cast("string").alias("label"), "r_regionkey")
    return G.alias_union(accepted, a).select(F.col("r_regionkey").alias("n_regionkey"), F.array_join("all_aliases", ",").alias("aliases"))


@query("j17_dictionary_join", "select n_name as entity_id, count(*) as n from events join nation on n_nationkey = user_id where event_type <> 'view' group by 1")
def j17(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("identifier"), F.col("n_name").alias("entity_id"))
    mentions = table(spark, d, "events").select(F.col("user_id").alias("identifier"), F.when(F.col("event_type") == "view", "PERSON").otherwise("PHONE").alias("entity_type"))
    return T.dictionary_mentions(mentions, names)


@query("a07_rrf_scores", """with r as (select event_type, user_id, min(event_id) as e from events where event_type in ('signup', 'error') group by 1, 2), k as (select event_type, user_id, row_number() over (partition by event_type order by e, user_id) as k from r),
s as (select user_id, round(cast(sum(cast((case event_type when 'error' then 2.0 else 1.0 end)::double / (60 + k) as decimal(38,18))) as double), 9) as score from k group by 1)
select user_id, score, cast(row_number() over (order by score desc, user_id) as int) as rank from s order by rank limit 500""")
def a07(spark, d):
    """Two whole rankings fused with unequal weights; None numbers them by range partitions."""
    e = table(spark, d, "events")
    side = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("rank"))
    return R.fuse({"bm25": side("signup"), "vector": side("error")}, {"bm25": 1.0, "vector": 2.0}, 500, key="user_id", page=None).select("user_id", "score", "rank")


@query("a09_newest_checkpoint", "select conv_id, arg_max(text, turn * 10 + length(role)) as text from conversations group by 1")
def a09(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), (F.col("turn") * 10 + F.length("role")).alias("ts"), F.to_json(F.struct("text")).alias("state"), F.lit(0).alias("seq"))
    bad = c.withColumn("state", F.lit("{broken")).withColumn("ts", F.col("ts") + 1000)
    return M.newest_checkpoints(c.unionByName(bad)).select(F.col("thread_id").alias("conv_id"), F.get_json_object("state", "$.text").alias("text"))


@query("r05_modality_problems", "select doc_id, case when doc_id % 3 = 0 then 'wrong_modality' when doc_id % 3 = 1 then 'reference_mismatch' end as problem from labels where doc_id % 3 <> 2")
def r05(spark, d):
    k = F.col("doc_id") % 3
    c = table(spark, d, "labels").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.when(k == 0, "vector").otherwise("bm25").alias("modality"), F.lit("r").alias("record_id"), F.struct(F.when(k == 1, "x").otherwise("r").alias("record_id")).alias("source_ref"))
    return R.modality_problems(c, "bm25").select("doc_id", "problem")


@query("w02_dense_ranks", "select user_id, cast(row_number() over (order by r, user_id) as int) as rank from (select user_id, min(event_id) as r from events where event_type = 'error' group by 1) order by rank limit 1000")
def w02(spark, d):
    """Ranks with gaps and repeats become 1, 2, ... of the distinct chunks of a page of 1000."""
    hits = table(spark, d, "events").filter("event_type = 'error'").select("user_id", F.col("event_id").alias("rank"))
    return R.fuse({"bm25": hits}, {"bm25": 1.0}, 1000, key="user_id").select("user_id", F.col("contributions")[0]["rank"].alias("rank"))


@query("w03_evidence_sequence", "select conv_id as thread_id, turn as evidence_id, 100 + row_number() over (partition by conv_id order by cast(turn as string)) as sequence from (select distinct conv_id, turn from conversations)")
def w03(spark, d):
    c = table(spark, d, "conversations")
    index = c.select(F.col("conv_id").alias("thread_id")).distinct().select("thread_id", F.lit("old").alias("evidence_id"), F.lit(100).cast("bigint").alias("sequence"), F.lit("x").alias("display"))
    new = c.select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("string").alias("evidence_id"), F.lit("y").alias("display")).distinct()
    return M.upsert_cards(index, new, 2**31 - 1, F.lit(False)).filter("evidence_id <> 'old'").select("thread_id", F.col("evidence_id").cast("bigint").alias("evidence_id"), "sequence")


@query("w06_chunk_index", f"{X.chunks_sql('conversations', 'conv_id, turn, role', 'text', 80, 20)} select conv_id, turn, role, cast(i as int) as chunk_index, cast(s as int) as char_start from w")
def w06(spark, d):
    c = table(spark, d, "conversations").withColumn("record_id", F.struct("conv_id", "turn", "role"))
    return X.chunk_text(c.select(F.to_json("record_id").alias("record_id"), "text"), 80, 20).select(
        F.get_json_object("record_id", "$.conv_id").cast("bigint").alias("conv_id"), F.get_json_object("record_id", "$.turn").cast("bigint").alias("turn"), F.get_json_object("record_id", "$.role").alias("role"), "chunk_index", "char_start"
    )


@query("t05_crosswalk", "select concat('same-event:c', p_partkey, ':m', p_partkey, ':reconciliation@1') as event_id from part where p_partkey % 2 = 0")
def t05(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    r = p.select(F.concat(F.lit("m"), "k").alias("msg_id"), F.array(F.concat(F.lit("c"), "k")).alias("candidates"), F.when(F.col("p_partkey") % 2 == 0, "same_event").otherwise("abstain").alias("outcome"))
    return T.crosswalk(r).select("event_id")


@query("t04_mail_checks", "select p_partkey, case when p_partkey % 2 = 0 then 'Subject' else 'To:domain' end as problem from part where p_partkey % 5 = 0")
def t04(spark, d):
    k = F.col("p_partkey")
    bad = k % 5 == 0
    headers = F.create_map(F.lit("From"), F.lit("a@x.example"), F.lit("To"), F.when(bad & (k % 2 != 0), "b@x.com").otherwise("b@x.example"), F.lit("Date"), F.lit("d"), F.lit("Subject"), F.when(bad & (k % 2 == 0), "").otherwise("s"), F.lit("X-Source-Record-ID"), F.lit("i"))
    return T.mail_problems(table(spark, d, "part").select("p_partkey", headers.alias("headers"))).select("p_partkey", F.col("problems")[0].alias("problem"))


@query("t01_totals", "select source as source_system, count(*) as n from documents group by 1 having count(*) <> 49")
def t01(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("source_system"))
    return L.total_problems(docs, docs.distinct().withColumn("want", F.lit(49).cast("bigint"))).select("source_system", "n")


@query("x11_draft_violations", "select p_partkey, case p_partkey % 4 when 0 then 'missing_key' when 1 then 'unexpected_key' when 2 then 'missing_source' end as violation from part where p_partkey % 4 <> 3")
def x11(spark, d):
    k = F.col("p_partkey") % 4
    e = table(spark, d, "part").select("p_partkey", F.when(k == 0, "PHONE").otherwise("PERSON").alias("entity_type"), F.when(k == 1, "key").alias("normalized_key"), F.lit("r").alias("scope"), F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("r"))).alias("source_refs"))
    return S.draft_violations(e).filter(F.size("violations") > 0).select("p_partkey", F.col("violations")[0].alias("violation"))


@query("m11_tool_outcomes", "select p_partkey, case when p_partkey % 5 = 0 then 'transient_exhausted' when p_partkey % 5 = 1 then 'permanent_failed' when p_partkey % 5 = 2 then 'empty' when p_partkey % 5 = 3 then 'partial' else 'complete' end as status from part")
def m11(spark, d):
    k = F.col("p_partkey") % 5
    error = F.when(k == 0, "timeout").when(k == 1, "bad_request")
    return table(spark, d, "part").select("p_partkey", M.tool_outcome(F.when(k == 2, 0).otherwise(3), k == 3, error)["status"].alias("status"))


@query("n07_order_independent", "select user_id, arg_min(event_type, event_id) as label from events group by 1")
def n07(spark, d):
    """The merge of A-01 over rows in a shuffled order."""
    e = table(spark, d, "events").repartition(7, "value").select(F.col("user_id").alias("entity_id"), F.lit("P").alias("entity_type"), F.col("event_type").alias("label"), F.lit(None).cast("string").alias("normalized_key"), F.array(F.lit("r")).alias("source_refs"), F.col("event_id").alias("seq"))
    return G.merged_entities(e).select(F.col("entity_id").alias("user_id"), "label")


@query("n08_stream_reconciliation", "select cast(a.event_id as string) as msg_id, cast(b.event_id as string) as cdr_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'view' and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000")
def n08c(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("sender"), F.col("user_id").alias("receiver"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return N.stream_reconciliation(e.filter("event_type = 'click'").withColumnRenamed("id", "msg_id"), e.filter("event_type = 'view'").withColumnRenamed("id", "cdr_id"), 3600).select("msg_id", "cdr_id")


@query("l01_redacted_maps", "select n_nationkey, '[REDACTED]' as secret, n_name as name from nation")
def l01m(spark, d):
    m = X.redacted_map(F.create_map(F.lit("api_key"), F.col("n_name"), F.lit("name"), F.col("n_name")))
    return table(spark, d, "nation").select("n_nationkey", m["api_key"].alias("secret"), m["name"].alias("name"))


@query("l02_attribute_pipeline", "select n_nationkey, n_name as renamed from nation where n_nationkey % 2 = 0")
def l02(spark, d):
    a = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("old"), F.col("n_name"), F.lit("secret"), F.lit("s"), F.lit("genai"), F.lit("1"))).otherwise(F.create_map(F.lit("old"), F.col("n_name")))
    out = L.attribute_pipeline(table(spark, d, "nation").select("n_nationkey", a.alias("attributes")), ["secret"], {"old": "new"}, "genai")
    return out.filter(~F.map_contains_key("attributes", "secret")).select("n_nationkey", F.col("attributes")["new"].alias("renamed"))


@query("l03_token_usage", "select s_suppkey, s_suppkey as input, case when s_suppkey % 2 = 0 then 7 else 0 end as cache_write from supplier")
def l03(spark, d):
    k = F.col("s_suppkey").cast("bigint")
    m = F.when(k % 2 == 0, F.create_map(F.lit("prompt_tokens"), k, F.lit("cache_creation"), F.lit(7).cast("bigint"))).otherwise(F.create_map(F.lit("input"), k))
    return table(spark, d, "supplier").select("s_suppkey", L.token_usage(m).alias("u")).select("s_suppkey", "u.input", "u.cache_write")


@query("l04_error_classes", "select event_id, case when event_type = 'error' then 'transient' else 'permanent' end as class from events")
def l04(spark, d):
    return table(spark, d, "events").select("event_id", L.error_class(F.when(F.col("event_type") == "error", "timeout").otherwise("odd")).alias("class"))


@query("c05_duplicate_keys", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def c05(spark, d):
    return S.duplicate_keys(table(spark, d, "orders"), "o_custkey")


