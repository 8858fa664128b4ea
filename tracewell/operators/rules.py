"""Reconciliation, screening, identity and provenance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import iban_mod97, luhn_check_digit
from ..plans.lineage import cut

# Fixed values of the policy.
TOLERANCE_S, LOOKBACK_H, MIN_EVENTS, LOWER_MINOR, UPPER_MINOR, WINDOW_DAYS, MIN_COUNT = 90, 24, 2, 900_000, 1_000_000, 3, 3
AMOUNT_TOLERANCE, DATE_TOLERANCE, THETA_AUTO, THETA_MIN, MIN_CORROBORATORS = 50_000, 1, 0.9, 0.65, 2
WEIGHTS = {"name_similarity": 0.45, "alias_assertion": 0.3, "corroboration": 0.15, "temporal_context": 0.1}


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_us: str, right_us: str, tolerance_us: int) -> DataFrame:
    """Pairs equal in `on` whose times (microseconds, in columns of different names) differ by at most the tolerance.

    Time is cut into buckets as long as the tolerance; one side stands in three of them, so the join is an equi-join on
    keys and bucket, whose hot keys spread over time, and the exact test follows.
    """
    one = left.withColumn("_b", F.floor(F.col(left_us) / tolerance_us))
    three = right.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(right_us) / tolerance_us) + i)))
    return one.join(three, [*on, "_b"]).filter(F.abs(F.col(left_us) - F.col(right_us)) <= tolerance_us).drop("_b")


def reconciliation(messages: DataFrame, cdr: DataFrame, tolerance_s: int = TOLERANCE_S) -> DataFrame:
    """J-12, T-06: msg_id, candidates (sorted) and outcome of each message (msg_id, sender, receiver, imei, subscriber, ts).

    A record of the network (cdr_id, with the same columns) is a candidate if sender and receiver are the same, the
    times are close and the device or the subscriber agrees; more than one candidate means that nothing is decided.
    """
    c = cdr.select("cdr_id", "sender", "receiver", F.col("imei").alias("_imei"), F.col("subscriber").alias("_subscriber"), F.unix_micros("ts").alias("_c_us"))
    m = messages.withColumn("_m_us", F.unix_micros("ts"))
    pairs = interval_join(m, c, ["sender", "receiver"], "_m_us", "_c_us", tolerance_s * 1_000_000)
    pairs = pairs.filter(F.coalesce(F.col("imei") == F.col("_imei"), F.lit(False)) | F.coalesce(F.col("subscriber") == F.col("_subscriber"), F.lit(False)))
    found = pairs.groupBy("msg_id").agg(F.array_sort(F.collect_set("cdr_id")).alias("candidates"))
    out = messages.select("msg_id").join(found, "msg_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    n = F.size("candidates")
    return out.withColumn("outcome", F.when(n == 0, "unmatched").when(n == 1, "same_event").otherwise("abstain"))


def crosswalk(reconciled: DataFrame) -> DataFrame:
    """T-05: an id for each pair that is surely one event."""
    one = reconciled.filter("outcome = 'same_event'").withColumn("cdr_id", F.col("candidates")[0])
    return one.select("msg_id", "cdr_id", F.concat_ws(":", F.lit("same-event"), "cdr_id", "msg_id", F.lit("reconciliation@1")).alias("event_id"))


def canonical_events(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """T-07: events (record_id, ...) with event_id; both records of a pair share one, others keep their own."""
    ids = pairs.select(F.explode(F.array("msg_id", "cdr_id")).alias("record_id"), "event_id")
    return events.join(ids, "record_id", "left").withColumn("event_id", F.coalesce("event_id", "record_id"))


def before_transfer(transfers: DataFrame, events: DataFrame, hours: int = LOOKBACK_H, minor: int = LOWER_MINOR, least: int = MIN_EVENTS) -> DataFrame:
    """J-13, A-16: transfers (txn_id, a, b, amount_minor, ts) with at least `least` events between a and b, either way, in [ts - hours, ts).

    Spans of six hours are the buckets, so that a busy pair's events spread over several: an event is looked for in the
    transfer's span and those before it that the lookback reaches.
    """
    pair = lambda x, y: (F.least(x, y).alias("_p"), F.greatest(x, y).alias("_q"))
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (6 * 3_600_000_000))
    back = -(-hours // 6)
    t = transfers.filter(F.col("amount_minor") >= minor).select("txn_id", "ts", *pair("a", "b")).withColumn("_d", F.explode(F.sequence(span("ts") - back, span("ts"))))
    e = events.select("event_id", F.col("ts").alias("_ts"), *pair("a", "b"), span("ts").alias("_d"))
    near = t.join(e, ["_p", "_q", "_d"]).filter((F.col("_ts") < F.col("ts")) & (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp")) <= hours * 3_600_000_000))
    return near.groupBy("txn_id").agg(F.count_distinct("event_id").alias("events")).filter(F.col("events") >= least)


def contacts_before(events: DataFrame, endpoint: str, at: Column, hours: int = 48) -> DataFrame:
    """J-14: events of an endpoint in [at - hours, at)."""
    window = (F.col("ts") < at) & (F.col("ts") >= at - F.expr(f"interval {hours} hours"))
    return events.filter(window & ((F.col("from_endpoint") == endpoint) | (F.col("to_endpoint") == endpoint)))


def business_day(day: Column) -> Column:
    """W-07: the ordinal of a day's business day, Monday to Friday; a weekend counts with the Friday before. Monday 1969-12-29 starts the count."""
    n = F.datediff(day, F.lit("1969-12-29").cast("date"))
    return F.floor(n / 7).cast("long") * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4))


def structuring(transactions: DataFrame, group: str, days: int = WINDOW_DAYS, least: int = MIN_COUNT, lower: int = LOWER_MINOR, upper: int = UPPER_MINOR, each_day: bool = True) -> DataFrame:
    """A-15: groups with `least` or more booked EUR payments in [lower, upper) within `days` business days, with activity on each of them.

    transactions: group, day, amount_minor, currency, status. One row per group and day goes into the window.
    """
    band = transactions.filter((F.col("status") == "booked") & (F.col("currency") == "EUR") & (F.col("amount_minor") >= lower) & (F.col("amount_minor") < upper))
    daily = band.groupBy(group, business_day(F.col("day")).alias("bday")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy("bday").rangeBetween(-(days - 1), 0)
    hits = daily.withColumn("payments", F.sum("n").over(w)).withColumn("active", F.count(F.lit(1)).over(w)).filter(F.col("payments") >= least)
    return hits.filter(F.col("active") == days) if each_day else hits


def approximate_reference(mentions: DataFrame, transactions: DataFrame) -> DataFrame:
    """J-16: mention_id, candidates, outcome; same currency, amount and date near, the named counterparty where one is named.

    The day and the amount's bucket, as wide as the tolerance, are the join's key. Without a name, more than one candidate means abstaining; the result is a candidate, never a fact.
    """
    t = transactions.select("txn_id", "currency", F.col("amount_minor").alias("_amount"), F.col("day").alias("_day"), F.floor(F.col("amount_minor") / AMOUNT_TOLERANCE).alias("_bucket"), F.col("counterparty").alias("_name"))
    m = mentions.withColumn("_day", F.explode(F.transform(F.sequence(F.lit(-DATE_TOLERANCE), F.lit(DATE_TOLERANCE)), lambda i: F.date_add("day", i))))
    m = m.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("amount_minor") / AMOUNT_TOLERANCE) + i)))
    near = m.join(t, ["currency", "_day", "_bucket"]).filter((F.abs(F.col("amount_minor") - F.col("_amount")) <= AMOUNT_TOLERANCE) & (F.col("counterparty").isNull() | (F.col("counterparty") == F.col("_name"))))
    found = near.groupBy("mention_id").agg(F.array_sort(F.collect_set("txn_id")).alias("candidates"))
    out = mentions.select("mention_id", "counterparty").join(found, "mention_id", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return out.withColumn("outcome", F.when(F.coalesce(n, F.lit(0)) < 1, "none").when((n > 1) & F.col("counterparty").isNull(), "abstain").otherwise("candidate"))


def identity_score(features: DataFrame) -> DataFrame:
    """A-20: the weighted sum of the features, cut to [0, 1], and what follows from it.

    A shared asset of one type decides by itself; people are never merged on a shared phone or account alone, and names
    in different scripts, or too few independent corroborators, go to review.
    """
    total = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in WEIGHTS.items()), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)
    decision = (
        F.when(F.col("same_asset"), "auto").when(F.col("shared_phone_or_iban_only"), "never").when(F.col("conflict") | F.col("cross_script_name_only"), "review")
        .when((F.col("score") >= THETA_AUTO) & (F.col("corroborators") >= MIN_CORROBORATORS), "auto").when(F.col("score") >= THETA_MIN, "review").otherwise("none")
    )
    return features.withColumn("score", score).withColumn("decision", decision)


def mention_counts(mentions: DataFrame, least: int = 1) -> DataFrame:
    """A-13, J-17: mentions by entity of assets."""
    return mentions.filter(F.col("entity_type").isin("PHONE", "DEVICE")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def dictionary_mentions(mentions: DataFrame, dictionary: DataFrame, least: int = 1) -> DataFrame:
    """J-17: mentions (identifier, entity_type) counted under the entity that the dictionary (identifier, entity_id) gives; unknown ones are left out."""
    return mention_counts(mentions.join(dictionary.select("identifier", "entity_id").distinct(), "identifier"), least)


def activity(events: DataFrame, least: int = 3) -> DataFrame:
    """A-14: endpoints in at least so many events; an event with one endpoint on both sides counts once."""
    ends = events.select(F.explode(F.array_distinct(F.array("from_endpoint", "to_endpoint"))).alias("endpoint"))
    return ends.filter("endpoint is not null").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def not_increasing(rows: DataFrame, seq: str, order: str, group: list[str]) -> DataFrame:
    """W-08: rows whose number is not above the one before, by file."""
    return rows.withColumn("_before", F.lag(seq).over(Window.partitionBy(*group).orderBy(order))).filter(F.col("_before") >= F.col(seq)).drop("_before")


def cdr_problems(cdr: DataFrame) -> DataFrame:
    """T-02: check digit of the device, the offset of the local time, and durations that fit the kind."""
    luhn = F.substring("imei", 15, 1).try_cast("int") == luhn_check_digit(F.substring("imei", 1, 14))
    sms = F.col("record_type").startswith("SMS")
    found = F.array_compact(F.array(
        F.when(F.col("imei").isNotNull() & ~F.coalesce(luhn, F.lit(False)), F.lit("imei")), F.when(~F.col("ts_local").endswith("+02:00"), F.lit("offset")),
        F.when(sms & F.col("duration_s").isNotNull(), F.lit("sms_duration")), F.when(~sms & ~F.coalesce(F.col("duration_s").between(20, 900), F.lit(False)), F.lit("call_duration")),
    ))
    return cdr.withColumn("problems", found).filter(F.size("problems") > 0)


def bank_problems(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """T-03, J-15: IBANs by check digits and uniqueness, amounts by form, and accounts that transactions lack."""
    bad = accounts.filter(F.coalesce(iban_mod97("iban") != 1, F.lit(True))).select(F.lit("iban").alias("problem"), F.col("account_id").alias("id"))
    twice = accounts.groupBy("iban").agg(F.count(F.lit(1)).alias("n"), F.min("account_id").alias("id")).filter("n > 1").select(F.lit("duplicate_iban").alias("problem"), "id")
    form = transactions.filter(~F.col("amount_text").rlike(r"^\d+\.\d{2}$")).select(F.lit("amount").alias("problem"), F.col("txn_id").alias("id"))
    ends = transactions.select(F.col("txn_id").alias("id"), F.explode(F.array("debtor_iban", "creditor_iban")).alias("iban"))
    lost = ends.join(accounts.select("iban"), "iban", "left_anti").select(F.lit("unknown_account").alias("problem"), "id").distinct()
    return bad.unionByName(twice).unionByName(form).unionByName(lost)


def mail_problems(mails: DataFrame) -> DataFrame:
    """T-04: headers that must stand, and domains that must be examples."""
    need = ["From", "To", "Date", "Subject", "X-Source-Record-ID"]
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.length(F.col("headers")[h]), F.lit(0)) == 0, F.lit(h)) for h in need]))
    domain = F.array_compact(F.array(*[F.when(~F.coalesce(F.col("headers")[h], F.lit("")).rlike(r"@[\w.-]*\.example\W*$"), F.lit(f"{h}:domain")) for h in ("From", "To")]))
    return mails.withColumn("problems", F.concat(lacking, domain)).filter(F.size("problems") > 0)


def resolution_decisions(mentions: DataFrame) -> DataFrame:
    """T-08, T-09: mentions of each entity, in order, with the weakest status of any."""
    return mentions.groupBy("entity_id").agg(F.array_sort(F.collect_set("mention_id")).alias("mention_ids"), F.when(F.max(F.col("status") == "proposed"), "proposed").otherwise("confirmed").alias("status"))


def forbidden_merges(decisions: DataFrame, forbidden: DataFrame) -> DataFrame:
    """T-10: forbidden pairs (a, b of mention ids) that stand in one entity."""
    m = decisions.select("entity_id", F.explode("mention_ids").alias("m"))
    a = forbidden.join(m.select(F.col("m").alias("a"), F.col("entity_id").alias("_ea")), "a")
    return a.join(m.select(F.col("m").alias("b"), F.col("entity_id").alias("_eb")), "b").filter("_ea = _eb").select("a", "b", F.col("_ea").alias("entity_id"))


def valid_at(assertions: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """T-11: assertions that hold at an event's time: valid_from inclusive, valid_to exclusive, null open."""
    j = events.join(assertions, key)
    return j.filter((F.col("valid_from").isNull() | (F.col("ts") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to"))))


def source_ref_id(record_version: Column, payload: Column) -> Column:
    """T-12."""
    return F.concat(F.lit("src:"), record_version, F.lit(":"), F.sha2(payload, 256))


def walks(edges: DataFrame, root: str, growth: int = 4) -> DataFrame:
    """(kind, node_id): what the root reaches, and nodes that end (`back`) or begin (`onward`) walks without end.

    Pointer doubling: the pairs one walk of 1, 2, 4, ... edges apart. A round adds to what is reached all that is one such
    pair further, and takes from the others what has no pair; rounds are as many as the logarithm of the longest path.
    Pairs are doubled only while the next ones would be at most `growth` times the edges, by a count made before the join;
    from then on rounds go by the longest pairs there are. Nothing bounds the rounds but that one changes nothing.
    """
    jump = cut(edges.select("parent", "child").distinct())
    most, size = growth * jump.count() + 1000, None
    of = lambda c, kind: jump.select(F.lit(kind).alias("kind"), F.col(c).alias("node_id"))
    start = edges.sparkSession.createDataFrame([("reached", root)], "kind string, node_id string")
    state = cut(start.unionByName(of("child", "back")).unionByName(of("parent", "onward")).distinct())
    while True:
        now = {r.kind: r.n for r in state.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if now == size:
            return state
        size = now
        kind = lambda k: state.filter(F.col("kind") == k).select("node_id")
        further = jump.join(kind("reached"), F.col("parent") == F.col("node_id"), "left_semi").select(F.lit("reached").alias("kind"), F.col("child").alias("node_id"))
        back = jump.join(kind("back"), F.col("parent") == F.col("node_id"), "left_semi").select(F.lit("back").alias("kind"), F.col("child").alias("node_id"))
        onward = jump.join(kind("onward"), F.col("child") == F.col("node_id"), "left_semi").select(F.lit("onward").alias("kind"), F.col("parent").alias("node_id"))
        state = cut(state.filter("kind = 'reached'").unionByName(further).unionByName(back).unionByName(onward).distinct())
        into, out = jump.groupBy(F.col("child").alias("at")).agg(F.count(F.lit(1)).alias("i")), jump.groupBy(F.col("parent").alias("at")).agg(F.count(F.lit(1)).alias("o"))
        if (into.join(out, "at").agg(F.sum(F.col("i").cast("decimal(38,0)") * F.col("o"))).first()[0] or 0) <= most:
            ahead = jump.select(F.col("parent").alias("at"), F.col("child").alias("end"))
            jump = cut(jump.join(ahead, F.col("child") == F.col("at")).select("parent", F.col("end").alias("child")).distinct())
        else:
            most = -1  # the pairs stay as they are


def dag_problems(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """T-13: duplicate nodes, edges without ends, cycles, nodes that the root does not reach, and leaves that are no source or policy.

    nodes: node_id, kind; edges: parent, child. Nodes of cycles are those that both end and begin walks without end: the
    cycles, and the ways between them.
    """
    say = lambda df, what, c="node_id": df.select(F.lit(what).alias("problem"), F.col(c).alias("node_id")).distinct()
    twice = say(nodes.groupBy("node_id").count().filter("count > 1"), "duplicate_node")
    ends = edges.select(F.explode(F.array("parent", "child")).alias("node_id")).distinct()
    lost = say(ends.join(nodes, "node_id", "left_anti"), "missing_node")
    leaves = nodes.join(edges.select(F.col("parent").alias("node_id")), "node_id", "left_anti").filter(~F.col("kind").isin("source_ref", "policy"))
    found = walks(edges, root)
    reached = found.filter("kind = 'reached'").select("node_id").join(nodes.filter(F.col("node_id") == root).limit(1).select(F.lit(1).alias("_there")))
    cycle = found.filter("kind = 'back'").select("node_id").join(found.filter("kind = 'onward'").select("node_id"), "node_id", "left_semi")
    problems = twice.unionByName(lost).unionByName(say(leaves, "open_leaf")).unionByName(say(nodes.join(reached, "node_id", "left_anti"), "unreachable"))
    return problems.unionByName(say(cycle, "cycle"))


def provenance_dag(results: DataFrame, support: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-14: a screening result's graph: result to supporting records, records to their source references, each result to its policy."""
    result = F.concat(F.lit("result:"), "result_id")
    policy = F.concat(F.lit("policy:"), "policy_version")
    edges = results.select(result.alias("parent"), policy.alias("child")).unionByName(support.select(result.alias("parent"), F.concat(F.lit("record:"), "record_id").alias("child")))
    edges = edges.unionByName(refs.select(F.concat(F.lit("record:"), "record_id").alias("parent"), "source_ref_id").withColumnRenamed("source_ref_id", "child")).distinct()
    kind = F.when(F.col("node_id").startswith("result:"), "screening_result").when(F.col("node_id").startswith("policy:"), "policy").when(F.col("node_id").startswith("record:"), "record").otherwise("source_ref")
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node_id")).distinct().withColumn("kind", kind)
    return nodes, edges


def screening_outcomes(fired: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """T-15, T-16: expected (key, must_fire) held against what fired."""
    hit = expected.join(fired.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").withColumn("fired", F.coalesce("_f", F.lit(False))).drop("_f")
    return hit.withColumn("passed", F.col("fired") == F.col("must_fire"))


def quarantine_outcome(kind: Column, ts_ok: Column, iban_ok: Column, money_ok: Column, headers_ok: Column, format_ok: Column) -> Column:
    """T-17: the first reason for which a record is set aside, or null."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(format_ok), "unsupported_format").when((kind == "email") & no(headers_ok), "email_header_error").when(no(ts_ok), "timestamp_parse_error")
        .when(kind.isin("account", "transaction") & no(iban_ok), "iban_checksum_error").when((kind == "transaction") & no(money_ok), "currency_scale_error")
    )


def conflicts(stored: DataFrame, incoming: DataFrame, key: str = "record_id") -> DataFrame:
    """T-17: incoming records whose id is known with another content."""
    return incoming.join(stored.select(key, F.col("content_hash").alias("_had")), key).filter("_had <> content_hash").drop("_had").withColumn("outcome", F.lit("conflict_no_overwrite"))
