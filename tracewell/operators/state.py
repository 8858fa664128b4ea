"""Evidence index, grounding, history and paging."""

from __future__ import annotations

import base64
import json
import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import claims_absence

DISPLAY = 4000
INCOMPLETE = ["partial", "exhausted", "limited", "transient_exhausted", "permanent_failed", "cancelled", "policy_rejected", "retrieval_incomplete"]


def upsert_cards(index: DataFrame, new: DataFrame, most: int, protected: Column, display: int = DISPLAY) -> DataFrame:
    """M-01, W-03, W-05: cards (thread_id, evidence_id, sequence, display, ...) with new ones put in where absent.

    New cards get the thread's next numbers in the order of their ids; then the oldest unprotected go until `most` are left.
    """
    fresh = new.join(index.select("thread_id", "evidence_id"), ["thread_id", "evidence_id"], "left_anti").dropDuplicates(["thread_id", "evidence_id"])
    last = index.groupBy("thread_id").agg(F.max("sequence").alias("_last"))
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("evidence_id"))
    fresh = fresh.join(last, "thread_id", "left").withColumn("sequence", (F.coalesce("_last", F.lit(0)) + place).cast("long")).drop("_last").withColumn("display", F.substring("display", 1, display))
    return evicted(index.unionByName(fresh.select(*index.columns)), most, protected)


def evicted(cards: DataFrame, most: int, protected: Column) -> DataFrame:
    """W-05: the oldest by (protected, sequence, id) go; protected cards go last."""
    order = Window.partitionBy("thread_id").orderBy(protected.cast("int").desc(), F.desc("sequence"), F.desc("evidence_id"))
    return cards.withColumn("_keep", F.row_number().over(order)).filter(F.col("_keep") <= most).drop("_keep")


def merge_indexes(left: DataFrame, right: DataFrame, most: int, protected: Column) -> DataFrame:
    """M-02: of two branches' cards the one with the lower number stays; equal numbers move up; then W-05."""
    both = left.unionByName(right)
    others = [c for c in both.columns if c not in ("thread_id", "evidence_id", "sequence")]
    one = both.groupBy("thread_id", "evidence_id").agg(F.min("sequence").alias("sequence"), *[F.min_by(c, "sequence").alias(c) for c in others])
    return evicted(spread_sequences(one, ["thread_id"], "evidence_id").select(*left.columns), most, protected)


def spread_sequences(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """W-04: numbers made distinct: in the order of (sequence, key) each is at least one above the one before."""
    w = Window.partitionBy(*group).orderBy("sequence", key)
    n = F.row_number().over(w)
    top = F.max(F.col("sequence") - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", n).withColumn("sequence", (top + F.col("_n")).cast("long")).drop("_n")


def citations(claims: DataFrame, cards: DataFrame) -> DataFrame:
    """J-20: one row for each source reference of each known card that a claim cites."""
    one = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id"))
    return one.join(cards.select("evidence_id", "source_refs"), "evidence_id").select("claim_id", "evidence_id", F.explode("source_refs").alias("source_ref"))


def violations(answers: DataFrame, claims: DataFrame, cards: DataFrame, max_chars: int = 16_000) -> DataFrame:
    """M-03, M-05, U-02: answer_id, violation for each deterministic rule that an answer breaks.

    answers: answer_id, answer, coverage_incomplete; claims: answer_id, claim_id, kind, material, text, evidence_ids;
    cards: evidence_id, status, source_refs, content_hash.
    """
    cited = claims.select("answer_id", "claim_id", "kind", "material", F.explode("evidence_ids").alias("evidence_id")).join(cards.withColumn("_known", F.lit(True)), "evidence_id", "left")
    unknown = cited.filter("_known is null").groupBy("answer_id").agg(F.concat(F.lit("unknown_evidence_ids:"), F.array_join(F.array_sort(F.collect_set("evidence_id")), ",")).alias("violation"))
    bare = cited.filter("_known").filter((F.coalesce(F.size("source_refs"), F.lit(0)) < 1) | F.col("content_hash").isNull() | (F.col("content_hash") == "")).select("answer_id", F.lit("missing_provenance").alias("violation"))
    proposed = cited.filter("material and kind = 'verified' and status = 'proposed'").select("answer_id", F.concat(F.lit("unqualified_proposed:"), "claim_id").alias("violation"))
    uncited = claims.filter("material and kind <> 'limitation'").filter(F.coalesce(F.size("evidence_ids"), F.lit(0)) < 1).select("answer_id", F.concat(F.lit("uncited_material_claim:"), "claim_id").alias("violation"))
    says = claims.groupBy("answer_id").agg(F.count(F.lit(1)).alias("_n"), F.max(claims_absence(F.col("text"))).alias("_absent"))
    a = answers.join(says, "answer_id", "left")
    whole = F.array_compact(F.array(
        F.when(F.length("answer") > max_chars, F.lit("answer_too_long")),
        F.when(F.col("coverage_incomplete") & (F.coalesce("_absent", F.lit(False)) | claims_absence(F.col("answer"))), F.lit("absence_claim_from_incomplete_coverage")),
        F.when(F.coalesce("_n", F.lit(0)).eqNullSafe(0) & F.col("answer").rlike("[0-9]"), F.lit("no_material_claims")),
    ))
    out = a.select("answer_id", F.explode(whole).alias("violation"))
    for part in (unknown, bare, proposed, uncited):
        out = out.unionByName(part)
    return out.distinct()


def verdict_problems(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """J-21, M-04: claims without a verdict, verdicts without a claim, double and unsupported ones."""
    v = verdicts.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_n"), F.every("supported").alias("_ok"))
    both = claims.select("claim_id", F.lit(True).alias("_c")).join(v, "claim_id", "full_outer")
    what = F.when(F.col("_c").isNull(), "unknown_claim").when(F.col("_n").isNull(), "missing_verdict").when(F.col("_n") > 1, "duplicate_verdict").when(~F.col("_ok"), "unsupported")
    return both.select("claim_id", what.alias("problem")).filter("problem is not null")


def acceptance(pending_calls: Column, structured: Column, problems: Column, repairs: Column, verifier_failed: Column) -> Column:
    """M-12: what becomes of a draft: exactly one repair, and deterministic checks before the verifier's."""
    bad = ~structured | (problems > 0)
    return F.when(pending_calls & ~structured, "continue").when(bad & (repairs < 1), "repair").when(bad, "grounding_failed").when(verifier_failed, "transient_exhausted").otherwise("accepted")


def coverage_incomplete(outcomes: DataFrame) -> DataFrame:
    """P-19: turns with any tool outcome that leaves coverage open."""
    return outcomes.groupBy("turn_id").agg(F.coalesce(F.max(F.col("status").isin(INCOMPLETE)), F.lit(False)).alias("incomplete"))


def tool_outcome(rows: Column, limited: Column, error: Column) -> Column:
    """M-11: status, coverage and retryability of a tool's run."""
    status = F.when(error.isNotNull(), F.when(error.isin("timeout", "unavailable"), "transient_exhausted").otherwise("permanent_failed")).when(rows == 0, "empty").when(limited, "partial").otherwise("complete")
    return F.struct(status.alias("status"), (status == "complete").alias("covered"), F.coalesce(error.isin("timeout", "unavailable"), F.lit(False)).alias("retryable"))


def append_messages(history: DataFrame, new: DataFrame, max_turns: int) -> DataFrame:
    """M-06, N-05, A-12: messages (thread_id, turn_id, request_id, sequence, role, content, status) appended once per request.

    A repeated request adds nothing, a full thread takes no new turn, and an assistant's message needs the user's before it.
    """
    seen = history.select("thread_id", "request_id", "role").distinct()
    fresh = new.join(seen, ["thread_id", "request_id", "role"], "left_anti")
    full = history.groupBy("thread_id").agg(F.count_distinct("turn_id").alias("_turns"))
    known = history.select("thread_id", "turn_id").distinct().withColumn("_known", F.lit(True))
    fresh = fresh.join(full, "thread_id", "left").join(known, ["thread_id", "turn_id"], "left")
    fresh = fresh.filter(F.col("_known") | (F.coalesce("_turns", F.lit(0)) < max_turns))
    users = history.unionByName(new.select(*history.columns)).filter("role = 'user'").select("thread_id", "turn_id").distinct()
    answers = fresh.filter("role <> 'user'").join(users, ["thread_id", "turn_id"], "left_semi")
    return history.unionByName(fresh.filter("role = 'user'").select(*history.columns)).unionByName(answers.select(*history.columns))


def commit_turn(history: DataFrame, thread: str, turn: str, status: str) -> DataFrame:
    """M-06, M-07: the turn's messages get the status; other turns still running were abandoned."""
    mine = F.col("thread_id") == thread
    new = F.when(mine & (F.col("turn_id") == turn), status).when(mine & (F.col("status") == "running"), "interrupted").otherwise(F.col("status"))
    return history.withColumn("status", new)


def request_resolution(requests: DataFrame, history: DataFrame, max_turns: int) -> DataFrame:
    """M-08, N-05: new, resume, replay_completed, replay_failed, conflict or full for each request (thread_id, request_id, content)."""
    had = history.filter("role = 'user'").groupBy("thread_id", "request_id").agg(F.max("content").alias("_content"), F.max("status").alias("_status"))
    turns = history.groupBy("thread_id").agg(F.count_distinct("turn_id").alias("_turns"))
    r = requests.join(had, ["thread_id", "request_id"], "left").join(turns, "thread_id", "left")
    action = (
        F.when(F.col("_status").isNull(), F.when(F.coalesce("_turns", F.lit(0)) >= max_turns, "full").otherwise("new")).when(F.col("_content") != F.col("content"), "conflict")
        .when(F.col("_status") == "completed", "replay_completed").when(F.col("_status") == "failed", "replay_failed").otherwise("resume")
    )
    return r.withColumn("action", action).drop("_content", "_status", "_turns")


def overlay_status(messages: DataFrame, locks: DataFrame) -> DataFrame:
    """M-09: a running turn whose thread nobody holds reads as interrupted."""
    held = locks.select("thread_id", F.lit(True).alias("_held")).distinct()
    j = messages.join(held, "thread_id", "left")
    return j.withColumn("status", F.when((F.col("status") == "running") & F.col("_held").isNull(), "interrupted").otherwise(F.col("status"))).drop("_held")


class ThreadLocks:
    """M-10: one lease for a thread; a second asker learns whose request is active. Held by the driver alone."""

    def __init__(self) -> None:
        self._held, self._guard = {}, threading.Lock()

    def acquire(self, thread: str, request: str) -> str | None:
        with self._guard:
            return None if (owner := self._held.setdefault(thread, request)) == request else owner

    def release(self, thread: str, request: str) -> None:
        with self._guard:
            if self._held.get(thread) == request:
                del self._held[thread]


def newest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """S-20, A-09: the newest readable state of each thread; of equal times the first stays."""
    ok = checkpoints.filter(F.try_parse_json("state").isNotNull())
    return ok.groupBy("thread_id").agg(F.max("ts").alias("ts"), F.max_by("state", F.struct("ts", -F.col("seq"))).alias("state"))


def created_at(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """A-10."""
    first = messages.groupBy("thread_id").agg(F.min("created_at").alias("_first"))
    return threads.join(first, "thread_id", "left").withColumn("created_at", F.coalesce("_first", "opened_at")).drop("_first")


def usage_totals(usage: DataFrame, counters: Sequence[str]) -> DataFrame:
    """A-11."""
    return usage.groupBy("thread_id").agg(*[F.sum(c).alias(c) for c in counters])


def page_after(rows: DataFrame, order: Sequence[str], after: Sequence | None, size: int, most: int, descending: bool = False) -> DataFrame:
    """O-07, O-08: a page by keyset; one row more than the page tells that there is another."""
    key = F.struct(*order)
    if after is not None:
        bound = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)])
        rows = rows.filter(key < bound if descending else key > bound)
    return rows.orderBy(*[F.desc(c) if descending else F.asc(c) for c in order]).limit(min(size, most) + 1)


def encode_cursor(endpoint: str, values: Sequence) -> str:
    """O-09."""
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "e": endpoint, "k": list(values)}, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode_cursor(endpoint: str, cursor: str) -> list:
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(got, dict) or got.get("v") != 1 or got.get("e") != endpoint:
        raise ValueError("the cursor belongs to another endpoint or version")
    return got["k"]


def trimmed_steps(turns: DataFrame, max_chars: int) -> DataFrame:
    """W-10: of each turn (turn_id, head, steps: array of texts) the newest steps that fit beside the head, in order.

    A step that does not fit is left out and older ones may still fit; the newest stays in any case.
    """
    start = F.struct(F.length("head").alias("total"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, i: Column) -> Column:
        n = F.length(F.element_at("steps", i))
        fits = (F.size(a["kept"]) == 0) | (a["total"] + n <= max_chars)
        return F.struct(F.when(fits, a["total"] + n).otherwise(a["total"]).alias("total"), F.when(fits, F.concat(F.array(i), a["kept"])).otherwise(a["kept"]).alias("kept"))

    order = F.when(F.size("steps") > 0, F.reverse(F.sequence(F.lit(1), F.size("steps")))).otherwise(F.array().cast("array<int>"))
    out = turns.withColumn("_r", F.aggregate(order, start, step))
    return out.withColumn("kept", F.col("_r.kept")).withColumn("trimmed", F.size("_r.kept") < F.size("steps")).drop("_r")


def ordered_distinct(values: Column, most: int = 16) -> Column:
    """U-05."""
    return F.slice(F.array_distinct(values), 1, most)


def protected_ids(*sets: Column) -> Column:
    """U-06."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in sets]))))


def merge_pages(existing: DataFrame, page: DataFrame, key: str, last_wins: bool) -> DataFrame:
    """N-13: threads keep what is there and add the unseen; of messages the later page wins."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(page.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_p") if last_wins else F.asc("_p"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")
