"""Replay of the append-only request ledger and crash recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.identity import intent_id
from trailmark.functions.receipts import failure_payload
from trailmark.vocab import STARTED_EVENT, TERMINAL_EVENT_STATES

# A history is decided by its first three relevant events.
DECIDING_EVENTS = 3
STATES = ("COMPLETED", "FAILED", "INTERRUPTED_UNKNOWN")
_START = 0
INTERRUPTED_REASON = "prior run ended without terminal receipt"  # fixed value: it is recorded in ledgers


def event_code(event_type: Column) -> Column:
    """0 for a start, 1.. for a terminal event's state, NULL for any other event.

    Integer codes keep the replay in hash aggregation.
    """
    code = F.when(event_type == STARTED_EVENT, _START)
    for number, state in enumerate(STATES, start=1):
        events = [e for e, s in TERMINAL_EVENT_STATES.items() if s == state]
        code = code.when(event_type.isin(*events), number)
    return code


def state_name(code: Column) -> Column:
    name = F.when(code == 1, STATES[0])
    for number, state in enumerate(STATES[1:], start=2):
        name = name.when(code == number, state)
    return name


def ledger_event_order(ledger: DataFrame, keep: int | None = None) -> DataFrame:
    """Start and terminal events per intent, numbered in ``seq`` order; all, or the first ``keep``.

    With ``keep`` the row_number filter becomes a group limit that runs before the shuffle, so an
    intent with any number of events sends at most ``keep`` rows per task. Events without
    ``seq`` come last; of equal ones starts come first, then terminal events by state.
    """
    relevant = ledger.where(F.col("intent_id").isNotNull()).withColumn(
        "code", event_code(F.col("event_type"))
    )
    order = Window.partitionBy("intent_id").orderBy(F.col("seq").asc_nulls_last(), "code")
    numbered = relevant.where(F.col("code").isNotNull()).withColumn(
        "event_ordinal", F.row_number().over(order)
    )
    return numbered if keep is None else numbered.where(F.col("event_ordinal") <= keep)


def intent_states(ledger: DataFrame, strict: bool = False) -> DataFrame:
    """State per intent; an invalid history has a ``violation`` and no state.

    Only [], [start] and [start, terminal] are valid. In strict mode an invalid
    history fails the job instead.
    """
    ordered = ledger_event_order(ledger, DECIDING_EVENTS)
    at = lambda n: F.max(F.when(F.col("event_ordinal") == n, F.col("code")))
    first = ordered.groupBy("intent_id").agg(*[at(n).alias(f"e{n}") for n in (1, 2, 3)])
    e1, e2, e3 = F.col("e1"), F.col("e2"), F.col("e3")
    violation = (
        F.when(e1 != _START, "TERMINAL_WITHOUT_START")
        .when(e2 == _START, "DUPLICATE_START")
        .when(e3 == _START, "DUPLICATE_START")
        .when(e3.isNotNull(), "DUPLICATE_TERMINAL")
    )
    if strict:
        text = F.concat(F.lit("invalid intent history "), F.col("intent_id"), F.lit(": "), violation)
        violation = F.when(violation.isNotNull(), F.raise_error(text).cast("string"))
    state = F.when(e2.isNull(), "STARTED_UNKNOWN").otherwise(state_name(e2))
    decided = first.withColumn("violation", violation)
    return decided.select(
        "intent_id", F.when(F.col("violation").isNull(), state).alias("state"), "violation"
    )


def interrupted_intents(ledger: DataFrame) -> DataFrame:
    """The INTERRUPTED_UNKNOWN event of every dangling start, numbered as ``append_ledger`` takes it."""
    dangling = intent_states(ledger).where(F.col("state") == "STARTED_UNKNOWN")
    reason = F.lit(INTERRUPTED_REASON)
    events = dangling.select(
        F.lit("INTERRUPTED_UNKNOWN").alias("event_type"),
        "intent_id",
        reason.alias("reason"),
        F.parse_json(F.to_json(F.struct(reason.alias("reason")))).alias("payload"),
    )
    return numbered_after(events, ledger).select("seq", "event_type", "intent_id", "reason", "payload")


def recovery_events(ledger: DataFrame, recovery: DataFrame, stage: str = "BASE") -> DataFrame:
    """The terminal events that a resume must append, as ``append_ledger`` takes them.

    ``recovery`` is what ``intent_receipt_recovery`` says of the intents of one stage (BASE,
    CHECKPOINT or RUNTIME_LOAD). An intent with a receipt gets the event of its status, one without
    is marked as interrupted; all other actions need no event.
    """
    receipt = F.regexp_extract("action", "^RECOVER_(.*)$", 1)
    stage_event = F.concat(F.lit(f"{stage}_"), receipt)
    needed = recovery.where(F.col("action").startswith("RECOVER_") | (F.col("action") == "MARK_INTERRUPTED"))
    events = needed.select(
        "intent_id",
        F.when(receipt.isin("COMPLETED", "FAILED"), stage_event).otherwise("INTERRUPTED_UNKNOWN").alias("event_type"),
        F.parse_json(
            F.when(receipt == "", F.to_json(F.struct(F.lit(INTERRUPTED_REASON).alias("reason"))))
            .otherwise(F.to_json(F.struct(F.lit(True).alias("recovered"))))
        ).alias("payload"),
    ).dropDuplicates(["intent_id"])
    return numbered_after(events, ledger).select("seq", "event_type", "intent_id", "payload")


def numbered_after(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds ``seq``: whole numbers after the ledger's last, in order of the digest of ``intent_id``.

    The first three hex digits of the digest deal rows into 4,096 even buckets that are in order; a
    number is the place in the bucket plus the sizes of the buckets before.
    """
    digest = F.sha2("intent_id", 256)
    dealt = events.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, 3)})
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_rows"))  # 4,096 rows at most
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", "intent_id"))
    last = F.coalesce(ledger.agg(F.max("seq")).scalar(), F.lit(0))
    numbered = dealt.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    seq = (last + F.col("_before") + F.col("_place")).cast("bigint")
    return numbered.withColumn("seq", seq).drop("_digest", "_bucket", "_place", "_before")


def intent_receipt_recovery(states: DataFrame, receipts: DataFrame) -> DataFrame:
    """What a resume must do per intent, from ledger state and stored receipts.

    ``receipts`` has (receipt_id, status); UNAVAILABLE checkpoints never have an intent
    and are left out. Receipts are counted per id and status before the join, so
    repeated receipts of one id arrive as a single row.
    """
    stored = (
        receipts.where(~F.col("status").eqNullSafe("UNAVAILABLE"))
        .groupBy(intent_id(F.col("receipt_id")).alias("intent_id"), F.coalesce("status", F.lit("UNKNOWN")).alias("receipt_status"))
        .agg(F.count("*").alias("receipts"))
    )
    both = states.join(stored, "intent_id", "full")
    state, receipt = F.col("state"), F.col("receipt_status")
    action = (
        F.when(F.col("violation").isNotNull(), "ERROR_INVALID_HISTORY")
        .when(state.isNull(), "ERROR_RECEIPT_WITHOUT_INTENT")
        .when((state == "STARTED_UNKNOWN") & receipt.isNull(), "MARK_INTERRUPTED")
        .when((state == "STARTED_UNKNOWN") & receipt.isin(*STATES), F.concat(F.lit("RECOVER_"), receipt))
        .when(state == "STARTED_UNKNOWN", "ERROR_UNSUPPORTED_RECEIPT_STATUS")
        .when(state.isin("COMPLETED", "FAILED") & receipt.isNull(), "ERROR_TERMINAL_WITHOUT_RECEIPT")
        .when(receipt.isNull(), "SYNTHESISE_INTERRUPTED_RECEIPT")
        .otherwise("KEEP")
    )
    return both.select(
        "intent_id", "state", "receipt_status",
        F.coalesce("receipts", F.lit(0)).cast("bigint").alias("receipts"),
        action.alias("action"),
    )


def interrupted_receipts(
    planned: DataFrame, recovery: DataFrame, id_column: str = "rollout_id"
) -> DataFrame:
    """Receipts to write for planned rollouts or checkpoints that ended without one.

    Keeps the planned identity columns and adds status and failure.
    """
    needed = recovery.where(
        F.col("action").isin("MARK_INTERRUPTED", "SYNTHESISE_INTERRUPTED_RECEIPT")
    ).select(F.col("intent_id").alias("needed_intent"))
    rows = planned.join(needed, intent_id(F.col(id_column)) == F.col("needed_intent"), "left_semi")
    failure = failure_payload(
        F.lit("INTERRUPTED_UNKNOWN"),
        F.lit("prior invocation ended after intent start without a receipt"),
        F.lit(False),
        F.lit(None).cast("double"),
    )
    return rows.withColumns({"status": F.lit("INTERRUPTED_UNKNOWN"), "failure": failure})


def invocation_log(ledger: DataFrame) -> DataFrame:
    """Outcome per started invocation; NULL outcome means it never finished.

    Starts and finishes meet in one aggregate instead of a self join.
    """
    started = F.col("event_type") == "RUN_INVOCATION_STARTED"
    finished = F.col("event_type") == "RUN_INVOCATION_FINISHED"
    events = ledger.where((started | finished) & F.col("invocation_id").isNotNull())
    last = F.max(F.when(finished, F.struct("seq", "outcome", "error_type")))
    grouped = events.groupBy("invocation_id").agg(
        F.count_if(started).cast("bigint").alias("starts"),
        F.count_if(finished).cast("bigint").alias("finishes"),
        F.min(F.when(started, F.col("seq"))).alias("first_seq"),
        last.alias("last"),
    )
    return grouped.where(F.col("starts") > 0).select(
        "invocation_id", "starts", "finishes", "first_seq", "last.outcome", "last.error_type"
    )
