"""M10. Replay a whole history: replies and organiser calls in one order per event.

Calls that change what counts (edit, complete, reopen) cut an event's history into epochs. Inside
an epoch the set-based decision applies, with the state at its start; between epochs the calls
are applied as joins. The loop runs as often as the event with the most such calls needs, and
events that have no more drop out of it. No event is ever folded row by row in one task.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countersign import schemas
from countersign.operators import lifecycle as L
from countersign.operators.decide import _yes, decide
from countersign.operators.ledger import apply_decisions, signature_rows
from countersign.operators.numbering import running_sums
from countersign.session import checkpointed

BARRIERS = ("edit", "complete", "reopen")
# Places inside this history, apart from any ledger number the records already mention.
PLACE = 1 << 61


class History:
    """What a replay yields."""

    def __init__(self, entries: DataFrame, events: DataFrame, signatures: DataFrame, calls: DataFrame, changes: DataFrame, completions: DataFrame):
        self.entries = entries  # numbered ledger entries of all kinds
        self.events = events  # final records
        self.signatures = signatures  # final signatures
        self.calls = calls  # outcome of every barrier call
        self.changes = changes  # edit changes, participants hashed
        self.completions = completions  # completion records, versioned


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def epochs(replies: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give replies and barrier calls their place `ord` in the event's history and their epoch.

    A call at the same instant as a reply comes first; replies of one instant stand by the value of their id, as in `assign_sequence`.
    """
    calls = actions.filter(F.col("action").isin(*BARRIERS))
    marks = replies.select("event_id", "received_at", F.lit(1).alias("_late"), F.col("mail_id").cast("string").alias("_id"), F.col("mail_id").alias("_mail")).unionByName(
        calls.select("event_id", F.col("at").alias("received_at"), F.lit(0).alias("_late"), F.col("action_id").cast("string").alias("_id")), allowMissingColumns=True
    )
    placed = running_sums(
        marks, ["event_id"], "received_at", ["_late", "_mail", "_id"], {"ord": F.lit(1), "epoch": 1 - F.col("_late")}
    )
    where = placed.select("event_id", "_late", "_id", "ord", "epoch")
    r = replies.withColumn("_id", F.col("mail_id").cast("string")).join(
        where.filter("_late = 1").drop("_late"), ["event_id", "_id"]
    ).drop("_id")
    a = calls.withColumn("_id", F.col("action_id").cast("string")).join(
        where.filter("_late = 0").drop("_late"), ["event_id", "_id"]
    ).drop("_id")
    return r, a


def replay(
    events: DataFrame,
    replies: DataFrame,
    actions: DataFrame,
    signatures: DataFrame | None = None,
    last: DataFrame | None = None,
) -> History:
    """Run every reply and call of a history from the given starting state.

    `last(event_id, last)` continues the numbering of an earlier ledger.
    """
    spark = events.sparkSession
    # Every epoch joins them again; what they come from is read once.
    events, actions = checkpointed(events), checkpointed(actions)
    known = events.select(F.col("id").alias("event_id"))
    rows, calls = epochs(replies.join(known, "event_id", "left_semi"), actions.join(known, "event_id", "left_semi"))
    rows, calls = checkpointed(rows), checkpointed(calls)
    state = L.activate(events, actions)
    held = signatures if signatures is not None else spark.createDataFrame([], schemas.SIGNATURES)
    per_event = calls.groupBy(F.col("event_id").alias("id")).agg(F.max("epoch").alias("_n"))
    counts = checkpointed(events.select("id").join(per_event, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    top = counts.agg(F.max("_n")).first()[0] or 0

    settled_events, settled_signed, done_rows, outcomes, all_changes, all_retracted = [], [], [], [], [], []
    for epoch in range(top + 1):
        live = rows.filter(F.col("epoch") == epoch).withColumn("sequence", F.col("ord") + PLACE)
        d = decide(live, state, held)
        decided = checkpointed(
            d.rows.select(
                *live.columns, "sender_hash", "sender_domain", "participant_match", "counted", "count_reason",
                "nth", _yes(F.col("lock_seq") == F.col("sequence")).alias("closes"),
            )
        )
        done_rows.append(decided)
        locks = decided.filter("closes").select("event_id", F.col("sequence").alias("lock_seq"))
        state = apply_decisions(state, decided, locks)
        held = held.unionByName(signature_rows(decided))
        over = counts.filter(F.col("_n") == epoch).select("id")
        settled_events.append(state.join(over, "id", "left_semi").select(*events.columns))
        over_ev = over.withColumnRenamed("id", "event_id")
        settled_signed.append(held.join(over_ev, "event_id", "left_semi").select(*schemas.SIGNATURES.fieldNames()))
        if epoch == top:
            break
        state = checkpointed(state.join(over, "id", "left_anti").select(*events.columns))
        held = checkpointed(held.join(over_ev, "event_id", "left_anti").select(*schemas.SIGNATURES.fieldNames()))
        now = calls.filter(F.col("epoch") == epoch + 1)
        changes, verdicts = L.edit_changes(now, state)
        changes = checkpointed(L.hashed_changes(changes, state).join(
            changes.select("action_id", "step_pos", "pos", F.col("new").alias("plain_new")), ["action_id", "step_pos", "pos"]
        ))
        touched = changes.select("action_id").distinct().withColumn("applied", F.lit(True))
        plain = changes.withColumn("new", F.col("plain_new"))
        edit_out = verdicts.join(touched, "action_id", "left").select(
            "action_id", "event_id", "at", F.lit("edit").alias("action"), _yes(F.col("applied")).alias("applied"),
            F.col("error").alias("reason"),
        )
        closed, close_out = L.close_and_reopen(state, now)
        reopened = close_out.filter("applied and action = 'reopen'").select("action_id")
        kept, taken = L.retract(held, now.join(reopened, "action_id", "left_semi"))
        live_at = state.select(F.col("id").alias("event_id"), "activated_at")
        out = edit_out.unionByName(close_out, allowMissingColumns=True).join(live_at, "event_id").join(
            now.select("action_id", "ord"), "action_id"
        )
        outcomes.append(
            checkpointed(
                out.withColumn("on_ledger", F.col("applied") & _yes(F.col("activated_at") <= F.col("at"))).drop("activated_at")
            )
        )
        all_changes.append(changes.drop("plain_new"))
        all_retracted.append(taken.select("action_id", "sender_hash"))
        state = checkpointed(L.apply_changes(closed, plain))
        held = checkpointed(kept)

    decided = _union(done_rows)
    calls_out = _union(outcomes) if outcomes else spark.createDataFrame(
        [], "action_id string, event_id string, at timestamp, action string, applied boolean, reason string, "
        "completed_at timestamp, summary string, ord bigint, on_ledger boolean"
    )
    changes_out = _union(all_changes) if all_changes else spark.createDataFrame(
        [], "event_id string, action_id string, step_pos int, pos int, step_id string, field string, old string, new string"
    )
    retracted_out = _union(all_retracted) if all_retracted else None
    entries = number_entries(decided, calls_out, last, call_contents(actions, changes_out, retracted_out))
    final_events = _union(settled_events)
    final_signed = _union(settled_signed)
    numbers = entries.filter("kind = 'reply'").select("event_id", (F.col("ord") + PLACE).alias("ord"), F.col("sequence").alias("_final"))
    final_signed = final_signed.join(
        numbers.withColumnRenamed("ord", "commit_sequence"), ["event_id", "commit_sequence"], "left"
    ).withColumn("commit_sequence", F.coalesce("_final", "commit_sequence")).select(*schemas.SIGNATURES.fieldNames())
    return History(
        entries, renumber_steps(final_events, numbers), final_signed, calls_out, changes_out,
        completion_history(decided, calls_out, entries, events),
    )


def call_contents(actions: DataFrame, changes: DataFrame, retracted: DataFrame | None) -> DataFrame:
    """M7/M9. What the entry of an edit or reopen call says: reason, organiser, hashed changes, hashes of retracted signatures.

    Each list is bounded by what one call names.
    """
    each = F.struct("step_pos", "pos", "step_id", "field", "old", "new")
    listed = changes.groupBy("action_id").agg(F.sort_array(F.collect_list(each)).alias("_changes"))
    df = actions.filter("action in ('edit', 'reopen')").select("action_id", "reason", "organiser").join(listed, "action_id", "left")
    if retracted is None:
        df = df.withColumn("_retracted", F.array().cast("array<string>"))
    else:
        gone = retracted.groupBy("action_id").agg(F.sort_array(F.collect_set("sender_hash")).alias("_retracted"))
        df = df.join(gone, "action_id", "left")
    short = F.transform(F.coalesce("_changes", F.array()), lambda c: F.struct(*[c[n].alias(n) for n in ("step_id", "field", "old", "new")]))
    return df.select(
        "action_id",
        F.struct("reason", "organiser", short.alias("changes"), F.coalesce("_retracted", F.array()).alias("retracted")).cast(schemas.LEDGER["change"].dataType).alias("change"),
    )


def number_entries(decided: DataFrame, calls: DataFrame, last: DataFrame | None = None, contents: DataFrame | None = None) -> DataFrame:
    """W1. One sequence per event over replies, applied edits and reopens, in history order."""
    replies = decided.select(
        "event_id", "ord", F.lit("reply").alias("kind"), "received_at", "mail_id", "mode", "step_id", "sender_hash",
        "sender_domain", "trust_level", "participant_match", "counted", "count_reason", "closes", "nth", "attachments",
    )
    logged = calls.filter(F.col("on_ledger") & F.col("action").isin("edit", "reopen")).select(
        "event_id", "ord", F.concat(F.lit("event_"), "action").alias("kind"), F.col("at").alias("received_at"), "action_id"
    )
    if contents is not None:
        logged = logged.join(contents, "action_id", "left")
    both = replies.unionByName(logged, allowMissingColumns=True)
    numbered = running_sums(both, ["event_id"], "received_at", ["ord"], {"sequence": F.lit(1)})
    if last is None:
        return numbered
    return (
        numbered.join(last, "event_id", "left")
        .withColumn("sequence", F.col("sequence") + F.coalesce("last", F.lit(0)))
        .drop("last")
    )


def renumber_steps(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """Turn the history positions noted on steps into ledger sequences."""
    pos = events.select("id", F.explode("steps").alias("s")).filter("s.commit_sequence is not null").select(
        F.col("id").alias("event_id"), F.col("s.id").alias("step_id"), F.col("s.commit_sequence").alias("ord")
    )
    maps = pos.join(numbers, ["event_id", "ord"]).groupBy(F.col("event_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("step_id", "_final"))).alias("_m")
    )
    renumbered = F.transform(
        "steps",
        lambda s: s.withField("commit_sequence", F.coalesce(F.try_element_at(F.col("_m"), s["id"]), s["commit_sequence"])),
    )
    return events.join(maps, "id", "left").withColumn(
        "steps", F.when(F.col("_m").isNotNull(), renumbered).otherwise(F.col("steps"))
    ).select(*events.columns)


def completion_history(decided: DataFrame, calls: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """M11. Completion records in order, `version` 1 being the first; the last one is current."""
    kinds = events.select(
        F.col("id").alias("event_id"), F.col("type").alias("event_type"),
        F.coalesce(F.size("steps"), F.lit(0)).alias("steps_completed"),
        F.when(F.col("threshold") >= 1, F.col("threshold")).otherwise(1).alias("threshold"),
    )
    auto = entries.filter("closes").join(kinds, "event_id").select(
        "event_id", "event_type", "ord", F.col("received_at").alias("at"), F.col("received_at").alias("completed_at"),
        F.col("sequence").alias("triggering_commit_sequence"),
        F.when(F.col("mode") == "workflow", F.col("steps_completed")).alias("steps_completed"),
        F.when(F.col("mode") == "crypto", F.col("threshold")).alias("threshold"),
    )
    by_call = calls.filter("action = 'complete' and on_ledger").join(kinds.select("event_id", "event_type"), "event_id").select(
        "event_id", "event_type", "ord", "at", "completed_at", "summary"
    )
    both = auto.unionByName(by_call, allowMissingColumns=True)
    return running_sums(both, ["event_id"], "at", ["ord"], {"version": F.lit(1)}).drop("ord", "at")
