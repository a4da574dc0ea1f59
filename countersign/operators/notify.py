"""Notices: who gets told what. Sending is someone else's job; the outbox is a table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign import schemas
from countersign.functions.messages import build_raw_message, new_message_id, reply_address
from countersign.functions.steps import eligible_steps, is_complete
from countersign.functions.hashing import salted_sender_hash
from countersign.functions.templates import render_default
from countersign.operators.decide import _yes

# fixed values: notice kinds
KINDS = (
    "activation", "advance", "reassigned", "ack", "completion", "stats", "bounce", "overdue",
    "archived", "proof_anchored", "verify_report", "reverify_report",
)


def compose(notices: DataFrame, domain: str, body: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """S11/U1. Notices to outbox rows; a notice without a recipient makes none.

    Needs event_id, event_type, kind, to, cause, at; every other context column is optional.
    `body(df)` may return a custom text; empty or NULL falls back to the default.
    """
    df = notices.filter(F.coalesce(F.col("to"), F.lit("")) != "")
    ctx = {c: F.col(c) for c in df.columns}
    ctx["mode"] = F.col("event_type")
    subject, default = render_default("kind", ctx)
    custom = F.lit(None).cast("string") if body is None else body(df)
    step = F.col("step_id") if "step_id" in df.columns else None
    seq = F.col("sequence") if "sequence" in df.columns else None
    reply_to = reply_address(F.col("kind"), F.col("event_type"), F.col("event_id"), F.lit(domain), step, seq)
    df = df.select(
        "event_id",
        F.col("cause").cast("string").alias("cause"),
        "kind",
        "to",
        "at",
        reply_to.alias("reply_address"),
        subject.alias("subject"),
        F.coalesce(F.nullif(custom, F.lit("")), default).alias("body"),
    )
    raw = build_raw_message(
        F.col("reply_address"), F.col("to"), F.col("subject"), F.col("body"),
        new_message_id(F.lit(domain), "at", "event_id", "kind", "to", "cause"),
        F.col("at"), F.lit("auto-generated"),
    )
    return df.withColumn("raw", raw).select(*schemas.OUTBOX.fieldNames())


def _event_ctx(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("id").alias("event_id"), F.col("type").alias("event_type"), "title", "initiator"
    )


def activation_notices(events: DataFrame, at: Column | str = "activated_at") -> DataFrame:
    """C9. First activation: every listed signer, or every step that waits for nothing."""
    base = events.filter(F.col("activated_at").isNotNull())
    when = F.col(at) if isinstance(at, str) else at
    head = [F.col("id").alias("event_id"), F.col("type").alias("event_type"), "title", when.alias("at")]
    signers = base.filter(F.col("type") == "crypto").select(*head, F.explode("signers").alias("to"))
    steps = base.filter(F.col("type") != "crypto").select(*head, F.explode(eligible_steps("steps")).alias("s"))
    steps = steps.select(
        "event_id", "event_type", "title", "at", F.col("s.participant").alias("to"),
        F.col("s.id").alias("step_id"), F.col("s.name").alias("step_name"),
    )
    return signers.unionByName(steps, allowMissingColumns=True).withColumns(
        {"kind": F.lit("activation"), "cause": F.lit("activate")}
    )


def transition_notices(rows: DataFrame, locks: DataFrame, events_after: DataFrame, counted_commits: DataFrame) -> DataFrame:
    """C10. Notices of counted replies: `ack`, `advance` per J6, `completion`.

    `rows` are decided replies, `events_after` the records after the batch. A step becomes newly
    eligible at the reply that finishes the last of its dependencies.
    """
    counted = rows.filter("counted").drop("event_type")
    edges = locks.select("event_id", F.col("lock_seq").alias("sequence"), F.lit(True).alias("closes"))
    head = counted.drop("lock_seq").join(edges, ["event_id", "sequence"], "left").join(_event_ctx(events_after), "event_id")
    closes = _yes(F.col("closes"))
    keep = ["event_id", "event_type", "title", F.col("received_at").alias("at"), F.col("sequence").cast("string").alias("cause")]
    ack = head.filter("mode = 'crypto'").select(
        *keep, F.col("sender").alias("to"), F.lit("ack").alias("kind"), F.col("nth").alias("signature_count")
    )
    done = (
        head.filter(closes)
        .join(counted_commits, "event_id", "left")
        .select(*keep, F.col("initiator").alias("to"), F.lit("completion").alias("kind"), "counted_commits")
    )
    advance = newly_eligible(head.filter((F.col("mode") == "workflow") & ~closes), events_after).select(
        *keep, F.col("participant").alias("to"), F.lit("advance").alias("kind"),
        F.col("next_step").alias("step_id"), F.col("next_name").alias("step_name"),
    )
    return ack.unionByName(advance, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)


def newly_eligible(counted: DataFrame, events_after: DataFrame) -> DataFrame:
    """J6. Steps that a counted workflow reply made eligible, with a participant to tell.

    The trigger is the reply that completed the last missing dependency, so each step appears at
    most once per run.
    """
    steps = events_after.select(F.col("id").alias("event_id"), "steps", F.explode("steps").alias("s"))
    finish = F.transform(
        F.filter("steps", lambda d: F.array_contains(F.col("s.dependsOn"), d["id"])),
        lambda d: F.when(is_complete(d["status"]), F.coalesce(d["commit_sequence"], F.lit(0))),
    )
    n_deps = F.size(F.array_distinct("s.dependsOn"))
    waiting = steps.filter(n_deps > 0).select(
        "event_id",
        F.col("s.id").alias("next_step"), F.col("s.name").alias("next_name"), F.col("s.participant").alias("participant"),
        F.col("s.commit_sequence").alias("_own"),
        F.when(
            F.forall(finish, lambda x: x.isNotNull()) & (F.size(finish) == n_deps), F.array_max(finish)
        ).alias("sequence"),
    ).filter((F.coalesce("participant", F.lit("")) != "") & (F.col("sequence") > 0))
    # A step that was already complete by then is not news.
    waiting = waiting.filter(F.col("_own").isNull() | (F.col("_own") > F.col("sequence"))).drop("_own")
    return counted.join(waiting, ["event_id", "sequence"])


def reassigned_notices(changes: DataFrame, events: DataFrame) -> DataFrame:
    """J12. New participants of currently eligible steps of activated workflows.

    `changes`: event_id, step_id, field, to, at, cause.
    """
    eligible = events.filter(F.col("activated_at").isNotNull() & (F.col("type") == "workflow")).select(
        F.col("id").alias("event_id"), F.col("type").alias("event_type"), "title",
        F.explode(eligible_steps("steps")).alias("s"),
    ).select("event_id", "event_type", "title", F.col("s.id").alias("step_id"), F.col("s.name").alias("step_name"))
    moved = changes.filter((F.col("field") == "participant") & (F.coalesce("to", F.lit("")) != ""))
    return moved.join(eligible, ["event_id", "step_id"]).withColumn("kind", F.lit("reassigned"))


def unsigned_signers(events: DataFrame, signatures: DataFrame) -> DataFrame:
    """J11/O5. Listed signers without a signature, by the salted hash the ledger dedups on."""
    listed = events.filter(F.col("type") == "crypto").select(
        F.col("id").alias("event_id"), "salt", F.posexplode("signers").alias("pos", "signer")
    ).withColumn("sender_hash", salted_sender_hash(F.lower("signer"), "salt"))
    held = signatures.filter(F.coalesce("sender_hash", F.lit("")) != "").select("event_id", "sender_hash")
    return listed.join(held, ["event_id", "sender_hash"], "left_anti").drop("salt")
