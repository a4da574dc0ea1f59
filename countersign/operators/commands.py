"""Initiator commands by mail: stats and remind."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions.hashing import salted_sender_hash
from countersign.functions.steps import eligible_steps, is_complete
from countersign.functions.templates import stats_body


def auth_initiator(trust_level: Column, sender: Column, initiator: Column) -> Column:
    """F5. NULL when the sender may command, else the reason."""
    who = F.lower(F.coalesce(initiator, F.lit("")))
    return (
        F.when(F.coalesce(trust_level != "verified", F.lit(True)), "unverified")
        .when(who == "", "no_initiator")
        .when(F.lower(F.coalesce(sender, F.lit(""))) != who, "sender_not_initiator")
    )


def seen_records(commands: DataFrame, before: DataFrame, after: DataFrame, locks: DataFrame) -> DataFrame:
    """The record of each command's event as it was at the command's place in the order of the mail.

    `commands`: mail_id, event_id, horizon (the last number given before the command). Between the records before and
    after a batch only steps that a reply of the batch finished and the completion differ; what lies behind the
    horizon is taken back.
    """
    old = before.select("id", F.col("steps").alias("_steps"), F.col("status").alias("_status"), F.col("completed_at").alias("_completed"))
    edges = locks.select(F.col("event_id").alias("id"), "lock_seq")
    asked = commands.select("mail_id", F.col("event_id").alias("id"), "horizon")
    df = asked.join(after, "id").join(old, "id").join(edges, "id", "left")
    closed = F.coalesce(F.col("lock_seq") <= F.col("horizon"), F.lit(True))
    steps = F.zip_with("steps", "_steps", lambda a, b: F.when(a["commit_sequence"] > F.col("horizon"), b).otherwise(a))
    return df.select(
        "mail_id",
        *[
            {"steps": steps, "status": F.when(closed, F.col("status")).otherwise(F.col("_status")), "completed_at": F.when(closed, F.col("completed_at")).otherwise(F.col("_completed"))}
            .get(c, F.col(c)).alias(c)
            for c in after.columns
        ],
    )


def command_results(commands: DataFrame, events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """C3/C4. Adds `authenticated` and `reason` to remind and stats mail.

    `commands`: mail_id, received_at, event_id, command, sender, trust_level. `seen` has the record each command saw
    (`seen_records`); without it all see `events`.
    """
    key, records = ("event_id", events) if seen is None else ("mail_id", seen)
    head = records.select(
        *([F.col("id").alias("event_id")] if seen is None else ["mail_id"]), "initiator", F.lit(True).alias("_known"),
        (is_complete("status") | F.col("archived_at").isNotNull()).alias("_over"),
    )
    denied = auth_initiator(F.col("trust_level"), F.col("sender"), F.col("initiator"))
    known = F.col("_known").isNotNull()
    reason = (
        F.when(~known, F.lit("unknown_event"))
        .when(denied.isNotNull(), denied)
        .when((F.col("command") == "remind") & F.col("_over"), F.lit("already_complete"))
    )
    return commands.join(head, key, "left").select(
        *commands.columns,
        F.when(known, denied.isNull()).alias("authenticated"),
        reason.alias("reason"),
    )


def stats_snapshot(events: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """A6. One record per event, plus the plain-text dump of it. A `signature_count` that `events` has is taken as it is, and
    so is a `mail_id` of `seen_records`."""
    carried = [c for c in ("mail_id",) if c in events.columns]
    if "signature_count" in events.columns:
        df, events = events, events.drop("signature_count")
    elif signatures is None:
        df = events.withColumn("signature_count", F.lit(0).cast("bigint"))
    else:
        n = signatures.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("signature_count"))
        df = events.join(n, "id", "left").withColumn("signature_count", F.coalesce("signature_count", F.lit(0)))
    wf, crypto = F.col("type") == "workflow", F.col("type") == "crypto"
    default_status = F.when(F.col("activated_at").isNotNull(), F.lit("open")).otherwise(F.lit("pending"))
    steps = F.transform(
        "steps",
        lambda s: F.struct(
            s["id"].alias("id"),
            F.nullif(s["name"], F.lit("")).alias("name"),
            F.nullif(s["participant"], F.lit("")).alias("participant"),
            F.coalesce(s["status"], F.lit("pending")).alias("status"),
            F.coalesce(s["dependsOn"], F.array().cast("array<string>")).alias("depends_on"),
            s["completed_at"].alias("completed_at"),
        ),
    )
    body = df.withColumn("event", F.struct(*[F.col(c) for c in events.columns]))
    return body.select(
        *carried, F.col("id").alias("event_id"), "type", F.nullif(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.nullif(F.col("status"), F.lit("")), default_status).alias("status"),
        "activated_at", "archived_at", "completed_at",
        F.when(wf, F.col("flow")).alias("flow"),
        F.when(wf, F.coalesce(steps, F.array().cast(steps_type()))).alias("steps"),
        F.when(crypto, F.coalesce("threshold", F.lit(1))).alias("threshold"),
        F.when(crypto, F.coalesce("open", F.lit(False))).alias("open"),
        F.when(crypto, F.coalesce("signers", F.array().cast("array<string>"))).alias("signers"),
        F.when(crypto, F.col("signature_count")).alias("signature_count"),
        stats_body("event", F.col("signature_count")).alias("body"),
    )


def steps_type() -> str:
    return (
        "array<struct<id:string,name:string,participant:string,status:string,"
        "depends_on:array<string>,completed_at:string>>"
    )


def stats_notices(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    """C4. Answer each accepted stats command with the snapshot's text."""
    ok = results.filter(F.col("authenticated") & (F.col("command") == "stats"))
    key = "mail_id" if "mail_id" in snapshots.columns else "event_id"
    snap = snapshots.select(key, F.col("type").alias("event_type"), "title", F.col("body").alias("snapshot"))
    return ok.join(snap, key).select(
        "event_id", "event_type", "title", "snapshot", F.col("received_at").alias("at"),
        F.col("mail_id").cast("string").alias("cause"), F.col("sender").alias("to"), F.lit("stats").alias("kind"),
    )


def remind_notices(results: DataFrame, events: DataFrame, signatures: DataFrame) -> DataFrame:
    """C3. Prompt again whoever an accepted remind command is waiting for.

    `events` may be the records that each command saw (`mail_id`, `horizon` beside the record): then signatures behind the horizon
    do not count either.
    """
    key = "mail_id" if "mail_id" in events.columns else "event_id"
    ok = results.filter(F.col("authenticated") & F.col("reason").isNull() & (F.col("command") == "remind"))
    asked = ok.select(*dict.fromkeys([key, "event_id"]), F.col("received_at").alias("at"), F.col("mail_id").cast("string").alias("cause"))
    records = events.withColumnRenamed("id", "event_id").withColumnRenamed("type", "event_type")
    # Only records that someone asked about are taken apart.
    due = asked.join(records.drop("event_id") if key == "mail_id" else records, key)
    head = ["event_id", "event_type", "title", "at", "cause"]
    wf = due.filter("event_type = 'workflow'").select(*head, F.explode(eligible_steps("steps")).alias("s")).select(
        *head, F.col("s.participant").alias("to"), F.col("s.id").alias("step_id"), F.col("s.name").alias("step_name"), F.lit("advance").alias("kind"),
    )
    horizon = [c for c in ("horizon",) if c in events.columns]
    listed = due.filter("event_type = 'crypto'").select(*head, *horizon, "salt", F.explode("signers").alias("to"))
    listed = listed.withColumn("sender_hash", salted_sender_hash(F.lower("to"), "salt"))
    held = signatures.filter(F.coalesce("sender_hash", F.lit("")) != "").groupBy("event_id", "sender_hash").agg(F.min("commit_sequence").alias("_signed"))
    there = F.col("_signed") <= F.col("horizon") if horizon else F.col("_signed").isNotNull()
    sg = listed.join(held, ["event_id", "sender_hash"], "left").filter(~F.coalesce(there, F.lit(False))).select(*head, "to", F.lit("activation").alias("kind"))
    return wf.unionByName(sg, allowMissingColumns=True).withColumn("reminder", F.lit(True))
