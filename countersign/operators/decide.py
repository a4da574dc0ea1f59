"""Which replies count: workflow steps (M1/M2) and threshold sign-offs (M3/M4).

Both rules look order-dependent ("has this sender signed before?", "is the step's dependency done
yet?"), but each has a set-based form over the per-event sequence number:

* a sender's signature is the lowest eligible sequence of that sender;
* a sign-off locks at the sequence of its threshold-th distinct signature;
* a step completes at the lowest eligible sequence above those of its dependencies.

All of them are minima, so they aggregate before they shuffle, and no task ever holds an event.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions.addresses import sender_domain, sender_matches
from countersign.functions.hashing import salted_sender_hash
from countersign.functions.steps import is_complete, step_levels
from countersign.functions.trust import meets_trust
from countersign.operators.numbering import rank_numbered
from countersign.session import checkpointed

# fixed values: why a workflow reply does not count, in gate order
WORKFLOW_REASONS = (
    "event_not_activated",
    "event_archived",
    "already_complete",
    "wrong_participant",
    "no_step",
    "unknown_step",
    "unverified_trust",
    "deps_unmet",
    "out_of_order",
    "missing_attachment",
)
# fixed values: why a sign-off reply does not count, in gate order
SIGNOFF_REASONS = (
    "event_not_activated",
    "event_archived",
    "already_complete",
    "unverified_trust",
    "initiator_self_reply",
    "not_a_signer",
    "already_signed",
    "doc_hash_mismatch",
)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def doc_hash_matches(attachments: Column, required: Column) -> Column:
    """F7. Exact text comparison; no requirement means satisfied."""
    return _yes(
        (F.coalesce(required, F.lit("")) == "")
        | F.exists(attachments, lambda a: _yes(a["sha256"] == required))
    )


def event_steps(events: DataFrame) -> DataFrame:
    """One row per step with its position and dependency level."""
    return events.select(
        F.col("id").alias("event_id"), F.col("flow"), step_levels("steps").alias("_levels"),
        F.posexplode("steps").alias("pos", "step"),
    ).select(
        "event_id", "flow", "pos",
        F.col("step.id").alias("step_id"),
        F.col("step.participant").alias("participant"),
        F.col("step.minTrust").alias("min_trust"),
        _yes(F.col("step.requires_attachment")).alias("requires_attachment"),
        is_complete("step.status").alias("step_done"),
        F.coalesce(F.col("step.dependsOn"), F.array().cast("array<string>")).alias("deps"),
        F.get(F.col("_levels"), F.col("pos")).alias("level"),
    )


def identify(replies: DataFrame, events: DataFrame, activation: str = "log") -> DataFrame:
    """J2/J3. Attach each reply's event flags, its step, and who its sender is to the event.

    `activation='log'` compares the reply's time with the activation and archive times;
    `'snapshot'` only asks whether the record has them.
    """
    header = events.select(
        F.col("id").alias("event_id"),
        F.col("type").alias("event_type"),
        "salt", "activated_at", "archived_at",
        is_complete("status").alias("complete_before"),
        F.lower("initiator").alias("initiator"),
        _yes(F.col("open")).alias("open"),
        "requiredDocHash",
    )
    members = (
        events.filter(~_yes(F.col("open")))
        .select(F.col("id").alias("event_id"), F.explode("signers").alias("sender"))
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    steps = event_steps(events).select(
        "event_id", "step_id", "flow", "participant", "min_trust", "requires_attachment",
        "step_done", F.lit(True).alias("has_step"),
    )
    r = (
        replies.join(header, "event_id")
        .join(steps, ["event_id", "step_id"], "left")
        .join(members, ["event_id", "sender"], "left")
    )
    if activation == "log":
        active = _yes(F.col("activated_at") <= F.col("received_at"))
        archived = _yes(F.col("archived_at") <= F.col("received_at"))
    else:
        active, archived = F.col("activated_at").isNotNull(), F.col("archived_at").isNotNull()
    return r.select(
        *replies.columns,
        "event_type", "flow", "complete_before",
        active.alias("active"),
        archived.alias("archived"),
        salted_sender_hash("sender", "salt").alias("sender_hash"),
        sender_domain("sender").alias("sender_domain"),
        F.when(
            F.col("mode") == "workflow", _yes(F.col("has_step")) & sender_matches("sender", "participant")
        ).alias("participant_match"),
        (F.col("open") | _yes(F.col("listed"))).alias("signer_match"),
        _yes((F.col("initiator") != "") & (F.col("sender") == F.col("initiator"))).alias("is_initiator"),
        doc_hash_matches(F.col("attachments"), F.col("requiredDocHash")).alias("doc_ok"),
        (F.coalesce(F.size("attachments"), F.lit(0)) > 0).alias("has_attachment"),
        _yes(F.col("has_step")).alias("has_step"),
        _yes(F.col("step_done")).alias("step_done_before"),
        _yes(F.col("requires_attachment")).alias("requires_attachment"),
        meets_trust("trust_level", "min_trust").alias("trust_ok"),
    )


def _dedup_key() -> Column:
    # A reply without a sender is never anyone's second signature.
    return F.coalesce(F.col("sender_hash"), F.concat(F.lit("#"), F.col("sequence").cast("string")))


def first_signatures(identified: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """W2. `(event_id, signer_key, first_seq)`: each sender's lowest eligible sign-off."""
    eligible = identified.filter(
        (F.col("mode") == "crypto") & F.col("active") & ~F.col("archived") & ~F.col("complete_before")
        & (F.col("trust_level") == "verified") & ~F.col("is_initiator")
        & F.col("signer_match") & F.col("doc_ok")
    )
    firsts = (
        eligible.select("event_id", _dedup_key().alias("signer_key"), "sequence")
        .groupBy("event_id", "signer_key")
        .agg(F.min("sequence").alias("first_seq"))
    )
    if signed is not None:
        before = signed.select("event_id", F.col("sender_hash").alias("signer_key")).distinct()
        firsts = firsts.join(before, ["event_id", "signer_key"], "left_anti")
    return firsts


def running_signatures(firsts: DataFrame) -> DataFrame:
    """W3/A1. Adds `nth`: the distinct signatures an event has once this one is in."""
    return rank_numbered(firsts, "event_id", "first_seq", "nth")


def signoff_lock(ranked: DataFrame, events: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """A2. `(event_id, lock_seq)`: the signature that reaches the threshold."""
    rules = events.filter(~_yes(F.col("manualCompletion"))).select(
        F.col("id").alias("event_id"),
        F.when(F.col("threshold") >= 1, F.col("threshold")).otherwise(1).alias("needed"),
    )
    if signed is not None:
        held = signed.groupBy("event_id").agg(F.count("*").alias("held"))
        rules = rules.join(held, "event_id", "left").select(
            "event_id", F.greatest(F.col("needed") - F.coalesce("held", F.lit(0)), F.lit(1)).alias("needed")
        )
    return (
        ranked.join(rules, "event_id")
        .filter(F.col("nth") == F.col("needed"))
        .select("event_id", F.col("first_seq").alias("lock_seq"))
    )


def step_completions(identified: DataFrame, steps: DataFrame) -> DataFrame:
    """W4. `(event_id, step_id, done_seq)`; 0 for steps that were complete to begin with.

    One round per dependency level. Eligible replies are written once as three narrow columns;
    the table of finished steps is at most as large as the step definitions.
    """
    eligible = identified.filter(
        (F.col("mode") == "workflow") & F.col("active") & ~F.col("archived") & ~F.col("complete_before")
        & F.col("participant_match") & ~F.col("step_done_before") & F.col("trust_ok")
        & (~F.col("requires_attachment") | F.col("has_attachment"))
    ).select("event_id", "step_id", "sequence")
    todo = steps.filter(~F.col("step_done") & (F.col("level") >= 0))
    top = todo.agg(F.max("level")).first()[0]
    finished = steps.filter("step_done").select("event_id", "step_id", F.lit(0).cast("bigint").alias("done_seq"))
    if top is None:
        return finished
    first_round = todo.filter("level = 0").select("event_id", "step_id")
    if top == 0:
        level0 = eligible.join(first_round, ["event_id", "step_id"], "left_semi")
        return finished.unionByName(
            level0.groupBy("event_id", "step_id").agg(F.min("sequence").alias("done_seq"))
        )
    eligible = checkpointed(eligible)
    for level in range(top + 1):
        ready = dependency_front(todo.filter(F.col("level") == level), finished)
        reached = (
            eligible.join(ready, ["event_id", "step_id"])
            .filter(F.col("sequence") > F.col("after_seq"))
            .groupBy("event_id", "step_id")
            .agg(F.min("sequence").alias("done_seq"))
        )
        finished = checkpointed(finished.unionByName(reached))
    return finished


def dependency_front(steps: DataFrame, finished: DataFrame) -> DataFrame:
    """J4. `(event_id, step_id, after_seq)` for steps whose dependencies all finish at some point."""
    wants = steps.select(
        "event_id", "step_id", F.size("deps").alias("n_deps"), F.explode_outer("deps").alias("dep")
    )
    have = finished.select("event_id", F.col("step_id").alias("dep"), F.col("done_seq").alias("dep_seq"))
    return (
        wants.join(have, ["event_id", "dep"], "left")
        .groupBy("event_id", "step_id")
        .agg(
            F.max("n_deps").alias("n_deps"),
            F.count("dep_seq").alias("n_done"),
            F.coalesce(F.max("dep_seq"), F.lit(0)).alias("after_seq"),
        )
        .filter("n_done = n_deps")
        .select("event_id", "step_id", "after_seq")
    )


def workflow_done(steps: DataFrame, finished: DataFrame, events: DataFrame) -> DataFrame:
    """A3. `(event_id, lock_seq)`: the reply that completes an event's last step."""
    auto = events.filter(~_yes(F.col("manualCompletion"))).select(F.col("id").alias("event_id"))
    return (
        steps.join(finished, ["event_id", "step_id"], "left")
        .groupBy("event_id")
        .agg(F.bool_and(F.col("done_seq").isNotNull()).alias("all_done"), F.max("done_seq").alias("lock_seq"))
        # Everything complete from the start cannot complete again by a reply.
        .filter("all_done and lock_seq > 0")
        .join(auto, "event_id", "left_semi")
        .select("event_id", "lock_seq")
    )


def signoff_reason() -> Column:
    """M3. Ordered gates; NULL means the reply counts."""
    c = F.col
    return (
        F.when(~c("active"), "event_not_activated")
        .when(c("archived"), "event_archived")
        .when(c("complete_before") | _yes(c("sequence") > c("lock_seq")), "already_complete")
        .when(~_yes(c("trust_level") == "verified"), "unverified_trust")
        .when(c("is_initiator"), "initiator_self_reply")
        .when(~c("signer_match"), "not_a_signer")
        .when(_yes(c("signed_before")) | _yes(c("first_seq") < c("sequence")), "already_signed")
        .when(~c("doc_ok"), "doc_hash_mismatch")
    )


def workflow_reason() -> Column:
    """M1. Ordered gates; NULL means the reply counts."""
    c = F.col
    return (
        F.when(~c("active"), "event_not_activated")
        .when(c("archived"), "event_archived")
        .when(c("complete_before") | _yes(c("sequence") > c("lock_seq")), "already_complete")
        .when(~_yes(c("participant_match")), "wrong_participant")
        .when(F.coalesce(c("step_id"), F.lit("")) == "", "no_step")
        .when(~c("has_step"), "unknown_step")
        .when(c("step_done_before") | _yes(c("done_seq") < c("sequence")), "already_complete")
        .when(~c("trust_ok"), "unverified_trust")
        .when(
            ~_yes(c("after_seq") < c("sequence")),
            F.when(c("flow") == "sequential", "out_of_order").otherwise("deps_unmet"),
        )
        .when(c("requires_attachment") & ~c("has_attachment"), "missing_attachment")
    )


class Decision:
    """The frames one decision pass yields."""

    def __init__(self, rows: DataFrame, firsts: DataFrame, finished: DataFrame, locks: DataFrame):
        self.rows = rows  # every reply, with `counted`, `count_reason`, `lock_seq`, `nth`
        self.firsts = firsts
        self.finished = finished
        self.locks = locks

    def held(self) -> "Decision":
        """The same with rows and locks written once, for callers that derive several outputs."""
        return Decision(checkpointed(self.rows), self.firsts, self.finished, checkpointed(self.locks))


def decide(
    replies: DataFrame,
    events: DataFrame,
    signed: DataFrame | None = None,
    activation: str = "log",
    modes: tuple[str, ...] = ("crypto", "workflow"),
) -> Decision:
    """Decide every reply of a batch.

    `replies`: event_id, sequence, mode, received_at, step_id, sender, trust_level, attachments
    plus any columns to carry along. `signed`: signatures events already hold. The decision mode
    follows the reply's tag, not the event's type. An event's two rules share only its
    completion, so the earlier lock ends both.
    """
    # Written once: the rules below read these rows two or three times.
    r = checkpointed(identify(replies, events, activation))
    steps = event_steps(events)
    if "workflow" in modes:
        steps = checkpointed(steps)
    locks: list[DataFrame] = []
    firsts = finished = None
    if "crypto" in modes:
        firsts = running_signatures(first_signatures(r, signed))
        locks.append(signoff_lock(firsts, events, signed))
        if signed is not None:
            held = signed.groupBy("event_id").agg(F.count("*").alias("_held"))
            firsts = firsts.join(held, "event_id", "left").withColumn("nth", F.col("nth") + F.coalesce("_held", F.lit(0))).drop("_held")
    if "workflow" in modes:
        finished = step_completions(r, steps)
        locks.append(workflow_done(steps, finished, events))
    lock = locks[0] if len(locks) == 1 else locks[0].unionByName(locks[1])
    lock = lock.groupBy("event_id").agg(F.min("lock_seq").alias("lock_seq"))

    rows = r.join(lock, "event_id", "left")
    reason = F.lit(None).cast("string")
    if "crypto" in modes:
        rows = rows.withColumn("signer_key", F.when(F.col("mode") == "crypto", _dedup_key())).join(
            firsts, ["event_id", "signer_key"], "left"
        )
        if signed is None:
            rows = rows.withColumn("signed_before", F.lit(False))
        else:
            before = signed.select(
                "event_id", F.col("sender_hash").alias("signer_key"), F.lit(True).alias("signed_before")
            ).distinct()
            rows = rows.join(before, ["event_id", "signer_key"], "left")
        reason = F.when(F.col("mode") == "crypto", signoff_reason()).otherwise(reason)
    if "workflow" in modes:
        fronts = dependency_front(steps.filter("level >= 0"), finished)
        progress = (
            steps.select("event_id", "step_id")
            .join(finished, ["event_id", "step_id"], "left")
            .join(fronts, ["event_id", "step_id"], "left")
        )
        rows = rows.join(progress, ["event_id", "step_id"], "left")
        reason = F.when(F.col("mode") == "workflow", workflow_reason()).otherwise(reason)
    rows = rows.withColumn("count_reason", reason).withColumn("counted", F.col("count_reason").isNull())
    return Decision(rows, firsts, finished, lock)


def signoff_decide(replies: DataFrame, events: DataFrame, signed: DataFrame | None = None, activation: str = "log") -> DataFrame:
    """M3 over a batch of sign-off replies."""
    return decide(replies, events, signed, activation, modes=("crypto",)).rows


def workflow_decide(replies: DataFrame, events: DataFrame, activation: str = "log") -> DataFrame:
    """M1 over a batch of workflow replies."""
    return decide(replies, events, None, activation, modes=("workflow",)).rows
