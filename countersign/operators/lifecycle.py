"""Organiser calls over event records: create, activate, edit, complete, reopen."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countersign.functions.addresses import valid_event_id
from countersign.functions.headers import _strip
from countersign.functions.hashing import event_id_from_seed, salt_from_seed, salted_sender_hash
from countersign.functions.steps import expand_flow, is_complete
from countersign.operators.decide import _yes

# fixed values: error codes of an edit
EDIT_ERRORS = (
    "NOT_FOUND", "EVENT_COMPLETE", "EVENT_ARCHIVED", "BAD_TITLE",
    "STEP_NOT_FOUND", "EVENT_STEP_FROZEN", "BAD_EMAIL", "BAD_DEADLINE",
)
# fixed values: step fields an edit may touch, in checking order
STEP_FIELDS = ("participant", "deadline", "requires_attachment", "details")
# fixed values: what an edit accepts as an address and as a deadline
_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def create_events(drafts: DataFrame, existing: DataFrame, now: Column, draft_key: str = "draft_id") -> DataFrame:
    """M5. Normalised records plus `error`; only rows without an error may be stored.

    Drafts have the record's fields (any may be NULL; `threshold` may be fractional) and a
    `draft_id` that orders them: the lowest one keeps a contested id.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    df = drafts.withColumns(
        {
            "id": F.coalesce(blank("id"), event_id_from_seed(draft_key)),
            "type": F.coalesce(blank("type"), F.lit("workflow")),
            "created_at": F.coalesce("created_at", now),
            "status": F.coalesce(blank("status"), F.lit("open")),
        }
    )
    wf, crypto = F.col("type") == "workflow", F.col("type") == "crypto"
    ids = F.transform("steps", lambda s: F.coalesce(s["id"], F.lit("")))
    threshold = F.coalesce(F.col("threshold"), F.lit(1.0)).cast("double")
    is_open = _yes(F.col("open"))
    n_signers = F.coalesce(F.size("signers"), F.lit(0))
    error = (
        F.when(~valid_event_id("id"), "invalid_id")
        .when(~(wf | crypto), "unknown_type")
        .when(wf & _yes(F.array_contains(ids, "")), "step_without_id")
        .when(wf & _yes(F.size(F.array_distinct(ids)) < F.size(ids)), "duplicate_step_id")
        .when(crypto & ((threshold < 1) | (threshold != F.floor(threshold))), "bad_threshold")
        .when(crypto & ~is_open & (n_signers <= 0), "no_signers")
    )
    flow = F.coalesce(blank("flow"), F.lit("sequential"))
    no_steps = F.array().cast(drafts.schema["steps"].dataType)
    df = df.withColumns(
        {
            "error": error,
            "salt": F.coalesce(blank("salt"), salt_from_seed("id", draft_key)),
            "flow": F.when(wf, flow).otherwise(F.col("flow")),
            "steps": F.when(wf, expand_flow(F.coalesce("steps", no_steps), flow)).otherwise(F.col("steps")),
            "signers": F.when(crypto, F.coalesce(F.transform("signers", F.lower), F.array().cast("array<string>"))).otherwise(F.col("signers")),
            "open": F.when(crypto, is_open).otherwise(F.col("open")),
            "threshold": F.when(error.isNull() & crypto, threshold.cast("int")).otherwise(F.col("threshold").cast("int")),
            "requiredDocHash": blank("requiredDocHash"),
        }
    )
    taken = existing.select("id").withColumn("_taken", F.lit(True))
    owner = df.filter("error is null").groupBy("id").agg(F.min(draft_key).alias("_owner"))
    df = df.join(taken, "id", "left").join(owner, "id", "left")
    clash = _yes(F.col("_taken")) | (F.col("_owner") < F.col(draft_key))
    return df.withColumn("error", F.coalesce("error", F.when(clash, F.lit("already_exists")))).select(
        *[c for c in drafts.columns], "error"
    )


def activate(events: DataFrame, actions: DataFrame) -> DataFrame:
    """M6. The first activation sets the time; an event that has one keeps it."""
    first = (
        actions.filter("action = 'activate'").groupBy(F.col("event_id").alias("id")).agg(F.min("at").alias("_at"))
    )
    return events.join(first, "id", "left").withColumn(
        "activated_at", F.coalesce("activated_at", "_at")
    ).select(*events.columns)


def activation_results(events: DataFrame, actions: DataFrame) -> DataFrame:
    """M6. Per activate call: `already_active` (NULL when there is no such event)."""
    calls = actions.filter("action = 'activate'").select("action_id", "event_id", "at")
    head = events.select(F.col("id").alias("event_id"), F.col("activated_at").alias("_was"), F.lit(True).alias("_known"))
    first = calls.groupBy("event_id").agg(F.min(F.struct("at", "action_id")).alias("_first"))
    won = F.col("_first.action_id") == F.col("action_id")
    return calls.join(head, "event_id", "left").join(first, "event_id").select(
        "action_id", "event_id", "at", F.when(F.col("_known"), F.col("_was").isNotNull() | ~won).alias("already_active")
    )


def edit_rows(actions: DataFrame, events: DataFrame) -> DataFrame:
    """J13. Long form of edits: one row per (step, field) a patch names, with old and new value
    and the error it raises, in checking order. `pos` orders the checks of one call."""
    edits = actions.filter("action = 'edit'").select("action_id", "event_id", "at", "title", F.col("steps").alias("patch"))
    # A record without steps (a sign-off) ignores the steps of a patch.
    head = events.select(F.col("id").alias("event_id"), F.col("title").alias("_title"), F.col("steps").alias("_steps"))
    df = edits.join(head, "event_id")
    new_title = _strip(F.col("title"))
    title = df.filter(F.col("title").isNotNull()).select(
        "action_id", "event_id", F.lit(-1).alias("step_pos"), F.lit(None).cast("string").alias("step_id"),
        F.lit(-1).alias("pos"), F.lit("title").alias("field"), F.col("_title").alias("old"), new_title.alias("new"),
        F.when(new_title == "", "BAD_TITLE").alias("error"),
    )
    per_step = df.filter("_steps is not null").select("action_id", "event_id", "_steps", F.posexplode("patch").alias("step_pos", "p")).filter(
        F.coalesce("p.id", F.lit("")) != ""
    )
    cur = F.get(F.filter("_steps", lambda s: s["id"] == F.col("p.id")), F.lit(0))
    per_step = per_step.withColumn("cur", cur)
    participant, deadline = F.coalesce(_strip(F.col("p.participant")), F.lit("")), F.coalesce(_strip(F.col("p.deadline")), F.lit(""))
    # The four fields in checking order, led by a row that stands for the step itself.
    checks = F.array(
        _check("", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")),
        _check("participant", F.col("cur.participant"), participant, F.when(~participant.rlike(_EMAIL), "BAD_EMAIL")),
        _check("deadline", F.col("cur.deadline"), F.nullif(deadline, F.lit("")),
               F.when((deadline != "") & ~deadline.rlike(_DATE), "BAD_DEADLINE")),
        _check("requires_attachment", F.col("cur.requires_attachment").cast("string"),
               _yes(F.col("p.requires_attachment")).cast("string"), F.lit(None).cast("string")),
        _check("details", F.col("cur.details"), F.nullif(F.col("p.details"), F.lit("")), F.lit(None).cast("string")),
    )
    rows = per_step.select(
        "action_id", "event_id", "step_pos", F.col("p.id").alias("step_id"), F.col("p.fields").alias("_named"),
        "cur", F.posexplode(checks).alias("pos", "c"),
    )
    named = (F.col("c.field") == "") | _yes(F.array_contains("_named", F.col("c.field")))
    step_error = F.when(F.col("cur").isNull(), "STEP_NOT_FOUND").when(is_complete("cur.status"), "EVENT_STEP_FROZEN")
    steps = rows.filter(named).select(
        "action_id", "event_id", "step_pos", "step_id", "pos", F.col("c.field").alias("field"),
        F.col("c.old").alias("old"), F.col("c.new").alias("new"),
        F.when(F.col("c.field") == "", step_error).otherwise(F.col("c.error")).alias("error"),
    )
    # A patch that names a step twice compares with its own earlier value.
    again = Window.partitionBy("action_id", "step_id", "field").orderBy("step_pos")
    seen = F.row_number().over(again) > 1
    steps = steps.withColumn("old", F.when(seen, F.lag("new").over(again)).otherwise(F.col("old")))
    return title.unionByName(steps)


def _check(field: str, old: Column, new: Column, error: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), old.alias("old"), new.alias("new"), error.cast("string").alias("error"))


def edit_errors(actions: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """M7. Per edit call the first error, NULL when it goes through; a patch that names nothing changes nothing."""
    head = events.select(
        F.col("id").alias("event_id"), F.lit(True).alias("_known"), is_complete("status").alias("_complete"), "archived_at"
    )
    first = rows.filter("error is not null").groupBy("action_id").agg(
        F.min_by("error", F.struct("step_pos", "pos")).alias("_bad")
    )
    calls = actions.filter("action = 'edit'").select("action_id", "event_id", "at")
    error = (
        F.when(F.col("_known").isNull(), "NOT_FOUND")
        .when(F.col("_complete"), "EVENT_COMPLETE")
        .when(_yes(F.col("archived_at") <= F.col("at")), "EVENT_ARCHIVED")
        .otherwise(F.col("_bad"))
    )
    return calls.join(head, "event_id", "left").join(first, "action_id", "left").select(
        "action_id", "event_id", "at", error.alias("error")
    )


def edit_changes(actions: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7/J13. `(changes, verdicts)` of edit calls against one state of the records.

    Changes: action_id, event_id, step_id, field, old, new. An edit with an error changes nothing.
    """
    rows = edit_rows(actions, events)
    verdicts = edit_errors(actions, rows, events)
    ok = verdicts.filter("error is null").select("action_id")
    changes = (
        rows.filter((F.col("field") != "") & ~F.col("old").eqNullSafe(F.col("new")))
        .join(ok, "action_id", "left_semi")
        .select("action_id", "event_id", "step_pos", "pos", "step_id", "field", "old", "new")
    )
    return changes, verdicts


def hashed_changes(changes: DataFrame, events: DataFrame) -> DataFrame:
    """M7. Changes as the ledger keeps them: participants only as salted hashes."""
    salts = events.select(F.col("id").alias("event_id"), "salt")
    person = F.col("field") == "participant"
    return changes.join(salts, "event_id").select(
        "action_id", "event_id", "step_pos", "pos", "step_id", "field",
        F.when(person, salted_sender_hash("old", "salt")).otherwise(F.col("old")).alias("old"),
        F.when(person, salted_sender_hash("new", "salt")).otherwise(F.col("new")).alias("new"),
    )


def apply_changes(events: DataFrame, changes: DataFrame) -> DataFrame:
    """M7. Event records after the changes of at most one edit per event.

    A new participant clears the step's last send error.
    """
    last = changes.groupBy(F.col("event_id").alias("id"), "step_id", "field").agg(
        F.max_by("new", "step_pos").alias("new")
    )
    # Bounded by the fields one call names.
    per_event = last.groupBy("id").agg(F.collect_list(F.struct("step_id", "field", "new")).alias("_ch"))
    df = events.join(per_event, "id", "left")

    def change(s: Column, field: str) -> Column:
        return F.get(F.filter("_ch", lambda c: (c["step_id"] == s["id"]) & (c["field"] == field)), F.lit(0))

    def edited(s: Column) -> Column:
        out = s
        for field in STEP_FIELDS:
            c = change(s, field)
            new = c["new"].cast("boolean") if field == "requires_attachment" else c["new"]
            out = out.withField(field, F.when(c.isNotNull(), new).otherwise(s[field]))
        moved = change(s, "participant").isNotNull()
        return out.withField("last_send_error", F.when(~moved, s["last_send_error"]))

    title = F.get(F.filter("_ch", lambda c: c["field"] == "title"), F.lit(0))
    touched = F.col("_ch").isNotNull()
    return df.withColumns(
        {
            "title": F.when(touched & title.isNotNull(), title["new"]).otherwise(F.col("title")),
            "steps": F.when(touched, F.transform("steps", edited)).otherwise(F.col("steps")),
        }
    ).select(*events.columns)


def close_and_reopen(events: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8/M9. `(records, outcomes)` of at most one complete or reopen call per event.

    Steps are not rewound by a reopen; taking signatures back is `retract`.
    """
    calls = actions.filter("action in ('complete', 'reopen')").select(
        F.col("event_id").alias("id"), F.col("action_id").alias("_aid"), F.col("action").alias("_act"),
        F.col("at").alias("_at"), F.col("reason").alias("_reason"), F.col("completed_at").alias("_given"),
    )
    df = events.join(calls, "id", "left")
    archived, complete = _yes(F.col("archived_at") <= F.col("_at")), is_complete("status")
    closing = _yes(F.col("_act") == "complete") & ~archived & ~complete
    opening = _yes(F.col("_act") == "reopen") & ~archived & complete
    after = df.withColumns(
        {
            "status": F.when(closing, F.lit("complete")).when(opening, F.lit("open")).otherwise(F.col("status")),
            "completed_at": F.when(closing, F.coalesce("_given", "_at")).when(~opening, F.col("completed_at")),
            "reopened_at": F.when(opening, F.col("_at")).otherwise(F.col("reopened_at")),
            "reopened_reason": F.when(opening, F.col("_reason")).otherwise(F.col("reopened_reason")),
        }
    ).select(*events.columns)
    outcome = (
        F.when(archived, "EVENT_ARCHIVED")
        .when((F.col("_act") == "complete") & complete, "already_complete")
        .when((F.col("_act") == "reopen") & ~complete, "not_complete")
    )
    outcomes = df.filter("_aid is not null").select(
        F.col("_aid").alias("action_id"), F.col("id").alias("event_id"), F.col("_at").alias("at"),
        F.col("_act").alias("action"), (closing | opening).alias("applied"), outcome.alias("reason"),
        F.coalesce("_given", "_at").alias("completed_at"), F.col("_reason").alias("summary"),
    )
    return after, outcomes


def retract(signatures: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O4. `(kept, retracted)` for applied reopen calls with a `retract` list of sender hashes."""
    named = (
        actions.filter("action = 'reopen'")
        .select("event_id", "action_id", F.explode("retract").alias("sender_hash"))
        .filter(F.coalesce("sender_hash", F.lit("")) != "")
        .distinct()
    )
    kept = signatures.join(named.select("event_id", "sender_hash").distinct(), ["event_id", "sender_hash"], "left_anti")
    return kept.select(*signatures.columns), signatures.join(named, ["event_id", "sender_hash"])


def latest_state_rows(state: DataFrame, mirror: DataFrame, key: str = "id") -> DataFrame:
    """S10. Rows of `state` that the mirror lacks or holds with different content.

    `mirror(key, digest)` keeps the digest of what was written last.
    """
    from countersign.functions.hashing import canonical_json

    digest = F.sha2(canonical_json(*state.columns), 256)
    return state.withColumn("digest", digest).join(mirror.select(key, "digest"), [key, "digest"], "left_anti")


def first_proof_message(log: DataFrame) -> DataFrame:
    """A11. The first recorded proof mail of each event stays its thread root.

    `log`: event_id, at, message_id.
    """
    return log.filter(F.coalesce("message_id", F.lit("")) != "").groupBy("event_id").agg(
        F.min_by("message_id", F.struct("at", "message_id")).alias("proof_email_message_id")
    )
