"""Queries for whole jobs: bounces, commands, sweep, lifecycle, replay, ingest and streams."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from countersign import functions as fn
from countersign import schemas
from countersign.operators import bounce as B
from countersign.operators import commands as C
from countersign.operators import ledger as LG
from countersign.operators import lifecycle as L
from countersign.operators import notify as N
from countersign.operators import routing as R
from countersign.operators import sweep as S
from countersign.plans.ingest import ingest_batch
from countersign.plans.replay import replay
from countersign.session import checkpointed, shared_folder
from countersign.sources import mail as M
from countersign.sources import tables
from countersign.sources.store import Files
from countersign.workload import fixtures as fx
from countersign.workload.registry import HEADERS, SIGNOFF, iso, query

W = fx.with_clause
BOUNCES = W("fc", "fb") + HEADERS + """, bn as (select r.*, fb.type, case when fb.k % 5 <> 0 then 'Plan ' || fb.k else fb.coord_id end as title, mail_id % 2 = 0 as failed from routed r join fb on fb.coord_id = r.event_id where route = 'bounce')
"""


def _bounces(spark, sf):
    routed = R.route_bounces(fx.mail(spark, sf))
    return B.process_bounces(routed.select("mail_id", "received_at", "event_id", "step_id", "raw"), fx.coord_events(spark, sf))


def scratch(spark) -> str:
    """A folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


@query("w8_dsn_groups", W("fc") + "select mail_id, 'u' || user_id || '@d1.example' as final_recipient, case when mail_id % 2 = 0 then 'failed' else 'delayed' end as action, case when mail_id % 2 = 0 then '5.1.1' else '4.2.2' end as status, 'smtp; 550 user unknown' as diagnostic, 1 as pos from fc where mail_id % 11 = 5")
def w8(spark, sf):
    return B.dsn_recipients(R.route_bounces(fx.mail(spark, sf))).select("mail_id", "pos", "final_recipient", "action", "status", "diagnostic")


@query("f03_permanent_failures", W("fc") + "select mail_id, case when mail_id % 2 = 0 then 1 else 0 end as n_failed from fc where mail_id % 11 = 5")
def f03(spark, sf):
    return B.with_failures(R.route_bounces(fx.mail(spark, sf))).select("mail_id", F.size("failed").alias("n_failed"))


@query("c02_process_bounces", BOUNCES + "select mail_id, event_id, route_step as step_id, case when failed then 1 else 0 end as n_failed, case when failed then 'u' || user_id || '@d1.example' end as failed_recipient, case when failed then '5.1.1' end as code, case when failed then 'smtp; 550 user unknown' end as error_reason from bn")
def c02(spark, sf):
    return _bounces(spark, sf).select(
        "mail_id", "event_id", "step_id", "n_failed", F.get("failed_recipients", F.lit(0)).alias("failed_recipient"), "code", "error_reason"
    )


@query("a10_latest_send_error", BOUNCES + f"select event_id, route_step as step_id, 'smtp; 550 user unknown' as reason, '5.1.1' as code, {iso('max(received_at)')} as at from bn where failed and route_step is not null group by event_id, route_step")
def a10(spark, sf):
    return B.latest_send_errors(_bounces(spark, sf)).withColumn("at", fn.iso_millis("at"))


@query("a10_errors_from_log", W("lg") + f"""select event_id, step_id, reason, {iso('received_at')} as at from (select event_id, step_id, received_at, case when mail_id % 3 <> 0 then 'error ' || sequence end as reason, row_number() over (partition by event_id, step_id order by received_at desc, mail_id desc) as r from lg) where r = 1 and reason is not null""")
def a10_log(spark, sf):
    lg = fx.ledger(spark, sf)
    log = lg.select(
        "event_id", "step_id", F.col("received_at").alias("at"), F.col("mail_id").alias("entry_id"),
        F.when(F.col("mail_id") % 3 != 0, F.concat(F.lit("error "), F.col("sequence").cast("string"))).alias("reason"), F.lit("5.0.0").alias("code"),
    )
    return B.latest_errors_from_log(log).select("event_id", "step_id", "reason", fn.iso_millis("at").alias("at"))


@query("c02_bounce_notices", BOUNCES + """select event_id, cast(mail_id as varchar) as cause, 'u9@d0.example' as "to", case when type = 'crypto' then 'attest+' else 'event+' end || event_id || '@app.example' as reply_address,
 'A notification for "' || title || '" could not be delivered to u' || user_id || '@d1.example.' || chr(10) || chr(10) || 'The mail server said: smtp; 550 user unknown' || chr(10) || chr(10) || 'Check the address, then reply to resend or update it and try again.' as body from bn where failed""")
def c02_notices(spark, sf):
    return N.compose(B.bounce_notices(_bounces(spark, sf)), fx.DOMAIN).select("event_id", "cause", "to", "reply_address", "body")


# --- commands --------------------------------------------------------------------------------

# Initiators write under their own address here, so that some commands are accepted.
_CMD = W("fc", "fb") + HEADERS + """, cq as (select mail_id, received_at, route as command, event_id, case when mail_id % 2 = 0 then 'u9@d0.example' else who end as sender, trust from routed where route in ('stats', 'remind')),
cr as (select cq.*, fb.type, fb.archived, fb.k, fb.coord_id is not null as known, case when trust <> 'verified' then 'unverified' when sender <> initiator then 'sender_not_initiator' end as denied from cq left join fb on fb.coord_id = cq.event_id),
cx as (select *, case when not known then 'unknown_event' when denied is not null then denied when command = 'remind' and archived then 'already_complete' end as reason, case when known then denied is null end as authenticated from cr)
"""


def _commands(spark, sf):
    routed = R.graded(R.route(fx.mail(spark, sf)))
    me = F.when(F.col("mail_id") % 2 == 0, "u9@d0.example").otherwise(F.col("sender"))
    cmd = routed.filter(F.col("route").isin("stats", "remind")).select(
        "mail_id", "received_at", "event_id", F.col("route").alias("command"), me.alias("sender"), "trust_level"
    )
    return C.command_results(cmd, fx.coord_events(spark, sf))


@query("c03_c04_command_results", _CMD + "select mail_id, event_id, command, authenticated, reason from cx")
def c0304(spark, sf):
    return _commands(spark, sf).select("mail_id", "event_id", "command", "authenticated", "reason")


@query("c04_stats", _CMD + """select mail_id, event_id, 'u9@d0.example' as "to", 'Status: ' || case when k % 5 <> 0 then 'Plan ' || k else event_id end as subject, 'stats+' || event_id || '@app.example' as reply_address from cx where authenticated and command = 'stats'""")
def c04(spark, sf):
    ev = fx.coord_events(spark, sf)
    out = N.compose(C.stats_notices(_commands(spark, sf), C.stats_snapshot(ev)), fx.DOMAIN)
    return out.select(F.col("cause").cast("bigint").alias("mail_id"), "event_id", "to", "subject", "reply_address")


@query("c03_remind", W("fc", "fb", "fs", "fd") + _CMD[_CMD.index(", hb as"):] + """select mail_id, cx.event_id, 'advance' as kind, fs.participant as "to" from cx join fs on fs.coord_id = cx.event_id where authenticated and reason is null and command = 'remind' and not exists (select 1 from fd where fd.coord_id = fs.coord_id and fd.step_id = fs.step_id)
 union all select mail_id, event_id, 'activation', 'u' || r.i || '@d' || (k % 3) || '.example' from cx cross join range(1, 6) r(i) where authenticated and reason is null and command = 'remind' and type = 'crypto' and k % 4 = 0""")
def c03(spark, sf):
    none = spark.createDataFrame([], schemas.SIGNATURES)
    out = C.remind_notices(_commands(spark, sf), fx.coord_events(spark, sf), none)
    return out.select(F.col("cause").cast("bigint").alias("mail_id"), "event_id", "kind", "to")


@query("a06_stats_snapshot", W("fb", "fs") + """select coord_id as event_id, type, case when k % 5 <> 0 then 'Plan ' || k end as title, 'open' as status, case when type = 'workflow' then flow end as flow, case when type = 'workflow' then 4 end as n_steps,
 case when type = 'crypto' then cast(threshold as integer) end as threshold, case when type = 'crypto' then open end as open, case when type = 'crypto' then case when open then 0 else 5 end end as n_signers, case when type = 'crypto' then cast(0 as bigint) end as signature_count from fb""")
def a06(spark, sf):
    return C.stats_snapshot(fx.coord_events(spark, sf)).select(
        "event_id", "type", "title", "status", "flow", F.size("steps").alias("n_steps"), "threshold", "open", F.size("signers").alias("n_signers"), "signature_count"
    ).withColumns({"n_steps": F.when(F.col("type") == "workflow", F.col("n_steps")), "n_signers": F.when(F.col("type") == "crypto", F.col("n_signers"))})


# --- sweep -----------------------------------------------------------------------------------

_NOW = "2024-03-15 06:00:00"
_SWEEP = W("fb", "fs") + f""", ck as (select fb.*, case when type = 'workflow' then (select max(date '2024-01-01' + cast((fs.k + fs.i * 3) % 60 as integer)) from fs where fs.coord_id = fb.coord_id)::timestamp else timestamp '2024-02-01' + interval 1 day * (fb.k % 31) end as clock from fb),
dv as (select *, (epoch_ms(timestamp '{_NOW}') - epoch_ms(clock)) / 86400000.0 as days, k % 6 = 2 as nudged from ck where activated and not archived),
du as (select *, case when days >= 30 then 'archived' when days >= 14 and not nudged then 'overdue' end as kind from dv)
"""


def _sweep_events(spark, sf):
    """Sign-offs activated through February; some events were nudged before."""
    k = F.substring("id", 2, 9).cast("int")
    day = F.lit("2024-02-01").cast("timestamp") + F.make_dt_interval(days=k % 31)
    return fx.coord_events(spark, sf).withColumns(
        {
            "activated_at": F.when(F.col("activated_at").isNotNull(), F.when(F.col("type") == "crypto", day).otherwise(F.col("activated_at"))),
            "nudged_overdue_at": F.when(k % 6 == 2, F.col("created_at")),
        }
    )


@query("a05_reference_clock", _SWEEP + f"select coord_id as event_id, {iso('clock')} as clock from dv")
def a05(spark, sf):
    ev = _sweep_events(spark, sf).filter(fn.is_active())
    return ev.select(F.col("id").alias("event_id"), fn.iso_millis(fn.reference_clock("type", "steps", "activated_at")).alias("clock"))


@query("c07_sweep", _SWEEP + "select coord_id as event_id, kind, cast(floor(days) as bigint) as days from du where kind is not null")
def c07(spark, sf):
    return S.sweep(_sweep_events(spark, sf), _NOW, archive_days=30).select("event_id", "kind", "days")


@query("a08_sweep_summary", _SWEEP + "select kind, count(*) as n, max(cast(floor(days) as bigint)) as most_days from du where kind is not null group by kind")
def a08(spark, sf):
    return S.sweep(_sweep_events(spark, sf), _NOW, archive_days=30).groupBy("kind").agg(F.count("*").alias("n"), F.max("days").alias("most_days"))


@query("c07_sweep_state", _SWEEP + "select fb.coord_id as event_id, fb.archived or coalesce(du.kind = 'archived', false) as archived, case when du.kind = 'archived' then 'auto_stale' end as archive_reason, fb.k % 6 = 2 or coalesce(du.kind = 'overdue', false) as nudged from fb left join du on du.coord_id = fb.coord_id")
def c07_state(spark, sf):
    after = S.apply_sweep(_sweep_events(spark, sf), _NOW, archive_days=30)
    return after.select(
        F.col("id").alias("event_id"), F.col("archived_at").isNotNull().alias("archived"), "archive_reason", F.col("nudged_overdue_at").isNotNull().alias("nudged")
    )


@query("c07_sweep_notices", _SWEEP + """select coord_id as event_id, kind, 'u9@d0.example' as "to", case kind when 'archived' then 'Archived: ' else 'Still pending: ' end || case when k % 5 <> 0 then 'Plan ' || k else coord_id end as subject from du where kind is not null""")
def c07_notices(spark, sf):
    due = S.sweep(_sweep_events(spark, sf), _NOW, archive_days=30)
    return N.compose(S.sweep_notices(due, _NOW), fx.DOMAIN).select("event_id", "kind", "to", "subject")


# --- lifecycle -------------------------------------------------------------------------------

_DRAFT_ERRORS = W("fa") + """, df as (select mail_id as draft_id, case mail_id % 8 when 0 then 'bad-id' when 1 then 'c' || (mail_id % 64) else 'e' || (mail_id // 2) end as id, case when mail_id % 8 = 2 then 'poll' when mail_id % 2 = 0 then 'crypto' else 'workflow' end as type,
 case when mail_id % 8 = 4 then 0.5 else 2 end as threshold, mail_id % 8 = 6 as closed, mail_id % 8 = 3 as twin, mail_id % 8 = 5 as blank from fa),
e1 as (select *, case when id = 'bad-id' then 'invalid_id' when type = 'poll' then 'unknown_type' when type = 'workflow' and blank then 'step_without_id' when type = 'workflow' and twin then 'duplicate_step_id'
 when type = 'crypto' and threshold <> floor(threshold) then 'bad_threshold' when type = 'crypto' and closed then 'no_signers' end as error from df)
select draft_id, id as event_id, coalesce(error, case when id in (select concat('c', user_id % 60) from events) or draft_id > (select min(o.draft_id) from e1 o where o.id = e1.id and o.error is null) then 'already_exists' end) as error from e1"""


@query("m5_create_events", _DRAFT_ERRORS)
def m5(spark, sf):
    m = F.col("mail_id")
    fields = {
        "id": F.when(m % 8 == 0, "bad-id").when(m % 8 == 1, F.concat(F.lit("c"), (m % 64).cast("string"))).otherwise(F.concat(F.lit("e"), F.floor(m / 2).cast("string"))),
        "type": F.when(m % 8 == 2, "poll").when(m % 2 == 0, "crypto").otherwise("workflow"),
        "threshold": F.when(m % 8 == 4, 0.5).otherwise(2.0),
        "open": m % 8 != 6,
        "steps": F.from_json(
            F.when(m % 8 == 3, '[{"id":"s1"},{"id":"s1"}]').when(m % 8 == 5, '[{"id":"s1"},{"name":"x"}]').otherwise('[{"id":"s1"},{"id":"s2"}]'),
            schemas.COORD_EVENTS["steps"].dataType,
        ),
    }
    drafts = fx.projection(spark, sf, "fa").select(
        m.alias("draft_id"),
        *[
            fields[f.name].alias(f.name) if f.name in fields else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.COORD_EVENTS.fields
        ],
    )
    made = L.create_events(drafts, fx.coord_events(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    return made.select("draft_id", F.col("id").alias("event_id"), "error")


def _actions(spark, sf):
    """One call per mail: its kind and arguments follow from the mail."""
    fa = fx.projection(spark, sf, "fa")
    m = F.col("mail_id")
    patch = F.array(
        F.struct(
            F.col("step_id").alias("id"),
            F.when(m % 11 == 0, "nobody").otherwise(F.concat(F.lit(" new"), (m % 7).cast("string"), F.lit("@x.example "))).alias("participant"),
            F.when(m % 13 == 0, "soon").otherwise("2024-06-01").alias("deadline"),
            (m % 2 == 0).alias("requires_attachment"),
            F.lit(None).cast("string").alias("details"),
            F.when(m % 3 == 0, F.array(F.lit("participant"))).when(m % 3 == 1, F.array(F.lit("deadline"), F.lit("requires_attachment")))
            .otherwise(F.array(F.lit("participant"), F.lit("deadline"))).alias("fields"),
        )
    )
    title = F.when(m % 17 == 0, " ").when(m % 5 == 0, F.concat(F.lit(" Title "), (m % 4).cast("string")))
    return fa.select(
        m.alias("action_id"), F.col("coord_id").alias("event_id"), F.col("received_at").alias("at"), F.lit("edit").alias("action"),
        F.lit(None).cast("string").alias("reason"), title.alias("title"), F.when(m % 4 != 0, patch).alias("steps"),
        F.lit(None).cast("array<string>").alias("retract"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("organiser"),
    )


_EDITS = W("fa", "fb", "fs") + """, ed as (select fa.mail_id as id, fa.coord_id, fa.step_id, fb.k, fb.type, fb.archived, case when fa.mail_id % 17 = 0 then '' when fa.mail_id % 5 = 0 then 'Title ' || (fa.mail_id % 4) end as new_title, fa.mail_id % 4 <> 0 and fb.type = 'workflow' as has_patch,
  fa.mail_id % 3 in (0, 2) as sets_p, fa.mail_id % 3 in (1, 2) as sets_d, fa.mail_id % 3 = 1 as sets_r, fa.mail_id % 11 = 0 as bad_p, fa.mail_id % 13 = 0 as bad_d, fs.step_id is not null as has_step,
  fs.participant, strftime(date '2024-01-01' + cast((fs.k + fs.i * 3) % 60 as integer), '%Y-%m-%d') as deadline, fs.requires_attachment as req
  from fa join fb on fb.coord_id = fa.coord_id left join fs on fs.coord_id = fa.coord_id and fs.step_id = fa.step_id),
ee as (select *, case when archived then 'EVENT_ARCHIVED' when new_title = '' then 'BAD_TITLE' when not has_patch then null
  when not has_step then 'STEP_NOT_FOUND' when sets_p and bad_p then 'BAD_EMAIL' when sets_d and bad_d then 'BAD_DEADLINE' end as error from ed)
"""


@query("m7_edit_verdicts", _EDITS + "select id as action_id, coord_id as event_id, error from ee")
def m7(spark, sf):
    return L.edit_changes(_actions(spark, sf), fx.coord_events(spark, sf))[1].select("action_id", "event_id", "error")


@query("j13_edit_diff", _EDITS + """select * from (
 select id as action_id, coord_id as event_id, null as step_id, 'title' as field, case when k % 5 <> 0 then 'Plan ' || k end as old, new_title as new from ee where error is null and new_title is not null
 union all select id, coord_id, step_id, 'participant', participant, 'new' || (id % 7) || '@x.example' from ee where error is null and has_patch and sets_p
 union all select id, coord_id, step_id, 'deadline', deadline, '2024-06-01' from ee where error is null and has_patch and sets_d
 union all select id, coord_id, step_id, 'requires_attachment', cast(req as varchar), cast(id % 2 = 0 as varchar) from ee where error is null and has_patch and sets_r) where old is distinct from new""")
def j13(spark, sf):
    return L.edit_changes(_actions(spark, sf), fx.coord_events(spark, sf))[0].select("action_id", "event_id", "step_id", "field", "old", "new")


@query("m7_hashed_changes", _EDITS + "select id as action_id, coord_id as event_id, step_id, 'sha256:' || sha256('salt-' || coord_id || '|' || participant) as old, 'sha256:' || sha256('salt-' || coord_id || '|new' || (id % 7) || '@x.example') as new from ee where error is null and has_patch and sets_p")
def m7_hashed(spark, sf):
    ev = fx.coord_events(spark, sf)
    changes = L.edit_changes(_actions(spark, sf), ev)[0]
    return L.hashed_changes(changes, ev).filter("field = 'participant'").select("action_id", "event_id", "step_id", "old", "new")


@query("m6_activate", W("fa", "fb") + f"select fa.mail_id as action_id, fa.coord_id as event_id, fb.activated or fa.mail_id <> (select min_by(x.mail_id, x.received_at) from fa x where x.coord_id = fa.coord_id) as already_active from fa join fb on fb.coord_id = fa.coord_id")
def m6(spark, sf):
    calls = _actions(spark, sf).withColumn("action", F.lit("activate"))
    return L.activation_results(fx.coord_events(spark, sf), calls).select("action_id", "event_id", "already_active")


@query("m6_activated_state", W("fa", "fb") + f"select coord_id as event_id, case when activated then '2023-12-01T00:00:00.000Z' else (select {iso('min(received_at)')} from fa where fa.coord_id = fb.coord_id) end as activated_at from fb")
def m6_state(spark, sf):
    calls = _actions(spark, sf).withColumn("action", F.lit("activate"))
    return L.activate(fx.coord_events(spark, sf), calls).select(F.col("id").alias("event_id"), fn.iso_millis("activated_at").alias("activated_at"))


@query("m8_m9_close_and_reopen", W("fb") + """select coord_id as event_id, case when k % 3 = 0 then 'reopen' else 'complete' end as action, not archived and (k % 3 = 0) = (k % 2 = 0) as applied, case when archived then 'EVENT_ARCHIVED' when k % 3 = 0 and k % 2 = 1 then 'not_complete' when k % 3 <> 0 and k % 2 = 0 then 'already_complete' end as reason,
 case when (k % 2 = 0) <> (not archived and (k % 3 = 0) = (k % 2 = 0)) then 'complete' else 'open' end as status_after from fb""")
def m89(spark, sf):
    """Even events start complete. A third of all events gets a reopen call, the rest a complete call."""
    k = F.substring("id", 2, 9).cast("int")
    ev = fx.coord_events(spark, sf).withColumn("status", F.when(k % 2 == 0, "complete").otherwise("open"))
    calls = ev.select(
        F.col("id").alias("event_id"), F.col("id").alias("action_id"), F.when(k % 3 == 0, "reopen").otherwise("complete").alias("action"),
        F.lit("2024-02-01").cast("timestamp").alias("at"), F.lit("why").alias("reason"), F.lit(None).cast("timestamp").alias("completed_at"),
    )
    after, out = L.close_and_reopen(ev, calls)
    return out.join(after.select(F.col("id").alias("event_id"), F.col("status").alias("status_after")), "event_id").select(
        "event_id", "action", "applied", "reason", "status_after"
    )


def _history(spark, sf):
    """Activate at noon of day one, edit step two on day five, close on day ten, reopen on day twelve."""
    ev = fx.coord_events(spark, sf).withColumn("activated_at", F.lit(None).cast("timestamp"))
    patch = F.array(
        F.struct(
            F.lit("s2").alias("id"), F.lit("u1@d1.example").alias("participant"), F.lit(None).cast("string").alias("deadline"),
            F.lit(None).cast("boolean").alias("requires_attachment"), F.lit(None).cast("string").alias("details"), F.array(F.lit("participant")).alias("fields"),
        )
    )
    k = F.substring("id", 2, 9).cast("int")
    signer = F.concat(F.lit("u3@d"), (k % 3).cast("string"), F.lit(".example"))
    days = {"activate": "2024-01-01 12:00:00", "edit": "2024-01-05 00:00:00", "complete": "2024-01-10 00:00:00", "reopen": "2024-01-12 00:00:00"}
    calls = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(at).alias("at")) for a, at in days.items()])
    actions = ev.select("id", "type", signer.alias("_s"), "salt", F.explode(calls).alias("c")).select(
        F.concat(F.col("id"), F.lit("-"), F.col("c.action")).alias("action_id"), F.col("id").alias("event_id"), F.col("c.at").cast("timestamp").alias("at"),
        "c.action", F.lit("review").alias("reason"), F.lit(None).cast("string").alias("title"),
        F.when((F.col("c.action") == "edit") & (F.col("type") == "workflow"), patch).otherwise(F.array().cast(schemas.ACTIONS["steps"].dataType)).alias("steps"),
        F.when(F.col("c.action") == "reopen", F.array(fn.salted_sender_hash("_s", "salt"))).alias("retract"),
        F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("organiser"),
    )
    return replay(ev, fx.replies(spark, sf), actions)


@query("m10_replay_entries")
def m10(spark, sf):
    """Checked against a row-by-row fold in the tests."""
    return _history(spark, sf).entries.select("event_id", "sequence", "kind", "mail_id", "counted", "count_reason")


@query("m10_replay_state")
def m10_state(spark, sf):
    h = _history(spark, sf)
    n = h.signatures.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("signatures"))
    done = F.size(F.filter("steps", lambda s: s["status"] == "complete"))
    return h.events.join(n, "id", "left").select(F.col("id").alias("event_id"), "status", done.alias("steps_done"), "signatures")


# --- ingest ----------------------------------------------------------------------------------

_INGEST = W("fc", "fb") + HEADERS + """, ix as (select mail_id, received_at, route, route_step, who, trust, coord_id is not null as known, event_id, row_number() over (partition by event_id, route in ('event', 'attest') order by received_at, mail_id) as seq from routed left join fb on fb.coord_id = routed.event_id)
"""


@query("c01_ingest_ledger", _INGEST + """select event_id, seq as sequence, route_step as step_id, trust as trust_level, case when who <> '' then 'sha256:' || sha256('salt-' || event_id || '|' || who) end as sender_hash,
 'sha256:' || sha256('salt-' || event_id || '|m' || mail_id || '@mail.example') as message_id_hash from ix where known and route in ('event', 'attest')""")
def c01(spark, sf):
    b = ingest_batch(fx.mail(spark, sf), fx.coord_events(spark, sf), fx.DOMAIN)
    return b.ledger.select("event_id", "sequence", "step_id", "trust_level", "sender_hash", "message_id_hash")


@query("c01_ingest_routes", _INGEST + """select case when route in ('event', 'attest') and known then 'reply' when route in ('event', 'attest') then 'none' else case when route in ('stats', 'remind', 'verify', 'reverify') then route else 'none' end end as outcome, count(*) as n from ix group by 1""")
def c01_routes(spark, sf):
    b = ingest_batch(fx.mail(spark, sf), fx.coord_events(spark, sf), fx.DOMAIN)
    return b.results.groupBy(F.when(F.col("routed"), F.lit("reply")).otherwise(F.coalesce("command", F.lit("none"))).alias("outcome")).agg(F.count("*").alias("n"))


# Sign-off events also get event+ mail; it is numbered with the rest and never matches a participant.
_ATTEST = SIGNOFF.replace(
    "from fa a join fb b on a.coord_id = b.coord_id where a.k % 2 = 0",
    "from (select mail_id, received_at, event_id as coord_id, k, who as sender, case when route = 'event' then 'by step' else trust end as trust, false as doc_ok from routed where route in ('event', 'attest')) a"
    " join fb b on a.coord_id = b.coord_id where b.type = 'crypto'",
)


@query("c01_ingest_decisions", W("fc", "fb") + HEADERS + _ATTEST + "select coord_id as event_id, seq as sequence, count_reason is null as counted, case when trust = 'by step' and count_reason = 'unverified_trust' then 'wrong_participant' else count_reason end as count_reason from sd")
def c01_decisions(spark, sf):
    b = ingest_batch(fx.mail(spark, sf), fx.coord_events(spark, sf), fx.DOMAIN)
    crypto = fx.coord_events(spark, sf).filter("type = 'crypto'").select(F.col("id").alias("event_id"))
    return b.ledger.join(crypto, "event_id", "left_semi").select("event_id", "sequence", "counted", "count_reason")


@query("r3_dispatch_results", _INGEST + """select mail_id, known and route in ('event', 'attest') as routed, event_id, case when route in ('stats', 'remind', 'verify', 'reverify') then route end as command from ix""")
def r3(spark, sf):
    b = ingest_batch(fx.mail(spark, sf), fx.coord_events(spark, sf), fx.DOMAIN)
    return b.results.select("mail_id", "routed", "event_id", "command")


@query("c01_ingest_outbox")
def c01_outbox(spark, sf):
    """Notices of one batch by kind; their parts have checks of their own."""
    b = ingest_batch(fx.mail(spark, sf), fx.coord_events(spark, sf), fx.DOMAIN)
    return b.outbox.groupBy("kind").agg(F.count("*").alias("n"))


# --- sources and streams ---------------------------------------------------------------------


@query("c11_parse_mail", W("fc") + HEADERS + "select cast(mail_id as varchar) as mail_id, from_address, message_id, 'sha256:' || sha256(raw) as raw_sha256, cast(strlen(raw) as bigint) as raw_size from h")
def c11(spark, sf):
    return M.parse_mail(fx.mail(spark, sf)).select("mail_id", "from_address", "message_id", "raw_sha256", "raw_size")


def _forwards(spark, sf):
    """Documents forwarded as attachments of one message each."""
    docs = fx.table(spark, sf, "documents")
    text = F.concat(
        F.lit("From: a@b.example\r\nMessage-ID: <f"), F.col("doc_id").cast("string"), F.lit("@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"zz\"\r\n\r\n"),
        F.lit("--zz\r\nContent-Type: text/plain\r\n\r\nsee attached\r\n--zz\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=\"doc.txt\"\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
        F.base64(F.col("text").cast("binary")), F.lit("\r\n--zz--\r\n"),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("request_id"), F.lit("c0").alias("event_id"), F.lit("<f@x>").alias("message_id"), text.cast("binary").alias("raw")
    )


@query("c12_extract_candidates", "select cast(doc_id as varchar) as request_id, 'sha256:' || sha256(text) as raw_sha256, cast(octet_length(encode(text)) as bigint) as raw_size from documents where text <> ''")
def c12(spark, sf):
    out = M.extract_candidates(_forwards(spark, sf))
    return out.filter("cand_pos = 0").select("request_id", "raw_sha256", "raw_size")


@query("s08_append_ledger", W("lg") + "select event_id, count(*) as entries, max(sequence) as last from lg group by event_id")
def s08(spark, sf):
    """Write the ledger as two batches, one of them twice, and read it back."""
    root = scratch(spark)
    lg = checkpointed(fx.ledger(spark, sf).drop("mail_id", "k"))
    half = F.col("received_at") < F.lit("2024-01-15").cast("timestamp")
    tables.append_ledger(lg.filter(half), root, "0000000000")
    tables.append_ledger(lg.filter(~half), root, "0000000001")
    tables.append_ledger(lg.filter(~half), root, "0000000001")
    return tables.scan_ledger(spark, root).groupBy("event_id").agg(F.count("*").alias("entries"), F.max("sequence").alias("last"))


@query("s09_write_state", W("fb") + "select coord_id as event_id, 'v2' as title, type from fb")
def s09(spark, sf):
    root = scratch(spark)
    ev = fx.coord_events(spark, sf)
    tables.write_state(ev, root, 1)
    tables.write_state(ev.withColumn("title", F.lit("v2")), root, 2)
    return tables.read_state(spark, root, schemas.COORD_EVENTS).select(F.col("id").alias("event_id"), "title", "type")


@query("s03_read_events", W("fb") + "select coord_id as event_id, type, case when type = 'workflow' then 4 end as n_steps, cast(case when type = 'crypto' then threshold end as integer) as threshold from fb")
def s03(spark, sf):
    """Records written as one JSON document per file, as an event folder holds them."""
    root = scratch(spark)
    docs = fx.coord_events(spark, sf).select("id", F.to_json(F.struct(*schemas.COORD_EVENTS.fieldNames())).alias("value"))
    docs.repartition("id").write.partitionBy("id").text(root + "/raw")
    rename_parts(spark, root)
    ev = tables.read_events(spark, root + "/events")
    return ev.select(F.col("id").alias("event_id"), "type", F.when(F.col("type") == "workflow", F.size("steps")).alias("n_steps"), "threshold")


def rename_parts(spark, root: str) -> None:
    """Give each event's file its own name, `{id}.json`."""
    files = Files(spark)
    for folder in files.names(f"{root}/raw"):
        if folder.startswith("id="):
            part = next(f for f in files.names(f"{root}/raw/{folder}") if f.startswith("part-"))
            files.move(f"{root}/raw/{folder}/{part}", f"{root}/events/{folder[3:]}.json")
