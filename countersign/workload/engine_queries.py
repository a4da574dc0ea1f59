"""Queries for the decision engines, windows, joins over steps and signers, and state updates."""
from __future__ import annotations

from pyspark.sql import functions as F

from countersign import functions as fn
from countersign.operators import decide as D
from countersign.operators import ledger as LG
from countersign.operators import notify as N
from countersign.operators.numbering import assign_sequence, last_sequence
from countersign.workload import fixtures as fx
from countersign.workload.registry import SIGNOFF, WORKFLOW, iso, query

W = fx.with_clause
SO = W("fa", "fb") + SIGNOFF
WF = W("fa", "fb", "fs", "fd") + WORKFLOW
BOTH = W("fa", "fb", "fs", "fd") + SIGNOFF + WORKFLOW


def _replies(spark, sf, mode=None):
    return assign_sequence(fx.replies(spark, sf, mode))


def _signoff(spark, sf):
    return D.decide(_replies(spark, sf, "crypto"), fx.coord_events(spark, sf), modes=("crypto",))


def _workflow(spark, sf):
    return D.decide(_replies(spark, sf, "workflow"), fx.coord_events(spark, sf), modes=("workflow",))


def _both(spark, sf):
    return D.decide(_replies(spark, sf), fx.coord_events(spark, sf)).held()


def _identified(spark, sf, mode):
    return D.identify(_replies(spark, sf, mode), fx.coord_events(spark, sf))


@query("w1_assign_sequence", W("fa") + "select mail_id, coord_id as event_id, row_number() over (partition by coord_id order by received_at, mail_id) as sequence from fa")
def w1(spark, sf):
    return _replies(spark, sf).select("mail_id", "event_id", "sequence")


@query("a09_next_sequence", W("fa") + ", a as (select coord_id, mail_id, received_at, row_number() over (partition by coord_id order by received_at, mail_id) as n, ntile(1) over (order by mail_id) as t from fa) select coord_id as event_id, max(n) + 1 as next_sequence from a group by coord_id")
def a09(spark, sf):
    """Half of the mail is on the ledger; numbering the other half continues behind it."""
    mail = fx.replies(spark, sf)
    median = F.lit("2024-01-15").cast("timestamp")
    old = assign_sequence(mail.filter(F.col("received_at") < median))
    new = assign_sequence(mail.filter(F.col("received_at") >= median), base=last_sequence(old))
    return last_sequence(old.select("event_id", "sequence").unionByName(new.select("event_id", "sequence"))).select(
        "event_id", (F.col("last") + 1).alias("next_sequence")
    )


@query("w2_first_eligible_signature", SO + "select coord_id as event_id, seq as sequence, sender_hash from so4 where elig and seq = first_seq")
def w2(spark, sf):
    firsts = D.first_signatures(_identified(spark, sf, "crypto"))
    return firsts.select(
        "event_id", F.col("first_seq").alias("sequence"),
        F.when(~F.col("signer_key").startswith("#"), F.col("signer_key")).alias("sender_hash"),
    )


@query("w3_running_signatures", SO + "select coord_id as event_id, seq as sequence, cast(n as bigint) as signatures from so4 where elig and seq = first_seq")
def w3(spark, sf):
    return _signoff(spark, sf).firsts.select("event_id", F.col("first_seq").alias("sequence"), F.col("nth").alias("signatures"))


@query("a01_signature_count", SO + "select coord_id as event_id, count(*) as signature_count from sd where count_reason is null group by coord_id")
def a01(spark, sf):
    return _signoff(spark, sf).rows.filter("counted").groupBy("event_id").agg(F.count("*").alias("signature_count"))


@query("a02_threshold_reached", SO + "select coord_id as event_id, lock_seq from lk")
def a02(spark, sf):
    return _signoff(spark, sf).locks.select("event_id", "lock_seq")


@query("m3_signoff_decide", SO + "select mail_id, coord_id as event_id, seq as sequence, count_reason is null as counted, count_reason from sd")
def m3(spark, sf):
    return _signoff(spark, sf).rows.select("mail_id", "event_id", "sequence", "counted", "count_reason")


@query("m3_signoff_reasons", SO + "select coalesce(count_reason, 'counted') as outcome, count(*) as n from sd group by 1")
def m3_reasons(spark, sf):
    return _signoff(spark, sf).rows.groupBy(F.coalesce("count_reason", F.lit("counted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("m4_signoff_apply", SO + f"select coord_id as event_id, coalesce(sender_hash, '') as sender_hash, sender_domain, seq as commit_sequence, {iso('received_at')} as received_at, trust as trust_level from sd where count_reason is null")
def m4(spark, sf):
    return LG.signature_rows(_signoff(spark, sf).rows).withColumn("received_at", fn.iso_millis("received_at"))


@query("m4_signoff_events_after", SO + f"select fb.coord_id as event_id, case when sd.seq is not null then 'complete' else 'open' end as status, {iso('sd.received_at')} as completed_at from fb left join sd on sd.coord_id = fb.coord_id and sd.seq = sd.lock_seq where fb.type = 'crypto'")
def m4_after(spark, sf):
    d = _signoff(spark, sf).held()
    ev = fx.coord_events(spark, sf).filter("type = 'crypto'")
    return LG.apply_decisions(ev, d.rows, d.locks).select(F.col("id").alias("event_id"), "status", fn.iso_millis("completed_at").alias("completed_at"))


@query("j02_reply_step_match", W("fa", "fb", "fs") + "select mail_id, lower(trim(sender)) = participant as participant_match from fa join fs on fa.coord_id = fs.coord_id and fa.step_id = fs.step_id")
def j02(spark, sf):
    return _identified(spark, sf, "workflow").select("mail_id", "participant_match")


@query("j03_signer_match", SO + "select mail_id, signer_match, is_initiator from so")
def j03(spark, sf):
    return _identified(spark, sf, "crypto").select("mail_id", "signer_match", "is_initiator")


@query("w4_step_completions", WF + "select coord_id as event_id, step_id, c as sequence from cs")
def w4(spark, sf):
    ev = fx.coord_events(spark, sf)
    done = D.step_completions(_identified(spark, sf, "workflow"), D.event_steps(ev))
    return done.select("event_id", "step_id", F.col("done_seq").alias("sequence"))


@query("j04_step_dependencies", WF + "select coord_id as event_id, step_id, after_seq from af where after_seq is not null")
def j04(spark, sf):
    ev = fx.coord_events(spark, sf)
    steps = D.event_steps(ev)
    done = D.step_completions(_identified(spark, sf, "workflow"), steps)
    return D.dependency_front(steps, done).select("event_id", "step_id", "after_seq")


@query("a03_all_steps_complete", WF + "select coord_id as event_id, done_seq as sequence from dn")
def a03(spark, sf):
    return _workflow(spark, sf).locks.select("event_id", F.col("lock_seq").alias("sequence"))


@query("m1_workflow_decide", WF + "select mail_id, coord_id as event_id, step_id, seq as sequence, count_reason is null as counted, count_reason from wd")
def m1(spark, sf):
    return _workflow(spark, sf).rows.select("mail_id", "event_id", "step_id", "sequence", "counted", "count_reason")


@query("m1_workflow_reasons", WF + "select coalesce(count_reason, 'counted') as outcome, count(*) as n from wd group by 1")
def m1_reasons(spark, sf):
    return _workflow(spark, sf).rows.groupBy(F.coalesce("count_reason", F.lit("counted")).alias("outcome")).agg(F.count("*").alias("n"))


_AFTER = """, st as (select fs.coord_id, fs.step_id, fs.i, fs.participant, wd.seq from fs left join wd on wd.coord_id = fs.coord_id and wd.step_id = fs.step_id and wd.count_reason is null)
"""


@query("m2_workflow_apply", WF + _AFTER + "select st.coord_id as event_id, st.step_id, case when st.seq is null then 'pending' else 'complete' end as step_status, st.seq as commit_sequence, case when dn.done_seq is null then 'open' else 'complete' end as event_status from st left join dn on dn.coord_id = st.coord_id")
def m2(spark, sf):
    d = _workflow(spark, sf).held()
    after = LG.apply_decisions(fx.coord_events(spark, sf), d.rows, d.locks)
    return after.select("id", "status", F.explode("steps").alias("s")).select(
        F.col("id").alias("event_id"), F.col("s.id").alias("step_id"), F.col("s.status").alias("step_status"),
        F.col("s.commit_sequence").alias("commit_sequence"), F.col("status").alias("event_status"),
    )


@query("w5_first_pending_step", WF + _AFTER + "select coord_id as event_id, min_by(step_id, i) as step_id from st where seq is null group by coord_id")
def w5(spark, sf):
    d = _workflow(spark, sf).held()
    after = LG.apply_decisions(fx.coord_events(spark, sf), d.rows, d.locks)
    first = fn.first_pending_step("steps")["id"]
    return after.select(F.col("id").alias("event_id"), first.alias("step_id")).filter("step_id is not null")


_ELIGIBLE = _AFTER + """, el as (select s.coord_id, s.step_id, s.participant from st s left join fd d on d.coord_id = s.coord_id and d.step_id = s.step_id
 left join st x on x.coord_id = d.coord_id and x.step_id = d.dep where s.seq is null group by s.coord_id, s.step_id, s.participant having count(d.dep) = count(x.seq))
"""


@query("j05_eligible_steps", WF + _ELIGIBLE + "select coord_id as event_id, step_id from el")
def j05(spark, sf):
    d = _workflow(spark, sf).held()
    after = LG.apply_decisions(fx.coord_events(spark, sf), d.rows, d.locks)
    return after.select(F.col("id").alias("event_id"), F.explode(fn.eligible_steps("steps")).alias("s")).select("event_id", F.col("s.id").alias("step_id"))


_NEWLY = _AFTER + """, nw as (select s.coord_id, s.step_id, s.participant, max(x.seq) as seq from st s join fd d on d.coord_id = s.coord_id and d.step_id = s.step_id
 left join st x on x.coord_id = d.coord_id and x.step_id = d.dep group by s.coord_id, s.step_id, s.participant, s.seq having count(*) = count(x.seq))
"""


@query("j06_newly_eligible", WF + _NEWLY + "select nw.coord_id as event_id, nw.seq as sequence, nw.step_id, nw.participant from nw left join dn on dn.coord_id = nw.coord_id where dn.done_seq is null or nw.seq < dn.done_seq")
def j06(spark, sf):
    d = _workflow(spark, sf).held()
    after = LG.apply_decisions(fx.coord_events(spark, sf), d.rows, d.locks)
    edge = d.rows.filter(F.col("counted") & ~F.coalesce(F.col("sequence") == F.col("lock_seq"), F.lit(False)))
    return N.newly_eligible(edge.select("event_id", "sequence"), after).select(
        "event_id", "sequence", F.col("next_step").alias("step_id"), "participant"
    )


@query("j11_unsigned_signers", SO + "select fb.coord_id as event_id, 'u' || r.i || '@d' || (k % 3) || '.example' as signer from fb cross join range(1, 6) r(i) where type = 'crypto' and not open and 'sha256:' || sha256('salt-' || fb.coord_id || '|u' || r.i || '@d' || (k % 3) || '.example') not in (select sender_hash from sd where count_reason is null and sender_hash is not null and sd.coord_id = fb.coord_id)")
def j11(spark, sf):
    signed = LG.signature_rows(_signoff(spark, sf).rows)
    return N.unsigned_signers(fx.coord_events(spark, sf), signed).select("event_id", "signer")


_COMMITS = BOTH + """, al as (select mail_id, received_at, coord_id, k, sender, trust, count_reason, seq, null as step_id, null as pm, doc_match from sd union all select mail_id, received_at, coord_id, k, sender, trust, count_reason, seq, step_id, pm, null from wd)
"""


@query("p38_build_reply_commit", _COMMITS + f"""select al.coord_id as event_id, al.seq as sequence, cast(2 as integer) as schema_version, 'reply' as kind, al.step_id, {iso('al.received_at')} as received_at,
 case when al.sender <> '' then 'sha256:' || sha256('salt-' || al.coord_id || '|' || lower(al.sender)) end as sender_hash, case when al.sender <> '' then split_part(al.sender, '@', 2) end as sender_domain,
 'sha256:' || sha256('salt-' || al.coord_id || '|m' || al.mail_id || '@mail.example') as message_id_hash, al.trust as trust_level, al.pm as participant_match, al.count_reason is null as counted, al.count_reason,
 case when al.k % 2 = 0 then case when fa.doc_ok then 1 else 0 end else case when fa.has_attachment then 1 else 0 end end as n_attachments
 from al join fa on fa.mail_id = al.mail_id""")
def p38(spark, sf):
    ev = fx.coord_events(spark, sf)
    d = _both(spark, sf)
    return LG.build_reply_commits(d.rows, ev).select(
        "event_id", "sequence", "schema_version", "kind", "step_id", fn.iso_millis("received_at").alias("received_at"), "sender_hash",
        "sender_domain", "message_id_hash", "trust_level", "participant_match", "counted", "count_reason", F.size("attachments").alias("n_attachments"),
    )


@query("m11_completion_records", BOTH + f"""select coord_id as event_id, 'crypto' as event_type, {iso('received_at')} as completed_at, seq as triggering_commit_sequence, cast(null as integer) as steps_completed, cast(threshold as integer) as threshold, cast(n as bigint) as signatures from sd where seq = lock_seq
 union all select coord_id, 'workflow', {iso('received_at')}, seq, cast(4 as integer), null, null from wd where seq = done_seq""")
def m11(spark, sf):
    ev = fx.coord_events(spark, sf)
    d = _both(spark, sf)
    return LG.completion_records(d.rows, d.locks, ev).withColumn("completed_at", fn.iso_millis("completed_at"))


@query("c10_notify_transitions", BOTH + _NEWLY + """, n as (
 select coord_id as event_id, seq as cause, 'ack' as kind, sender as "to", cast(null as varchar) as step_id, cast(n as bigint) as signature_count, cast(null as bigint) as counted_commits from sd where count_reason is null and sender <> ''
 union all select coord_id, done_seq, 'completion', 'u9@d0.example', null, null, (select count(*) from wd w where w.coord_id = dn.coord_id and w.count_reason is null) from dn
 union all select coord_id, lock_seq, 'completion', 'u9@d0.example', null, null, (select count(*) from sd w where w.coord_id = lk.coord_id and w.count_reason is null) from lk
 union all select nw.coord_id, nw.seq, 'advance', nw.participant, nw.step_id, null, null from nw left join dn on dn.coord_id = nw.coord_id where dn.done_seq is null or nw.seq < dn.done_seq)
 select event_id, cast(cause as varchar) as cause, kind, "to", step_id, signature_count, counted_commits from n""")
def c10(spark, sf):
    ev = fx.coord_events(spark, sf)
    d = _both(spark, sf)
    after = LG.apply_decisions(ev, d.rows, d.locks)
    counts = LG.receipt_counts(LG.build_reply_commits(d.rows, ev))
    notes = N.transition_notices(d.rows, d.locks, after, counts).filter(F.col("to") != "")
    return notes.select("event_id", "cause", "kind", "to", "step_id", "signature_count", "counted_commits")


@query("c09_notify_activation", W("fb", "fs", "fd") + """select coord_id as event_id, 'u' || r.i || '@d' || (k % 3) || '.example' as "to", cast(null as varchar) as step_id from fb cross join range(1, 6) r(i) where activated and type = 'crypto' and not open
 union all select fs.coord_id, participant, step_id from fs join fb on fb.coord_id = fs.coord_id where activated and not exists (select 1 from fd where fd.coord_id = fs.coord_id and fd.step_id = fs.step_id)""")
def c09(spark, sf):
    return N.activation_notices(fx.coord_events(spark, sf)).select("event_id", "to", "step_id")


@query("s11_write_outbox", W("fb", "fs", "fd") + f"""select fs.coord_id as event_id, participant as "to", 'event+' || fs.coord_id || '-' || step_id || '@app.example' as reply_address, 'Action needed: ' || case when fb.k % 5 <> 0 then 'Plan ' || fb.k else fs.coord_id end as subject, 'Fri, 01 Dec 2023 00:00:00 GMT' as date
 from fs join fb on fb.coord_id = fs.coord_id where activated and not exists (select 1 from fd where fd.coord_id = fs.coord_id and fd.step_id = fs.step_id)""")
def s11(spark, sf):
    out = N.compose(N.activation_notices(fx.coord_events(spark, sf).filter("type = 'workflow'")), fx.DOMAIN)
    return out.select("event_id", "to", "reply_address", "subject", F.regexp_extract("raw", r"(?m)^Date: ([^\r\n]+)", 1).alias("date"))


@query("u1_compose_hook", W("fb", "fs", "fd") + """select fs.coord_id as event_id, step_id, case when fs.k % 2 = 1 and fs.i = 1 then 'custom ' || fs.coord_id else 'A step is ready for you in "' || case when fb.k % 5 <> 0 then 'Plan ' || fb.k else fs.coord_id end || '" — "Step ' || fs.i || '".' || chr(10) || chr(10) || 'Reply to this email to confirm your part. Your reply is verified and recorded in the event''s tamper-evident log.' end as body
 from fs join fb on fb.coord_id = fs.coord_id where activated and not exists (select 1 from fd where fd.coord_id = fs.coord_id and fd.step_id = fs.step_id)""".replace('" — "Step', '" — "Step'))
def u1(spark, sf):
    notes = N.activation_notices(fx.coord_events(spark, sf).filter("type = 'workflow'"))
    hook = lambda df: F.when(F.col("step_id") == "s1", F.concat(F.lit("custom "), F.col("event_id")))
    out = N.compose(notes.withColumn("cause", F.col("step_id")), fx.DOMAIN, hook)
    return out.select("event_id", F.col("cause").alias("step_id"), "body")


@query("j12_reassigned", W("fb", "fs", "fd") + """select fs.coord_id as event_id, step_id, 'new' || fs.i || '@x.example' as "to" from fs join fb on fb.coord_id = fs.coord_id where activated and i in (1, 3) and not exists (select 1 from fd where fd.coord_id = fs.coord_id and fd.step_id = fs.step_id)""")
def j12(spark, sf):
    ev = fx.coord_events(spark, sf)
    moved = ev.select(F.col("id").alias("event_id"), F.explode("steps").alias("s")).select(
        "event_id", F.col("s.id").alias("step_id"), F.lit("participant").alias("field"),
        F.when(F.col("s.id").isin("s1", "s3"), F.concat(F.lit("new"), F.substring("s.id", 2, 1), F.lit("@x.example"))).otherwise("").alias("to"),
    )
    return N.reassigned_notices(moved, ev).select("event_id", "step_id", "to")
