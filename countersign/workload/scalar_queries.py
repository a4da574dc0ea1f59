"""Queries for the column functions, filters and routing (P, F, R and S2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from countersign import functions as fn
from countersign.operators import commands, routing
from countersign.operators.decide import doc_hash_matches
from countersign.workload import fixtures as fx
from countersign.workload.registry import HEADERS, header, iso, query

W = fx.with_clause
MESSAGES = W("fc") + HEADERS


def _fc(spark, sf):
    return fx.projection(spark, sf, "fc").withColumn("block", fn.header_block("raw"))


@query("s02_normalise_envelope", W("fc") + """select mail_id, nullif(nullif(sender, ''), 'unknown') as sender, nullif(nullif(recipient, ''), 'unknown') as recipient,
 case when mail_id % 3 <> 0 then '192.0.2.1' end as client_ip, cast(null as varchar) as client_helo from fc""")
def s02(spark, sf):
    return fx.mail(spark, sf).select("mail_id", routing.normalise_envelope("envelope").alias("e")).select("mail_id", "e.*")


@query("p01_header_block", MESSAGES + "select mail_id, block from h")
def p01(spark, sf):
    return _fc(spark, sf).select("mail_id", "block")


@query("p02_raw_header", MESSAGES + f"select mail_id, auto_submitted, precedence, message_id, {header('X-Note')} as note, {header('Subject')} as subject from h")
def p02(spark, sf):
    h = lambda name: fn.raw_header("block", name)
    return _fc(spark, sf).select(
        "mail_id", h("Auto-Submitted").alias("auto_submitted"), F.lower(h("Precedence")).alias("precedence"),
        h("Message-ID").alias("message_id"), h("X-Note").alias("note"), h("Subject").alias("subject"),
    )


@query("p03_content_type", MESSAGES + "select mail_id, content_type from h")
def p03(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.content_type("block").alias("content_type"))


@query("p04_parse_address", MESSAGES + "select mail_id, case when is_tag then kind end as kind, case when is_tag then ext end as extension, case when is_tag then dom end as domain from h")
def p04(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.parse_address("recipient").alias("a")).select("mail_id", "a.*")


@query("p05_event_tag", MESSAGES + "select mail_id, ev_id as event_id, ev_step as step_id from h")
def p05(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.event_tag("recipient").alias("a")).select("mail_id", "a.*")


@query("p06_attest_tag", MESSAGES + "select mail_id, at_id as event_id from h")
def p06(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.attest_tag("recipient").alias("a")).select("mail_id", "a.*")


@query("p07_verify_tag", MESSAGES + "select mail_id, vf_id as event_id from h")
def p07(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.verify_tag("recipient").alias("a")).select("mail_id", "a.*")


@query("p08_reverify_tag", MESSAGES + "select mail_id, rv_id as event_id, case when rv_id is not null then rv_seq end as commit_sequence from h")
def p08(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.reverify_tag("recipient").alias("a")).select(
        "mail_id", "a.event_id", F.col("a.commit_sequence").cast("bigint").alias("commit_sequence")
    )


@query("p09_initiator_command", MESSAGES + "select mail_id, case when cmd_id is not null then kind end as command, cmd_id as event_id from h")
def p09(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.initiator_command("recipient").alias("a")).select("mail_id", "a.*")


@query("p10_normalise_email", W("fc") + "select mail_id, lower(trim(coalesce('  ' || upper(nullif(sender, '')) || ' ', ''))) as email from fc")
def p10(spark, sf):
    messy = F.concat(F.lit("  "), F.upper(F.nullif(F.col("sender"), F.lit(""))), F.lit(" "))
    return fx.projection(spark, sf, "fc").select("mail_id", fn.normalise_email(messy).alias("email"))


@query("p11_resolve_sender", MESSAGES + "select mail_id, who as sender from h")
def p11(spark, sf):
    df = fx.mail(spark, sf).select(
        "mail_id", routing.normalise_envelope("envelope")["sender"].alias("env"), routing.from_address(fn.header_block("raw")).alias("frm")
    )
    return df.select("mail_id", fn.resolve_sender("env", "frm").alias("sender"))


@query("p12_sender_domain", W("fc") + "select mail_id, case when strpos(sender, '@') > 0 then split_part(sender, '@', 2) end as domain, split_part(concat('a@', sender, '@z'), '@', 2) as second from fc")
def p12(spark, sf):
    return fx.projection(spark, sf, "fc").select(
        "mail_id", fn.sender_domain("sender").alias("domain"),
        fn.sender_domain(F.concat(F.lit("a@"), F.col("sender"), F.lit("@z"))).alias("second"),
    )


@query("p13_hash_document", "select doc_id, 'sha256:' || sha256(text) as fingerprint from documents")
def p13(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fn.hash_document("text").alias("fingerprint"))


@query("p14_norm_hash", "select doc_id, sha256(text) as bare from documents")
def p14(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", fn.norm_hash(F.upper(fn.hash_document("text"))).alias("bare")
    )


@query("p15_salted_sender_hash", W("fa") + "select mail_id, case when sender <> '' then 'sha256:' || sha256('salt-' || coord_id || '|' || lower(sender)) end as sender_hash, case when sender <> '' then 'sha256:' || sha256('|' || lower(sender)) end as unsalted from fa")
def p15(spark, sf):
    salt = F.concat(F.lit("salt-"), F.col("coord_id"))
    return fx.projection(spark, sf, "fa").select(
        "mail_id", fn.salted_sender_hash("sender", salt).alias("sender_hash"),
        fn.salted_sender_hash("sender", F.lit(None).cast("string")).alias("unsalted"),
    )


@query("p16_normalise_message_id", MESSAGES + "select mail_id, 'm' || mail_id || '@mail.example' as message_id from h")
def p16(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.normalise_message_id(fn.raw_header("block", "Message-ID")).alias("message_id"))


@query("p17_salted_message_id_hash", W("fc") + "select mail_id, 'sha256:' || sha256('salt-c' || k || '|m' || mail_id || '@mail.example') as message_id_hash from fc")
def p17(spark, sf):
    salt = F.concat(F.lit("salt-c"), F.col("k").cast("string"))
    return _fc(spark, sf).select("mail_id", fn.salted_message_id_hash(fn.raw_header("block", "Message-ID"), salt).alias("message_id_hash"))


@query("p18_classify_trust", W("fc") + "select mail_id, trust as trust_level from fc")
def p18(spark, sf):
    return fx.mail(spark, sf).select("mail_id", fn.classify_trust("auth").alias("trust_level"))


_RANK = "case trust when 'verified' then 0 when 'forwarded' then 1 when 'authorized' then 2 when 'unverified' then 3 else 2147483647 end"


@query("p19_trust_rank", W("fa") + f"select mail_id, cast({_RANK} as integer) as trust_rank, {_RANK} <= 0 as meets_default, {_RANK} <= 2 as meets_authorized from fa")
def p19(spark, sf):
    return fx.projection(spark, sf, "fa").select(
        "mail_id", fn.trust_rank("trust").alias("trust_rank"),
        fn.meets_trust("trust", F.lit(None).cast("string")).alias("meets_default"),
        fn.meets_trust("trust", F.lit("authorized")).alias("meets_authorized"),
    )


@query("p20_summarise_auth", W("fc") + """select mail_id, case when trust = 'verified' then 'pass' else 'fail' end as dkim_result, 'd.example' as dkim_domain, 'sel' as dkim_selector,
 case when trust = 'verified' then 'd.example' end as dkim_aligned, cast(null as varchar) as dkim_comment, case when trust = 'authorized' then 'pass' else 'none' end as spf, case when trust in ('verified', 'authorized') then 'pass' else 'none' end as dmarc,
 case when trust = 'forwarded' then 'pass' else 'none' end as arc, cast(case when trust = 'forwarded' then 2 else 0 end as integer) as arc_depth from fc""")
def p20(spark, sf):
    df = fx.mail(spark, sf).select("mail_id", fn.summarise_auth("auth").alias("s")).withColumn("d", F.get("s.dkim.signatures", F.lit(0)))
    return df.select(
        "mail_id", F.col("d.result").alias("dkim_result"), F.col("d.domain").alias("dkim_domain"), F.col("d.selector").alias("dkim_selector"),
        F.col("d.aligned").alias("dkim_aligned"), F.col("d.comment").alias("dkim_comment"), F.col("s.spf.result").alias("spf"),
        F.col("s.dmarc.result").alias("dmarc"), F.col("s.arc.result").alias("arc"), F.col("s.arc.chain_length").alias("arc_depth"),
    )


@query("p21_pick_signature_to_archive", W("fa") + """select mail_id, case when trust = 'unverified' then null when has_attachment then 'c' when doc_ok then 'b' else 'a' end as selector from fa""")
def p21(spark, sf):
    def sig(selector, result, aligned):
        return F.struct(F.struct(result.alias("result"), F.lit("").alias("comment"), aligned.alias("aligned")).alias("status"), F.lit(selector).alias("selector"))

    fail, ok, none = F.lit("fail"), F.lit("pass"), F.lit(None).cast("string")
    sigs = F.array(
        sig("a", fail, F.lit("d.example")), sig("b", F.when(F.col("doc_ok"), ok).otherwise(fail), none),
        sig("c", F.when(F.col("has_attachment"), ok).otherwise(fail), F.lit("d.example")),
    )
    auth = F.struct(F.struct(F.when(F.col("trust") == "unverified", F.slice(sigs, 1, 0)).otherwise(sigs).alias("results")).alias("dkim"))
    return fx.projection(spark, sf, "fa").select("mail_id", fn.pick_signature_to_archive(auth)["selector"].alias("selector"))


@query("p22_pick_signer", W("lg") + "select mail_id, case when mail_id % 13 <> 0 then 'd' || (k % 3) || '.example' end as domain, case when mail_id % 13 <> 0 then 'sel' end as selector from lg")
def p22(spark, sf):
    return fx.ledger(spark, sf).select("mail_id", fn.pick_signer("dkim").alias("s")).select("mail_id", "s.domain", "s.selector")


_TXT = "case mail_id % 4 when 0 then 'v=DKIM1; k=rsa; p= ' || sha256('k' || mail_id) || ' ' || sha256('l' || mail_id) when 1 then 'v=DKIM1; k=rsa' when 2 then 'P=' || sha256('k' || mail_id) || ';n=x' else 'p=; t=s' end"


def _txt():
    no = F.col("mail_id").cast("string")
    k, l_ = F.sha2(F.concat(F.lit("k"), no), 256), F.sha2(F.concat(F.lit("l"), no), 256)
    m = F.col("mail_id") % 4
    return (
        F.when(m == 0, F.concat(F.lit("v=DKIM1; k=rsa; p= "), k, F.lit(" "), l_)).when(m == 1, F.lit("v=DKIM1; k=rsa"))
        .when(m == 2, F.concat(F.lit("P="), k, F.lit(";n=x"))).otherwise(F.lit("p=; t=s"))
    )


_KEY = "case mail_id % 4 when 0 then sha256('k' || mail_id) || sha256('l' || mail_id) when 2 then sha256('k' || mail_id) when 3 then '' end"


@query("p23_extract_public_key", W("fa") + f"select mail_id, {_KEY} as public_key from fa")
def p23(spark, sf):
    return fx.projection(spark, sf, "fa").select("mail_id", fn.extract_public_key(_txt()).alias("public_key"))


@query("p24_to_pem", W("fa") + f", t as (select mail_id, {_KEY} as b from fa) select mail_id, case when b <> '' then '-----BEGIN PUBLIC KEY-----' || chr(10) || substr(b, 1, 64) || case when length(b) > 64 then chr(10) || substr(b, 65) else '' end || chr(10) || '-----END PUBLIC KEY-----' || chr(10) end as pem from t")
def p24(spark, sf):
    return fx.projection(spark, sf, "fa").select("mail_id", fn.to_pem(fn.extract_public_key(_txt())).alias("pem"))


@query("p25_parse_block_height", W("fa") + "select mail_id, case mail_id % 6 when 0 then 850000 + mail_id when 1 then 700000 + mail_id when 2 then 123456 when 3 then null when 4 then null else 99 end as height from fa")
def p25(spark, sf):
    no = F.col("mail_id")
    m = no % 6
    text = (
        F.when(m == 0, F.concat(F.lit("Success! Bitcoin block "), (no + 850000).cast("string"), F.lit(" attests")))
        .when(m == 1, F.concat(F.lit("block height: "), (no + 700000).cast("string")))
        .when(m == 2, F.lit("verify BitcoinBlockHeaderAttestation(77)\n at 123456 "))
        .when(m == 3, F.lit("Pending confirmation in Bitcoin blockchain"))
        .when(m == 4, F.lit("Bitcoin block 0"))
        .otherwise(F.lit("bitcoin  block  height 99"))
    )
    return fx.projection(spark, sf, "fa").select("mail_id", fn.parse_block_height(text).alias("height"))


@query("p26_sanitize_subject", W("fc") + r"select mail_id, regexp_replace(raw, '[\r\n]+', ' ', 'g') as subject, '' as nothing from fc")
def p26(spark, sf):
    return fx.projection(spark, sf, "fc").select(
        "mail_id", fn.sanitize_subject("raw").alias("subject"), fn.sanitize_subject(F.lit(None).cast("string")).alias("nothing")
    )


@query("p27_with_signature", "select doc_id, text || chr(10) || chr(10) || '-- ' || chr(10) || 'The team' as signed, text as unsigned from documents")
def p27(spark, sf):
    once = fn.with_signature("text", F.lit("The team"))
    return fx.table(spark, sf, "documents").select(
        "doc_id", fn.with_signature(once, F.lit("The team")).alias("signed"), fn.with_signature("text", F.lit("")).alias("unsigned")
    )


@query("p28_build_raw_message", W("fa") + r"""select mail_id, concat_ws(chr(13) || chr(10), 'From: event+' || coord_id || '@app.example', 'To: ' || nullif(sender, ''), case when has_attachment then 'Reply-To: desk@app.example' end, 'Subject: Reply ' || mail_id,
 'Message-Id: <' || mail_id || '@app.example>', 'Date: ' || strftime(received_at, '%a, %d %b %Y %H:%M:%S GMT'), 'Auto-Submitted: ' || case when doc_ok then 'auto-generated' else 'auto-replied' end,
 case when mail_id % 2 = 0 then 'In-Reply-To: <q@x>' end, 'MIME-Version: 1.0', 'Content-Type: text/plain; charset=utf-8', 'Content-Transfer-Encoding: 8bit', '', 'one' || chr(13) || chr(10) || 'two') as raw from fa where sender <> ''
 union all select mail_id, null from fa where sender = ''""")
def p28(spark, sf):
    no = F.col("mail_id").cast("string")
    raw = fn.build_raw_message(
        F.concat(F.lit("event+"), F.col("coord_id"), F.lit("@app.example")), F.col("sender"), F.concat(F.lit("Reply "), no),
        F.lit("one\ntwo"), F.concat(F.lit("<"), no, F.lit("@app.example>")), F.col("received_at"),
        F.when(F.col("doc_ok"), "auto-generated"), F.when(F.col("has_attachment"), "desk@app.example"),
        F.when(F.col("mail_id") % 2 == 0, "<q@x>"),
    )
    return fx.projection(spark, sf, "fa").select("mail_id", raw.alias("raw"))


@query("p29_message_id_and_date", W("fa") + r"select mail_id, '<' || (epoch_us(received_at) // 1000) || '.' || substr(sha256(coord_id || '|' || mail_id), 1, 16) || '@app.example>' as message_id, strftime(received_at, '%a, %d %b %Y %H:%M:%S GMT') as date from fa")
def p29(spark, sf):
    return fx.projection(spark, sf, "fa").select(
        "mail_id", fn.new_message_id(F.lit("app.example"), "received_at", "coord_id", "mail_id").alias("message_id"),
        fn.rfc5322_date("received_at").alias("date"),
    )


_NOTE = "Your reply is verified and recorded in the event''s tamper-evident log."
_RENDER = f""", t as (select mail_id, case when k % 5 <> 0 then 'Plan ' || k else coord_id end as title, k % 2 = 0 as crypto, mail_id % 3 = 0 as rem, ' — "Step ' || (1 + mail_id % 4) || '"' as step,
 case mail_id % 7 when 0 then 'activation' when 1 then 'advance' when 2 then 'reassigned' when 3 then 'ack' when 4 then 'completion' when 5 then 'archived' else 'overdue' end as kind, mail_id % 5 as n from fa)
select mail_id, kind, case kind when 'activation' then case when crypto and rem then 'Reminder — signature requested: ' when crypto then 'Signature requested: ' when rem then 'Reminder — action needed: ' else 'Action needed: ' end
  when 'advance' then case when rem then 'Reminder — action needed: ' else 'Action needed: ' end when 'reassigned' then 'Action needed: ' when 'ack' then 'Recorded: ' when 'completion' then 'Complete: ' when 'archived' then 'Archived: ' else 'Still pending: ' end || title as subject,
 case when kind = 'activation' and crypto and rem then 'A reminder: your signature is still requested on "' || title || '".' || chr(10) || chr(10) || 'Reply to this email to sign.'
  when kind = 'activation' and crypto then 'Your signature is requested on "' || title || '".' || chr(10) || chr(10) || 'Reply to this email to sign. {_NOTE}'
  when kind in ('activation', 'advance') and rem then 'A reminder: a step in "' || title || '"' || step || ' is still waiting for you.' || chr(10) || chr(10) || 'Reply to this email to confirm your part.'
  when kind = 'activation' then 'A step is ready for you in "' || title || '"' || step || '.' || chr(10) || chr(10) || 'Reply to this email to confirm your part. {_NOTE}'
  when kind = 'advance' then 'A step is now ready for you in "' || title || '"' || step || '.' || chr(10) || chr(10) || 'Reply to this email to confirm your part. {_NOTE}'
  when kind = 'reassigned' then 'A step in "' || title || '"' || step || ' has been assigned to you.' || chr(10) || chr(10) || 'Reply to this email to confirm your part. {_NOTE}'
  when kind = 'ack' then 'Your verified reply to "' || title || '" has been recorded in the event''s tamper-evident log.' || chr(10) || chr(10) || 'Signatures recorded so far: ' || n || '.' || chr(10) || chr(10) || 'Nothing further is needed from you.'
  when kind = 'completion' then '"' || title || '" is now complete.' || chr(10) || chr(10) || 'The full audit trail is preserved as a tamper-evident log (' || n || ' recorded ' || case when n = 1 then 'reply' else 'replies' end || ') and stays verifiable offline.'
  when kind = 'archived' then '"' || title || '" was automatically archived after ' || n || ' days with no activity.' || chr(10) || chr(10) || 'Reply to this email to reopen it.'
  else '"' || title || '" still has steps pending after ' || n || ' days.' || chr(10) || chr(10) || 'Reply to send a reminder, or leave it to keep waiting.' end as body from t"""


@query("p30_render_default", W("fa") + _RENDER)
def p30(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("activation", "advance", "reassigned", "ack", "completion", "archived", "overdue")])
    n = F.col("mail_id") % 5
    df = fx.projection(spark, sf, "fa").withColumn("kind", F.get(kinds, (F.col("mail_id") % 7).cast("int")))
    ctx = {
        "title": F.when(F.col("k") % 5 != 0, F.concat(F.lit("Plan "), F.col("k").cast("string"))),
        "event_id": F.col("coord_id"), "mode": F.when(F.col("k") % 2 == 0, "crypto").otherwise("workflow"),
        "reminder": F.col("mail_id") % 3 == 0,
        "step_name": F.concat(F.lit("Step "), (F.col("mail_id") % 4 + 1).cast("string")),
        "signature_count": n, "counted_commits": n, "days": n,
    }
    subject, body = fn.render_default("kind", ctx)
    return df.select("mail_id", "kind", subject.alias("subject"), body.alias("body"))


@query("p31_stats_body", W("fb", "fs", "fd") + """, dl as (select coord_id, step_id, string_agg(dep, ', ' order by dep) as deps from fd group by coord_id, step_id),
sl as (select fs.coord_id, string_agg('  [ ] ' || fs.step_id || ' — Step ' || fs.i || ' → ' || fs.participant || case when deps is null then '' else ' (after: ' || deps || ')' end, chr(10) order by fs.i) as lines
 from fs left join dl on dl.coord_id = fs.coord_id and dl.step_id = fs.step_id group by fs.coord_id)
select fb.coord_id as event_id, concat_ws(chr(10), 'Event: ' || case when k % 5 <> 0 then 'Plan ' || k else fb.coord_id end, 'ID: ' || fb.coord_id, 'Type: ' || type, 'Status: open',
 case when archived then 'Archived:  2023-12-01T00:00:00.000Z' end, case when type = 'workflow' then chr(10) || 'Steps:' end, lines, case when type = 'crypto' then 'Signatures: 0 / ' || threshold end,
 case when type = 'crypto' and not open then chr(10) || 'Signers:' || chr(10) || '  - u1@d' || (k % 3) || '.example' || chr(10) || '  - u2@d' || (k % 3) || '.example' || chr(10) || '  - u3@d' || (k % 3) || '.example' || chr(10) || '  - u4@d' || (k % 3) || '.example' || chr(10) || '  - u5@d' || (k % 3) || '.example' end) as body
 from fb left join sl on sl.coord_id = fb.coord_id""")
def p31(spark, sf):
    return commands.stats_snapshot(fx.coord_events(spark, sf)).select("event_id", "body")


@query("p32_reply_address", W("fa") + """select mail_id, 'event+' || coord_id || '-' || step_id || '@app.example' as advance, case when k % 2 = 0 then 'attest+' else 'event+' end || coord_id || '@app.example' as overdue,
 'stats+' || coord_id || '@app.example' as stats, 'verify+' || coord_id || '@app.example' as verify, 'reverify+' || coord_id || '-' || mail_id || '@app.example' as reverify from fa""")
def p32(spark, sf):
    etype = F.when(F.col("k") % 2 == 0, "crypto").otherwise("workflow")
    at = lambda kind, t: fn.reply_address(F.lit(kind), t, F.col("coord_id"), F.lit("app.example"), F.col("step_id"), F.col("mail_id"))
    return fx.projection(spark, sf, "fa").select(
        "mail_id", at("advance", F.lit("workflow")).alias("advance"), at("overdue", etype).alias("overdue"), at("stats", etype).alias("stats"),
        at("verify_report", etype).alias("verify"), at("reverify_report", etype).alias("reverify"),
    )


@query("p33_pad_seq", W("fa") + "select mail_id, case when mail_id < 1000 then lpad(cast(mail_id as varchar), 3, '0') else cast(mail_id as varchar) end as padded from fa")
def p33(spark, sf):
    return fx.projection(spark, sf, "fa").select("mail_id", fn.pad_seq("mail_id").alias("padded"))


@query("p34_generated_ids", "select event_id as mail_id, sha256('event-salt|x|' || event_id) as salt, 12 as id_length from events")
def p34(spark, sf):
    made = fn.event_id_from_seed(F.lit("x"), "event_id")
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("mail_id"), fn.salt_from_seed(F.lit("x"), "event_id").alias("salt"),
        F.when(fn.valid_event_id(made), F.length(made)).alias("id_length"),
    )


@query("p35_expand_flow", W("fb", "fs", "fd") + """select fs.coord_id as event_id, fs.step_id, case flow when 'sequential' then case when i = 1 then '' else 's' || (i - 1) end when 'parallel' then '' else coalesce(d.deps, '') end as deps, 'pending' as status
 from fs join fb on fb.coord_id = fs.coord_id left join (select coord_id, step_id, string_agg(dep, ',' order by dep) as deps from fd group by coord_id, step_id) d on d.coord_id = fs.coord_id and d.step_id = fs.step_id""")
def p35(spark, sf):
    ev = fx.coord_events(spark, sf).filter("type = 'workflow'")
    bare = F.transform("steps", lambda s: s.withField("status", F.lit(None).cast("string")))
    return ev.select("id", F.explode(fn.expand_flow(bare, "flow")).alias("s")).select(
        F.col("id").alias("event_id"), F.col("s.id").alias("step_id"), F.array_join("s.dependsOn", ",").alias("deps"), F.col("s.status").alias("status")
    )


@query("p36_strip_address_type", W("fc") + "select mail_id, case when sender = '' then null else sender end as plain, case when sender = '' then null else sender end as typed from fc")
def p36(spark, sf):
    typed = F.when(F.col("sender") != "", F.concat(F.lit("RFC822 ; "), F.col("sender"), F.lit(" ")))
    return fx.projection(spark, sf, "fc").select(
        "mail_id", fn.strip_address_type("sender").alias("plain"), fn.strip_address_type(typed).alias("typed")
    )


@query("p37_event_accessors", W("fb", "fs") + "select coord_id as event_id, false as is_complete, case when type = 'workflow' then 's1' end as first_pending, case when type = 'workflow' then 'u' || ((k + 3) % 11) || '@d' || (k % 3) || '.example' end as third_participant from fb")
def p37(spark, sf):
    return fx.coord_events(spark, sf).select(
        F.col("id").alias("event_id"), fn.is_complete("status").alias("is_complete"),
        fn.first_pending_step("steps")["id"].alias("first_pending"), fn.find_step("steps", F.lit("s3"))["participant"].alias("third_participant"),
    )


@query("p39_canonical_json", W("fb") + """select coord_id as event_id, sha256('{"id":"' || coord_id || '","title":' || case when k % 5 <> 0 then '"Plan ' || k || '"' else 'null' end || ',"created_at":"2023-12-01T00:00:00.000Z"}') as digest from fb""")
def p39(spark, sf):
    return fx.coord_events(spark, sf).select(F.col("id").alias("event_id"), F.sha2(fn.canonical_json("id", "title", "created_at"), 256).alias("digest"))


@query("p40_days_over", W("fa") + "select mail_id, cast(floor((epoch_ms(timestamp '2024-02-10 12:00:00') - epoch_ms(received_at)) / 86400000.0) as bigint) as days from fa")
def p40(spark, sf):
    now = F.lit("2024-02-10 12:00:00").cast("timestamp")
    return fx.projection(spark, sf, "fa").select("mail_id", F.floor(fn.days_over(now, "received_at")).alias("days"))


@query("p41_parse_field_group", W("fc") + """select mail_id, event_type as subject, cast(case when mail_id % 11 = 5 then 'multipart/report; report-type=delivery-status; boundary="B' || mail_id || '"' end as varchar) as content_type, case when mail_id % 11 = 4 then 'folded List-Id: not a header' end as note from fc""")
def p41(spark, sf):
    df = _fc(spark, sf).select("mail_id", fn.parse_field_group("block").alias("m"))
    return df.select(
        "mail_id", F.try_element_at("m", F.lit("subject")).alias("subject"), F.try_element_at("m", F.lit("content-type")).alias("content_type"),
        F.try_element_at("m", F.lit("x-note")).alias("note"),
    )


@query("p42_split_multipart", W("fc") + "select mail_id, case when mail_id % 11 = 5 then 'B' || mail_id end as boundary, case when mail_id % 11 = 5 then 1 else 0 end as n_parts, case when mail_id % 11 = 5 then 'Content-Type: message/delivery-status' end as part_header from fc")
def p42(spark, sf):
    df = _fc(spark, sf).withColumn("boundary", fn.extract_boundary(fn.content_type("block")))
    parts = fn.split_multipart(F.get(fn.split_headers_body("raw"), F.lit(1)), "boundary")
    return df.select(
        "mail_id", "boundary", F.size(parts).alias("n_parts"),
        F.get(fn.split_headers_body(F.get(parts, F.lit(0))), F.lit(0)).alias("part_header"),
    )


@query("p43_resolve_upgrade", W("fa") + "select mail_id, case when trust <> 'verified' then 'verified' end as upgrade_to, case when trust = 'verified' then 'already verified' end as reason from fa")
def p43(spark, sf):
    return fx.projection(spark, sf, "fa").select("mail_id", fn.resolve_upgrade("trust").alias("u")).select("mail_id", "u.*")


@query("f01_is_delivery_status_report", MESSAGES + "select mail_id, is_dsn from h")
def f01(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.is_delivery_status_report("block").alias("is_dsn"))


@query("f02_prefilter", MESSAGES + "select mail_id, reject_reason is not null as rejected, reject_reason as reason from h")
def f02(spark, sf):
    return _fc(spark, sf).select("mail_id", routing.prefilter("block", routing.from_address("block")).alias("p")).select("mail_id", "p.*")


@query("f04_is_active", W("fb") + "select coord_id as event_id from fb where activated and not archived")
def f04(spark, sf):
    return fx.coord_events(spark, sf).filter(fn.is_active()).select(F.col("id").alias("event_id"))


@query("f05_auth_initiator", W("fa", "fb") + "select mail_id, case when trust <> 'verified' then 'unverified' when lower(sender) <> initiator then 'sender_not_initiator' end as reason from fa join fb on fa.coord_id = fb.coord_id")
def f05(spark, sf):
    ev = fx.coord_events(spark, sf).select(F.col("id").alias("coord_id"), "initiator")
    return fx.projection(spark, sf, "fa").join(ev, "coord_id").select(
        "mail_id", commands.auth_initiator(F.col("trust"), F.col("sender"), F.col("initiator")).alias("reason")
    )


@query("f06_valid_event_id", MESSAGES + "select mail_id, regexp_matches(coalesce(ext, ''), '^[a-zA-Z0-9]+$') as valid from h")
def f06(spark, sf):
    return _fc(spark, sf).select("mail_id", fn.valid_event_id(fn.parse_address("recipient")["extension"]).alias("valid"))


@query("f07_doc_hash_matches", W("fa", "fb") + "select mail_id, not needs_doc or doc_ok as matches from fa join fb on fa.coord_id = fb.coord_id where fb.type = 'crypto'")
def f07(spark, sf):
    ev = fx.coord_events(spark, sf).select(F.col("id").alias("event_id"), "requiredDocHash")
    return fx.replies(spark, sf, "crypto").join(ev, "event_id").select(
        "mail_id", doc_hash_matches(F.col("attachments"), F.col("requiredDocHash")).alias("matches")
    )


@query("f08_requires_attachment", W("fa", "fs") + "select mail_id, not requires_attachment or has_attachment as passes from fa join fs on fa.coord_id = fs.coord_id and fa.step_id = fs.step_id")
def f08(spark, sf):
    steps = fx.coord_events(spark, sf).select(F.col("id").alias("event_id"), F.explode("steps").alias("s")).select(
        "event_id", F.col("s.id").alias("step_id"), "s.requires_attachment"
    )
    return fx.replies(spark, sf, "workflow").join(steps, ["event_id", "step_id"]).select(
        "mail_id", (~F.col("requires_attachment") | (F.size("attachments") > 0)).alias("passes")
    )


@query("r1_route", MESSAGES + "select mail_id, route, event_id, route_step as step_id, commit_seq as commit_sequence, case route when 'event' then 'workflow' when 'attest' then 'crypto' end as mode, reason from routed")
def r1(spark, sf):
    return routing.route(fx.mail(spark, sf)).select(
        "mail_id", "route", "event_id", "step_id", F.col("commit_sequence").cast("bigint").alias("commit_sequence"), "mode", "reason"
    )


@query("r2_route_bounce", W("fc", "fb") + HEADERS + "select mail_id, event_id, route_step as step_id, case when event_id is not null and event_id not in (select coord_id from fb) then 'unknown_event' else reason end as reason from routed where route = 'bounce'")
def r2(spark, sf):
    bounces = routing.route_bounces(fx.mail(spark, sf))
    return routing.known_events(bounces, fx.coord_events(spark, sf)).select("mail_id", "event_id", "step_id", "reason")


@query("j01_known_events", W("fc", "fb") + HEADERS + "select mail_id, route, event_id, event_id is not null and event_id in (select coord_id from fb) as known, case when event_id is not null and event_id not in (select coord_id from fb) then 'unknown_event' else reason end as reason from routed")
def j01(spark, sf):
    return routing.known_events(routing.route(fx.mail(spark, sf)), fx.coord_events(spark, sf)).select("mail_id", "route", "event_id", "known", "reason")


@query("r1_route_counts", MESSAGES + "select route, count(*) as n from routed group by route")
def r1_counts(spark, sf):
    return routing.route(fx.mail(spark, sf)).groupBy("route").agg(F.count("*").alias("n"))


@query("u4_iso_time", W("fa") + f"select mail_id, {iso('received_at')} as at from fa")
def u4(spark, sf):
    return fx.projection(spark, sf, "fa").select("mail_id", fn.iso_millis("received_at").alias("at"))
