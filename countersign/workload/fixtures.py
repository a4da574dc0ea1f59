"""Deterministic projections of the shared test tables, as SQL that two engines read alike.

Each text names earlier ones as CTEs. `{sha}` stands for the engine's SHA-256 function and
`{events}` / `{documents}` for the table.
"""
from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign import schemas
from countersign.functions.addresses import sender_domain
from countersign.functions.hashing import hash_document, pad_seq, salted_message_id_hash, salted_sender_hash
from countersign.operators.numbering import assign_sequence
from countersign.session import checkpointed

DOMAIN = "app.example"

SQL: dict[str, str] = {}

# Replies: one row per message.
SQL["fa"] = """
select event_id as mail_id, cast(ts as timestamp) as received_at, user_id % 60 as k, concat('c', user_id % 60) as coord_id,
 case when event_id % 37 = 0 then '' else concat('u', (event_id*7+user_id) % 11, '@d', user_id % 3, '.example') end as sender,
 concat('s', 1 + event_id % 4) as step_id,
 case when event_id % 10 < 6 then 'verified' when event_id % 10 = 6 then 'forwarded' when event_id % 10 = 7 then 'authorized' else 'unverified' end as trust,
 event_type = 'purchase' as has_attachment, event_type in ('purchase','click','view') as doc_ok from {events}"""

# Coordination events.
SQL["fb"] = """
select k, concat('c', k) as coord_id, case when k % 2 = 0 then 'crypto' else 'workflow' end as type, 3 + k % 5 as threshold, k % 4 <> 0 as open,
 'u9@d0.example' as initiator, k % 7 = 0 as needs_doc, k % 11 = 5 as manual_completion, k % 13 <> 12 as activated, k % 17 = 16 as archived,
 case k % 3 when 0 then 'sequential' when 1 then 'parallel' else 'custom' end as flow from (select distinct user_id % 60 as k from {events}) t"""

# Workflow steps.
SQL["fs"] = """
select coord_id, k, concat('s', i) as step_id, i, concat('u', (k + i) % 11, '@d', k % 3, '.example') as participant,
 case i when 1 then 0 when 2 then 2 when 3 then 1 else 3 end as min_rank, i = 4 as requires_attachment
 from fb cross join (select 1 as i union all select 2 union all select 3 union all select 4) s where type = 'workflow'"""

# Step dependencies: a chain, a diamond tail, one unknown dependency, one cycle.
SQL["fd"] = """
select coord_id, step_id, dep from (
 select coord_id, step_id, concat('s', i-1) as dep from fs where k % 3 = 0 and i > 1
 union all select coord_id, step_id, 's1' from fs where k % 3 = 2 and i = 3 and k <> 17
 union all select coord_id, step_id, 's2' from fs where k % 3 = 2 and i = 3
 union all select coord_id, step_id, case when k = 11 then 's9' else 's3' end from fs where k % 3 = 2 and i = 4
 union all select coord_id, step_id, 's4' from fs where k = 17 and i = 3) d"""

# Raw messages with recipients of every kind.
SQL["fc"] = """
select event_id as mail_id, cast(ts as timestamp) as received_at, user_id % 60 as k, user_id, event_type,
 case when event_id % 37 = 0 then '' when event_id % 41 = 0 then 'unknown'
  else concat('u', (event_id*7+user_id) % 11, '@d', user_id % 3, '.example') end as sender,
 case event_id % 12 when 0 then concat('stats+c', user_id % 60, '@app.example') when 1 then concat('remind+c', user_id % 60, '@app.example')
  when 2 then concat('verify+c', user_id % 60, '@app.example') when 3 then concat('reverify+c', user_id % 60, '-', event_id % 7, '@app.example')
  when 4 then 'plain@app.example' when 5 then concat('event+zz', user_id, '-s1@app.example') when 6 then concat('EVENT+c', user_id % 60, '-s-1@App.Example') when 7 then 'manage+c1@app.example'
  when 8 then concat('attest+c', user_id % 60, '-x@app.example')
  else case when user_id % 2 = 0 then concat('attest+c', user_id % 60, '@app.example') else concat('event+c', user_id % 60, '-s', 1 + event_id % 4, '@app.example') end end as recipient,
 case when event_id % 10 < 6 then 'verified' when event_id % 10 = 6 then 'forwarded' when event_id % 10 = 7 then 'authorized' else 'unverified' end as trust,
 concat('From: ', case when event_id % 29 = 0 then 'no-reply@d0.example' else concat('u', (event_id*7+user_id) % 11, '@d', user_id % 3, '.example') end, chr(13), chr(10),
  case event_id % 11 when 0 then concat('Auto-Submitted: auto-replied', chr(13), chr(10)) when 1 then concat('Auto-Submitted: no', chr(13), chr(10)) when 2 then concat('LIST-ID: <l.example>', chr(13), chr(10))
   when 3 then concat('Precedence: Bulk', chr(13), chr(10)) when 4 then concat('X-Note: folded', chr(13), chr(10), ' List-Id: not a header', chr(13), chr(10))
   when 5 then concat('Content-Type: multipart/report;', chr(13), chr(10), ' report-type=delivery-status; boundary="B', event_id, '"', chr(13), chr(10)) else '' end,
  'Message-ID: <M', event_id, '@Mail.Example>', chr(13), chr(10), 'Subject: ', event_type, chr(13), chr(10), chr(13), chr(10),
  case when event_id % 11 = 5 then concat('--B', event_id, chr(13), chr(10), 'Content-Type: message/delivery-status', chr(13), chr(10), chr(13), chr(10), 'Reporting-MTA: dns; mx.example', chr(13), chr(10), chr(13), chr(10),
   'Final-Recipient: rfc822;u', user_id, '@d1.example', chr(13), chr(10), 'Action: ', case when event_id % 2 = 0 then 'Failed' else 'delayed' end, chr(13), chr(10), 'Status: ', case when event_id % 2 = 0 then '5.1.1' else '4.2.2' end, chr(13), chr(10),
   'Diagnostic-Code: smtp; 550', chr(13), chr(10), ' user unknown', chr(13), chr(10), chr(13), chr(10), '--B', event_id, '--', chr(13), chr(10)) else concat('reply ', event_id, chr(13), chr(10)) end) as raw from {events}"""

# A ledger of the replies in `fa`: one entry each, at most one attachment, a few hot documents.
SQL["lg"] = """
select coord_id as event_id, mail_id, received_at, k, sender, step_id, row_number() over (partition by coord_id order by received_at, mail_id) as sequence,
 case when sender = '' then null else concat('sha256:', {sha}(concat('salt-', coord_id, '|', lower(sender)))) end as sender_hash,
 case when sender = '' then null else concat('d', substr(sender, instr(sender, '@') + 2)) end as sender_domain,
 trust as trust_level, mail_id % 3 = 0 as counted, case when mail_id % 3 = 0 then null else 'already_complete' end as count_reason,
 concat('sha256:', {sha}(concat('salt-', coord_id, '|m', mail_id, '@mail.example'))) as message_id_hash,
 concat('sha256:', {sha}(concat('raw ', mail_id))) as raw_sha256,
 case when doc_ok then concat('doc', mail_id % 50, '.pdf') end as att_name,
 case when doc_ok then concat('sha256:', {sha}(concat('doc ', mail_id % 50))) end as att_sha256,
 case when mail_id % 4 = 0 then 'fail' else 'pass' end as sig_result, mail_id % 9 <> 0 as has_key from fa"""

# Messages someone forwards for verification: unchanged, re-encoded, a document, or unrelated.
SQL["cd"] = """
select mail_id as cand_id, coord_id as event_id, received_at,
 concat('sha256:', {sha}(case when mail_id % 5 in (0, 4) then concat('raw ', mail_id) when mail_id % 5 = 2 then concat('doc ', mail_id % 50) else concat('altered ', mail_id) end)) as raw_sha256,
 case when mail_id % 5 in (0, 1) then concat('<M', mail_id, '@Mail.Example>') else concat('<x', mail_id, '@else.example>') end as message_id from fa"""

# Proof results and the records beside them, one per ledger entry.
SQL["pf"] = """
select event_id, concat('commit-', case when sequence < 1000 then lpad(cast(sequence as {text}), 3, '0') else cast(sequence as {text}) end) as base, sequence,
 sequence % 4 in (0, 1) as anchored, sequence % 4 = 0 as changed, sequence % 4 = 2 and k % 3 <> 0 as pending, case when sequence % 4 = 3 then 'calendar down' end as error,
 case when sequence % 4 in (0, 1) and sequence % 5 <> 0 then 800000 + sequence end as block_height,
 sequence % 8 = 1 as rec_anchored, sequence % 8 = 1 as rec_has_time, case when sequence % 16 = 1 then 700000 end as rec_block from lg"""

_NEEDS = {"fs": ("fb",), "fd": ("fb", "fs"), "lg": ("fa",), "cd": ("fa",), "pf": ("fa", "lg")}


def with_clause(*names: str, sha: str = "sha256", events: str = "events", text: str = "varchar") -> str:
    """`with a as (...), b as (...)` holding the named projections and those they build on."""
    order: list[str] = []
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            if need not in order:
                order.append(need)
    body = ",\n".join(f"{n} as ({SQL[n].replace('{events}', events).replace('{sha}', sha).replace('{text}', text)})" for n in order)
    return f"with {body}\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the projections above as a DataFrame."""
    text = with_clause(name, sha="sha2", events="{events}", text="string") + f"select * from {name}"
    # Spark spells the digest length out.
    text = re.sub(r"sha2\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"sha2(\1, 256)", text)
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, events=table(spark, sf_dir, "events"))


_STEP = """named_struct('id', 's{i}', 'name', 'Step {i}', 'participant', concat('u', (k + {i}) % 11, '@d', k % 3, '.example'),
 'deadline', date_format(date_add(date'2024-01-01', cast((k + {i} * 3) % 60 as int)), 'yyyy-MM-dd'), 'requires_attachment', {i} = 4, 'details', cast(null as string),
 'status', 'pending', 'commit_sequence', cast(null as bigint), 'dependsOn', case when k % 3 = 0 then {chain} when k % 3 = 2 then {custom} else array() end,
 'minTrust', '{trust}', 'completed_at', cast(null as string), 'last_send_error', cast(null as struct<reason:string,code:string,at:string>))"""
_CUSTOM = {
    1: "array()",
    2: "array()",
    3: "case when k = 17 then array('s2', 's4') else array('s1', 's2') end",
    4: "case when k = 11 then array('s9') else array('s3') end",
}
_MIN_TRUST = {1: "verified", 2: "authorized", 3: "forwarded", 4: "unverified"}
_STEPS = ", ".join(
    _STEP.format(i=i, chain="array()" if i == 1 else f"array('s{i - 1}')", custom=_CUSTOM[i], trust=_MIN_TRUST[i])
    for i in (1, 2, 3, 4)
)
_SIGNERS = ", ".join(f"concat('u{i}@d', k % 3, '.example')" for i in range(1, 6))
_EVENTS = f"""
select concat('c', k) as id, if(k % 2 = 0, 'crypto', 'workflow') as type, if(k % 5 <> 0, concat('Plan ', k), null) as title, 'u9@d0.example' as initiator,
 concat('salt-c', k) as salt, 'open' as status, timestamp'2023-12-01 00:00:00' as created_at, if(k % 13 <> 12, timestamp'2023-12-01 00:00:00', null) as activated_at,
 if(k % 17 = 16, timestamp'2023-12-01 00:00:00', null) as archived_at, case when k % 2 = 0 then null when k % 3 = 0 then 'sequential' when k % 3 = 1 then 'parallel' else 'custom' end as flow,
 if(k % 2 = 1, array({_STEPS}), null) as steps, if(k % 4 = 0, array({_SIGNERS}), null) as signers, if(k % 2 = 0, k % 4 <> 0, null) as open,
 if(k % 2 = 0, cast(3 + k % 5 as int), null) as threshold, k % 11 = 5 as manualCompletion, if(k % 2 = 0 and k % 7 = 0, concat('sha256:', sha2('contract', 256)), null) as requiredDocHash
 from (select distinct user_id % 60 as k from {{events}})"""


def coord_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordination events as full records; steps and dependencies are built row by row."""
    return _sql(spark, sf_dir, _EVENTS).to(schemas.COORD_EVENTS)


_FA = SQL["fa"]
_FILE = "array(named_struct('filename', '{name}', 'size', cast({size} as bigint), 'sha256', concat('sha256:', sha2('{text}', 256))))"
_REPLIES = f"""
select coord_id as event_id, mail_id, received_at, if(k % 2 = 0, 'crypto', 'workflow') as mode, if(k % 2 = 1, step_id, null) as step_id, sender, trust as trust_level,
 concat('<M', mail_id, '@Mail.Example>') as message_id,
 case when k % 2 = 0 and doc_ok then {_FILE.format(name="contract.pdf", size=8, text="contract")} when k % 2 = 1 and has_attachment then {_FILE.format(name="photo.jpg", size=5, text="photo")}
  else cast(array() as array<struct<filename:string,size:bigint,sha256:string>>) end as attachments from ({_FA})"""


def replies(spark: SparkSession, sf_dir: str, mode: str | None = None) -> DataFrame:
    """The replies of projection `fa` in the form `decide` takes.

    A sign-off reply may carry the contract, a workflow reply any file.
    """
    rows = _sql(spark, sf_dir, _REPLIES)
    return rows if mode is None else rows.filter(F.col("mode") == mode)


_MAIL = f"""
select mail_id, received_at, cast(raw as binary) as raw,
 named_struct('sender', sender, 'recipient', recipient, 'client_ip', if(mail_id % 3 = 0, 'unknown', '192.0.2.1'), 'client_helo', '') as envelope,
 named_struct('dkim', named_struct('results', array(named_struct('status', named_struct('result', if(trust = 'verified', 'pass', 'fail'), 'comment', '', 'aligned', if(trust = 'verified', 'd.example', null)),
   'signingDomain', 'd.example', 'selector', 'sel', 'algo', 'rsa-sha256', 'info', cast(null as string)))),
  'spf', named_struct('status', named_struct('result', if(trust = 'authorized', 'pass', 'none'))), 'dmarc', named_struct('status', named_struct('result', if(trust in ('verified', 'authorized'), 'pass', 'none'))),
  'arc', named_struct('status', named_struct('result', if(trust = 'forwarded', 'pass', 'none'), 'comment', cast(null as string)), 'i', if(trust = 'forwarded', 2, null))) as auth
 from ({SQL["fc"]})"""


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of projection `fc` as `mail` rows; each verdict grades to the row's trust.

    Written once, as mail is at rest: the text is then a column to read, not an expression that
    every header test repeats.
    """
    return checkpointed(_sql(spark, sf_dir, _MAIL))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection `lg`, numbered without a per-event sort."""
    fa = assign_sequence(projection(spark, sf_dir, "fa").withColumnRenamed("coord_id", "event_id"))
    no = F.col("mail_id").cast("string")
    doc = (F.col("mail_id") % 50).cast("string")
    with_doc = lambda c: F.when(F.col("doc_ok"), c)
    salt = F.concat(F.lit("salt-"), F.col("event_id"))
    return fa.select(
        "event_id", "mail_id", "received_at", "k", "sender", "step_id", "sequence",
        salted_sender_hash("sender", salt).alias("sender_hash"),
        sender_domain("sender").alias("sender_domain"),
        F.col("trust").alias("trust_level"),
        (F.col("mail_id") % 3 == 0).alias("counted"),
        F.when(F.col("mail_id") % 3 != 0, "already_complete").alias("count_reason"),
        salted_message_id_hash(F.concat(F.lit("<M"), no, F.lit("@Mail.Example>")), salt).alias("message_id_hash"),
        hash_document(F.concat(F.lit("raw "), no)).alias("raw_sha256"),
        with_doc(F.concat(F.lit("doc"), doc, F.lit(".pdf"))).alias("att_name"),
        with_doc(hash_document(F.concat(F.lit("doc "), doc))).alias("att_sha256"),
        F.when(F.col("mail_id") % 4 == 0, "fail").otherwise("pass").alias("sig_result"),
        (F.col("mail_id") % 9 != 0).alias("has_key"),
    )


_LEDGER = [
    "2 as schema_version", "'reply' as kind", "event_id", "step_id", "sequence", "received_at", "sender_hash", "sender_domain", "message_id_hash",
    "trust_level", "counted", "count_reason",
    "if(att_sha256 is not null, array(named_struct('filename', att_name, 'size', cast(6 as bigint), 'sha256', att_sha256)), cast(array() as array<struct<filename:string,size:bigint,sha256:string>>)) as attachments",
    "named_struct('result', cast(null as string), 'signatures', array(named_struct('result', sig_result, 'comment', cast(null as string), 'domain', concat('d', k % 3, '.example'), "
    "'selector', if(mail_id % 13 <> 0, 'sel', null), 'aligned', cast(null as string), 'algorithm', 'rsa-sha256', 'info', cast(null as string)))) as dkim",
    "raw_sha256", "cast(10 as bigint) as raw_size", "if(has_key, concat('dkim_keys/commit-', format_string('%03d', sequence), '.pem'), null) as dkim_key_file", "mail_id", "k",
]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection `lg` with the ledger's column types."""
    extra = [schemas.T.StructField("mail_id", schemas.L), schemas.T.StructField("k", schemas.L)]
    return numbered(spark, sf_dir).selectExpr(*_LEDGER).to(schemas.T.StructType([*schemas.LEDGER.fields, *extra]))


def proofs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Projection `pf` as proof results and ledger records."""
    q = F.col("sequence")
    lg = numbered(spark, sf_dir).select("event_id", "k", "sequence", F.concat(F.lit("commit-"), pad_seq("sequence")).alias("base"))
    anchored = (q % 4).isin(0, 1)
    results = lg.select(
        "event_id", "base",
        anchored.alias("anchored"),
        (q % 4 == 0).alias("changed"),
        ((q % 4 == 2) & (F.col("k") % 3 != 0)).alias("pending"),
        F.when(q % 4 == 3, "calendar down").alias("error"),
        F.when(anchored & (q % 5 != 0), q + 800000).alias("block_height"),
    )
    had = q % 8 == 1
    records = lg.select(
        "event_id", "base", had.alias("ots_anchored"),
        F.when(had, F.lit("2024-01-01").cast("timestamp")).alias("ots_anchored_at"),
        F.when(q % 16 == 1, F.lit(700000)).cast("bigint").alias("ots_block"),
    )
    return results, records
