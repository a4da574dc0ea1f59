"""Queries for the ledger, its digests, proofs and the read side."""
from __future__ import annotations

import functools

from pyspark.sql import functions as F

from countersign import functions as fn
from countersign.operators import anchor as A
from countersign.operators import ledger as LG
from countersign.operators import lifecycle as L
from countersign.operators import mountain as MT
from countersign.operators import verify as V
from countersign.operators.numbering import rank_numbered
from countersign.session import checkpointed
from countersign.sources import tables
from countersign.workload import fixtures as fx
from countersign.workload.registry import iso, query

W = fx.with_clause
LEDGER = W("lg")
NOW = "2024-02-10 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query("s04_read_ledger", LEDGER + f"select event_id, sequence, 'reply' as kind, {iso('received_at')} as received_at, counted from lg")
def s04(spark, sf):
    return LG.read_ledger(fx.ledger(spark, sf)).select("event_id", "sequence", "kind", fn.iso_millis("received_at").alias("received_at"), "counted")


@query("s05_load_commit", LEDGER + "select event_id, sequence, sender_hash, counted from lg where event_id = 'c7' and sequence = 3")
def s05(spark, sf):
    return LG.load_commit(fx.ledger(spark, sf), "c7", 3).select("event_id", "sequence", "sender_hash", "counted")


def _completions(spark, sf):
    """Every entry as one version of its event's record."""
    return fx.ledger(spark, sf).select(
        "event_id", F.col("received_at").alias("completed_at"), F.col("sequence").alias("triggering_commit_sequence"),
        F.col("sequence").cast("int").alias("version"),
    )


@query("s06_load_completion", LEDGER + f"select event_id, max_by({iso('received_at')}, sequence) as completed_at, max(sequence) as triggering_commit_sequence from lg group by event_id")
def s06(spark, sf):
    return LG.load_completion(_completions(spark, sf)).withColumn("completed_at", fn.iso_millis("completed_at"))


@query("m11_supersede_completions", LEDGER + "select event_id, max(sequence) + case when substr(event_id, 2)::int % 2 = 0 then 1 else 0 end as versions, max(sequence) + case when substr(event_id, 2)::int % 2 = 0 then 1 else 0 end as current_trigger from lg group by event_id")
def m11s(spark, sf):
    """Even events complete again with a new trigger; odd ones repeat their current record."""
    history = checkpointed(_completions(spark, sf))
    current = LG.load_completion(history)
    bump = F.when(F.substring("event_id", 2, 9).cast("int") % 2 == 0, 1).otherwise(0)
    new = current.withColumn("triggering_commit_sequence", F.col("triggering_commit_sequence") + bump)
    after = LG.supersede_completions(history, new)
    return after.groupBy("event_id").agg(
        F.max("version").cast("bigint").alias("versions"),
        F.max_by("triggering_commit_sequence", "version").alias("current_trigger"),
    )


@query("s12_read_keys", LEDGER + "select event_id, sequence, case when has_key then 'key ' || event_id || '/' || sequence end as pem from lg")
def s12(spark, sf):
    lg = fx.ledger(spark, sf).select("event_id", "sequence", "dkim_key_file")
    keys = lg.select("event_id", "sequence", F.concat(F.lit("key "), "event_id", F.lit("/"), F.col("sequence").cast("string")).alias("pem"))
    # A path outside the key folder reads nothing.
    paths = lg.withColumn("dkim_key_file", F.coalesce("dkim_key_file", F.concat(F.lit("../commit-"), fn.pad_seq("sequence"), F.lit(".pem"))))
    return LG.read_keys(keys, paths).select("event_id", "sequence", "pem")


@query("a04_receipts", LEDGER + f"select event_id, sequence, {iso('received_at')} as received_at, step_id, sender_domain, sender_hash, trust_level from lg where counted")
def a04(spark, sf):
    return LG.receipts(fx.ledger(spark, sf)).withColumn("received_at", fn.iso_millis("received_at"))


@query("a04_receipt_counts", LEDGER + "select event_id, count(*) as counted_commits from lg where counted group by event_id")
def a04_counts(spark, sf):
    return LG.receipt_counts(fx.ledger(spark, sf))


def _payload():
    return LG.payload_digest("event_id", "sequence", "sender_hash", "trust_level", "counted")


_JSON = """'{"event_id":"' || event_id || '","sequence":' || sequence || ',"sender_hash":' || case when sender_hash is null then 'null' else '"' || sender_hash || '"' end || ',"trust_level":"' || trust_level || '","counted":' || case when counted then 'true' else 'false' end || '}'"""
# Chain step by step over the sequence numbers; segments of 256 start from their own seed.
_CHAIN = W("lg").replace("with ", "with recursive ", 1) + f""", pl as (select event_id, sequence, (sequence - 1) // 256 as seg, sha256({_JSON}) as payload_digest from lg),
ch as (select event_id, sequence, seg, payload_digest, sha256(event_id || '|' || seg) as prev_digest, sha256(sha256(event_id || '|' || seg) || '|' || payload_digest) as digest from pl where sequence % 256 = 1
 union all select p.event_id, p.sequence, p.seg, p.payload_digest, ch.digest, sha256(ch.digest || '|' || p.payload_digest) from ch join pl p on p.event_id = ch.event_id and p.sequence = ch.sequence + 1 and p.seg = ch.seg)
"""


@query("w6_build_hash_chain", _CHAIN + "select event_id, sequence, payload_digest, prev_digest, digest from ch")
def w6(spark, sf):
    lg = fx.ledger(spark, sf)
    return LG.build_hash_chain(lg, _payload())


@query("w6_digest_tree", _CHAIN + """, n0 as (select event_id, seg as node, max_by(digest, sequence) as digest, count(*) as entries from ch group by event_id, seg),
n1 as (select event_id, node // 256 as node, sha256(string_agg(digest, '|' order by node)) as digest, sum(entries) as entries from n0 group by event_id, node // 256),
n2 as (select event_id, node // 256 as node, sha256(string_agg(digest, '|' order by node)) as digest, sum(entries) as entries from n1 group by event_id, node // 256),
n3 as (select event_id, node // 256 as node, sha256(string_agg(digest, '|' order by node)) as digest, sum(entries) as entries from n2 group by event_id, node // 256),
n4 as (select event_id, node // 256 as node, sha256(string_agg(digest, '|' order by node)) as digest, sum(entries) as entries from n3 group by event_id, node // 256)
select event_id, cast(entries as bigint) as entries, digest as root from n4""")
def w6_tree(spark, sf):
    return LG.digest_tree(LG.build_hash_chain(fx.ledger(spark, sf), _payload()))


@query("w7_verify_hash_chain", LEDGER + "select event_id, sequence, case when sequence = 5 then 'altered' else 'missing' end as problem from lg where sequence in (5, 9)")
def w7(spark, sf):
    """Entry 5 of every event is altered and entry 9 removed after the chain was built."""
    lg = fx.ledger(spark, sf)
    chain = LG.build_hash_chain(lg, _payload())
    tampered = lg.filter("sequence <> 9").withColumn("counted", F.when(F.col("sequence") == 5, ~F.col("counted")).otherwise(F.col("counted")))
    return LG.verify_hash_chain(tampered, chain, _payload())


def _json_text(value: str) -> str:
    return f"""coalesce('"' || {value} || '"', 'null')"""


# The canonical JSON of a whole entry of projection `lg`, nulls kept, nested fields too.
_ENTRY = f"""'{{"schema_version":2,"kind":"reply","event_id":"' || event_id || '","step_id":' || {_json_text("step_id")} || ',"sequence":' || sequence || ',"received_at":"' || {iso("received_at")}
 || '","sender_hash":' || {_json_text("sender_hash")} || ',"sender_domain":' || {_json_text("sender_domain")} || ',"message_id_hash":' || {_json_text("message_id_hash")} || ',"trust_level":"' || trust_level
 || '","participant_match":null,"counted":' || case when counted then 'true' else 'false' end || ',"count_reason":' || {_json_text("count_reason")}
 || ',"attachments":[' || case when att_sha256 is null then '' else '{{"filename":"' || att_name || '","size":6,"sha256":"' || att_sha256 || '"}}' end
 || '],"dkim":{{"result":null,"signatures":[{{"result":"' || sig_result || '","comment":null,"domain":"d' || (k % 3) || '.example","selector":' || case when mail_id % 13 <> 0 then '"sel"' else 'null' end
 || ',"aligned":null,"algorithm":"rsa-sha256","info":null}}]}},"spf":null,"dmarc":null,"arc":null,"envelope":null,"raw_sha256":"' || raw_sha256 || '","raw_size":10,"dkim_key_file":'
 || case when has_key then '"dkim_keys/commit-' || case when sequence < 1000 then lpad(cast(sequence as varchar), 3, '0') else cast(sequence as varchar) end || '.pem"' else 'null' end || ',"ots_proof_file":null,"change":null}}'"""
_RANGE = (
    LEDGER
    + f", m0 as (select event_id, sequence - 1 as i, sha256({_ENTRY}) as digest from lg), mn as (select event_id, count(*) as n from lg group by event_id)"
    + "".join(f", m{h} as (select event_id, i // 16 as i, sha256(string_agg(digest, '|' order by i)) as digest from m{h - 1} group by event_id, i // 16 having count(*) = 16)" for h in range(1, 7))
    + ", pk as (" + " union all ".join(f"select m{h}.event_id, {h} as height, i, digest from m{h} join mn on mn.event_id = m{h}.event_id where (i // 16 + 1) * {16 ** (h + 1)} > n" for h in range(7)) + ")"
)


def _appended(lg, parts=5):
    """States and nodes of a ledger that grew in several batches, each extending the stored peaks."""
    whole = lg.groupBy("event_id").agg(F.max("sequence").alias("_n"))
    numbered = checkpointed(MT.leaves(lg).join(whole, "event_id").withColumn("_part", F.floor(F.col("index") * parts / F.col("_n"))))
    peaks, states, nodes = None, [], []
    for p in range(parts):
        formed, fresh = MT.extend(peaks, numbered.filter(F.col("_part") == p))
        touched = fresh.select("event_id").distinct()
        peaks = checkpointed(fresh if peaks is None else fresh.unionByName(peaks.join(touched, "event_id", "left_anti")))
        states.append(MT.roots(peaks.join(touched, "event_id", "left_semi")).withColumn("state", F.lit(p).cast("bigint")))
        nodes.append(formed)
    union = lambda frames: functools.reduce(lambda a, b: a.unionByName(b), frames)
    return peaks, union(states), union(nodes)


@query("w6_append_digest", _RANGE + "select pk.event_id, cast(n as bigint) as entries, sha256(n || '|' || string_agg(digest, '|' order by height desc, i)) as root from pk join mn on mn.event_id = pk.event_id group by pk.event_id, n")
def w6_append(spark, sf):
    """Roots of a ledger that was chained in five batches; the SQL builds each in one piece."""
    peaks, _, _ = _appended(checkpointed(fx.ledger(spark, sf)))
    return MT.roots(peaks)


_STATES = LEDGER + """, nn as (select event_id, any_value(k) as k, count(*) as n from lg group by event_id),
st as (select distinct lg.event_id, k2.k, n, (sequence - 1) * 5 // n as state from lg join nn k2 on k2.event_id = lg.event_id),
se as (select st.event_id, st.k, st.n, state, (select count(*) from lg where lg.event_id = st.event_id and (lg.sequence - 1) * 5 // st.n <= state) as entries from st)
"""


@query("w7_check_states", _STATES + """select event_id, state, entries, coalesce(lag(entries) over (partition by event_id order by state), 0) as after,
 case when k % 4 = 1 and state >= 1 then 'missing' when k % 4 = 2 and state = 4 then 'missing' when k % 4 = 3 and state >= 2 then 'changed' end as problem from se""")
def w7_states(spark, sf):
    """After five batches one event in four loses its second batch, one its last entry, and one has its third batch rewritten."""
    lg = checkpointed(fx.ledger(spark, sf))  # numbered once for all that reads it
    _, states, _ = _appended(lg)
    whole = lg.groupBy("event_id").agg(F.max("sequence").alias("_n"))
    part, kind = F.floor((F.col("sequence") - 1) * 5 / F.col("_n")), F.col("k") % 4
    kept = lg.join(whole, "event_id").filter(~((kind == 1) & (part == 1)) & ~((kind == 2) & (F.col("sequence") == F.col("_n"))))
    left = kept.withColumn("trust_level", F.when((kind == 3) & (part == 2), "verified!").otherwise(F.col("trust_level")))
    nodes, _ = MT.extend(None, MT.leaves(left))
    return MT.check_states(states, nodes)


@query("w7_growth_proof", _STATES + "select event_id, max(entries) filter (where state = 1) as start, max(entries) filter (where state = 4) as entries, case when any_value(k) % 4 = 3 then 'newer' end as problem from se group by event_id")
def w7_growth(spark, sf):
    """The second and the last state compared without the entries; one event in four has its third batch rewritten and its last root made anew."""
    lg = checkpointed(fx.ledger(spark, sf))  # numbered once for all that reads it
    _, states, nodes = _appended(lg)
    older, newer = states.filter("state = 1"), states.filter("state = 4")
    forged = F.col("k") % 4 == 3
    false = newer.join(lg.select("event_id", "k").distinct(), "event_id").select("event_id", "entries", F.when(forged, F.sha2(F.concat("root", F.lit("!")), 256)).otherwise(F.col("root")).alias("root"))
    pairs = older.select("event_id", F.col("entries").alias("start")).join(newer.select("event_id", "entries"), "event_id")
    return MT.check_growth(MT.growth_proof(nodes, pairs), older, false)


@query("o1_sort_commits", LEDGER + "select event_id, sequence, row_number() over (partition by event_id order by sequence) as place from lg where counted")
def o1(spark, sf):
    """Place of every counted entry in numeric order."""
    counted = fx.ledger(spark, sf).filter("counted").select("event_id", "sequence")
    return rank_numbered(counted, "event_id", "sequence", "place")


@query("o3_union_kinds", W("lg") + "select 'reply' as kind, event_id, sequence, sender_hash, cast(null as varchar) as reason from lg union all select 'event_reopen', event_id, max(sequence) + 1, null, 'again' from lg group by event_id")
def o3(spark, sf):
    from countersign.operators.routing import dispatch_results

    lg = fx.ledger(spark, sf)
    reopen = LG.last_sequence(lg).select(
        F.lit("event_reopen").alias("kind"), "event_id", (F.col("last") + 1).alias("sequence"), F.lit("again").alias("reason")
    )
    return dispatch_results(lg.select("kind", "event_id", "sequence", "sender_hash"), reopen)


_SIGNED = LEDGER + """, sg as (select event_id, sender_hash, min(sequence) as commit_sequence from lg where counted and sender_hash is not null group by event_id, sender_hash),
rt as (select event_id, sender_hash from sg where commit_sequence % 2 = 0)
"""


def _signatures(spark, sf):
    lg = fx.ledger(spark, sf).filter("counted and sender_hash is not null")
    return lg.groupBy("event_id", "sender_hash").agg(F.min("sequence").alias("commit_sequence"))


def _reopen(signatures):
    """One reopen call per event that takes back the signatures on even entries."""
    return signatures.filter("commit_sequence % 2 = 0").groupBy("event_id").agg(F.collect_list("sender_hash").alias("retract")).select(
        "event_id", F.concat(F.lit("r-"), "event_id").alias("action_id"), F.lit("reopen").alias("action"), "retract"
    )


@query("o4_signatures_kept", _SIGNED + "select event_id, sender_hash, commit_sequence from sg where commit_sequence % 2 = 1")
def o4(spark, sf):
    s = _signatures(spark, sf)
    return L.retract(s, _reopen(s))[0].select("event_id", "sender_hash", "commit_sequence")


@query("o4_signatures_retracted", _SIGNED + "select 'r-' || event_id as action_id, event_id, sender_hash, commit_sequence from sg where commit_sequence % 2 = 0")
def o4_retracted(spark, sf):
    s = _signatures(spark, sf)
    return L.retract(s, _reopen(s))[1].select("action_id", "event_id", "sender_hash", "commit_sequence")


@query("o5_signers_minus_signed", W("lg", "fb") + "select fb.coord_id as event_id, 'u' || r.i || '@d' || (fb.k % 3) || '.example' as signer from fb cross join range(1, 6) r(i) where type = 'crypto' and not open and 'u' || r.i || '@d' || (fb.k % 3) || '.example' not in (select sender from lg where counted and lg.event_id = fb.coord_id)")
def o5(spark, sf):
    from countersign.operators.notify import unsigned_signers

    return unsigned_signers(fx.coord_events(spark, sf), _signatures(spark, sf)).select("event_id", "signer")


# --- matching --------------------------------------------------------------------------------

_MATCH = W("lg", "cd") + """, cm as (select cand_id, cd.event_id, cd.received_at, cd.raw_sha256, 'sha256:' || sha256('salt-' || cd.event_id || '|' || lower(substr(message_id, 2, length(message_id) - 2))) as mid from cd),
br as (select event_id, raw_sha256, min(sequence) as s from lg group by event_id, raw_sha256), bm as (select event_id, message_id_hash, min(sequence) as s from lg group by event_id, message_id_hash),
ba as (select event_id, att_sha256, min(sequence) as s from lg where att_sha256 is not null group by event_id, att_sha256),
mt as (select cm.*, case when br.s is not null then 'raw_email' when bm.s is not null then 'message_id' when ba.s is not null then 'attachment' else 'none' end as match_type, coalesce(br.s, bm.s, ba.s) as sequence from cm
 left join br on br.event_id = cm.event_id and br.raw_sha256 = cm.raw_sha256 left join bm on bm.event_id = cm.event_id and bm.message_id_hash = cm.mid left join ba on ba.event_id = cm.event_id and ba.att_sha256 = cm.raw_sha256)
"""


def _candidates(spark, sf):
    return fx.projection(spark, sf, "cd").withColumnRenamed("cand_id", "request_id")


@query("j07_find_match", _MATCH + "select cand_id as request_id, event_id, match_type, sequence from mt")
def j07(spark, sf):
    cand = V.candidate_hashes(_candidates(spark, sf), fx.coord_events(spark, sf))
    return V.find_match(cand, fx.ledger(spark, sf)).select("request_id", "event_id", "match_type", "sequence")


@query("j07_match_counts", _MATCH + "select match_type, count(*) as n from mt group by match_type")
def j07_counts(spark, sf):
    cand = V.candidate_hashes(_candidates(spark, sf), fx.coord_events(spark, sf))
    return V.find_match(cand, fx.ledger(spark, sf)).groupBy("match_type").agg(F.count("*").alias("n"))


def _documents(spark, sf):
    """Every reply asks about one of sixty documents, half of them with an address."""
    fa = fx.projection(spark, sf, "fa")
    return fa.select(
        F.col("coord_id").alias("event_id"), "mail_id",
        fn.hash_document(F.concat(F.lit("doc "), (F.col("mail_id") % 60).cast("string"))).alias("doc_sha256"),
        F.when(F.col("mail_id") % 2 == 0, F.upper("sender")).alias("email"),
    )


_DOCS = W("lg") + """, dq as (select mail_id, coord_id as event_id, 'sha256:' || sha256('doc ' || (mail_id % 60)) as doc, case when mail_id % 2 = 0 and sender <> '' then upper(sender) end as email from fa)
"""


@query("j08_verify_document", _DOCS + f"""select dq.event_id, substr(doc, 8) as doc_hash, email, lg.sequence, {iso('lg.received_at')} as received_at, lg.trust_level, lg.counted, lg.sender_domain,
 case when email is not null then coalesce(lg.sender_hash = 'sha256:' || sha256('salt-' || dq.event_id || '|' || lower(email)), false) end as sender_match, att_name as filename
 from (select distinct event_id, doc, email from dq) dq join lg on lg.event_id = dq.event_id and lg.att_sha256 = dq.doc""")
def j08(spark, sf):
    hits = V.verify_document(_documents(spark, sf), fx.ledger(spark, sf), fx.coord_events(spark, sf))
    return hits.withColumn("received_at", fn.iso_millis("received_at"))


@query("j08_document_found", _DOCS + "select mail_id, dq.event_id, (select count(*) from lg where lg.event_id = dq.event_id and lg.att_sha256 = dq.doc) as entries, (select count(*) from lg where lg.event_id = dq.event_id and lg.att_sha256 = dq.doc) > 0 as found from dq")
def j08_found(spark, sf):
    return V.document_found(_documents(spark, sf), fx.ledger(spark, sf)).select("mail_id", "event_id", "entries", "found")


_TXT_SQL = """, tx as (select 'sel._domainkey.d' || d || '.example' as name, case d when 0 then 'v=DKIM1; k=rsa; p=' || sha256('d0') when 1 then 'v=DKIM1; k=rsa' end as txt from range(0, 3) r(d))
"""


def _dns(spark, sf):
    """Published key records of the domains seen in the mail."""
    domains = fx.projection(spark, sf, "fa").select((F.col("k") % 3).alias("d")).distinct()
    d = F.col("d").cast("string")
    return domains.select(
        F.concat(F.lit("sel._domainkey.d"), d, F.lit(".example")).alias("name"),
        F.when(F.col("d") == 0, F.concat(F.lit("v=DKIM1; k=rsa; p="), F.sha2(F.lit("d0"), 256))).when(F.col("d") == 1, "v=DKIM1; k=rsa").alias("txt"),
    )


@query("j09_archive_keys", W("lg") + _TXT_SQL + """, sq as (select event_id, sequence, mail_id, 'd' || (k % 3) || case when mail_id % 17 = 0 then '!' else '' end || '.example' as domain, case when mail_id % 13 <> 0 then 'sel' end as selector from lg)
select event_id, sequence, case when selector is not null and strpos(domain, '!') = 0 then 'sel._domainkey.' || domain end as lookup, case when tx.txt like '%p=%' then sha256('d0') end as base64,
 case when tx.txt like '%p=%' then '-----BEGIN PUBLIC KEY-----' || chr(10) || sha256('d0') || chr(10) || '-----END PUBLIC KEY-----' || chr(10) end as pem,
 case when selector is null then 'missing domain/selector' when strpos(domain, '!') > 0 then 'invalid domain/selector' when tx.txt is null then 'no TXT record' when tx.txt not like '%p=%' then 'no p= tag' end as error
 from sq left join tx on tx.name = 'sel._domainkey.' || sq.domain and selector is not null""")
def j09(spark, sf):
    sig = F.get("dkim.signatures", F.lit(0))
    bad = F.when(F.col("mail_id") % 17 == 0, F.regexp_replace(sig["domain"], r"\.", "!.")).otherwise(sig["domain"])
    sigs = fx.ledger(spark, sf).select("event_id", "sequence", "received_at", bad.alias("domain"), sig["selector"].alias("selector"))
    return V.archive_keys(sigs, _dns(spark, sf), F.col("received_at")).select("event_id", "sequence", "lookup", "base64", "pem", "error")


def _verdicts(spark, sf):
    """A check result for most candidates: good for two thirds."""
    cd = fx.projection(spark, sf, "cd")
    k = F.regexp_extract("event_id", r"(\d+)", 1).cast("int")
    return (
        cd.filter("cand_id % 7 <> 0")
        .select(
            "raw_sha256", F.concat(F.lit("d"), (k % 3).cast("string"), F.lit(".example")).alias("domain"), F.lit("sel").alias("selector"),
            F.crc32(F.col("raw_sha256").cast("binary")).alias("_c"), "cand_id",
        )
        .groupBy("raw_sha256", "domain", "selector")
        .agg(F.min("cand_id").alias("c"))
        .select("raw_sha256", "domain", "selector", (F.col("c") % 3 != 0).alias("ok"), F.when(F.col("c") % 3 == 0, "bad signature").alias("reason"))
    )


_VERDICTS = """, vd as (select raw_sha256, 'd' || (substr(event_id, 2)::int % 3) || '.example' as domain, min(cand_id) % 3 <> 0 as ok, case when min(cand_id) % 3 = 0 then 'bad signature' end as reason from cd where cand_id % 7 <> 0 group by 1, 2)
"""


@query("c05_verify_candidates", _MATCH + _VERDICTS + """select mt.cand_id as request_id, mt.event_id, cast(0 as integer) as cand_pos, match_type <> 'none' as matched, match_type, mt.raw_sha256 as hash, mt.sequence, lg.counted, lg.trust_level, lg.sender_domain,
 case when match_type in ('raw_email', 'message_id') then case when sig_result = 'pass' and has_key then coalesce(vd.ok and lg.mail_id % 13 <> 0, false) else false end end as dkim_ok,
 case when match_type in ('raw_email', 'message_id') then case when not (sig_result = 'pass' and has_key) then 'no archived key or signature was not pass' when vd.ok is null or lg.mail_id % 13 = 0 then 'no verdict' else vd.reason end end as dkim_reason
 from mt left join lg on lg.event_id = mt.event_id and lg.sequence = mt.sequence left join vd on vd.raw_sha256 = mt.raw_sha256 and vd.domain = 'd' || (lg.k % 3) || '.example'""")
def c05(spark, sf):
    cand = _candidates(spark, sf).withColumn("cand_pos", F.lit(0))
    out = V.verify_candidates(cand, fx.ledger(spark, sf), fx.coord_events(spark, sf), _verdicts(spark, sf))
    return out.select("request_id", "event_id", "cand_pos", "matched", "match_type", "hash", "sequence", "counted", "trust_level", "sender_domain", "dkim_ok", "dkim_reason")


@query("c05_first_matching_candidate", _MATCH + """, gr as (select mt.*, cand_id // 3 as request_id, cast(cand_id % 3 as integer) as cand_pos from mt),
pk as (select gr.*, row_number() over (partition by request_id, event_id order by case when match_type <> 'none' then cand_pos else 1000 - cand_pos end) as r from gr)
select request_id, event_id, cand_pos, match_type, sequence from pk where r = 1""")
def c05_first(spark, sf):
    """Three neighbouring messages form one request; the first match speaks for it."""
    cand = fx.projection(spark, sf, "cd").withColumns(
        {"request_id": F.floor(F.col("cand_id") / 3), "cand_pos": (F.col("cand_id") % 3).cast("int")}
    )
    out = V.verify_candidates(cand, fx.ledger(spark, sf), fx.coord_events(spark, sf))
    return out.select("request_id", "event_id", "cand_pos", "match_type", "sequence")


_REVERIFY = W("lg", "cd") + _VERDICTS + """, rq as (select cand_id as request_id, received_at, event_id, cand_id % 90 as target, raw_sha256 from cd),
rr as (select rq.*, lg.sequence is not null as found, lg.trust_level as lv, lg.has_key, lg.mail_id % 13 <> 0 as signer, coalesce(vd.ok, false) as ok, vd.ok is null as none, vd.reason as why, lg.raw_sha256 = rq.raw_sha256 as same
 from rq left join lg on lg.event_id = rq.event_id and lg.sequence = rq.target left join vd on vd.raw_sha256 = rq.raw_sha256 and vd.domain = 'd' || (lg.k % 3) || '.example' and lg.mail_id % 13 <> 0)
"""


@query("c06_reverify_batch", _REVERIFY + """select request_id, event_id, target as target_sequence, found, case when found then row_number() over (partition by event_id, found order by received_at, request_id) end as reverify_sequence,
 coalesce(found and signer and has_key and ok and lv <> 'verified', false) as upgraded, lv as trust_level_before, case when signer and has_key and ok then 'verified' else lv end as trust_level_after,
 case when lv = 'verified' then 'already verified' end as policy_note, case when found then signer and has_key and ok end as dkim_ok,
 case when found then case when not signer then 'no signing domain/selector in committed DKIM record' when not has_key then 'no archived DKIM key for this commit' when not ok then coalesce(why, 'no verdict') end end as dkim_reason,
 case when found then same end as evidence_matches, case when not found then 'no commit-' || case when target < 1000 then lpad(cast(target as varchar), 3, '0') else cast(target as varchar) end || '.json in ' || event_id end as reason from rr""")
def c06(spark, sf):
    req = fx.projection(spark, sf, "cd").select(
        F.col("cand_id").alias("request_id"), "received_at", "event_id", (F.col("cand_id") % 90).alias("target_sequence"), "raw_sha256", F.lit(10).cast("bigint").alias("raw_size")
    )
    out = V.reverify(req, fx.ledger(spark, sf), fx.coord_events(spark, sf), _verdicts(spark, sf))
    return out.drop("received_at", "raw_sha256", "raw_size")


@query("j10_reverify_upgrades", _REVERIFY + "select event_id, target as target_sequence, count(*) as attempts, count(*) filter (where signer and has_key and ok and lv <> 'verified') as upgrades from rr where found group by event_id, target")
def j10(spark, sf):
    req = fx.projection(spark, sf, "cd").select(
        F.col("cand_id").alias("request_id"), "received_at", "event_id", (F.col("cand_id") % 90).alias("target_sequence"), "raw_sha256", F.lit(10).cast("bigint").alias("raw_size")
    )
    out = V.reverify(req, fx.ledger(spark, sf), fx.coord_events(spark, sf), _verdicts(spark, sf)).filter("found")
    return out.groupBy("event_id", "target_sequence").agg(F.count("*").alias("attempts"), F.count_if("upgraded").alias("upgrades"))


# --- proofs ----------------------------------------------------------------------------------

PROOFS = W("pf", "fb")
_PATCHED = "error is null and anchored and (not rec_anchored or not rec_has_time or (block_height is not null and rec_block is null))"


def _closed_events(spark, sf):
    return fx.coord_events(spark, sf).withColumn("status", F.when(F.col("manualCompletion"), "open").otherwise("complete"))


@query("s07_pair_proofs", W("pf") + "select event_id, base, 'proof ' || base as proof, sequence from pf")
def s07(spark, sf):
    results, _ = fx.proofs(spark, sf)
    lg = fx.ledger(spark, sf).select("event_id", LG.commit_base(F.col("kind"), F.col("sequence")).alias("base"), "sequence")
    return LG.pair_proofs(results.select("event_id", "base", F.concat(F.lit("proof "), "base").alias("proof")), lg)


@query("a07_anchor_rollup", PROOFS + f""", r as (select event_id, count(*) as checked, count(*) filter (where error is null and anchored and changed) as newly_anchored, count(*) filter (where error is null and not anchored and pending) as pending_after,
 count(*) filter (where error is null and anchored) as n_anchored, count(*) filter (where {_PATCHED}) as patched from pf group by event_id)
select coord_id as event_id, coalesce(checked, 0) as checked, coalesce(newly_anchored, 0) as newly_anchored, coalesce(pending_after, 0) as pending_after, coalesce(n_anchored, 0) as n_anchored, coalesce(patched, 0) as patched,
 not manual_completion and coalesce(newly_anchored, 0) > 0 and coalesce(pending_after, 0) = 0 as notified from fb left join r on r.event_id = fb.coord_id""")
def a07(spark, sf):
    results, records = fx.proofs(spark, sf)
    out = A.anchor_rollup(results, records, _closed_events(spark, sf), _now())
    return out.select("event_id", "checked", "newly_anchored", "pending_after", "n_anchored", "patched", "notified")


@query("a07_anchor_totals", PROOFS + f"select (select count(*) from fb) as events, count(*) as checked, count(*) filter (where error is null and anchored and changed) as anchored, count(*) filter (where error is null and not anchored and pending) as pending, count(*) filter (where {_PATCHED}) as patched from pf")
def a07_totals(spark, sf):
    results, records = fx.proofs(spark, sf)
    return A.anchor_totals(A.anchor_rollup(results, records, _closed_events(spark, sf), _now())).drop("notified")


@query("a12_first_block_height", PROOFS + "select event_id, min_by(block_height, base) as block_height from pf where error is null and anchored and block_height is not null group by event_id")
def a12(spark, sf):
    results, records = fx.proofs(spark, sf)
    return A.anchor_rollup(results, records, _closed_events(spark, sf), _now()).select("event_id", "block_height").filter("block_height is not null")


@query("m12_anchor_apply", W("pf") + """select event_id, base, rec_anchored or (error is null and anchored) as ots_anchored, case when rec_has_time then '2024-01-01T00:00:00.000Z' when error is null and anchored then '2024-02-10T12:00:00.000Z' end as ots_anchored_at,
 coalesce(rec_block, case when error is null and anchored then block_height end) as ots_block from pf""")
def m12(spark, sf):
    results, records = fx.proofs(spark, sf)
    return A.anchor_apply(results, records, _now()).withColumn("ots_anchored_at", fn.iso_millis("ots_anchored_at"))


@query("j14_proof_patches", W("pf") + f"select event_id, base from pf where {_PATCHED}")
def j14(spark, sf):
    results, records = fx.proofs(spark, sf)
    return A.anchor_patches(results, records, _now()).select("event_id", "base")


@query("c08_upgrade_proofs", PROOFS + """, r as (select event_id, count(*) filter (where error is null and anchored and changed) as newly, count(*) filter (where error is null and not anchored and pending) as pend, min_by(case when error is null and anchored then block_height end, case when error is null and anchored and block_height is not null then base end) as h from pf group by event_id)
select event_id, case when type = 'crypto' then 'attest+' else 'event+' end || event_id || '@app.example' as reply_address, 'Proof anchored: ' || case when k % 5 <> 0 then 'Plan ' || k else event_id end as subject,
 'The Bitcoin attestation for "' || case when k % 5 <> 0 then 'Plan ' || k else event_id end || '" has been folded into the ledger' || coalesce(' (block ' || h || ')', '') || '.' || chr(10) || chr(10) || 'Each commit''s proof is now offline-verifiable.' as body
 from r join fb on fb.coord_id = r.event_id where not manual_completion and newly > 0 and pend = 0""")
def c08(spark, sf):
    from countersign.operators.notify import compose

    results, records = fx.proofs(spark, sf)
    rollup = A.anchor_rollup(results, records, _closed_events(spark, sf), _now())
    return compose(A.anchor_notices(rollup, _now()), fx.DOMAIN).select("event_id", "reply_address", "subject", "body")


# --- state at rest ---------------------------------------------------------------------------


@query("s10_sync_mirror", W("fb") + "select coord_id as event_id from fb where k % 4 = 1 or k % 10 = 3")
def s10(spark, sf):
    """A quarter of the mirror is stale and a tenth is missing; the rest needs no write."""
    state = fx.coord_events(spark, sf)
    k = F.substring("id", 2, 9).cast("int")
    stale = state.withColumn("title", F.when(k % 4 == 1, F.lit("old title")).otherwise(F.col("title"))).filter(k % 10 != 3)
    return L.latest_state_rows(state, tables.mirror_digests(stale)).select(F.col("id").alias("event_id"))


@query("a11_first_proof_message_id", LEDGER + "select event_id, min_by('<p' || sequence || '@app.example>', sequence) as proof_email_message_id from lg where mail_id % 3 <> 0 group by event_id")
def a11(spark, sf):
    lg = fx.ledger(spark, sf)
    log = lg.select(
        "event_id", F.col("received_at").alias("at"),
        F.when(F.col("mail_id") % 3 != 0, F.concat(F.lit("<p"), F.col("sequence").cast("string"), F.lit("@app.example>"))).alias("message_id"),
    )
    return L.first_proof_message(log)
