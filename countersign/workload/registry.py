"""Registered queries: a Spark callable and, where SQL can say it, the same result as SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL fragments the reference texts share -------------------------------------------------

def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def header(name: str, block: str = "block") -> str:
    pattern = rf"(?im)^{name}\s*:\s*([^\r\n]+(?:\r?\n[ \t][^\r\n]+)*)"
    return rf"trim(regexp_replace(nullif(regexp_extract({block}, '{pattern}', 1), ''), '\r?\n[ \t]+', ' ', 'g'))"


# `h`: messages with their header block and the fields routing reads.
HEADERS = rf""", hb as (select *, case when strpos(raw, chr(13)||chr(10)||chr(13)||chr(10)) > 1
  then substr(raw, 1, strpos(raw, chr(13)||chr(10)||chr(13)||chr(10)) - 1) else raw end as block,
  nullif(nullif(recipient, ''), 'unknown') as rcpt, nullif(nullif(sender, ''), 'unknown') as env_sender from fc),
h1 as (select *, {header('From')} as from_address, {header('Auto-Submitted')} as auto_submitted, lower({header('Precedence')}) as precedence,
  {header('Message-ID')} as message_id,
  coalesce({header('List-Id')}, '') <> '' or coalesce({header('List-Post')}, '') <> '' or coalesce({header('List-Unsubscribe')}, '') <> '' as listed,
  nullif(trim(regexp_extract(regexp_replace(block, '\r?\n[ \t]+', ' ', 'g'), '(?im)^content-type:[ \t]*([^\r\n]+)', 1)), '') as content_type,
  regexp_matches(trim(coalesce(rcpt, '')), '(?i)^([a-z][a-z0-9]*)\+([^@\s]+)@([^\s@]+)$') as is_tag,
  lower(regexp_extract(trim(rcpt), '(?i)^([a-z][a-z0-9]*)\+([^@\s]+)@([^\s@]+)$', 1)) as kind,
  regexp_extract(trim(rcpt), '(?i)^([a-z][a-z0-9]*)\+([^@\s]+)@([^\s@]+)$', 2) as ext,
  lower(regexp_extract(trim(rcpt), '(?i)^([a-z][a-z0-9]*)\+([^@\s]+)@([^\s@]+)$', 3)) as dom from hb),
h as (select *, lower(coalesce(env_sender, from_address, '')) as who,
  regexp_matches(coalesce(content_type, ''), '(?i)multipart/report') and regexp_matches(coalesce(content_type, ''), '(?i)report-type\s*=\s*"?delivery-status"?') as is_dsn,
  case when auto_submitted <> '' and lower(auto_submitted) <> 'no' then 'auto-submitted: ' || auto_submitted
   when listed then 'mailing list headers present'
   when precedence in ('bulk', 'list', 'junk') then 'precedence: ' || precedence
   when split_part(lower(coalesce(from_address, '')), '@', 1) in ('noreply', 'no-reply', 'mailer-daemon', 'postmaster', 'bounces') then 'system sender: ' || lower(from_address) end as reject_reason,
  case when kind = 'event' and regexp_matches(split_part(ext, '-', 1), '^[a-zA-Z0-9]+$') then split_part(ext, '-', 1) end as ev_id,
  case when kind = 'event' and regexp_matches(split_part(ext, '-', 1), '^[a-zA-Z0-9]+$') and strpos(ext, '-') > 0 then substr(ext, strpos(ext, '-') + 1) end as ev_step,
  case when kind = 'attest' and regexp_matches(ext, '^[a-zA-Z0-9]+$') then ext end as at_id,
  case when kind = 'verify' and regexp_matches(ext, '^[a-zA-Z0-9]+$') then ext end as vf_id,
  case when kind in ('stats', 'remind') and regexp_matches(ext, '^[a-zA-Z0-9]+$') then ext end as cmd_id,
  case when kind = 'reverify' and regexp_matches(ext, '^([a-zA-Z0-9]+)-(\d+)$') and try_cast(regexp_extract(ext, '^([a-zA-Z0-9]+)-(\d+)$', 2) as bigint) >= 1
   then regexp_extract(ext, '^([a-zA-Z0-9]+)-(\d+)$', 1) end as rv_id,
  try_cast(nullif(regexp_extract(ext, '^([a-zA-Z0-9]+)-(\d+)$', 2), '') as bigint) as rv_seq from h1),
rt as (select *, case when is_dsn then 'bounce' when reject_reason is not null then 'rejected' when cmd_id is not null then kind when vf_id is not null then 'verify'
  when rv_id is not null then 'reverify' when ev_id is not null then 'event' when at_id is not null then 'attest' else 'no_event_tag' end as route from h),
routed as (select *, case when route in ('bounce', 'event', 'attest') then coalesce(ev_id, at_id) when route in ('stats', 'remind') then cmd_id when route = 'verify' then vf_id when route = 'reverify' then rv_id end as event_id,
  case when route in ('bounce', 'event') then nullif(ev_step, '') end as route_step, case when route = 'reverify' then rv_seq end as commit_seq,
  case when route = 'rejected' then reject_reason when route = 'no_event_tag' or (route = 'bounce' and coalesce(ev_id, at_id) is null) then 'no_event_tag' end as reason from rt)
"""

# `sd`: decided sign-off replies of `fa`; `lk`: the sequence at which an event locks.
SIGNOFF = """, so as (select a.mail_id, a.received_at, a.coord_id, a.k, a.sender, a.trust, b.threshold, b.manual_completion, b.activated, b.archived,
  row_number() over (partition by a.coord_id order by a.received_at, a.mail_id) as seq,
  case when a.sender = '' then null else 'sha256:' || sha256('salt-' || a.coord_id || '|' || lower(a.sender)) end as sender_hash,
  case when a.sender = '' then null else split_part(a.sender, '@', 2) end as sender_domain,
  b.open or a.sender in (select 'u' || i || '@d' || (b.k % 3) || '.example' from range(1, 6) r(i)) as signer_match,
  a.sender = b.initiator as is_initiator, not b.needs_doc or a.doc_ok as doc_match
  from fa a join fb b on a.coord_id = b.coord_id where a.k % 2 = 0),
so2 as (select *, activated and not archived and trust = 'verified' and not is_initiator and signer_match and doc_match as elig from so),
so3 as (select *, case when not elig then case when sender_hash is not null then min(case when elig then seq end) over (partition by coord_id, sender_hash) end
  when sender_hash is null then seq else min(case when elig then seq end) over (partition by coord_id, sender_hash) end as first_seq from so2),
so4 as (select *, sum(case when elig and seq = first_seq then 1 else 0 end) over (partition by coord_id order by seq) as n from so3),
lk as (select coord_id, min(seq) as lock_seq from so4 where n >= threshold and not manual_completion group by coord_id),
sd as (select so4.*, lk.lock_seq, case when not activated then 'event_not_activated' when archived then 'event_archived' when seq > lk.lock_seq then 'already_complete'
  when trust <> 'verified' then 'unverified_trust' when is_initiator then 'initiator_self_reply' when not signer_match then 'not_a_signer'
  when first_seq < seq then 'already_signed' when not doc_match then 'doc_hash_mismatch' end as count_reason from so4 left join lk on so4.coord_id = lk.coord_id)
"""

# `wd`: decided workflow replies of `fa`; `cs`: the sequence at which each step completes.
_ROUND = """, a{n} as (select d.coord_id, d.step_id, max(c.c) as after_seq, count(*) as n from fd d join c{p} c on c.coord_id = d.coord_id and c.step_id = d.dep group by d.coord_id, d.step_id),
c{n} as (select coord_id, step_id, c from c0 union all select e.coord_id, e.step_id, min(e.seq) as c from we e join a{n} a on a.coord_id = e.coord_id and a.step_id = e.step_id
  join nd on nd.coord_id = e.coord_id and nd.step_id = e.step_id and nd.n = a.n where e.seq > a.after_seq group by e.coord_id, e.step_id)"""
WORKFLOW = (
    """, wf as (select a.mail_id, a.received_at, a.coord_id, a.k, a.sender, a.step_id, a.trust, a.has_attachment, b.flow, b.manual_completion, b.activated, b.archived,
  row_number() over (partition by a.coord_id order by a.received_at, a.mail_id) as seq, lower(trim(a.sender)) = s.participant as pm,
  case a.trust when 'verified' then 0 when 'forwarded' then 1 when 'authorized' then 2 else 3 end <= s.min_rank as trust_ok,
  not s.requires_attachment or a.has_attachment as att_ok
  from fa a join fb b on a.coord_id = b.coord_id join fs s on s.coord_id = a.coord_id and s.step_id = a.step_id where a.k % 2 = 1),
we as (select coord_id, step_id, seq from wf where activated and not archived and pm and trust_ok and att_ok),
nd as (select s.coord_id, s.step_id, count(d.dep) as n from fs s left join fd d on d.coord_id = s.coord_id and d.step_id = s.step_id group by s.coord_id, s.step_id),
c0 as (select e.coord_id, e.step_id, min(e.seq) as c from we e join nd on nd.coord_id = e.coord_id and nd.step_id = e.step_id where nd.n = 0 group by e.coord_id, e.step_id)"""
    + "".join(_ROUND.format(n=i, p=i - 1) for i in (1, 2, 3))
    + """, cs as (select * from c3),
dn as (select s.coord_id, max(cs.c) as done_seq from fs s join fb b on b.coord_id = s.coord_id left join cs on cs.coord_id = s.coord_id and cs.step_id = s.step_id
  where not b.manual_completion group by s.coord_id having count(cs.c) = count(*)),
af as (select nd.coord_id, nd.step_id, case when nd.n = 0 then 0 when count(cs.c) = nd.n then max(cs.c) end as after_seq from nd
  left join fd d on d.coord_id = nd.coord_id and d.step_id = nd.step_id left join cs on cs.coord_id = d.coord_id and cs.step_id = d.dep group by nd.coord_id, nd.step_id, nd.n),
wd as (select wf.*, cs.c as done_at, dn.done_seq, case when not activated then 'event_not_activated' when archived then 'event_archived' when seq > dn.done_seq then 'already_complete'
  when not pm then 'wrong_participant' when seq > cs.c then 'already_complete' when not trust_ok then 'unverified_trust'
  when af.after_seq is null or af.after_seq >= seq then case when flow = 'sequential' then 'out_of_order' else 'deps_unmet' end
  when not att_ok then 'missing_attachment' end as count_reason from wf
  left join cs on cs.coord_id = wf.coord_id and cs.step_id = wf.step_id left join dn on dn.coord_id = wf.coord_id left join af on af.coord_id = wf.coord_id and af.step_id = wf.step_id)
"""
)
