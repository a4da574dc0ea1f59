"""Explicit table schemas. Field names of `COORD_EVENTS` follow the JSON event record."""
from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, B, I, L, TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.TimestampType()

ENVELOPE = _struct(sender=S, recipient=S, client_ip=S, client_helo=S)

AUTH = _struct(
    dkim=_struct(
        results=T.ArrayType(
            _struct(
                status=_struct(result=S, comment=S, aligned=S),
                signingDomain=S,
                selector=S,
                algo=S,
                info=S,
            )
        )
    ),
    spf=_struct(status=_struct(result=S)),
    dmarc=_struct(status=_struct(result=S)),
    arc=_struct(status=_struct(result=S, comment=S), i=I),
)

ATTACHMENT = _struct(filename=S, size=L, sha256=S)

# One row per message as delivered.
MAIL = _struct(mail_id=S, received_at=TS, raw=T.BinaryType(), envelope=ENVELOPE, auth=AUTH)

PARSED_MAIL = _struct(
    mail_id=S,
    from_address=S,
    from_name=S,
    message_id=S,
    attachments=T.ArrayType(ATTACHMENT),
    raw_sha256=S,
    raw_size=L,
)

STEP = _struct(
    id=S,
    name=S,
    participant=S,
    deadline=S,
    requires_attachment=B,
    details=S,
    status=S,
    commit_sequence=L,
    dependsOn=T.ArrayType(S),
    minTrust=S,
    completed_at=S,
    last_send_error=_struct(reason=S, code=S, at=S),
)

# One row per coordination event. `extra` keeps unknown caller fields as a JSON string.
COORD_EVENTS = _struct(
    id=S,
    type=S,
    title=S,
    initiator=S,
    salt=S,
    status=S,
    created_at=TS,
    activated_at=TS,
    completed_at=TS,
    archived_at=TS,
    archive_reason=S,
    flow=S,
    steps=T.ArrayType(STEP),
    signers=T.ArrayType(S),
    open=B,
    threshold=I,
    manualCompletion=B,
    requiredDocHash=S,
    reopened_at=TS,
    reopened_reason=S,
    nudged_overdue_at=TS,
    proof_email_message_id=S,
    ots_proof_anchored_notified_at=TS,
    extra=S,
)

# Signatures are their own table: an open petition has no useful bound on signers per event.
SIGNATURES = _struct(
    event_id=S, sender_hash=S, sender_domain=S, commit_sequence=L, received_at=TS, trust_level=S
)

# One row per numbered ledger entry; fields a kind does not use are null.
LEDGER = _struct(
    schema_version=I,
    kind=S,
    event_id=S,
    step_id=S,
    sequence=L,
    received_at=TS,
    sender_hash=S,
    sender_domain=S,
    message_id_hash=S,
    trust_level=S,
    participant_match=B,
    counted=B,
    count_reason=S,
    attachments=T.ArrayType(ATTACHMENT),
    dkim=_struct(
        result=S,
        signatures=T.ArrayType(
            _struct(result=S, comment=S, domain=S, selector=S, aligned=S, algorithm=S, info=S)
        ),
    ),
    spf=_struct(result=S),
    dmarc=_struct(result=S),
    arc=_struct(result=S, comment=S, chain_length=I),
    envelope=_struct(client_ip=S, client_helo=S),
    raw_sha256=S,
    raw_size=L,
    dkim_key_file=S,
    ots_proof_file=S,
    # What an organiser's call changed: participants and signers as salted hashes only.
    change=_struct(
        reason=S,
        organiser=S,
        changes=T.ArrayType(_struct(step_id=S, field=S, old=S, new=S)),
        retracted=T.ArrayType(S),
    ),
)

COMPLETIONS = _struct(
    event_id=S, event_type=S, completed_at=TS, triggering_commit_sequence=L, steps_completed=I, threshold=I, signatures=L, summary=S
)

# Where an event's ledger ends, and the peaks of its digest.
PEAK = _struct(height=I, index=L, digest=S)
HEADS = _struct(event_id=S, last=L, reverify_last=L, receipts=L, peaks=T.ArrayType(PEAK))

# Organiser calls: activate / edit / complete / reopen, with the call's arguments as typed fields.
STEP_PATCH = _struct(
    id=S, participant=S, deadline=S, requires_attachment=B, details=S, fields=T.ArrayType(S)
)
ACTIONS = _struct(
    action_id=S,
    event_id=S,
    at=TS,
    action=S,
    reason=S,
    title=S,
    steps=T.ArrayType(STEP_PATCH),
    retract=T.ArrayType(S),
    completed_at=TS,
    organiser=S,
)

OUTBOX = _struct(
    event_id=S, cause=S, kind=S, to=S, reply_address=S, subject=S, body=S, raw=S
)
