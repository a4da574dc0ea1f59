"""Header screening and routing of inbound mail: one narrow pass over the raw bytes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions import addresses, headers
from countersign.functions.hashing import hash_document
from countersign.functions.trust import classify_trust, pick_signature_to_archive, summarise_auth
from countersign.session import evaluated_once

ENVELOPE_FIELDS = ("sender", "recipient", "client_ip", "client_helo")
TAG_COLUMNS = ("tag_kind", "tag_event_id", "tag_step_id", "tag_sequence")

# fixed values: screening lists
LIST_HEADERS = ("List-Id", "List-Post", "List-Unsubscribe")
BULK_PRECEDENCE = ("bulk", "list", "junk")
SYSTEM_LOCAL_PARTS = ("noreply", "no-reply", "mailer-daemon", "postmaster", "bounces")


def normalise_envelope(envelope: Column | str) -> Column:
    """S2. Empty and `unknown` envelope fields become NULL."""
    e = headers._col(envelope)
    return F.struct(*[F.nullif(F.nullif(e[n], F.lit("")), F.lit("unknown")).alias(n) for n in ENVELOPE_FIELDS])


def from_address(block: Column | str) -> Column:
    """Address of the From header: the first bracketed one, else the first bare one.

    Quoted display names and comments go first: an address inside them is text that the sender chose.
    """
    return address_in(headers.raw_header(block, "From"))


def address_in(header: Column) -> Column:
    """The address that a From header names."""
    value = F.regexp_replace(header, r'"(?:[^"\\]|\\.)*"|\([^()]*\)', " ")
    return F.coalesce(
        headers._group(value, r"<\s*([^<>\s]+@[^<>\s]+)\s*>"), headers._group(value, r"([^\s<>,;\"]+@[^\s<>,;\"]+)")
    )


def prefilter(block: Column | str, sender: Column | str) -> Column:
    """F2. `(rejected, reason)` for machine mail; the first rule that applies names the reason."""
    return _screening(_screened_headers(headers._col(block)), headers._col(sender))


def _screened_headers(block: Column, lowered: Column | None = None) -> dict[str, Column]:
    listed = F.coalesce(*[headers.raw_header(block, name, lowered) for name in LIST_HEADERS], F.lit(""))
    return {
        "auto_submitted": headers.raw_header(block, "Auto-Submitted", lowered),
        "precedence": F.lower(headers.raw_header(block, "Precedence", lowered)),
        "listed": listed != "",
    }


def _screening(h: dict[str, Column], sender: Column) -> Column:
    auto, precedence = h["auto_submitted"], h["precedence"]
    address = F.lower(F.coalesce(sender, F.lit("")))
    reason = (
        F.when((auto != "") & (F.lower(auto) != "no"), F.concat(F.lit("auto-submitted: "), auto))
        .when(h["listed"], F.lit("mailing list headers present"))
        .when(precedence.isin(*BULK_PRECEDENCE), F.concat(F.lit("precedence: "), precedence))
        .when(
            F.substring_index(address, "@", 1).isin(*SYSTEM_LOCAL_PARTS),
            F.concat(F.lit("system sender: "), address),
        )
    )
    return F.struct(reason.isNotNull().alias("rejected"), reason.alias("reason"))


def screen(mail: DataFrame) -> DataFrame:
    """Everything later stages want from `raw` and the envelope, computed where they are read."""
    e = normalise_envelope("envelope")
    df = evaluated_once(
        mail, _block=headers.header_block("raw"), **{f"_env_{n}": e[n] for n in ENVELOPE_FIELDS}
    )
    df = evaluated_once(df, _lowered=F.lower("_block"))
    block, lowered = F.col("_block"), F.col("_lowered")
    df = evaluated_once(
        df,
        _from=headers.raw_header(block, "From", lowered),
        is_bounce=headers.is_delivery_status_report(block, lowered),
        message_id=headers.raw_header(block, "Message-ID", lowered),
        raw_size=F.octet_length("raw").cast("bigint"),
        **_screened_headers(block, lowered),
    ).drop("_block", "_lowered")
    df = evaluated_once(df, from_address=address_in(F.col("_from"))).drop("_from")
    read = {name: F.col(name) for name in ("auto_submitted", "precedence", "listed")}
    df = evaluated_once(
        df,
        reject_reason=_screening(read, F.col("from_address"))["reason"],
        sender=addresses.resolve_sender("_env_sender", "from_address"),
    ).drop("envelope", *read)
    # Only mail that goes on is hashed.
    return df.withColumn("raw_sha256", F.when(F.col("reject_reason").isNull() | F.col("is_bounce"), hash_document("raw")))


def _rebuilt_envelope() -> Column:
    return F.struct(*[F.col(f"_env_{n}").alias(n) for n in ENVELOPE_FIELDS])


def route(mail: DataFrame, keep_raw: bool = False) -> DataFrame:
    """R1. One row per message with its route and the tag's parts; `raw` only on request.

    Order: bounce, machine mail, initiator command, verify, reverify, event, attest, no tag.
    """
    df = with_tag(screen(mail), F.col("_env_recipient"))
    bounce, rejected = F.col("is_bounce"), F.col("reject_reason").isNotNull()
    kind = F.coalesce("tag_kind", F.lit("no_event_tag"))
    is_reply_tag = kind.isin("event", "attest")
    usable = F.when(bounce, is_reply_tag).otherwise(~rejected)
    out = df.withColumns(
        {
            "route": F.when(bounce, "bounce").when(rejected, "rejected").otherwise(kind),
            "event_id": F.when(usable, F.col("tag_event_id")),
            "step_id": F.when(usable, F.col("tag_step_id")),
            "commit_sequence": F.when(usable, F.col("tag_sequence")),
            "mode": F.when(
                is_reply_tag & ~bounce & ~rejected,
                F.when(kind == "event", F.lit("workflow")).otherwise(F.lit("crypto")),
            ),
            "reason": F.when(bounce, F.when(~is_reply_tag, F.lit("no_event_tag"))).otherwise(
                F.coalesce("reject_reason", F.when(F.col("tag_kind").isNull(), F.lit("no_event_tag")))
            ),
            "envelope": _rebuilt_envelope(),
        }
    ).drop(*TAG_COLUMNS, *[f"_env_{n}" for n in ENVELOPE_FIELDS], "is_bounce", "reject_reason")
    return out if keep_raw else out.drop("raw")


def any_tag(recipient: Column) -> dict[str, Column]:
    """The one tag an address can carry, as four columns that are NULL without a valid tag.

    A tag's kind is the address's kind, so one grammar applies at most.
    """
    kind, ext = _kind_and_extension(headers._strip(recipient))
    sequence = _named_sequence(kind, ext)
    return _tag(kind, ext, sequence, _named_event(kind, ext, sequence))


def with_tag(df: DataFrame, recipient: Column) -> DataFrame:
    """`any_tag` as columns of `df`: each of its expressions is computed once a row, though the next ones read it several times."""
    df = evaluated_once(df, _address=headers._strip(recipient))
    kind, ext = _kind_and_extension(F.col("_address"))
    df = evaluated_once(df, _kind=kind, _ext=ext)
    kind, ext = F.col("_kind"), F.col("_ext")
    df = evaluated_once(df, _sequence=_named_sequence(kind, ext))
    sequence = F.col("_sequence")
    df = evaluated_once(df, _event_id=_named_event(kind, ext, sequence))
    tag = _tag(kind, ext, sequence, F.col("_event_id"))
    return evaluated_once(df, **tag).drop("_address", "_kind", "_ext", "_sequence", "_event_id")


def _kind_and_extension(address: Column) -> tuple[Column, Column]:
    return F.lower(headers._group(address, addresses.ADDRESS, 1)), headers._group(address, addresses.ADDRESS, 2)


def _named_sequence(kind: Column, ext: Column) -> Column:
    found = headers._group(ext, r"^[a-zA-Z0-9]+-(\d+)$").try_cast("bigint")
    return F.when((kind == "reverify") & (found > 0), found)


def _named_event(kind: Column, ext: Column, sequence: Column) -> Column:
    plain = kind.isin(*addresses.INITIATOR_COMMANDS, "verify", "attest")
    return (
        F.when(plain, headers._group(ext, r"^([a-zA-Z0-9]+)$"))
        .when(kind == "event", headers._group(ext, r"^([a-zA-Z0-9]+)(?:-.*)?$"))
        .when(sequence.isNotNull(), headers._group(ext, r"^([a-zA-Z0-9]+)-\d+$"))
    )


def _tag(kind: Column, ext: Column, sequence: Column, event_id: Column) -> dict[str, Column]:
    step_id = F.when((kind == "event") & event_id.isNotNull() & ext.contains("-"), F.regexp_extract(ext, r"^[a-zA-Z0-9]+-(.*)$", 1))
    return dict(zip(TAG_COLUMNS, (F.when(event_id.isNotNull(), kind), event_id, step_id, sequence)))


def route_bounces(mail: DataFrame) -> DataFrame:
    """R2. Delivery reports alone, by the event or attest tag they came back to; keeps `raw`.

    The cheap test comes first, so no other header of other mail is looked at.
    """
    df = mail.filter(headers.is_delivery_status_report(headers.header_block("raw")))
    df = with_tag(df, normalise_envelope("envelope")["recipient"])
    event_id = F.when(F.col("tag_kind").isin("event", "attest"), F.col("tag_event_id"))
    return df.withColumns(
        {
            "event_id": event_id,
            "step_id": F.col("tag_step_id"),
            "reason": F.when(event_id.isNull(), F.lit("no_event_tag")),
        }
    ).drop(*TAG_COLUMNS)


def known_events(routed: DataFrame, events: DataFrame) -> DataFrame:
    """J1/R2. Mail that names an event nobody has gets `reason = unknown_event`.

    Mail without an event is spread by its own id over the join's partitions; no event has such a key.
    """
    ids = events.select(F.col("id").alias("_key"), F.lit(True).alias("known"))
    key = F.coalesce("event_id", F.concat(F.lit("#"), F.col("mail_id").cast("string")))
    df = routed.withColumn("_key", key).join(ids, "_key", "left").drop("_key")
    unknown = F.col("event_id").isNotNull() & F.col("known").isNull()
    return df.withColumn("reason", F.when(unknown, F.lit("unknown_event")).otherwise(F.col("reason"))).withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def graded(routed: DataFrame) -> DataFrame:
    """Trust level, the verdict summary the ledger keeps, and the signature whose key to archive."""
    return routed.withColumns(
        {
            "trust_level": classify_trust("auth"),
            "auth_summary": summarise_auth("auth"),
            "archive_signature": pick_signature_to_archive("auth"),
        }
    ).drop("auth")


def dispatch_results(*branches: DataFrame) -> DataFrame:
    """R3/O3. One result shape for all branches; a column a branch lacks is NULL."""
    out = branches[0]
    for other in branches[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
