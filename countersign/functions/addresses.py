"""Plus-tag address grammar and sender identity."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countersign.functions.headers import _col, _group, _strip

# fixed values: the grammar of tagged addresses and of event ids
ADDRESS = r"(?i)^([a-z][a-z0-9]*)\+([^@\s]+)@([^\s@]+)$"
_EVENT_ID = r"^[a-zA-Z0-9]+$"

# fixed values: the two commands an initiator may mail in
INITIATOR_COMMANDS = ("stats", "remind")


def valid_event_id(c: Column | str) -> Column:
    """F6."""
    return F.coalesce(_col(c).rlike(_EVENT_ID), F.lit(False))


def parse_address(recipient: Column | str) -> Column:
    """P4. `kind+extension@domain` as a struct, NULL for anything else."""
    text = _strip(_col(recipient))
    return F.when(
        text.rlike(ADDRESS),
        F.struct(
            F.lower(F.regexp_extract(text, ADDRESS, 1)).alias("kind"),
            F.regexp_extract(text, ADDRESS, 2).alias("extension"),
            F.lower(F.regexp_extract(text, ADDRESS, 3)).alias("domain"),
        ),
    )


def _address(recipient: Column | str | None, address: Column | None) -> Column:
    """Tags take a recipient, or the struct `parse_address` already made of it."""
    return parse_address(recipient) if address is None else address


def _plain_tag(recipient: Column | str | None, kind: str, address: Column | None) -> Column:
    addr = _address(recipient, address)
    ok = (addr["kind"] == kind) & addr["extension"].rlike(_EVENT_ID)
    return F.when(ok, F.struct(addr["extension"].alias("event_id")))


def event_tag(recipient: Column | str | None = None, address: Column | None = None) -> Column:
    """P5. Everything behind the first dash names the step."""
    addr = _address(recipient, address)
    ext = addr["extension"]
    event_id = F.substring_index(ext, "-", 1)
    dash = F.instr(ext, "-")
    step_id = F.when(dash > 0, F.substr(ext, dash + 1))
    return F.when(
        (addr["kind"] == "event") & event_id.rlike(_EVENT_ID),
        F.struct(event_id.alias("event_id"), step_id.alias("step_id")),
    )


def attest_tag(recipient: Column | str | None = None, address: Column | None = None) -> Column:
    """P6."""
    return _plain_tag(recipient, "attest", address)


def verify_tag(recipient: Column | str | None = None, address: Column | None = None) -> Column:
    """P7."""
    return _plain_tag(recipient, "verify", address)


def reverify_tag(recipient: Column | str | None = None, address: Column | None = None) -> Column:
    """P8. The digits behind the last dash are the entry under review: any positive number."""
    addr = _address(recipient, address)
    shape = r"^([a-zA-Z0-9]+)-(\d+)$"
    seq = _group(addr["extension"], shape, 2).try_cast("bigint")
    return F.when(
        (addr["kind"] == "reverify") & (seq > 0),
        F.struct(
            F.regexp_extract(addr["extension"], shape, 1).alias("event_id"),
            seq.alias("commit_sequence"),
        ),
    )


def initiator_command(recipient: Column | str | None = None, address: Column | None = None) -> Column:
    """P9."""
    addr = _address(recipient, address)
    ok = addr["kind"].isin(*INITIATOR_COMMANDS) & addr["extension"].rlike(_EVENT_ID)
    return F.when(
        ok, F.struct(addr["kind"].alias("command"), addr["extension"].alias("event_id"))
    )


def normalise_email(address: Column | str) -> Column:
    """P10."""
    return F.lower(_strip(F.coalesce(_col(address), F.lit(""))))


def resolve_sender(envelope_sender: Column | str, from_address: Column | str) -> Column:
    """P11. Envelope sender first, then From; case-folded but not trimmed."""
    return F.lower(
        F.coalesce(
            F.nullif(_col(envelope_sender), F.lit("")),
            F.nullif(_col(from_address), F.lit("")),
            F.lit(""),
        )
    )


def sender_domain(sender: Column | str) -> Column:
    """P12. The text between the first and second `@`."""
    return F.try_element_at(F.split(_col(sender), "@"), F.lit(2))


def sender_matches(sender: Column | str, participant: Column | str) -> Column:
    """Step participant check: false when the step names nobody."""
    named = F.coalesce(_col(participant), F.lit("")) != ""
    return named & (normalise_email(sender) == normalise_email(participant))
