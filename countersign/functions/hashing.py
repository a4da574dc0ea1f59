"""Fingerprints and canonical renderings. All hashes read `sha256:` + lower-case hex."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countersign.functions.headers import _col, _strip


def _sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def hash_document(content: Column | str) -> Column:
    """P13."""
    return _sha(_col(content).cast("binary"))


def norm_hash(h: Column | str) -> Column:
    """P14."""
    return F.coalesce(F.lower(F.regexp_replace(_col(h), "(?i)^sha256:", "")), F.lit(""))


def _salted(text: Column, salt: Column) -> Column:
    return _sha(F.concat(F.coalesce(salt, F.lit("")), F.lit("|"), text))


def salted_sender_hash(sender: Column | str, salt: Column | str) -> Column:
    """P15. NULL for an empty sender."""
    s = _col(sender)
    return F.when(s != "", _salted(F.lower(s), _col(salt)))


def normalise_message_id(message_id: Column | str) -> Column:
    """P16."""
    return F.lower(F.regexp_replace(_strip(_col(message_id)), "^<|>$", ""))


def salted_message_id_hash(message_id: Column | str, salt: Column | str) -> Column:
    """P17."""
    n = normalise_message_id(message_id)
    return F.when(n != "", _salted(n, _col(salt)))


def pad_seq(n: Column | str) -> Column:
    """P33. At least three digits, never truncated."""
    return F.format_string("%03d", _col(n).cast("bigint"))


def event_id_from_seed(*seed: Column | str) -> Column:
    """P34. Twelve base-36 characters that a rerun reproduces."""
    digest = F.sha2(F.concat_ws("|", F.lit("event-id"), *[_col(c).cast("string") for c in seed]), 256)
    # 15 hex digits fit a signed 64-bit number.
    base36 = F.lower(F.conv(F.substring(digest, 1, 15), 16, 36))
    return F.substring(F.lpad(base36, 12, "0"), 1, 12)


def salt_from_seed(*seed: Column | str) -> Column:
    """P34. 32 bytes of hex that a rerun reproduces."""
    return F.sha2(F.concat_ws("|", F.lit("event-salt"), *[_col(c).cast("string") for c in seed]), 256)


def iso_millis(ts: Column | str) -> Column:
    """`2026-01-31T09:30:00.000Z`, the text form every hash and message uses."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def canonical_json(*columns: Column | str) -> Column:
    """P39. JSON text in the given column order, nulls kept, for content hashes."""
    return F.to_json(
        F.struct(*[_col(c) for c in columns]),
        {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"},
    )
