"""Outbound message text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countersign.functions.headers import _col

CRLF = "\r\n"


def sanitize_subject(subject: Column | str) -> Column:
    """P26. No line break can end the Subject header early."""
    return F.regexp_replace(F.coalesce(_col(subject), F.lit("")), r"[\r\n]+", " ")


def with_signature(body: Column | str, footer: Column | str) -> Column:
    """P27. Append the `-- ` footer once; no footer leaves the body alone."""
    b, f = _col(body), _col(footer)
    sig = F.concat(F.lit("-- \n"), f)
    return (
        F.when(F.coalesce(f, F.lit("")) == "", b)
        .when(b.endswith(sig), b)
        .otherwise(F.concat(b, F.lit("\n\n"), sig))
    )


def rfc5322_date(ts: Column | str) -> Column:
    """P29."""
    return F.date_format(_col(ts), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def new_message_id(domain: Column | str, at: Column | str, *cause: Column | str) -> Column:
    """P29. `<millis.token@domain>`; the token comes from the cause, so a retry repeats it."""
    token = F.substring(F.sha2(F.concat_ws("|", *[_col(c).cast("string") for c in cause]), 256), 1, 16)
    return F.concat(
        F.lit("<"), F.unix_millis(_col(at)).cast("string"), F.lit("."), token, F.lit("@"), _col(domain), F.lit(">")
    )


def build_raw_message(
    sender: Column,
    to: Column,
    subject: Column,
    body: Column,
    message_id: Column,
    date: Column,
    auto_submitted: Column | bool | None = None,
    reply_to: Column | None = None,
    in_reply_to: Column | None = None,
    references: Column | None = None,
    footer: Column | None = None,
    extra_headers: dict[str, Column] | None = None,
) -> Column:
    """P28. RFC-822 text with CRLF line ends; a NULL optional header is left out.

    NULL when from, to, subject or body is missing. `auto_submitted=False` drops that header.
    """

    def header(name: str, value: Column | None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))

    auto = None
    if auto_submitted is not False:
        given = auto_submitted if isinstance(auto_submitted, Column) else F.lit(None).cast("string")
        auto = F.coalesce(given, F.lit("auto-replied"))
    signed = with_signature(body, footer) if footer is not None else body
    wire_body = F.regexp_replace(F.regexp_replace(signed, "\r\n", "\n"), "\n", CRLF)
    extras = [header(name, value) for name, value in (extra_headers or {}).items()]
    text = F.concat_ws(
        CRLF,
        header("From", sender),
        header("To", to),
        header("Reply-To", reply_to),
        F.concat(F.lit("Subject: "), sanitize_subject(subject)),
        header("Message-Id", message_id),
        F.concat(F.lit("Date: "), rfc5322_date(date)),
        header("Auto-Submitted", auto),
        header("In-Reply-To", in_reply_to),
        header("References", references),
        F.lit("MIME-Version: 1.0"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: 8bit"),
        *extras,
        F.lit(""),
        wire_body,
    )
    given = [F.coalesce(c, F.lit("")) != "" for c in (sender, to, subject)]
    return F.when(given[0] & given[1] & given[2] & body.isNotNull(), text)


def reply_address(
    kind: Column,
    event_type: Column,
    event_id: Column,
    domain: Column,
    step_id: Column | None = None,
    sequence: Column | None = None,
) -> Column:
    """P32. The plus-tag a notice is sent from, so that an answer finds its event again."""
    step = F.lit(None).cast("string") if step_id is None else step_id
    seq = F.lit(None).cast("string") if sequence is None else sequence.cast("string")
    base = F.when(event_type == "crypto", F.lit("attest")).otherwise(F.lit("event"))
    tag = (
        F.when(kind == "stats", F.lit("stats"))
        .when(kind == "verify_report", F.lit("verify"))
        .when(kind == "reverify_report", F.lit("reverify"))
        .otherwise(base)
    )
    suffix = (
        F.when(kind == "reverify_report", F.concat(F.lit("-"), seq))
        .when(
            kind.isin("activation", "advance", "reassigned") & (event_type != "crypto"),
            F.concat(F.lit("-"), step),
        )
        .otherwise(F.lit(""))
    )
    return F.concat(tag, F.lit("+"), event_id, F.coalesce(suffix, F.lit("")), F.lit("@"), domain)
