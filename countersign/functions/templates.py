"""Default notice texts.

A context is a dict of columns; a name a caller leaves out reads as NULL.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from countersign.functions.headers import _col
from countersign.functions.hashing import iso_millis

# fixed values: neutral subject and body per notice kind; {name} is filled from the context
LEDGER_NOTE = "Your reply is verified and recorded in the event's tamper-evident log."
TEXTS = {
    "activation": (
        "Action needed: {title}",
        'A step is ready for you in "{title}"{step}.\n\nReply to this email to confirm your part. ' + LEDGER_NOTE,
    ),
    "activation/crypto": (
        "Signature requested: {title}",
        'Your signature is requested on "{title}".\n\nReply to this email to sign. ' + LEDGER_NOTE,
    ),
    "activation/crypto/reminder": (
        "Reminder — signature requested: {title}",
        'A reminder: your signature is still requested on "{title}".\n\nReply to this email to sign.',
    ),
    "advance": (
        "Action needed: {title}",
        'A step is now ready for you in "{title}"{step}.\n\nReply to this email to confirm your part. ' + LEDGER_NOTE,
    ),
    "step/reminder": (
        "Reminder — action needed: {title}",
        'A reminder: a step in "{title}"{step} is still waiting for you.\n\nReply to this email to confirm your part.',
    ),
    "reassigned": (
        "Action needed: {title}",
        'A step in "{title}"{step} has been assigned to you.\n\nReply to this email to confirm your part. ' + LEDGER_NOTE,
    ),
    "stats": ("Status: {title}", "{snapshot}"),
    "bounce": (
        "Delivery problem: {title}",
        'A notification for "{title}" could not be delivered{who}.{why}\n\nCheck the address, then reply to resend or update it and try again.',
    ),
    "ack": (
        "Recorded: {title}",
        'Your verified reply to "{title}" has been recorded in the event\'s tamper-evident log.{signed_so_far}\n\nNothing further is needed from you.',
    ),
    "completion": (
        "Complete: {title}",
        '"{title}" is now complete.\n\nThe full audit trail is preserved as a tamper-evident log{tally} and stays verifiable offline.',
    ),
    "archived": (
        "Archived: {title}",
        '"{title}" was automatically archived after {days} days with no activity.\n\nReply to this email to reopen it.',
    ),
    "overdue": (
        "Still pending: {title}",
        '"{title}" still has steps pending after {days} days.\n\nReply to send a reminder, or leave it to keep waiting.',
    ),
    "proof_anchored": (
        "Proof anchored: {title}",
        'The Bitcoin attestation for "{title}" has been folded into the ledger{where}.\n\nEach commit\'s proof is now offline-verifiable.',
    ),
    "verify_report/match": (
        "Verification report: {title} — match (commit {sequence})",
        'We checked the message you forwarded against the ledger for "{title}".\n\n'
        "Result: MATCH ({match_type}) at commit {sequence}.\n"
        "Counted toward the event: {counted}\n"
        "Trust level at reception: {trust}{dkim_verify}\n\n"
        "The match is against the event's tamper-evident log; the proof holds offline.",
    ),
    "verify_report/none": (
        "Verification report: {title} — no match",
        'We checked the message you forwarded against the ledger for "{title}".\n\nResult: NO MATCH — {no_match}.',
    ),
    "reverify_report/found": (
        "Re-verification report: {title} — commit {sequence}{upgraded_subject}",
        'We re-checked commit {sequence} on "{title}" against its archived DKIM key.\n\n'
        "Trust level: {trust_before} → {trust_after}{upgraded_body}{dkim_reverify}\n\n"
        "This re-verification is recorded as an immutable entry in the event's log; the original commit is never rewritten.",
    ),
    "reverify_report/missing": (
        "Re-verification report: {title} — commit {sequence} not found",
        'We could not re-verify commit {sequence} on "{title}": {missing_reason}.',
    ),
    "other": ("{title}", 'Update on "{title}".'),
}


def _fill(text: str, values: dict[str, Column]) -> Column:
    pieces = [p for p in re.split(r"(\{\w+\})", text) if p]
    return F.concat(
        *[values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in pieces]
    )


def render_default(kind: Column | str, ctx: dict[str, Column]) -> tuple[Column, Column]:
    """P30. `(subject, body)` columns for a notice of that kind.

    Context names: title, event_id, mode, reminder, step_name, snapshot, failed_recipients
    (array), diagnostic, signature_count, counted_commits, days, block_height, matched, reason,
    sequence, match_type, counted, trust_level, dkim_ok, dkim_reason, found, upgraded,
    trust_before, trust_after.
    """
    k = _col(kind)

    def get(name: str, cast: str = "string") -> Column:
        return ctx[name].cast(cast) if name in ctx else F.lit(None).cast(cast)

    def some(name: str) -> Column:
        return F.nullif(get(name), F.lit(""))

    def yes(name: str) -> Column:
        return F.coalesce(get(name, "boolean"), F.lit(False))

    none = F.lit("")
    recipients = get("failed_recipients", "array<string>")
    verdict = F.when(yes("dkim_ok"), F.lit("PASS")).otherwise(
        F.concat(F.lit("FAIL"), F.coalesce(F.concat(F.lit(" ("), some("dkim_reason"), F.lit(")")), none))
    )
    has_verdict = get("dkim_ok", "boolean").isNotNull()
    n_counted = get("counted_commits", "bigint")
    values = {
        "title": F.coalesce(some("title"), some("event_id"), F.lit("your event")),
        "step": F.coalesce(F.concat(F.lit(' — "'), some("step_name"), F.lit('"')), none),
        "snapshot": F.coalesce(get("snapshot"), none),
        "who": F.when(F.size(recipients) > 0, F.concat(F.lit(" to "), F.array_join(recipients, ", "))).otherwise(none),
        "why": F.coalesce(F.concat(F.lit("\n\nThe mail server said: "), some("diagnostic")), none),
        "signed_so_far": F.coalesce(
            F.concat(F.lit("\n\nSignatures recorded so far: "), get("signature_count"), F.lit(".")), none
        ),
        "tally": F.coalesce(
            F.concat(
                F.lit(" ("), n_counted.cast("string"), F.lit(" recorded "),
                F.when(n_counted == 1, F.lit("reply")).otherwise(F.lit("replies")), F.lit(")"),
            ),
            none,
        ),
        "days": F.coalesce(get("days"), F.lit("undefined")),
        "where": F.when(get("block_height", "bigint") > 0, F.concat(F.lit(" (block "), get("block_height"), F.lit(")"))).otherwise(none),
        "sequence": F.coalesce(get("sequence"), F.lit("undefined")),
        "match_type": F.coalesce(get("match_type"), none),
        "counted": F.when(yes("counted"), F.lit("yes")).otherwise(F.lit("no")),
        "trust": F.coalesce(some("trust_level"), F.lit("unknown")),
        "dkim_verify": F.when(
            has_verdict, F.concat(F.lit("\nDKIM re-verify (against the archived key): "), verdict)
        ).otherwise(none),
        "dkim_reverify": F.when(has_verdict, F.concat(F.lit("\nDKIM re-verify: "), verdict)).otherwise(none),
        "no_match": F.when(
            get("reason") == "no_commits", F.lit("this event has no committed replies yet")
        ).otherwise(F.lit("the forwarded message did not match any committed reply")),
        "upgraded_subject": F.when(yes("upgraded"), F.lit(" (upgraded)")).otherwise(none),
        "upgraded_body": F.when(yes("upgraded"), F.lit(" (upgraded)")).otherwise(F.lit(" (unchanged)")),
        "trust_before": F.coalesce(get("trust_before"), none),
        "trust_after": F.coalesce(get("trust_after"), none),
        "missing_reason": F.coalesce(some("reason"), F.lit("no such commit")),
    }
    crypto = F.coalesce(get("mode") == "crypto", F.lit(False))
    reminder = yes("reminder")
    variant = (
        F.when(k == "activation", F.when(crypto & reminder, "activation/crypto/reminder")
               .when(crypto, "activation/crypto").when(reminder, "step/reminder").otherwise("activation"))
        .when((k == "advance") & reminder, F.lit("step/reminder"))
        .when(k == "verify_report", F.when(yes("matched"), "verify_report/match").otherwise("verify_report/none"))
        .when(k == "reverify_report", F.when(yes("found"), "reverify_report/found").otherwise("reverify_report/missing"))
        .when(k.isin(*TEXTS), k)
        .otherwise(F.lit("other"))
    )

    def pick(part: int) -> Column:
        chain = None
        for name, texts in TEXTS.items():
            text = _fill(texts[part], values)
            chain = F.when(variant == name, text) if chain is None else chain.when(variant == name, text)
        return chain

    return pick(0), pick(1)


def stats_body(event: str = "event", signature_count: Column | None = None) -> Column:
    """P31. Plain status dump of one event struct: step checklist or signature tally."""
    e = F.col(event)

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    def step_line(s: Column) -> Column:
        tick = F.when(s["status"] == "complete", F.lit("[x] ")).otherwise(F.lit("[ ] "))
        return F.concat(
            F.lit("  "), tick, s["id"],
            F.coalesce(F.concat(F.lit(" — "), F.nullif(s["name"], F.lit(""))), F.lit("")),
            F.lit(" → "), F.coalesce(F.nullif(s["participant"], F.lit("")), F.lit("?")),
            F.when(F.size(s["dependsOn"]) > 0,
                   F.concat(F.lit(" (after: "), F.array_join(s["dependsOn"], ", "), F.lit(")"))).otherwise(F.lit("")),
            F.coalesce(F.concat(F.lit(" · "), s["completed_at"]), F.lit("")),
        )

    workflow, crypto = e["type"] == "workflow", e["type"] == "crypto"
    n = F.lit(0) if signature_count is None else signature_count
    listed = F.coalesce(F.size(e["signers"]) > 0, F.lit(False))
    default_status = F.when(e["activated_at"].isNotNull(), F.lit("open")).otherwise(F.lit("pending"))
    return F.concat_ws(
        "\n",
        line("Event: ", F.coalesce(F.nullif(e["title"], F.lit("")), e["id"])),
        line("ID: ", e["id"]),
        line("Type: ", e["type"]),
        line("Status: ", F.coalesce(F.nullif(e["status"], F.lit("")), default_status)),
        line("Completed: ", iso_millis(e["completed_at"])),
        line("Archived:  ", iso_millis(e["archived_at"])),
        F.when(workflow, F.lit("\nSteps:")),
        F.when(workflow & (F.size(e["steps"]) > 0), F.array_join(F.transform(e["steps"], step_line), "\n")),
        F.when(crypto, F.concat(F.lit("Signatures: "), n.cast("string"), F.lit(" / "),
                                F.coalesce(e["threshold"], F.lit(1)).cast("string"))),
        F.when(crypto & listed, F.lit("\nSigners:")),
        F.when(crypto & listed, F.array_join(F.transform(e["signers"], lambda s: F.concat(F.lit("  - "), s)), "\n")),
    )
