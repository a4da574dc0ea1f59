"""Delivery reports: from raw message to per-step send errors and one notice."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions import headers as H
from countersign.functions.hashing import iso_millis
from countersign.session import evaluated_once

RECIPIENTS = (
    "array<struct<original_recipient:string,final_recipient:string,action:string,status:string,diagnostic:string>>"
)


def with_dsn_groups(df: DataFrame) -> DataFrame:
    """Add `groups`: the blank-line groups of the first message/delivery-status part of `raw`.

    NULL without such a part.
    """
    df = evaluated_once(df, _top=H.split_headers_body(H.text_of("raw")))
    df = evaluated_once(df, _boundary=H.extract_boundary(H.content_type(F.get("_top", F.lit(0)))))
    df = evaluated_once(df, _parts=H.split_multipart(F.get("_top", F.lit(1)), "_boundary"))
    split = F.transform("_parts", H.split_headers_body)
    is_status = lambda p: F.get(p, F.lit(0)).rlike(r"(?i)content-type\s*:\s*message/delivery-status")
    df = evaluated_once(df, _status=F.get(F.filter(split, is_status), F.lit(0)))
    body = F.when(F.col("_status").isNotNull(), F.coalesce(F.get("_status", F.lit(1)), F.lit("")))
    return evaluated_once(df, groups=dsn_groups(body)).drop("_top", "_boundary", "_parts", "_status")


def dsn_groups(body: Column | str) -> Column:
    """W8. Blank-line separated groups; the first is the report, the rest are recipients."""
    lf = F.regexp_replace(H._col(body), "\r\n", "\n")
    groups = F.transform(F.split(lf, r"\n[ \t]*\n"), H._strip)
    return F.filter(groups, lambda g: g != "")


def recipient(group: Column) -> Column:
    """One recipient group as a struct."""
    def text(fields: Column, name: str) -> Column:
        hits = F.filter(fields, lambda f: f["name"] == name)
        return F.nullif(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))

    def read(fields: Column) -> Column:
        return F.struct(
            H.strip_address_type(text(fields, "original-recipient")).alias("original_recipient"),
            H.strip_address_type(text(fields, "final-recipient")).alias("final_recipient"),
            F.lower(text(fields, "action")).alias("action"),
            text(fields, "status").alias("status"),
            text(fields, "diagnostic-code").alias("diagnostic"),
        )

    # Bind the parsed fields once for all five lookups.
    return F.get(F.transform(F.array(H._field_entries(group)), read), F.lit(0))


def is_permanent(r: Column) -> Column:
    """F3. Failed, or a 5.x status with no action."""
    return F.coalesce(
        (r["action"] == "failed") | (r["action"].isNull() & r["status"].rlike(r"^5\.")), F.lit(False)
    )


def with_failures(df: DataFrame) -> DataFrame:
    """C2. Add `failed`: the permanently failed recipients of the delivery report in `raw`."""
    df = with_dsn_groups(df)
    rest = F.slice("groups", F.lit(2), F.greatest(F.size("groups"), F.lit(1)))
    df = evaluated_once(df, recipients=F.transform(rest, recipient))
    none = F.array().cast(RECIPIENTS)
    return evaluated_once(df, failed=F.coalesce(F.filter("recipients", is_permanent), none)).drop("groups", "recipients")


def dsn_recipients(bounces: DataFrame) -> DataFrame:
    """Every recipient group of delivery reports as rows, permanent or not."""
    rows = with_dsn_groups(bounces).select("mail_id", F.posexplode("groups").alias("pos", "grp")).filter("pos > 0")
    return rows.select("mail_id", "pos", recipient(F.col("grp")).alias("r")).select("mail_id", "pos", "r.*")


def process_bounces(bounces: DataFrame, events: DataFrame) -> DataFrame:
    """C2. One row per bounce to a known event: what failed, and the error for its step.

    `bounces`: mail_id, received_at, event_id, step_id, raw. The first failed recipient speaks
    for the step.
    """
    head = events.select(
        F.col("id").alias("event_id"), F.col("type").alias("event_type"), "title", "initiator"
    )
    df = with_failures(bounces).drop("raw").join(head, "event_id")
    addresses = F.filter(
        F.transform("failed", lambda f: F.coalesce(f["final_recipient"], f["original_recipient"])),
        lambda a: a.isNotNull(),
    )
    top = F.get("failed", F.lit(0))
    return df.select(
        "mail_id", "received_at", "event_id", "event_type", "title", "initiator", "step_id",
        F.size("failed").alias("n_failed"),
        addresses.alias("failed_recipients"),
        top["diagnostic"].alias("diagnostic"),
        top["status"].alias("code"),
        F.when(F.size("failed") > 0, F.coalesce(top["diagnostic"], top["status"], F.lit("delivery failed"))).alias("error_reason"),
    )


def latest_send_errors(bounced: DataFrame) -> DataFrame:
    """A10. The last recorded error per step."""
    hit = bounced.filter((F.col("n_failed") > 0) & F.col("step_id").isNotNull())
    err = F.struct(F.col("error_reason").alias("reason"), "code", F.col("received_at").alias("at"))
    return (
        hit.groupBy("event_id", "step_id")
        .agg(F.max_by(err, F.struct("received_at", "mail_id")).alias("e"))
        .select("event_id", "step_id", "e.*")
    )


def apply_send_errors(events: DataFrame, errors: DataFrame) -> DataFrame:
    """A10. Event records with the last send error on its step; a step without a new one keeps what it has."""
    body = F.struct("reason", "code", iso_millis("at").alias("at"))
    # At most one error a step.
    per_event = errors.groupBy(F.col("event_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("step_id", body.alias("e")))).alias("_errors"))
    noted = F.transform("steps", lambda s: s.withField("last_send_error", F.coalesce(F.try_element_at(F.col("_errors"), s["id"]), s["last_send_error"])))
    return events.join(per_event, "id", "left").withColumn("steps", F.when(F.col("_errors").isNotNull(), noted).otherwise(F.col("steps"))).select(*events.columns)


def latest_errors_from_log(log: DataFrame) -> DataFrame:
    """A10. Latest entry per step from a log whose NULL reason clears; cleared steps drop out.

    `log`: event_id, step_id, at, entry_id, reason, code.
    """
    last = log.groupBy("event_id", "step_id").agg(
        F.max_by(F.struct("reason", "code", "at"), F.struct("at", "entry_id")).alias("e")
    )
    return last.select("event_id", "step_id", "e.*").filter("reason is not null")


def bounce_notices(bounced: DataFrame) -> DataFrame:
    """C2. One notice to the initiator per bounce with a permanent failure."""
    return bounced.filter("n_failed > 0").select(
        "event_id", "event_type", "title", "step_id",
        F.col("received_at").alias("at"), F.col("mail_id").cast("string").alias("cause"),
        F.col("initiator").alias("to"), F.lit("bounce").alias("kind"),
        "failed_recipients", "diagnostic",
    )
