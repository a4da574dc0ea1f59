"""Folding proof results into the ledger."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions.steps import is_complete
from countersign.operators.decide import _yes


def anchor_rollup(proofs: DataFrame, records: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """A7/A12/C8. Per event: proofs checked, newly anchored, still pending, records patched, notify.

    `proofs`: event_id, base, anchored, changed, pending, error, block_height. A proof that came
    back with an error counts as checked and nothing else. `records`: event_id, base,
    ots_anchored, ots_anchored_at, ots_block.
    """
    good = F.col("error").isNull()
    anchored, pending = good & _yes(F.col("anchored")), good & ~_yes(F.col("anchored")) & _yes(F.col("pending"))
    patched = anchor_patches(proofs, records, now).groupBy("event_id").agg(F.count("*").alias("patched"))
    per_event = proofs.groupBy("event_id").agg(
        F.count("*").alias("checked"),
        F.count_if(anchored & _yes(F.col("changed"))).alias("newly_anchored"),
        F.count_if(pending).alias("pending_after"),
        F.count_if(anchored).alias("n_anchored"),
        F.min_by(F.when(anchored & (F.col("block_height") > 0), F.col("block_height")),
                 F.when(anchored & (F.col("block_height") > 0), F.col("base"))).alias("block_height"),
    )
    head = events.select(
        F.col("id").alias("event_id"), F.col("type").alias("event_type"), "title", "initiator",
        (is_complete("status") & F.col("ots_proof_anchored_notified_at").isNull()).alias("_may"),
    )
    df = head.join(per_event, "event_id", "left").join(patched, "event_id", "left")
    zero = F.lit(0).cast("bigint")
    crossed = F.col("_may") & _yes(F.col("newly_anchored") > 0) & _yes(F.col("pending_after") == 0)
    return df.select(
        "event_id", "event_type", "title", "initiator",
        *[F.coalesce(c, zero).alias(c) for c in ("checked", "newly_anchored", "pending_after", "n_anchored", "patched")],
        "block_height",
        crossed.alias("crossed"),
        (crossed & (F.coalesce("initiator", F.lit("")) != "")).alias("notified"),
    )


def anchor_totals(rollup: DataFrame) -> DataFrame:
    """A7. Grand totals of one pass."""
    return rollup.agg(
        F.count("*").alias("events"), F.sum("checked").alias("checked"),
        F.sum("newly_anchored").alias("anchored"), F.sum("pending_after").alias("pending"),
        F.sum("patched").alias("patched"), F.count_if("notified").alias("notified"),
    )


def anchor_patches(proofs: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """M12/J14. Records an anchored proof changes, with the fields filled where they were missing."""
    ok = proofs.filter(F.col("error").isNull() & _yes(F.col("anchored"))).select(
        "event_id", "base", F.when(F.col("block_height") > 0, F.col("block_height")).alias("_height")
    )
    df = records.join(ok, ["event_id", "base"])
    dirty = (
        ~_yes(F.col("ots_anchored")) | F.col("ots_anchored_at").isNull()
        | (F.col("_height").isNotNull() & F.col("ots_block").isNull())
    )
    return df.filter(dirty).withColumns(
        {
            "ots_anchored": F.lit(True),
            "ots_anchored_at": F.coalesce("ots_anchored_at", now),
            "ots_block": F.coalesce("ots_block", "_height"),
        }
    ).drop("_height")


def anchor_apply(proofs: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """M12. All records after the pass."""
    patched = anchor_patches(proofs, records, now)
    return records.join(patched.select("event_id", "base"), ["event_id", "base"], "left_anti").unionByName(
        patched.select(*records.columns)
    )


def mark_notified(events: DataFrame, rollup: DataFrame, now: Column) -> DataFrame:
    """C8. Set the once-only flag on events that crossed to fully anchored."""
    crossed = rollup.filter("crossed").select(F.col("event_id").alias("id"), F.lit(True).alias("_x"))
    return events.join(crossed, "id", "left").withColumn(
        "ots_proof_anchored_notified_at", F.when(F.col("_x"), now).otherwise(F.col("ots_proof_anchored_notified_at"))
    ).select(*events.columns)


def anchor_notices(rollup: DataFrame, now: Column) -> DataFrame:
    """C8. One notice per event that crossed and has an initiator."""
    return rollup.filter("notified").select(
        "event_id", "event_type", "title", "block_height", F.col("initiator").alias("to"),
        F.lit("proof_anchored").alias("kind"), F.lit("anchor").alias("cause"), now.alias("at"),
    )
