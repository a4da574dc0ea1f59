"""Ordered numbering per key that never sorts one whole key in one task.

Rows are cut into minute slots. Row counts per (key, slot) are summed before the shuffle, a
window over those counts gives each slot the total before it, and only the rows inside one slot
are sorted together. The window over counts is bounded by the minutes in the data, however many
rows a hot key holds.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 60
# Dense positions per block when ranking already numbered rows.
BLOCK = 1 << 16


def _prefix(df: DataFrame, keys: list[str], slot: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    df = df.withColumn("_slot", slot)
    per_slot = df.groupBy(*keys, "_slot").agg(
        *[F.sum(value).alias(f"_n_{name}") for name, value in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slot.select(
        *keys, "_slot",
        *[F.coalesce(F.sum(f"_n_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(value).over(inside).alias(f"_in_{name}") for name, value in sums.items()])
    joined = local.join(offsets, [*keys, "_slot"], "left")
    out = [c for c in df.columns if c not in sums and c != "_slot"]
    return joined.select(
        *out,
        *[(F.coalesce(F.col(f"_before_{name}"), F.lit(0)) + F.col(f"_in_{name}")).cast("bigint").alias(name) for name in sums],
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    ties: Sequence[str],
    sums: dict[str, Column],
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Inclusive running sums per key in `(at, *ties)` order. Keys must not be NULL."""
    slot = F.floor(F.unix_seconds(F.col(at)) / slot_seconds)
    return _prefix(df, list(keys), slot, [F.col(at), *[F.col(t) for t in ties]], sums)


def assign_sequence(
    df: DataFrame,
    key: str = "event_id",
    at: str = "received_at",
    tie: str = "mail_id",
    base: DataFrame | None = None,
    out: str = "sequence",
) -> DataFrame:
    """W1. 1, 2, 3, ... per key in arrival order.

    `base(key, last)` continues numbering behind the entries a key already has (A9).
    """
    numbered = running_sums(df, [key], at, [tie], {out: F.lit(1)})
    if base is None:
        return numbered
    known = base.select(key, F.col("last").alias("_last"))
    return (
        numbered.join(known, key, "left")
        .withColumn(out, F.col(out) + F.coalesce(F.col("_last"), F.lit(0)))
        .drop("_last")
    )


def rank_numbered(df: DataFrame, key: str, number: str, out: str, block: int = BLOCK) -> DataFrame:
    """1-based rank per key of rows that carry a distinct `number` within the key."""
    slot = F.floor(F.col(number) / block)
    return _prefix(df, [key], slot, [F.col(number)], {out: F.lit(1)})


def last_sequence(ledger: DataFrame, key: str = "event_id", number: str = "sequence") -> DataFrame:
    """A9. Highest number per key; the next entry gets one more."""
    return ledger.groupBy(key).agg(F.max(number).alias("last"))
