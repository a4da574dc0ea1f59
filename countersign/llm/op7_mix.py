"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in an order that hashing gives them, form blocks. Block k of a source of weight n/H is released at slot
floor(k*H/n) and due by slot ceil((k+1)*H/n); earliest deadline first runs a released block in every slot, so at any slot each source
has had its share but for less than one block.

A period is at least as long as the mixture, until the first source runs out, and is cut into segments of SEGMENT slots. Cumulative
rounding says how many blocks of each source lie before any segment, to less than one of its target, so tasks schedule segments
independently, each by earliest deadline first. Over the whole mixture a source stays within two blocks of its target weight. Sources
with under two slots in a segment share the slots of one common entry and are mixed among themselves in the same way; they and the
others may then be off by half a block to two blocks more. The driver holds a few numbers for each source, however many rows there are.

A source whose target is under eight slots of a period (one, if the period is one segment) gets that many, which others give up in
proportion.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countersign.llm.text import mapped
from countersign.session import checkpointed

PERIOD = 1024  # slots of a period at least, and four for each source; doubled up to the length of the mixture
SEGMENT = 1 << 16  # slots that one task schedules, or four for each source; a period of one segment is sent to every task, longer ones are joined
FINE = 1 << 20  # parts of a slot to which weights are exact in a period of several segments
LEAST = 8  # slots of a source in such a period at least
BUCKET_ROWS = 1024  # rows that are ranked together


def quantised(weights: dict[str | None, float], period: int, least: int = 1) -> dict[str | None, int]:
    """Slots of each source in a period: in proportion by largest remainders, `least` where that is less, `period` in all."""
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    return dict(zip(names, apportioned([Fraction(weights[s]) for s in names], period, least)))


def apportioned(given: list[Fraction], period: int, least: int = 1) -> list[int]:
    few: set[int] = set()
    while True:
        total, spare = sum(w for i, w in enumerate(given) if i not in few), period - least * len(few)
        exact = [Fraction(least) if i in few else spare * w / total for i, w in enumerate(given)]
        under = {i for i, x in enumerate(exact) if x < least}
        if not under:
            break
        few |= under
    slots = [int(x) for x in exact]
    for i in sorted(range(len(given)), key=lambda i: slots[i] - exact[i])[: period - sum(slots)]:
        slots[i] += 1
    return slots


def period_for(weights: dict[str | None, float], blocks: dict[str | None, int]) -> int:
    """Slots of a period: as many as there are until the first source runs out, and one for the smallest weight if that many blocks exist."""
    total, all_ = sum(map(Fraction, weights.values())), sum(blocks.values())
    lasting = min(blocks[s] * total / Fraction(w) for s, w in weights.items() if w > 0)  # all_ at most
    smallest = max(total / Fraction(w) for w in weights.values() if w > 0)
    least, period = max(4 * len(weights), lasting, min(smallest, all_)), PERIOD
    while period < least:
        period *= 2
    return period


def schedule(slots: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period, by earliest deadline among released blocks."""
    period = sum(slots.values())
    waiting = sorted((k * period // n, -(-(k + 1) * period // n), i, k) for i, n in enumerate(slots.values()) for k in range(n))
    names, ready, at, out = list(slots), [], 0, []
    for slot in range(period):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, i, k = waiting[at]
            heapq.heappush(ready, (deadline, i, k, release))
            at += 1
        deadline, i, k, release = heapq.heappop(ready)
        out.append((names[i], k, release, deadline, slot))
    return out


def served(common: list[int], rare: int, slots: int) -> list[int]:
    """Blocks of each common source, and of all rare ones together, in the first `slots` slots: less than 1.5 from their targets, never falling."""
    total = sum(common) + rare
    few = (2 * slots * rare + total) // (2 * total)
    ends = [0, *accumulate(common)]
    before = [(slots - few) * e // ends[-1] for e in ends]
    return [*(b - a for a, b in zip(before, before[1:])), few]


def timetable(spark: SparkSession, units: list[int], length: int, segment: int) -> DataFrame:
    """`at, k, release, deadline, slot`: every block of the sources, by their place in `units` (their weights), in `length` slots or a few more."""
    total = sum(units)
    if length <= segment:
        return _scheduled(spark, list(range(len(units))), 1, lambda j: ([0] * len(units), apportioned([Fraction(u) for u in units], length)), segment)
    rare = [i for i, u in enumerate(units) if u * segment < 2 * total]
    common = [i for i in range(len(units)) if units[i] * segment >= 2 * total]
    weights, group = [units[i] for i in common], sum(units[i] for i in rare)

    def counts(j: int) -> tuple[list[int], list[int]]:
        before = served(weights, group, j * segment)
        return before, [b - a for a, b in zip(before, served(weights, group, (j + 1) * segment))]

    outer = checkpointed(_scheduled(spark, [*common, -1], -(-length // segment), counts, segment))
    if not rare:
        return outer
    # Rare sources have at most half of all weight, hence a few rounds suffice.
    inner = timetable(spark, [units[i] for i in rare], served(weights, group, length)[-1], segment)
    place = spark.createDataFrame(list(enumerate(rare)), "at int, place int")
    inner = inner.join(F.broadcast(place), "at").select(F.col("place").alias("at"), "k", F.col("slot").alias("turn"))
    turns = outer.where("at = -1").select(F.col("k").alias("turn"), "release", "deadline", "slot")
    return outer.where("at >= 0").unionByName(inner.join(turns, "turn").drop("turn"))


def _scheduled(spark: SparkSession, places: list[int], segments: int, counts, segment: int) -> DataFrame:
    """Segments by earliest deadline first; `counts(j)` are the blocks of each place before segment j and in it."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for j in b["id"]:
                before, now = counts(j)
                i, k, release, deadline, slot = zip(*schedule(dict(enumerate(now))))
                shift = j * segment
                yield {
                    "at": [places[x] for x in i], "k": [before[x] + y for x, y in zip(i, k)],
                    "release": [shift + x for x in release], "deadline": [shift + x for x in deadline], "slot": [shift + x for x in slot],
                }

    return mapped(spark.range(segments), run, "at int, k long, release long, deadline long, slot long")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, *, temper: float = 0.7, block_rows: int = 32, id_col: str = "doc_id", source_col: str = "source", tie_cols: tuple[str, ...] = ("text",), in_order: bool = False) -> DataFrame:
    """Slot of every row: `doc_id, source, block, release, deadline, slot, in_mix`; or, `in_order`, the whole rows sorted by slot.

    `weights` gives target weights by source (a source without one gets the smallest given); without it, weights are row counts to
    the power `temper`. No row is dropped or repeated: where a source has run out its slots stay empty, and `in_mix` tells the slots
    before the first empty one, in which the weights hold. A null source is a source. Null ids and repeated rows are rows like any
    other; equal rows take neighbouring places in either order. No rows give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ties = [F.col(c) for c in tie_cols if c in docs.columns]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col), *ties).alias("hash"), *[F.struct("*").alias("whole") for _ in range(in_order)])
    carried = ["whole"] if in_order else []
    # One row per source: the mixture's own configuration, not the corpus.
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if not counts:
        counts = {None: 1}
    if weights is None:
        weights = {s: n**temper for s, n in counts.items()}
    least = min(weights.values())
    weights = {s: weights.get(s, least) for s in counts}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    period = period_for(weights, blocks)
    segment = SEGMENT
    while segment < 4 * len(weights):
        segment *= 2
    units = quantised(weights, period) if period <= segment else quantised(weights, period * FINE, LEAST * FINE)
    plan = checkpointed(timetable(spark, list(units.values()), period, segment))
    own = spark.createDataFrame([(s, i, blocks[s]) for i, s in enumerate(units)], "source string, at int, blocks long")
    # A row per source from here to `cuts`: its blocks in a period, and the slot of the first block that it lacks.
    sized = checkpointed(plan.groupBy("at").agg(F.count("*").alias("n")).join(F.broadcast(own), "at"))
    lacking = sized.select("at", F.pmod("blocks", "n").alias("k"), F.expr(f"(blocks div n) * {period}").alias("shift"))
    whole = plan.join(F.broadcast(lacking), ["at", "k"]).agg(F.min(F.col("slot") + F.col("shift"))).first()[0]
    sized = F.broadcast(sized.select("source", "at", "n"))
    cuts = spark.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in counts.items()], "source string, buckets long")
    # A row per source.
    keyed = _beside(rows, F.broadcast(cuts)).withColumn("bucket", F.pmod("hash", "buckets"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id")
    ranked = keyed.select("doc_id", "source", "bucket", "hash", *carried, (F.row_number().over(within) - 1).alias("rank"))
    placed = _beside(ranked, offsets, "bucket").withColumn("block", F.expr(f"(first + rank) div {int(block_rows)}"))
    numbered = _beside(placed, sized).withColumn("k", F.pmod("block", "n"))
    numbered = numbered.withColumn("shift", F.expr(f"(block div n) * {period}"))
    shift = F.col("shift")
    slotted = numbered.drop("n").join(F.broadcast(plan) if period <= segment else plan, ["at", "k"])
    if in_order:
        return slotted.withColumn("slot", F.col("slot") + shift).orderBy("slot", "hash", "doc_id").select("whole.*")
    return slotted.select(
        "doc_id", "source", "block", _moved("release", shift), _moved("deadline", shift), _moved("slot", shift), (F.col("slot") + shift < whole).alias("in_mix")
    )


def _moved(name: str, shift: Column) -> Column:
    return (F.col(name) + shift).alias(name)


def _beside(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on `source`, nulls equal, and further keys."""
    names = {c: f"_{c}" for c in ("source", *keys)}
    right = right.withColumnsRenamed(names)
    on = F.col("source").eqNullSafe(F.col("_source"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return left.join(right, on).drop(*names.values())
