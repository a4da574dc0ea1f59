"""Tamper evidence that grows with the ledger: a range of complete trees of digests per event.

Entry `sequence` of an event is leaf `sequence - 1`; sixteen complete neighbours of one height make a node of the next. What no complete node
covers yet are the peaks, at most fifteen for each height, and they are all that a batch needs of the past: `extend` joins
its new leaves to the stored peaks and reads no older entry. A root digests the number of entries with the peaks and so commits to every
entry and to their number; the roots of two states are compared through the nodes that lie between them.

Every step groups sixteen rows at most, so an event of any size spreads over all tasks.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign import schemas
from countersign.operators.ledger import payload_digest
from countersign.session import checkpointed

FAN = 16
# Heights that a cover of entry numbers may need: 16^12 entries in one event.
HEIGHTS = 12
NODE = ["event_id", "height", "index", "digest"]


def leaves(ledger: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A node of height 0 for every entry, over all ledger columns unless `columns` names some."""
    digest = payload_digest(*(columns or schemas.LEDGER.fieldNames()))
    return ledger.select("event_id", F.lit(0).alias("height"), (F.col("sequence") - 1).alias("index"), digest.alias("digest"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _height(most: int | None) -> int:
    """Heights that `most` entries fill."""
    h = 0
    while most is not None and FAN ** (h + 1) <= most:
        h += 1
    return h


def extend(peaks: DataFrame | None, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W6. `(nodes, peaks)` after `fresh` nodes come behind the stored peaks.

    `fresh` may be leaves or nodes of several heights, as long as each event's follow its peaks without a gap. `nodes` are the fresh ones and
    all that became complete. Peaks of events without fresh nodes are not returned: they stay as they are.
    """
    fresh = checkpointed(fresh.select(*NODE))
    given = fresh
    if peaks is not None:
        touched = fresh.select("event_id").distinct()
        given = checkpointed(peaks.select(*NODE).join(touched, "event_id", "left_semi").unionByName(fresh))
    end = (F.col("index") + 1) * F.expr(f"cast(power({FAN}, height) as bigint)")
    sizes = checkpointed(given.groupBy("event_id").agg(F.max(end).alias("n")))
    top = _height(sizes.agg(F.max("n")).first()[0])
    at, formed = given.filter("height = 0"), []
    for h in range(top):
        groups = at.groupBy("event_id", F.floor(F.col("index") / FAN).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("kids"))
        up = groups.filter(F.size("kids") == FAN).select(
            "event_id", F.lit(h + 1).alias("height"), F.col("parent").alias("index"), node_digest(F.transform("kids", lambda k: k["digest"])).alias("digest")
        )
        formed.append(checkpointed(up))
        at = formed[-1].unionByName(given.filter(F.col("height") == h + 1))
    every = _union([given, *formed])
    covered = (F.floor(F.col("index") / FAN) + 1) * F.expr(f"cast(power({FAN}, height + 1) as bigint)") <= F.col("n")
    standing = every.join(sizes, "event_id").filter(~covered).select(*NODE)
    return _union([fresh, *formed]), standing


def node_digest(kids: Column) -> Column:
    return F.sha2(F.array_join(kids, "|"), 256)


def roots(peaks: DataFrame) -> DataFrame:
    """W6. `(event_id, entries, root)`: one digest over the number of entries and the peaks from left to right."""
    each = F.struct((-F.col("height")).alias("h"), "index", "digest")
    covered = (F.col("index") + 1) * F.expr(f"cast(power({FAN}, height) as bigint)")
    # A few dozen peaks an event.
    held = peaks.groupBy("event_id").agg(F.max(covered).alias("entries"), F.sort_array(F.collect_list(each)).alias("p"))
    return held.select("event_id", "entries", F.sha2(F.concat_ws("|", F.col("entries").cast("string"), F.array_join(F.transform("p", lambda x: x["digest"]), "|")), 256).alias("root"))


def cover(spans: DataFrame, start: str = "start", end: str = "entries") -> DataFrame:
    """`spans` with a row for each of the fewest nodes (`height, index`) that cover the entries after `start` up to `end`.

    Going up, each height takes what is left to the next multiple of sixteen; going down, what the height above left over. From 0 on these are the peaks of a state
    of `end` entries.
    """
    size = lambda h: F.expr(f"cast(power({FAN}, {h}) as bigint)")
    first = lambda h: F.ceil(F.col(start) / size(h)).cast("bigint")
    last = lambda h: F.floor(F.col(end) / size(h)).cast("bigint")
    none = F.array().cast("array<bigint>")

    def run(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def placed(h: int, indexes: Column) -> Column:
        return F.transform(indexes, lambda i: F.struct(F.lit(h).alias("height"), i.alias("index")))

    per_height = []
    for h in range(HEIGHTS):
        room = last(h + 1) >= first(h + 1)
        both = F.concat(run(first(h), F.least(first(h + 1) * FAN, last(h))), run(last(h + 1) * FAN, last(h)))
        picked = F.when(room, both).otherwise(run(first(h), last(h)))
        per_height.append(placed(h, picked))
    return spans.select("*", F.inline(F.concat(*per_height)))


def check_states(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """W7. Every stored state against nodes built from the ledger as it is now.

    `states`: event_id, state (a number that rises), entries, root. `problem` is `missing` where entries that the state counts are gone,
    `changed` where they give another root, NULL where the state holds; `after` is the number of entries of the last
    state before it, so the damage lies behind that entry.
    """
    spans = states.select("event_id", "state", "entries", "root", F.lit(0).cast("bigint").alias("start"))
    wanted = cover(spans)
    have = wanted.join(nodes.select(*NODE), ["event_id", "height", "index"], "left")
    each = F.struct((-F.col("height")).alias("h"), "index", "digest")
    again = have.groupBy("event_id", "state", "entries", "root").agg(F.sort_array(F.collect_list(each)).alias("p"), F.count("*").alias("wanted"), F.count("digest").alias("found"))
    root_now = F.sha2(F.concat_ws("|", F.col("entries").cast("string"), F.array_join(F.transform("p", lambda x: x["digest"]), "|")), 256)
    problem = F.when(F.col("found") < F.col("wanted"), "missing").when(root_now != F.col("root"), "changed")
    earlier = states.select("event_id", F.col("state").alias("_s"), F.col("entries").alias("_n"))
    # States are few beside entries: one for each batch that touched the event.
    before = states.select("event_id", "state").join(earlier, "event_id").filter("_s < state").groupBy("event_id", "state").agg(F.max("_n").alias("after"))
    return again.join(before, ["event_id", "state"], "left").select("event_id", "state", "entries", F.coalesce("after", F.lit(0)).alias("after"), problem.alias("problem"))


def growth_proof(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that show how one state grew into another: `pairs` has event_id, start (entries of the older state), entries (of the newer).

    `part` is `old` for the older state's peaks and `new` for what came between. A proof has a few dozen rows, however many entries lie between.
    """
    old = cover(pairs.withColumn("_zero", F.lit(0).cast("bigint")), "_zero", "start").drop("_zero").withColumn("part", F.lit("old"))
    new = cover(pairs).withColumn("part", F.lit("new"))
    wanted = old.unionByName(new)
    return wanted.join(nodes.select(*NODE), ["event_id", "height", "index"], "left")


def check_growth(proof: DataFrame, older: DataFrame, newer: DataFrame) -> DataFrame:
    """W7. Whether `newer` roots (event_id, entries, root) hold all that `older` ones held, from proofs alone: no entry is read.

    `problem`: `missing` nodes, an `older` root that its peaks do not give, or a `newer` one that peaks and new nodes do not give.
    """
    proof = checkpointed(proof)
    gaps = proof.groupBy("event_id").agg(F.max(F.col("digest").isNull()).alias("gap"))
    whole = proof.filter("digest is not null")
    was = roots(whole.filter("part = 'old'")).select("event_id", F.col("root").alias("was_root"))
    _, peaks = extend(whole.filter("part = 'old'"), whole.filter("part = 'new'"))
    now = roots(peaks).select("event_id", F.col("root").alias("now_root"), F.col("entries").alias("now_entries"))
    both = older.select("event_id", F.col("entries").alias("start"), F.col("root").alias("old_root")).join(
        newer.select("event_id", "entries", F.col("root").alias("new_root")), "event_id"
    )
    checked = both.join(gaps, "event_id", "left").join(was, "event_id", "left").join(now, "event_id", "left")
    same = F.col("start") == F.col("entries")
    problem = (
        F.when(F.coalesce("gap", F.lit(True)), "missing")
        .when(~F.coalesce(F.col("was_root") == F.col("old_root"), F.col("start") == 0), "older")
        .when(same & (F.col("old_root") != F.col("new_root")), "newer")
        .when(~same & ~F.coalesce((F.col("now_root") == F.col("new_root")) & (F.col("now_entries") == F.col("entries")), F.lit(False)), "newer")
    )
    return checked.select("event_id", "start", "entries", problem.alias("problem"))
