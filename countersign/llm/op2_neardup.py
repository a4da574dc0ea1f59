"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch has a fixed number of coordinates. In round i every shingle is hashed to one coordinate with a value in [i, i+1), and the coordinate keeps
the smallest; after as many rounds as coordinates each round fills the coordinate of its own number, so all are filled in twice as many, and
mostly in a few. Coordinates of two sets agree with the probability of their similarity J, and the share that agrees is concentrated about J.

Bands of coordinates put candidates into common buckets: their number and rows follow from the threshold, so that a pair at it misses all
bands with a probability of 1e-6. Pairs whose sketches agree in a share that a pair at the threshold shows with a probability under 1e-9
are put aside; all others are confirmed or refused on their full sets. Documents of equal sets form a class first and take part once.

Links only have to give the right components. So each class is first compared with the smallest class that it meets in a bucket. Then
buckets that still hold several components are worked off: some members become pivots, those of the bucket's smallest components first,
and are compared with all members of other components; then they leave the bucket. Each round takes four times as many pivots, and
components found meanwhile close buckets. A comparison starts with bitmaps of the two sets, inside the join: bits in which they differ
are at most the elements in which the sets differ, so pairs with too many of them are no links and never leave the join as rows. No
pair in different components stays uncompared, and no bucket is expanded into all pairs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import ceil, exp, lgamma, log, log1p
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countersign.llm.components import stars
from countersign.llm.text import WordHashes, lower_words, mapped, mixed, window_hashes
from countersign.session import checkpointed

SHINGLE = 5
SHARE = 85  # percent of the union that the intersection must have, if nothing else is asked for
MISSED, REFUSED = 1.05e-6, 5e-10  # probabilities that bands miss, and the sketch filter refuses, a pair at the threshold
MAX_SIZE = 288


class Plan(NamedTuple):
    """Bands, their rows and the least agreeing coordinates of sketches for one threshold."""

    share: int
    bands: int
    rows: int
    least: int

    @property
    def size(self) -> int:
        return self.bands * self.rows


def plan(share: int) -> Plan:
    """The most rows for which the bands that MISSED asks for fit MAX_SIZE coordinates."""
    if not 1 <= share <= 100:
        raise ValueError(f"share must be 1 to 100 percent, not {share}")
    j = min(share / 100, 0.99)
    needed = lambda rows: ceil(log(MISSED) / log1p(-(j**rows)))
    rows = max([k for k in range(1, 33) if k * needed(k) <= MAX_SIZE], default=1)
    size, tail, least = rows * needed(rows), 0.0, 0
    while least < size:
        tail += exp(lgamma(size + 1) - lgamma(least + 1) - lgamma(size - least + 1) + least * log(j) + (size - least) * log1p(-j))
        if tail >= REFUSED:
            break
        least += 1
    return Plan(share, needed(rows), rows, least)


SIZE = plan(SHARE).size
LONGS = 16  # of a set's bitmap
PIVOTS, MORE_PIVOTS = 16, 4
KEPT_SETS = 64


@cache
def seeds(size: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five-word shingles; of fewer words the whole sequence; none without words."""
    words = lower_words(text)
    return np.unique(window_hashes(hashes.of(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def sketch(items: np.ndarray, size: int = SIZE) -> np.ndarray:
    """`size` coordinates of a non-empty set."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    done, low = 0, np.uint64(0xFFFFFFFF)
    while done < size:
        rounds = np.arange(done, min(size, done + 1 + 3 * size // len(items)))
        h = mixed(items[None, :] ^ seeds(size)[rounds, None])
        at = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        np.minimum.at(out, at.reshape(-1).astype(np.int64), ((h & low) | (rounds[:, None].astype(np.uint64) << np.uint64(32))).reshape(-1))
        done = int(rounds[-1]) + 1
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for i in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[i] = (mixed(items ^ seeds(size)[size + i]) & low).min() | np.uint64(size + i) << np.uint64(32)
    return out


def bands(coordinates: np.ndarray, rows_each: int) -> np.ndarray:
    rows = coordinates.reshape(-1, rows_each)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(rows_each):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out.astype(np.int64)


def bitmap(items: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * LONGS, bool)
    bits[(items % np.uint64(64 * LONGS)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def near_duplicates(docs: DataFrame, *, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: `doc_id, n_shingles, component_id, kept`.

    `component_id` is the smallest id reachable over links (100 * intersection >= `share` * union of the shingle sets), `kept` whether that is
    the row's own. Texts without words have empty sets and no links. Rows that share an id are one node: their links unite, and each
    gives a row. Rows without an id get no component and are kept. No rows give none; other columns are not read.
    """
    sizes = plan(share)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = checkpointed(mapped(rows, _sketcher(sizes), "doc_id long, n_shingles long, set_key binary, low binary, bitmap array<long>, bands array<long>"))
    named = table.where("doc_id is not null and n_shingles > 0")
    classes = checkpointed(named.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), *[F.first(c).alias(c) for c in ("n_shingles", "low", "bitmap")], F.first("bands").alias("bands")))
    placed = classes.select("class_id", F.explode("bands").alias("bucket"))
    met = placed.groupBy("bucket").agg(F.min("class_id").alias("leader"), F.max("class_id").alias("last")).where("leader < last")
    members = checkpointed(placed.join(met.drop("last"), "bucket").distinct())

    wanted = members.select(F.col("class_id").alias("doc_id")).distinct()
    texts = checkpointed(rows.join(wanted, "doc_id", "left_semi").distinct())
    known = checkpointed(classes.select("class_id", "n_shingles", "low", "bitmap").join(wanted.withColumnRenamed("doc_id", "class_id"), "class_id", "left_semi"))

    pairs = checkpointed(members.where("class_id > leader").groupBy("class_id").agg(F.min("leader").alias("a")).select("a", F.col("class_id").alias("b")))
    compared, links = pairs, stars(_confirmed(pairs, texts, known, sizes))
    open_, pivots = members.select("bucket", "class_id"), PIVOTS
    while True:
        held = open_.join(links.withColumnRenamed("node", "class_id"), "class_id", "left").select("bucket", "class_id", F.coalesce("root", "class_id").alias("root"))
        several = held.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("bucket")
        held = checkpointed(held.join(several, "bucket").join(known.drop("low"), "class_id"))
        if held.isEmpty():
            break
        ranked = held.join(held.groupBy("bucket", "root").agg(F.count("*").alias("n")), ["bucket", "root"])
        order = Window.partitionBy("bucket").orderBy("n", "class_id")
        chosen = checkpointed(ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots).select("bucket", F.col("class_id").alias("pivot"), F.col("root").alias("pivot_root"), F.col("n_shingles").alias("pivot_n"), F.col("bitmap").alias("pivot_bitmap")))
        differing = sum((F.bit_count(F.col("bitmap")[i].bitwiseXOR(F.col("pivot_bitmap")[i])) for i in range(LONGS)), F.lit(0))
        may_link = (100 + share) * differing <= (100 - share) * (F.col("n_shingles") + F.col("pivot_n"))
        met = chosen.join(held, "bucket").where((F.col("root") != F.col("pivot_root")) & may_link)
        fresh = met.select(F.least("pivot", "class_id").alias("a"), F.greatest("pivot", "class_id").alias("b")).distinct()
        pairs = checkpointed(fresh.join(compared, ["a", "b"], "left_anti"))
        found = _confirmed(pairs, texts, known, sizes)
        compared = compared.unionByName(pairs)
        links = stars(links.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found))
        open_ = checkpointed(held.join(chosen.select("bucket", F.col("pivot").alias("class_id")), ["bucket", "class_id"], "left_anti").select("bucket", "class_id"))
        pivots *= MORE_PIVOTS

    # An id with several texts is in several classes of the same or another class id: links over it unite them.
    shared = named.join(classes.select("set_key", "class_id"), "set_key").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b").select("a", "b")
    if not shared.isEmpty():
        links = stars(links.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(shared))
    roots = classes.select("set_key", "class_id").join(links.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_key", F.coalesce("root", "class_id").alias("root"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return table.select("doc_id", "n_shingles", "set_key").join(roots, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sketcher(sizes: Plan) -> Callable[[Iterator[dict]], Iterator[dict]]:
    def sketched(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_shingles": [], "set_key": [], "low": [], "bitmap": [], "bands": []}
            for text in b["text"]:
                items = shingles(text, hashes)
                out["n_shingles"].append(len(items))
                coordinates = sketch(items, sizes.size) if len(items) else None
                out["set_key"].append(None if coordinates is None else xxhash.xxh3_128_digest(items.tobytes()))
                out["low"].append(None if coordinates is None else (coordinates & np.uint64(0xFF)).astype(np.uint8).tobytes())
                out["bitmap"].append(bitmap(items))
                out["bands"].append([] if coordinates is None else bands(coordinates, sizes.rows))
            yield out

    return sketched


def _confirmed(pairs: DataFrame, texts: DataFrame, known: DataFrame, sizes: Plan) -> DataFrame:
    """Those of the pairs `a, b` whose full sets are similar enough."""

    def agreeing(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            left, right = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, sizes.size) for c in ("low_a", "low_b"))
            near = np.flatnonzero((left == right).sum(axis=1) >= sizes.least)
            if len(near):
                yield {"a": [b["a"][i] for i in near], "b": [b["b"][i] for i in near]}

    def similar(batches: Iterator[dict]) -> Iterator[dict]:
        hashes, sets = WordHashes(), {}
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for i, j, t, u in zip(b["a"], b["b"], b["text_a"], b["text_b"]):
                if (i, t) not in sets:
                    if len(sets) >= KEPT_SETS:
                        sets.clear()
                    sets[i, t] = shingles(t, hashes)
                s, v = sets[i, t], shingles(u, hashes)
                both = len(np.intersect1d(s, v, assume_unique=True))
                if 100 * both >= sizes.share * (len(s) + len(v) - both):
                    out["a"].append(i)
                    out["b"].append(j)
            if out["a"]:
                yield out

    of_low = lambda c: known.select(F.col("class_id").alias(c), F.col("low").alias(f"low_{c}"))
    of_text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    near = mapped(pairs.join(of_low("a"), "a").join(of_low("b"), "b"), agreeing, "a long, b long").distinct()
    near = checkpointed(near)
    return checkpointed(mapped(near.join(of_text("a"), "a").join(of_text("b"), "b"), similar, "a long, b long").distinct())


def near_duplicate_sql() -> str:
    """The same result as DuckDB SQL over `documents`, from the shingles that pairs share."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive ws as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
 else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) as s from ws),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b using (s) where a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {SHARE} * (x.n + y.n - c)),
ways as (select a, b from link union select b, a from link),
reach(doc_id, m) as (select doc_id, doc_id from documents union select b, m from reach join ways on reach.doc_id = ways.a where m < b),
least as (select doc_id, min(m) as component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from documents join least using (doc_id) left join n using (doc_id)"""
