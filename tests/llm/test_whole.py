"""Whole jobs where a shorter one would look the same on the shared tables."""
import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from countersign.llm import op2_neardup, op7_mix, op9_pii, op10_decontaminate


def edited(n, name):
    """A text of 200 words and its copy with n separate words replaced: J = (196 - 5n) / (196 + 5n)."""
    words = [f"{name}{i}" for i in range(200)]
    other = list(words)
    for k in range(n):
        other[10 + 12 * k] = f"{name}new{k}"
    return " ".join(words), " ".join(other)


def test_near_duplicate_stage_goes_down_to_080(spark):
    rows, at = [], 0
    for copies in range(12):
        for n in (3, 4, 5):
            rows += [(at + k, t) for k, t in enumerate(edited(n, f"w{copies}x{n}y"))]
            at += 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 3 edits: 0.858; 4 edits: 0.815; 5 edits: 0.774.
    strict = {r["doc_id"] for r in op2_neardup.near_duplicates(docs).where("kept").collect()}
    assert strict == {i for i, _ in rows if i % 6 != 1}
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicate_groups(spark, docs, "").collect()}
    assert left == {i for i, _ in rows if i % 6 not in (1, 3)}


def test_sketches_of_a_threshold_miss_few_pairs():
    for share in (50, 70, 80, 85, 95, 100):
        p = op2_neardup.plan(share)
        assert (1 - (share / 100) ** p.rows) ** p.bands < 1.1e-6 and 0 < p.least < p.size <= 288
    assert op2_neardup.plan(85)[1:] == (36, 7, 176)


CARD, IBAN, PHONE = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "+1 (017) 555-7713"


@pytest.mark.parametrize(
    "text",
    ["card {CARD} 12/27", "qty 2 {CARD}.", "2 {CARD} 12 27", "born 1980-02-29 {CARD}", "{CARD} {CARD}", "{CARD} 500 {CARD} 12/27", "{IBAN} EUR 500", "{IBAN} BIC COBADEFF", "AB12 {IBAN} EUR", "{IBAN} {IBAN}", "{PHONE} {CARD}", "{PHONE} 1234 5678 9012", "{CARD}-{CARD}"],
)
def test_values_beside_digits_and_capitals_are_found(text):
    names = op9_pii.Pseudonyms(b"key")
    values = {"CARD": CARD, "IBAN": IBAN}
    alone = {k: names.of(v)[0] for k, v in values.items()}
    new, counts = names.of(text.format(**values, PHONE=PHONE))
    for kind, value in values.items():
        n = text.count("{%s}" % kind)
        assert value not in new and new.count(alone[kind]) == counts[op9_pii.KINDS.index(kind.lower())] == n
    assert "555-7713" not in new


def test_failed_values_stay():
    names = op9_pii.Pseudonyms(b"key")
    for text in ("4111 1111 1111 1112 12/27", "DE88 3704 0044 0532 0130 00 EUR 500", "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert names.of(text) == (text, [0] * len(op9_pii.KINDS))


@pytest.mark.parametrize("m, share", [(20, 0.5), (100, 0.5), (1000, 0.5), (3, 0.9995)])
def test_mix_stays_within_two_blocks_of_the_real_weights(m, share):
    weights = {"big": share, **{f"s{i}": (1 - share) / (m - 1) for i in range(m - 1)}}
    # The sources last for 20,000 slots.
    blocks = {s: max(1, round(20_000 * w)) for s, w in weights.items()}
    slots = op7_mix.quantised(weights, op7_mix.period_for(weights, blocks))
    done, worst = collections.Counter(), 0
    for t, (source, *_) in enumerate(op7_mix.schedule(slots)[:20_000], 1):
        done[source] += 1
        worst = max(worst, abs(done[source] - t * weights[source]), abs(done["big"] - t * share))
    assert worst < 2 and abs(done["big"] / 20_000 - share) < 2e-4


@pytest.mark.parametrize("segment", [op7_mix.SEGMENT, 64])
def test_mixed_rows_keep_to_the_real_weights(spark, monkeypatch, segment):
    monkeypatch.setattr(op7_mix, "SEGMENT", segment)
    weights = {"big": 0.5, **{f"s{i}": 0.5 / 19 for i in range(19)}}
    rows = [(i, s) for s, w in weights.items() for i in range(round(8000 * w))]
    got = op7_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1).where("in_mix").collect()
    assert len(got) == len({r["slot"] for r in got}) > 7900
    done = collections.Counter()
    for t, r in enumerate(sorted(got, key=lambda r: r["slot"]), 1):
        assert r["slot"] == t - 1 and r["block"] == done[r["source"]] and r["release"] <= r["slot"] < r["deadline"]
        done[r["source"]] += 1
        assert all(abs(done[s] - t * w) < 2 for s, w in weights.items())


def test_mix_of_segments_repeats_after_its_period(spark, monkeypatch):
    """Rows beyond the mixture get slots of their own too, with sources rare enough to share an entry."""
    monkeypatch.setattr(op7_mix, "SEGMENT", 64)
    weights = {"a": 0.6, "b": 0.397, "c": 0.002, None: 0.001}
    counts = {"a": 3000, "b": 6000, "c": 40, None: 30}
    rows = [(i, s) for s, n in counts.items() for i in range(n)]
    got = op7_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1).collect()
    assert len(got) == len(rows) == len({r["slot"] for r in got})
    for s, n in counts.items():
        own = sorted((r["block"], r["slot"]) for r in got if r["source"] == s)
        assert [k for k, _ in own] == list(range(n)) and own == sorted(own, key=lambda x: x[1])
    inside = sorted(r["slot"] for r in got if r["in_mix"])
    assert inside == list(range(len(inside))) and len(inside) > 4500
    assert inside[-1] + 1 not in {r["slot"] for r in got}


@pytest.mark.parametrize("units, rare", [({0: 3_000_017, 1: 1_999_983, 2: 777}, 0), ({0: 5_000_000, **{i: i for i in range(1, 40)}}, 39)])
def test_ten_million_blocks_keep_to_their_weights(spark, units, rare):
    """The schedule of 160 segments, made and checked in tasks: each slot once, each source near its weight at every slot."""
    length, total = 160 * op7_mix.SEGMENT, sum(units.values())
    assert sum(u * op7_mix.SEGMENT < 2 * total for u in units.values()) == rare
    plan = op7_mix.timetable(spark, list(units.values()), length, op7_mix.SEGMENT)
    share = F.create_map(*[F.lit(x) for i, u in units.items() for x in (i, u / total)])[F.col("at")]
    off = F.greatest(F.abs(F.col("k") + 1 - (F.col("slot") + 1) * share), F.abs(F.col("k") - F.col("slot") * share))
    order = F.max(F.when((F.col("slot") < F.col("release")) | (F.col("slot") >= F.col("deadline")), 1).otherwise(0))
    rows = plan.groupBy("at").agg(F.count("*").alias("n"), F.sum("slot").alias("slots"), F.max("k").alias("last"), F.max(off).alias("off"), order.alias("late")).collect()
    assert len(rows) == len(units) and sum(r["n"] for r in rows) == length and sum(r["slots"] for r in rows) == length * (length - 1) // 2
    assert all(r["n"] == r["last"] + 1 and r["late"] == 0 for r in rows)
    assert max(r["off"] for r in rows) < (4 if rare else 2)


@pytest.mark.parametrize("weights", [[5, 3, 2], [1000, 1, 1], [7] * 30])
def test_served_blocks_never_fall(weights):
    for rare in (0, 1, 3):
        rows = [op7_mix.served(weights, rare, j * 4096) for j in range(300)]
        total = sum(weights) + rare
        for j, (a, b) in enumerate(zip(rows, rows[1:])):
            assert sum(a) == j * 4096 and all(x <= y for x, y in zip(a, b))
            assert all(abs(x - j * 4096 * w / total) < 1.5 for x, w in zip(a, [*weights, rare]))


def edited_copies(length, rate, n, seed):
    """An item and copies with random words replaced, left out and put in, each between other words."""
    rng = random.Random(seed)
    item = [f"w{seed}x{k}" for k in range(length)]
    out = []
    for c in range(n):
        words = []
        for k, w in enumerate(item):
            at = rng.random()
            words += [w] if at >= rate else [[f"r{c}x{k}"], [], [w, f"i{c}x{k}"]][0 if at < 0.7 * rate else 1 if at < 0.85 * rate else 2]
        out.append([f"a{c}x{k}" for k in range(30)] + words + [f"b{c}x{k}" for k in range(30)])
    return item, out


def test_edited_copies_are_found_as_by_all_alignments(spark):
    """Copies of 15 to 60 words with 20 to 30 % of the words edited, against the alignment of every copy with its item."""
    items, docs, want, at = [], [], {}, 0
    for i, (length, rate) in enumerate((n, r) for n in (15, 20, 30, 60) for r in (0.2, 0.25, 0.3)):
        item, copies = edited_copies(length, rate, 300, i)
        items.append((i, " ".join(item)))
        ids = {w: k for k, w in enumerate(item)}
        for words in copies:
            best, _ = op10_decontaminate.align(np.array([ids.get(w, -1) for w in words]), np.arange(length))
            if best >= length:
                want[at] = i
            docs.append((at, " ".join(words)))
            at += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in op10_decontaminate.find_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got.items()) <= set(want.items())
    for length in range(4):
        due = [d for d, i in want.items() if i // 3 == length]
        found = sum(d in got for d in due)
        print("words", (15, 20, 30, 60)[length], "due", len(due), "found", found)
        assert len(due) > 400 and found >= (0.98 if length == 0 else 0.995) * len(due)


def test_common_seeds_find_their_item(spark):
    """Every document holds the item's seeds: none is too common, and a long item beside a short one widens no other alignment."""
    item = "the end of the day is a place where all of the others meet"
    long_item = " ".join(f"z{k}" for k in range(30_000))
    docs = [(d, f"start {d} {item} stop {d} " + " ".join(f"n{d}x{k}" for k in range(50))) for d in range(200)] + [(999, "the end of the day is another thing and nobody meets")]
    found = op10_decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, long_item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"], r["start_word"], r["end_word"]) for r in found) == [(d, 1, 1.0, 2, 16) for d in range(200)]
