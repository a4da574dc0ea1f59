"""The versioned store, and digests that grow with the ledger."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from countersign import schemas
from countersign.operators import mountain as MT
from countersign.sources.store import Conflict, Store, Table, buckets_of
from countersign.streaming import live
from countersign.workload import fixtures as fx
from tests.conftest import rows

NUMBERS = Table(schemas._struct(id=schemas.S, n=schemas.L), ("id",), "id")
LOG = Table(schemas._struct(id=schemas.S, n=schemas.L), (), "id")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/{uuid.uuid4().hex}", {"numbers": NUMBERS, "log": LOG}, buckets=8)


def values(spark, pairs):
    return spark.createDataFrame(list(pairs), "id string, n bigint")


def test_newest_row_of_a_key_and_no_others(spark, store):
    many = [(f"k{i}", i) for i in range(40)]
    store.advance("s", 0, lambda head: {"numbers": values(spark, many), "log": values(spark, many)})
    store.advance("s", 1, lambda head: {"numbers": values(spark, [("k1", 100)]), "log": values(spark, [("k1", 100)])})
    assert dict(rows(store.read("numbers"))) == {**dict(many), "k1": 100}
    assert rows(store.read("log").filter("id = 'k1'")) == [("k1", 1), ("k1", 100)]
    # A batch of one row wrote one bucket, and a reader of it opens no other file.
    near = buckets_of(values(spark, [("k1", 0)]), "id", 8)
    files = store.read("numbers", buckets=near).inputFiles()
    assert len(files) == 2 and all(f"bucket={near[0]}/" in f for f in files)
    # Earlier versions stay readable.
    assert dict(rows(store.read("numbers", store.at(0)))) == dict(many)


def test_a_number_is_committed_once(spark, store):
    for _ in range(2):
        store.advance("s", 5, lambda head: {"log": values(spark, [("a", 1)])})
    store.advance("s", 5, lambda head: {"log": values(spark, [])})
    store.advance("s", 4, lambda head: {"log": values(spark, [("late", 1)])})
    assert rows(store.read("log")) == [("a", 1)] and store.head().version == 0


@pytest.mark.parametrize("writes", [0, 1])
def test_nothing_of_a_failed_batch_is_seen(spark, store, writes):
    store.advance("s", 0, lambda head: {"log": values(spark, [("a", 1)]), "numbers": values(spark, [("a", 1)])})
    write, done = store.write, []

    def failing(name, *rest, **options):
        if len(done) == writes:
            raise OSError("lost")
        done.append(name)
        return write(name, *rest, **options)

    store.write = failing
    with pytest.raises(OSError):
        store.advance("s", 1, lambda head: {"log": values(spark, [("b", 2)]), "numbers": values(spark, [("b", 2)])})
    store.write = write
    assert rows(store.read("log")) == rows(store.read("numbers")) == [("a", 1)]
    # An empty second try leaves nothing of the first.
    store.advance("s", 1, lambda head: {"log": values(spark, []), "numbers": values(spark, [])})
    assert rows(store.read("log")) == rows(store.read("numbers")) == [("a", 1)]
    store.expire(keep=1)
    assert rows(store.read("log")) == [("a", 1)] and len(store.files.names(f"{store.root}/log")) == 1


def test_who_comes_second_works_again(spark, store):
    store.advance("s", 0, lambda head: {"numbers": values(spark, [("sum", 1)])})
    seen = []

    def add(head):
        total = store.read("numbers", head).first()["n"]
        seen.append(total)
        if len(seen) == 1:  # another stream commits while this one works
            store.advance("other", 0, lambda h: {"numbers": values(spark, [("sum", 10)])})
        return {"numbers": values(spark, [("sum", total + 5)])}

    store.advance("s", 1, add)
    assert seen == [1, 10] and rows(store.read("numbers")) == [("sum", 15)]
    with pytest.raises(Conflict):
        store.files.put_new(f"{store.root}/_manifest/v{0:012d}.json", "{}")


def test_levels_merge(spark, store):
    """Thirty small batches leave a few segments; a removed key stays removed until nothing older is left, and then goes."""
    want = {}
    for i in range(10):
        gone = i % 5 == 4
        want[f"k{i % 3}"] = None if gone else i
        store.advance("s", i, lambda head, i=i, gone=gone: {"numbers": values(spark, [(f"k{i % 3}", i)]).withColumn("_deleted", F.lit(gone)), "log": values(spark, [("x", i)])})
        store.merge("numbers", 3)
        store.merge("log", 3)
    assert dict(rows(store.read("numbers"))) == {k: v for k, v in want.items() if v is not None}
    assert rows(store.read("log"), "n") == [(i,) for i in range(10)]
    held = store.head().segments
    assert all(sum(s.level == v for s in held[t]) < 3 for t in held for v in range(4)) and max(s.level for s in held["log"]) == 2


# --- digests ---


def digests(spark, counts, changed=()):
    return spark.createDataFrame([(e, 0, i, f"{e}-{i}{'!' if (e, i) in changed else ''}") for e, n in counts.items() for i in range(n)], "event_id string, height int, index bigint, digest string")


def root_of(peaks):
    return rows(MT.roots(peaks))


def test_any_cut_gives_the_same_root(spark):
    rng = random.Random(4)
    counts = {"one": 1, "edge": 256, "over": 257, "some": 40, "long": 1500}
    leaves = digests(spark, counts).cache()
    whole = root_of(MT.extend(None, leaves)[1])
    assert [r[:2] for r in whole] == sorted(counts.items())
    cuts = {e: sorted(rng.sample(range(n + 1), min(n, 4))) for e, n in counts.items()}
    peaks = None
    for part in range(5):
        low = F.lit(0)
        bounds = {e: ([0, *c, n] + [n] * 5)[part : part + 2] for (e, n), c in zip(counts.items(), cuts.values())}
        mine = F.lit(False)
        for e, (low, high) in bounds.items():
            mine |= (F.col("event_id") == e) & (F.col("index") >= low) & (F.col("index") < high)
        nodes, fresh = MT.extend(peaks, leaves.filter(mine))
        touched = fresh.select("event_id").distinct()
        peaks = fresh if peaks is None else fresh.unionByName(peaks.join(touched, "event_id", "left_anti"))
        peaks = spark.createDataFrame(peaks.collect(), peaks.schema)
    assert root_of(peaks) == whole and peaks.count() < 60


@pytest.mark.parametrize(("start", "end"), [(0, 1), (0, 16), (0, 4113), (5, 5), (5, 7), (15, 17), (16, 272), (100, 5000), (4095, 4097)])
def test_cover_is_complete_and_without_overlap(spark, start, end):
    spans = spark.createDataFrame([("e", start, end)], "event_id string, start bigint, entries bigint")
    got = sorted((r["index"] * 16 ** r["height"], (r["index"] + 1) * 16 ** r["height"]) for r in MT.cover(spans).collect())
    at = start
    for a, b in got:
        assert a == at
        at = b
    assert at == end and len(got) <= 15 * 2 * 4


def test_growth_needs_no_entries(spark):
    counts = {"a": 900, "b": 900, "c": 900}
    nodes, peaks = MT.extend(None, digests(spark, counts))
    newer = MT.roots(peaks)
    older = MT.roots(MT.extend(None, digests(spark, {e: 300 for e in counts}))[1])
    pairs = older.select("event_id", F.col("entries").alias("start")).join(newer.select("event_id", "entries"), "event_id")
    proof = MT.growth_proof(nodes, pairs)
    assert proof.count() < 3 * 60 and {r["problem"] for r in MT.check_growth(proof, older, newer).collect()} == {None}
    # An entry that both roots count is changed and the newer root made anew: the old one no longer follows. One that only the newer counts: likewise.
    forged, top = MT.extend(None, digests(spark, counts, changed=[("a", 10), ("b", 500)]))
    found = {r["event_id"]: r["problem"] for r in MT.check_growth(MT.growth_proof(forged, pairs), older, MT.roots(top)).collect()}
    assert found == {"a": "older", "b": None, "c": None}
    found = {r["event_id"]: r["problem"] for r in MT.check_growth(MT.growth_proof(forged, pairs), older, newer).collect()}
    assert found == {"a": "older", "b": "newer", "c": None}
    lost = nodes.filter("not (event_id = 'c' and index * power(16, height) >= 512)")
    assert {r["event_id"]: r["problem"] for r in MT.check_growth(MT.growth_proof(lost, pairs), older, newer).collect()}["c"] == "missing"


# --- timed passes ---


def test_ticks_and_anchors_write_the_live_state(spark, tmp_path):
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    ev = fx.coord_events(spark, "/root/testdata/sf0.001")
    live.seed_state(ev, root)
    store = live.open_store(spark, root)
    for _ in range(2):
        live.tick(spark, root, 0, "2024-03-15 06:00:00", fx.DOMAIN, archive_days=30)
    archived = store.read("events").filter("archive_reason = 'auto_stale'").count()
    sent = store.read("outbox")
    assert archived > 0 and sent.filter("kind = 'archived'").count() == archived and store.head().done["ticks"] == 0
    done = ev.filter("type = 'crypto'").first()["id"]
    store.advance("test", 0, lambda head: {"events": store.read("events", head).filter(F.col("id") == done).withColumn("status", F.lit("complete"))})
    proofs = spark.createDataFrame([(done, "commit-001", True, True, False, None, 7), (done, "completion", True, False, False, None, 8)], "event_id string, base string, anchored boolean, changed boolean, pending boolean, error string, block_height bigint")
    for number in (0, 1):
        live.anchor(spark, root, number, proofs, "2024-04-01 00:00:00", fx.DOMAIN)
    assert rows(store.read("proofs"), "base", "ots_block") == [("commit-001", 7), ("completion", 8)]
    told = store.read("events").filter("ots_proof_anchored_notified_at is not null")
    assert rows(told, "id") == [(done,)] and store.read("outbox").filter("kind = 'proof_anchored'").count() == 1
    assert told.first()["ots_proof_anchored_notified_at"] == dt.datetime(2024, 4, 1)
