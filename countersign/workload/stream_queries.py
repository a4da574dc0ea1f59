"""Queries that run the pipeline as a stream over the whole mail and read back what it wrote."""
from __future__ import annotations

from pyspark.sql import functions as F

from countersign import schemas
from countersign.operators import mountain as MT
from countersign.session import checkpointed
from countersign.streaming import live
from countersign.workload import fixtures as fx
from countersign.workload.job_queries import scratch
from countersign.workload.registry import ORACLES, query


def _deliveries(spark, sf):
    """The mail as two deliveries, the older one first."""
    mail = fx.mail(spark, sf)
    early = F.col("received_at") < F.lit("2024-01-16").cast("timestamp")
    return mail.filter(early), mail.filter(~early)


def _land(delivery, root):
    delivery.write.mode("append").parquet(f"{root}/in")


@query("t7_route_stream", ORACLES["r1_route_counts"])
def t7(spark, sf):
    root = scratch(spark)
    deliveries = _deliveries(spark, sf)
    for delivery in deliveries:
        _land(delivery, root)
    stream = live.route_stream(live.read_mail_stream(spark, f"{root}/in", schema=deliveries[0].schema)).select("mail_id", "route")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start(
        f"{root}/out"
    ).awaitTermination()
    return spark.read.schema("mail_id bigint, route string").parquet(f"{root}/out").groupBy("route").agg(F.count("*").alias("n"))


def _streamed(spark, sf):
    """The store that the stream leaves behind.

    The stream runs once for each delivery and takes it as one micro-batch, into however many files it was written: a batch of one
    file would be thousands of batches of larger mail, and would cut a delivery across its order of arrival.
    """
    root = scratch(spark)
    live.seed_state(fx.coord_events(spark, sf), f"{root}/state")
    for delivery in _deliveries(spark, sf):
        _land(delivery, root)
        stream = live.read_mail_stream(spark, f"{root}/in", schema=delivery.schema)
        live.start_ingest(stream, f"{root}/state", fx.DOMAIN).awaitTermination()
    return live.open_store(spark, f"{root}/state")


@query("t1_ingest_stream", ORACLES["c01_ingest_ledger"])
def t1(spark, sf):
    return _streamed(spark, sf).read("ledger").select("event_id", "sequence", "step_id", "trust_level", "sender_hash", "message_id_hash")


@query("t2_stream_state", ORACLES["c01_ingest_decisions"])
def t2(spark, sf):
    store = _streamed(spark, sf)
    crypto = store.read("events").filter("type = 'crypto'").select(F.col("id").alias("event_id"))
    return store.read("ledger").join(crypto, "event_id", "left_semi").select("event_id", "sequence", "counted", "count_reason")


_LAST = ORACLES["c01_ingest_ledger"]


@query("a09_live_heads", f"select event_id, max(sequence) as last from ({_LAST}) group by event_id")
def a09(spark, sf):
    """Where each event's ledger ends, as the stream keeps it beside the state: no entry is read for it."""
    return _streamed(spark, sf).read("heads").filter("last > 0").select("event_id", "last")


@query("t5_one_copy", f"select event_id, count(*) as entries, max(sequence) as last, 1 as tries_seen from ({_LAST}) group by event_id")
def t5(spark, sf):
    """A first try that fails behind half of its writes, then the same micro-batch twice: readers see nothing of the first and one copy of the rest."""
    root = scratch(spark)
    mail = fx.mail(spark, sf)
    live.seed_state(fx.coord_events(spark, sf), root)
    store = live.open_store(spark, root)
    work = live.ingest_mail(store, mail, fx.DOMAIN)

    write, names = store.write, []

    def failing(name, rows, version, level=0):
        names.append(name)
        if len(names) > 5:
            raise OSError("lost")
        return write(name, rows, version, level)

    store.write = failing
    try:
        store.advance("mail", 0, work)
    except OSError:
        store.write = write
    seen_before = store.read("ledger").count()
    for _ in range(2):
        store.advance("mail", 0, work)
    entries = store.read("ledger").groupBy("event_id").agg(F.count("*").alias("entries"), F.max("sequence").alias("last"))
    return entries.withColumn("tries_seen", F.lit(1 + seen_before).cast("int"))


@query("s09_state_store", "select coord_id as event_id, case when k % 4 = 0 then 'third' when k % 2 = 0 then 'second' when k % 5 <> 0 then 'Plan ' || k end as title, case when k % 2 = 0 then 2 else 1 end as tries from (" + fx.with_clause("fb") + "select * from fb) where k % 3 <> 0")
def s09_store(spark, sf):
    """Records in three versions, each writing what it changed, then some removed; levels merged in between."""
    store = live.open_store(spark, scratch(spark))
    ev = checkpointed(fx.coord_events(spark, sf))
    k = F.substring("id", 2, 9).cast("int")
    store.advance("s", 0, lambda head: {"events": ev})
    store.advance("s", 1, lambda head: {"events": ev.filter(k % 2 == 0).withColumn("title", F.lit("second"))})
    store.merge("events", 2)
    store.advance("s", 2, lambda head: {"events": ev.filter(k % 4 == 0).withColumn("title", F.lit("third"))})
    store.advance("s", 2, lambda head: {"events": ev.withColumn("title", F.lit("a repeated number does nothing"))})
    store.advance("s", 3, lambda head: {"events": ev.filter(k % 3 == 0).withColumn("_deleted", F.lit(True))})
    return store.read("events").select(F.col("id").alias("event_id"), "title", F.when(k % 2 == 0, 2).otherwise(1).alias("tries"))


@query("t4_live_calls", f"""with base as ({_LAST.replace("'sha256:' || sha256('salt-' || event_id || '|m' || mail_id || '@mail.example') as message_id_hash", "mail_id, received_at")}),
ed as (select 'c' || user_id % 60 as event_id from events where user_id % 60 in (5, 27, 49) group by 1),
lt as (select ed.event_id, (select count(*) from base where base.event_id = ed.event_id and received_at < timestamp '2024-01-16') as n from ed)
select base.event_id, 'reply' as kind, sequence + case when lt.event_id is not null and received_at >= timestamp '2024-01-16' then 1 else 0 end as sequence, null as changed, null as reason
 from base left join lt on lt.event_id = base.event_id
union all select event_id, 'event_edit', n + 1, 'title', 'new name' from lt""")
def t4(spark, sf):
    """Two deliveries of mail with organiser calls between them: events that only their organiser completes get a new title. One of the
    five is archived and one not active, so three calls make an entry; the mail behind them is numbered after it."""
    root = scratch(spark)
    mail = fx.mail(spark, sf)
    live.seed_state(fx.coord_events(spark, sf), root)
    early = F.col("received_at") < F.lit("2024-01-16").cast("timestamp")
    live.mail_micro_batch(root, fx.DOMAIN)(mail.filter(early), 0)
    live.call_micro_batch(root, fx.DOMAIN)(_titles(spark, sf), 0)
    live.mail_micro_batch(root, fx.DOMAIN)(mail.filter(~early), 1)
    ledger = live.open_store(spark, root).read("ledger")
    return ledger.select("event_id", "kind", "sequence", F.get("change.changes", F.lit(0))["field"].alias("changed"), F.col("change.reason").alias("reason"))


def _titles(spark, sf):
    k = F.substring("id", 2, 9).cast("int")
    ev = fx.coord_events(spark, sf).filter(k % 11 == 5)
    values = {"action_id": F.concat(F.lit("t-"), "id"), "event_id": F.col("id"), "at": F.lit("2024-01-16").cast("timestamp"), "action": F.lit("edit"), "reason": F.lit("new name"), "title": F.concat(F.lit("Retitled "), "id")}
    return ev.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ACTIONS.fields])


@query("w6_live_states", "select event_id, max(sequence) as entries, true as holds from (" + _LAST + ") group by event_id")
def w6_live(spark, sf):
    """The last root that the stream stored for each event, against one built from the whole ledger."""
    store = _streamed(spark, sf)
    last = store.read("states").groupBy("event_id").agg(F.max_by(F.struct("entries", "root"), "state").alias("s")).select("event_id", "s.*")
    _, peaks = MT.extend(None, MT.leaves(store.read("ledger")))
    now = MT.roots(peaks).select("event_id", F.col("root").alias("again"))
    return last.join(now, "event_id").select("event_id", "entries", (F.col("root") == F.col("again")).alias("holds"))
