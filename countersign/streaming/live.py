"""The pipeline over Structured Streaming: mail, organiser calls and timed passes on one state.

Every micro-batch is one commit of a `Store`: ledger, outbox, records, signatures, digests and whatever else it yields become visible
together. It reads the buckets of the events that its rows name and writes the rows it changed; numbers, tallies and
digests go on from one row an event (`heads`), so no old entry is read, but where mail asks for verification.

Mail, calls and clock ticks are streams of their own that commit to the same store. Each commit checks that nobody took its version and
otherwise works again on the newer state, so their order is the order of the versions. Inside a micro-batch arrival order is
`(received_at, mail_id)`; there is no watermark, and repeated deliveries stay two entries.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign import schemas
from countersign.operators import anchor as A
from countersign.operators import ledger as LG
from countersign.operators import lifecycle as L
from countersign.operators import mountain as MT
from countersign.operators import notify as N
from countersign.operators import sweep as S
from countersign.operators.routing import route
from countersign.plans.ingest import ingest_batch, tagged_mail
from countersign.plans.replay import replay
from countersign.session import checkpointed
from countersign.sources import tables
from countersign.sources.store import Manifest, Store, Table, buckets_of

T = schemas.T
_ENTRY_NODE = schemas._struct(event_id=schemas.S, height=schemas.I, index=schemas.L, digest=schemas.S)
_RESULTS = "mail_id string, routed boolean, mode string, event_id string, step_id string, trust_level string, committed_seq bigint, counted boolean, reason string, event_complete boolean, command string, bounce boolean, rejected boolean"
_REVERIFIED = (
    "request_id string, received_at timestamp, event_id string, target_sequence bigint, reverify_sequence bigint, found boolean, upgraded boolean, trust_level_before string, "
    "trust_level_after string, policy_note string, dkim_ok boolean, dkim_reason string, raw_sha256 string, raw_size bigint, evidence_matches boolean, reason string"
)
_KEYS = "event_id string, sequence bigint, received_at timestamp, domain string, selector string, lookup string, base64 string, pem string, fetched_at timestamp, error string"


_KINDS = {"string": schemas.S, "boolean": schemas.B, "int": schemas.I, "bigint": schemas.L, "timestamp": schemas.TS}


def _ddl(text: str) -> T.StructType:
    """A schema of plain columns; no session is needed for it."""
    return schemas._struct(**{name: _KINDS[kind] for name, kind in (c.split() for c in text.split(","))})


TABLES = {
    "events": Table(schemas.COORD_EVENTS, ("id",), "id"),
    "signatures": Table(schemas.SIGNATURES, ("event_id", "sender_hash", "commit_sequence"), "event_id", "commit_sequence"),
    "heads": Table(schemas.HEADS, ("event_id",), "event_id"),
    "ledger": Table(schemas.LEDGER, (), "event_id", "sequence"),
    "nodes": Table(_ENTRY_NODE, (), "event_id", "index"),
    "states": Table(_ddl("event_id string, state bigint, entries bigint, root string"), (), "event_id"),
    "completions": Table(schemas.COMPLETIONS, (), "event_id"),
    "outbox": Table(schemas.OUTBOX),
    "send_errors": Table(_ddl("event_id string, step_id string, reason string, code string, at timestamp"), (), "event_id"),
    "reverified": Table(_ddl(_REVERIFIED), (), "event_id"),
    "keys": Table(_ddl(_KEYS), (), "event_id", "sequence"),
    "results": Table(_ddl(_RESULTS)),
    "proofs": Table(_ddl("event_id string, base string, ots_anchored boolean, ots_anchored_at timestamp, ots_block bigint"), ("event_id", "base"), "event_id"),
    "calls": Table(_ddl("action_id string, event_id string, at timestamp, action string, applied boolean, reason string"), (), "event_id"),
}


def open_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES)


def read_mail_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, schema=schemas.MAIL) -> DataFrame:
    """T1 source: parquet files of `mail` rows as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def route_stream(mail: DataFrame) -> DataFrame:
    """T7. Stateless screening and routing; append mode, no state store."""
    return route(mail)


def seed_state(events: DataFrame, root: str, signatures: DataFrame | None = None) -> None:
    """Commit the first version of the state: event records and the signatures they hold."""
    open_store(events.sparkSession, root).advance("seed", 0, lambda head: {"events": events, "signatures": signatures})


def _changed(after: DataFrame, before: DataFrame) -> DataFrame:
    return L.latest_state_rows(after, tables.mirror_digests(before)).drop("digest")


def _appended(entries: DataFrame, heads: DataFrame, ends: DataFrame, version: int) -> dict[str, DataFrame]:
    """W6 at append: entries, their digests joined to the stored peaks, and the new heads."""
    stored = heads.select("event_id", F.inline("peaks"))
    nodes, peaks = MT.extend(stored, MT.leaves(entries))
    nodes, peaks = checkpointed(nodes), checkpointed(peaks)
    per_event = peaks.groupBy("event_id").agg(F.collect_list(F.struct("height", "index", "digest")).alias("_new"))
    old = heads.select("event_id", "peaks")
    ends = ends.join(old, "event_id", "left").join(per_event, "event_id", "left")
    return {
        "ledger": entries,
        "nodes": nodes,
        "states": MT.roots(peaks).withColumn("state", F.lit(version).cast("long")),
        "heads": ends.select("event_id", "last", "reverify_last", "receipts", F.coalesce("_new", "peaks").alias("peaks")),
    }


def ingest_mail(store: Store, mail: DataFrame, domain: str, dns_txt: DataFrame | None = None, verdicts: DataFrame | None = None) -> Callable[[Manifest], dict[str, DataFrame | None]]:
    """T1/T2. What a micro-batch of mail changes, given the version it works on."""

    def work(head: Manifest) -> dict[str, DataFrame | None]:
        if not head.segments.get("events"):
            raise ValueError(f"no event records under {store.root}; call seed_state first")
        tagged = checkpointed(tagged_mail(mail))
        near = buckets_of(tagged)
        requests = buckets_of(tagged.filter(F.col("route").isin("verify", "reverify")))
        events, signed, heads = (checkpointed(store.read(t, head, near)) for t in ("events", "signatures", "heads"))
        done = ingest_batch(
            mail, events, domain, ledger=store.read("ledger", head, requests), signatures=signed, verdicts=verdicts, dns_txt=dns_txt, heads=heads, tagged=tagged
        )
        entries = checkpointed(done.ledger)
        return {
            **_appended(entries, heads, done.heads, head.version + 1),
            "events": _changed(done.events, events),
            "signatures": done.signatures,
            "completions": done.completions,
            "outbox": done.outbox,
            "send_errors": done.send_errors,
            "reverified": done.reverified,
            "results": done.results,
            "keys": done.keys,
        }

    return work


def apply_calls(store: Store, actions: DataFrame, domain: str) -> Callable[[Manifest], dict[str, DataFrame | None]]:
    """T4. What a micro-batch of organiser calls (activate, edit, complete, reopen) changes: records, signatures taken back, entries of
    calls that the ledger keeps, and notices to whoever is asked for the first time."""

    def work(head: Manifest) -> dict[str, DataFrame | None]:
        calls = checkpointed(actions)
        spark, near = calls.sparkSession, buckets_of(calls)
        events, signed, heads = (checkpointed(store.read(t, head, near)) for t in ("events", "signatures", "heads"))
        nobody = spark.createDataFrame([], _REPLIES)
        h = replay(events, nobody, calls, signatures=signed, last=heads.select("event_id", "last"))
        after, entries = checkpointed(h.events), checkpointed(h.entries.withColumn("schema_version", F.lit(2)))
        entries = _as_ledger(entries)
        on = ["event_id", "sender_hash", "commit_sequence"]
        gone = signed.join(h.signatures.select(*on), on, "left_anti").withColumn("_deleted", F.lit(True))
        fresh = after.join(events.filter("activated_at is null").select("id"), "id", "left_semi").filter("activated_at is not null")
        moved = h.changes.filter("field = 'participant'").select("action_id", "event_id", "step_id", "field").join(calls.select("action_id", "at"), "action_id")
        now = after.select(F.col("id").alias("event_id"), F.inline("steps")).select("event_id", F.col("id").alias("step_id"), F.col("participant").alias("to"))
        reassigned = N.reassigned_notices(moved.join(now, ["event_id", "step_id"]).withColumn("cause", F.col("action_id").cast("string")), after)
        notices = N.activation_notices(fresh).unionByName(reassigned, allowMissingColumns=True)
        return {
            **_appended(entries, heads, LG.heads_after(heads, entries), head.version + 1),
            "events": _changed(after, events),
            "signatures": gone,
            "completions": h.completions,
            "outbox": N.compose(notices, domain),
            "calls": h.calls,
        }

    return work


def apply_tick(store: Store, now: str, domain: str, overdue_days: float = S.OVERDUE_DAYS, archive_days: float = S.ARCHIVE_DAYS) -> Callable[[Manifest], dict[str, DataFrame | None]]:
    """T4/C7. A timed pass over all records: nudges and archiving, each noted on the record in the same commit as its notice."""

    def work(head: Manifest) -> dict[str, DataFrame | None]:
        events = checkpointed(store.read("events", head))
        due = S.sweep(events, now, overdue_days, archive_days)
        return {"events": _changed(S.apply_sweep(events, now, overdue_days, archive_days), events), "outbox": N.compose(S.sweep_notices(due, now), domain)}

    return work


def apply_proofs(store: Store, proofs: DataFrame, now: str, domain: str) -> Callable[[Manifest], dict[str, DataFrame | None]]:
    """T4/C8. A pass of proof results (`anchor_rollup`): the records they anchor, the once-only flag on events that are anchored as a whole,
    and the notice of it, in one commit. `proofs` holds all results of the events it names."""

    def work(head: Manifest) -> dict[str, DataFrame | None]:
        given, at = checkpointed(proofs), F.lit(now).cast("timestamp")
        near = buckets_of(given)
        events = checkpointed(store.read("events", head, near))
        records = given.select("event_id", "base").distinct().join(store.read("proofs", head, near), ["event_id", "base"], "left")
        records = checkpointed(records)
        rollup = checkpointed(A.anchor_rollup(given, records, events, at))
        return {
            "proofs": A.anchor_patches(given, records, at),
            "events": _changed(A.mark_notified(events, rollup, at), events),
            "outbox": N.compose(A.anchor_notices(rollup, at), domain),
        }

    return work


_REPLIES = "event_id string, mail_id string, received_at timestamp, mode string, step_id string, sender string, trust_level string, message_id string, attachments array<struct<filename:string,size:bigint,sha256:string>>"


def _as_ledger(entries: DataFrame) -> DataFrame:
    have = set(entries.columns)
    return entries.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.LEDGER.fields])


def mail_micro_batch(root: str, domain: str, dns_txt: DataFrame | None = None, verdicts: DataFrame | None = None, stream: str = "mail") -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body for mail."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store = open_store(batch.sparkSession, root)
        store.advance(stream, batch_id, ingest_mail(store, batch, domain, dns_txt, verdicts))
        tidy(store)

    return step


def call_micro_batch(root: str, domain: str, stream: str = "calls") -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body for organiser calls (`schemas.ACTIONS`)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store = open_store(batch.sparkSession, root)
        store.advance(stream, batch_id, apply_calls(store, batch, domain))
        tidy(store)

    return step


def tick(spark: SparkSession, root: str, number: int, now: str, domain: str, **days: float) -> None:
    """One timed pass; a pass of a number that is committed does nothing."""
    store = open_store(spark, root)
    store.advance("ticks", number, apply_tick(store, now, domain, **days))


def anchor(spark: SparkSession, root: str, number: int, proofs: DataFrame, now: str, domain: str) -> None:
    """One pass over proof results."""
    store = open_store(spark, root)
    store.advance("anchors", number, apply_proofs(store, proofs, now, domain))


def tidy(store: Store) -> None:
    """Merge full levels of segments."""
    for name in store.tables:
        store.merge(name)


def start_ingest(mail: DataFrame, root: str, domain: str, available_now: bool = True, dns_txt: DataFrame | None = None, verdicts: DataFrame | None = None):
    """T1-T6. Start the stateful pipeline for mail."""
    writer = mail.writeStream.foreachBatch(mail_micro_batch(root, domain, dns_txt, verdicts)).option("checkpointLocation", f"{root}/_progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_calls(actions: DataFrame, root: str, domain: str, available_now: bool = True):
    """T4. Start the stream of organiser calls beside it."""
    writer = actions.writeStream.foreachBatch(call_micro_batch(root, domain)).option("checkpointLocation", f"{root}/_calls")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
