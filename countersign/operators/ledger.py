"""The append-only ledger: reply entries, completion records, and the digest tree over them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countersign import schemas
from countersign.functions.hashing import canonical_json, pad_seq, salted_message_id_hash
from countersign.operators.numbering import last_sequence  # noqa: F401  (A9, part of this module's surface)

# Entries per chained segment, and children per tree node. Sequences are unique, so no group
# below ever holds more rows than this.
SEGMENT = 256
# Levels of the digest tree at least; events past 256^(1 + 4) entries get as many as they need.
TREE_LEVELS = 4


def build_reply_commits(decided: DataFrame, events: DataFrame) -> DataFrame:
    """P38. Ledger rows of decided replies. Sender and subject never appear in plain text."""
    salts = events.select(F.col("id").alias("event_id"), F.col("salt").alias("_salt"))
    rows = decided.join(salts, "event_id", "left")
    have = set(decided.columns)

    def opt(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    summary = (lambda part: F.col(f"auth_summary.{part}")) if "auth_summary" in have else (lambda part: F.lit(None))
    values = {
        "schema_version": F.lit(2),
        "kind": F.lit("reply"),
        "event_id": F.col("event_id"),
        "step_id": F.nullif(F.col("step_id"), F.lit("")),
        "sequence": F.col("sequence"),
        "received_at": F.col("received_at"),
        "sender_hash": F.col("sender_hash"),
        "sender_domain": F.col("sender_domain"),
        "message_id_hash": salted_message_id_hash(opt("message_id").cast("string"), "_salt"),
        "trust_level": F.col("trust_level"),
        "participant_match": F.col("participant_match"),
        "counted": F.col("counted"),
        "count_reason": F.when(~F.col("counted"), F.col("count_reason")),
        "attachments": F.coalesce(F.col("attachments"), F.array().cast(schemas.LEDGER["attachments"].dataType)),
        "dkim": summary("dkim"),
        "spf": summary("spf"),
        "dmarc": summary("dmarc"),
        "arc": summary("arc"),
        "envelope": F.struct(
            (F.col("envelope.client_ip") if "envelope" in have else F.lit(None).cast("string")).alias("client_ip"),
            (F.col("envelope.client_helo") if "envelope" in have else F.lit(None).cast("string")).alias("client_helo"),
        ),
        "raw_sha256": opt("raw_sha256"),
        "raw_size": opt("raw_size"),
        "dkim_key_file": opt("dkim_key_file"),
    }
    return rows.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.LEDGER.fields]
    )


def read_ledger(ledger: DataFrame, event_ids: list[str] | None = None) -> DataFrame:
    """S4/O1. Entries in numeric sequence order, counted or not."""
    rows = ledger if event_ids is None else ledger.filter(F.col("event_id").isin(event_ids))
    return rows.orderBy("event_id", F.col("sequence").cast("bigint"))


def load_commit(ledger: DataFrame, event_id: str, sequence: int) -> DataFrame:
    """S5. One entry; the filter reaches the scan."""
    return ledger.filter((F.col("event_id") == event_id) & (F.col("sequence") == sequence))


def completion_records(rows: DataFrame, locks: DataFrame, events: DataFrame) -> DataFrame:
    """M11. The record of each event that a reply of this batch completed."""
    kinds = events.select(
        F.col("id").alias("event_id"), F.col("type").alias("event_type"),
        F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps"),
        F.when(F.col("threshold") >= 1, F.col("threshold")).otherwise(1).alias("threshold"),
    )
    edge = rows.join(locks.withColumnRenamed("lock_seq", "sequence"), ["event_id", "sequence"], "left_semi")
    return edge.drop("event_type").join(kinds, "event_id").select(
        "event_id",
        "event_type",
        F.col("received_at").alias("completed_at"),
        F.col("sequence").alias("triggering_commit_sequence"),
        F.when(F.col("mode") == "workflow", F.col("n_steps")).alias("steps_completed"),
        F.when(F.col("mode") == "crypto", F.col("threshold")).alias("threshold"),
        F.when(F.col("mode") == "crypto", F.col("nth")).alias("signatures"),
    )


def load_completion(completions: DataFrame) -> DataFrame:
    """S6. The current record per event: the highest version."""
    body = F.struct(*[F.col(c) for c in completions.columns if c not in ("event_id", "version")])
    return completions.groupBy("event_id").agg(F.max_by(body, "version").alias("r")).select("event_id", "r.*")


def supersede_completions(history: DataFrame, new: DataFrame) -> DataFrame:
    """M11. Append new records as the next version; a record equal to the current one is dropped."""
    body = [c for c in new.columns if c not in ("event_id", "version")]
    current = history.groupBy("event_id").agg(
        F.max("version").alias("_v"), F.max_by(F.struct(*body), "version").alias("_cur")
    )
    # Several new records of one event take following versions; an event has one per reopening.
    order = Window.partitionBy("event_id").orderBy("triggering_commit_sequence", "completed_at")
    fresh = (
        new.join(current, "event_id", "left")
        .filter(~F.coalesce(F.struct(*body).eqNullSafe(F.col("_cur")), F.lit(False)))
        .withColumn("_nth", F.row_number().over(order))
        .select("event_id", *body, (F.coalesce("_v", F.lit(0)) + F.col("_nth")).cast("int").alias("version"))
    )
    return history.select("event_id", *body, "version").unionByName(fresh)


def signature_rows(rows: DataFrame) -> DataFrame:
    """M4. The signatures that counted replies add, one row each."""
    return rows.filter(F.col("counted") & (F.col("mode") == "crypto")).select(
        "event_id",
        F.coalesce("sender_hash", F.lit("")).alias("sender_hash"),
        "sender_domain",
        F.col("sequence").alias("commit_sequence"),
        "received_at",
        "trust_level",
    )


def step_updates(rows: DataFrame) -> DataFrame:
    """M2. The steps that counted replies complete."""
    return rows.filter(F.col("counted") & (F.col("mode") == "workflow")).select(
        "event_id", "step_id", F.col("sequence").alias("commit_sequence")
    )


def apply_decisions(events: DataFrame, rows: DataFrame, locks: DataFrame) -> DataFrame:
    """M2/M4. Event records after a batch: completed steps, status, completed_at.

    Only counted workflow replies meet the records, at most one per step.
    """
    done = (
        step_updates(rows)
        .groupBy(F.col("event_id").alias("id"))
        .agg(F.map_from_entries(F.collect_list(F.struct("step_id", "commit_sequence"))).alias("_done"))
    )
    closing = (
        rows.join(locks.withColumnRenamed("lock_seq", "sequence"), ["event_id", "sequence"], "left_semi")
        .filter("counted")
        .groupBy(F.col("event_id").alias("id")).agg(F.min("received_at").alias("_closed_at"))
    )
    df = events.join(done, "id", "left").join(closing, "id", "left")
    seq = lambda s: F.try_element_at(F.col("_done"), s["id"])
    steps = F.transform(
        "steps",
        lambda s: s.withField("status", F.when(seq(s).isNotNull(), F.lit("complete")).otherwise(s["status"]))
        .withField("commit_sequence", F.coalesce(seq(s), s["commit_sequence"])),
    )
    closed = F.col("_closed_at").isNotNull()
    return df.withColumns(
        {
            "steps": F.when(F.col("_done").isNotNull(), steps).otherwise(F.col("steps")),
            "status": F.when(closed, F.lit("complete")).otherwise(F.col("status")),
            "completed_at": F.coalesce("_closed_at", "completed_at"),
        }
    ).select(*events.columns)


# --- tamper evidence -------------------------------------------------------------------------


def payload_digest(*columns: str) -> Column:
    """Digest of an entry's content in fixed column order."""
    return F.sha2(canonical_json(*columns), 256)


def _segment() -> Column:
    return F.floor((F.col("sequence") - 1) / SEGMENT)


def _seed(event_id: Column, segment: Column) -> Column:
    return F.sha2(F.concat_ws("|", event_id, segment.cast("string")), 256)


def build_hash_chain(ledger: DataFrame, payload: Column | str = "payload_digest") -> DataFrame:
    """W6. `(event_id, sequence, payload_digest, prev_digest, digest)`.

    Each digest covers the entry and its predecessor inside a segment of 256 entries;
    `digest_tree` then covers the segments, so a hot event chains in parallel.
    """
    p = F.col(payload) if isinstance(payload, str) else payload
    rows = ledger.select("event_id", "sequence", p.alias("payload_digest"), _segment().alias("segment"))
    grouped = rows.groupBy("event_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("sequence", "payload_digest"))).alias("entries")
    )
    seed = _seed(F.col("event_id"), F.col("segment"))

    def link(acc: Column, entry: Column) -> Column:
        prev = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.sha2(F.concat_ws("|", prev, entry["payload_digest"]), 256)))

    chained = grouped.select(
        "event_id", "segment", "entries", F.aggregate("entries", F.array(seed), link).alias("links")
    )
    return chained.select("event_id", "links", F.posexplode("entries").alias("i", "entry")).select(
        "event_id",
        F.col("entry.sequence").alias("sequence"),
        F.col("entry.payload_digest").alias("payload_digest"),
        F.get("links", F.col("i")).alias("prev_digest"),
        F.get("links", F.col("i") + 1).alias("digest"),
    )


def digest_tree(chain: DataFrame, levels: int = TREE_LEVELS) -> DataFrame:
    """W6. `(event_id, entries, root)`: one digest that commits to every entry of an event.

    All events get the levels that the longest one needs, `levels` at least.
    """
    last = (chain.agg(F.max("sequence")).first()[0] or 1) - 1
    while last >= SEGMENT ** (levels + 1):
        levels += 1
    nodes = chain.groupBy("event_id", _segment().alias("node")).agg(
        F.max_by("digest", "sequence").alias("digest"), F.count("*").alias("entries")
    )
    for _ in range(levels):
        nodes = (
            nodes.groupBy("event_id", F.floor(F.col("node") / SEGMENT).alias("node"))
            .agg(
                F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("kids"),
                F.sum("entries").alias("entries"),
            )
            .select(
                "event_id", "node", "entries",
                F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), "|"), 256).alias("digest"),
            )
        )
    return nodes.select("event_id", "entries", F.col("digest").alias("root"))


def verify_hash_chain(ledger: DataFrame, chain: DataFrame, payload: Column | str = "payload_digest") -> DataFrame:
    """W7. Entries of a stored chain that do not hold against the ledger as it is now.

    Problems: `missing` (chained but not in the ledger), `unchained`, `altered`, `broken_link`,
    `gap` (a sequence number is skipped).
    """
    p = F.col(payload) if isinstance(payload, str) else payload
    now = ledger.select("event_id", "sequence", p.alias("now_digest"))
    both = chain.withColumn("_stored", F.lit(True)).join(now, ["event_id", "sequence"], "full")
    w = Window.partitionBy("event_id", _segment()).orderBy("sequence")
    expected_prev = F.coalesce(F.lag("digest").over(w), _seed(F.col("event_id"), _segment()))
    expected_seq = F.coalesce(F.lag("sequence").over(w) + 1, _segment() * SEGMENT + 1)
    checked = both.select(
        "event_id", "sequence",
        F.col("_stored").isNotNull().alias("stored"),
        "now_digest", "payload_digest", "prev_digest", "digest",
        expected_prev.alias("expected_prev"), expected_seq.alias("expected_seq"),
    )
    relinked = F.sha2(F.concat_ws("|", F.col("expected_prev"), F.col("payload_digest")), 256)
    problem = (
        F.when(~F.col("stored"), "unchained")
        .when(F.col("now_digest").isNull(), "missing")
        .when(F.col("now_digest") != F.col("payload_digest"), "altered")
        .when((F.col("prev_digest") != F.col("expected_prev")) | (F.col("digest") != relinked), "broken_link")
        .when(F.col("sequence") != F.col("expected_seq"), "gap")
    )
    return checked.select("event_id", "sequence", problem.alias("problem")).filter("problem is not null")


# --- proofs and keys beside the ledger -------------------------------------------------------


def commit_base(kind: Column, sequence: Column) -> Column:
    """File stem a record and its proof share: commit-001, reverify-001, completion."""
    return (
        F.when(kind == "reverify", F.concat(F.lit("reverify-"), pad_seq(sequence)))
        .when(kind == "completion", F.lit("completion"))
        .otherwise(F.concat(F.lit("commit-"), pad_seq(sequence)))
    )


def pair_proofs(proofs: DataFrame, records: DataFrame) -> DataFrame:
    """S7. Proofs beside their sibling record by `(event_id, base)`; the record may be missing."""
    return proofs.join(records, ["event_id", "base"], "left")


def read_keys(keys: DataFrame, paths: DataFrame) -> DataFrame:
    """S12. Archived keys by their recorded path; anything but a key path reads NULL."""
    ok = F.col("dkim_key_file").rlike(r"^dkim_keys/commit-\d+\.pem$")
    wanted = paths.withColumn("_seq", F.when(ok, F.regexp_extract("dkim_key_file", r"(\d+)\.pem$", 1).try_cast("bigint")))
    have = keys.select("event_id", F.col("sequence").alias("_seq"), "pem")
    return wanted.join(have, ["event_id", "_seq"], "left").drop("_seq")


def heads(ledger: DataFrame, reverify_log: DataFrame | None = None) -> DataFrame:
    """A9. Where an event's ledger ends: `last` number, `reverify_last` and the number of `receipts` (counted replies)."""
    reply = (F.col("kind") == "reply") & F.col("counted")
    ends = ledger.groupBy("event_id").agg(F.max("sequence").alias("last"), F.count(F.when(reply, 1)).alias("receipts"))
    if reverify_log is None:
        return ends.withColumn("reverify_last", F.lit(0).cast("bigint"))
    told = reverify_log.groupBy("event_id").agg(F.max("reverify_sequence").alias("reverify_last"))
    return ends.join(told, "event_id", "full").select(
        "event_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("last", "receipts", "reverify_last")]
    )


def heads_after(before: DataFrame | None, entries: DataFrame, reverified: DataFrame | None = None) -> DataFrame:
    """A9. The heads of the events that new entries or reverify records touch, from the earlier heads and those rows alone."""
    fresh = heads(entries, reverified)
    if before is None:
        return fresh
    old = before.select("event_id", *[F.col(c).alias(f"_{c}") for c in ("last", "receipts", "reverify_last")])
    kept = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    return fresh.join(old, "event_id", "left").select(
        "event_id", F.greatest("last", kept("last")).alias("last"), (F.col("receipts") + kept("receipts")).alias("receipts"),
        F.greatest("reverify_last", kept("reverify_last")).alias("reverify_last"),
    )


# --- receipts and snapshots ------------------------------------------------------------------


def receipts(ledger: DataFrame) -> DataFrame:
    """A4. Counted replies as receipts, one row each."""
    return ledger.filter((F.col("kind") == "reply") & F.col("counted")).select(
        "event_id", "sequence", "received_at",
        F.nullif(F.col("step_id"), F.lit("")).alias("step_id"),
        F.nullif(F.col("sender_domain"), F.lit("")).alias("sender_domain"),
        F.nullif(F.col("sender_hash"), F.lit("")).alias("sender_hash"),
        F.nullif(F.col("trust_level"), F.lit("")).alias("trust_level"),
    )


def receipt_counts(ledger: DataFrame) -> DataFrame:
    """A4. `counted_commits` per event."""
    return receipts(ledger).groupBy("event_id").agg(F.count("*").alias("counted_commits"))
