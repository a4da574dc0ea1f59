"""C1. One batch of inbound mail against the current state."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countersign.functions.hashing import pad_seq
from countersign.operators import bounce as B
from countersign.operators import commands as C
from countersign.operators import ledger as LG
from countersign.operators import notify as N
from countersign.operators import routing as R
from countersign.operators import verify as V
from countersign.operators.decide import Decision, decide
from countersign.operators.numbering import assign_sequence, running_sums
from countersign.session import checkpointed
from countersign.sources.mail import extract_candidates, parse_attachments


class Batch:
    """What one batch yields; every frame is lazy over the narrow routed rows."""

    def __init__(self, **frames: DataFrame):
        self.__dict__.update(frames)


SPREAD = 2  # tasks a core


def spread(mail: DataFrame) -> DataFrame:
    """The mail in even shares. A message takes a hundred microseconds to route, so files that are small as stored, of one row group, are
    minutes of work in a single task; dealing rows out by turns needs no key, so repeated or null ids cannot meet in one share."""
    return mail.repartition(SPREAD * mail.sparkSession.sparkContext.defaultParallelism)


def tagged_mail(mail: DataFrame) -> DataFrame:
    """Screen, route and grade: the one pass that reads `raw`; kept where the tag says that someone will read it."""
    tagged = F.col("event_id").isNotNull() & F.col("route").isin("bounce", "verify", "reverify", "event", "attest")
    # What nobody will read stays behind before the event join, not after it.
    return R.graded(R.route(spread(mail), keep_raw=True).withColumn("raw", F.when(tagged, F.col("raw"))))


def routed_mail(tagged: DataFrame, events: DataFrame) -> DataFrame:
    """Look up the event. Keeps `raw` for bounces, verification requests and replies that name a known event."""
    return R.known_events(tagged, events).withColumn("raw", F.when(F.col("known"), F.col("raw")))


def reply_rows(routed: DataFrame) -> DataFrame:
    """Replies to known events with their attachments; no message bytes left."""
    rows = routed.filter(F.col("known") & F.col("mode").isNotNull())
    return rows.drop("raw") if "attachments" in routed.columns else parse_attachments(rows)


def decide_replies(replies: DataFrame, events: DataFrame, ledger: DataFrame | None = None, signatures: DataFrame | None = None, activation: str = "log", base: DataFrame | None = None) -> Decision:
    """Number the replies behind the ledger's last entries, or behind `base(event_id, last)`, and decide each."""
    if base is None and ledger is not None:
        base = LG.last_sequence(ledger)
    return decide(assign_sequence(replies, base=base), events, signatures, activation)


def asked(routed: DataFrame, rows: DataFrame, base: DataFrame | None) -> DataFrame:
    """Commands and requests with their place among the replies of their event.

    `horizon` is the last number given before, `signed` and `receipts` how many of the batch's replies before it signed or counted:
    one order for mail of all kinds, by arrival and then id, as the numbers have it.
    """
    asks = routed.filter(F.col("known") & F.col("route").isin("stats", "remind", "verify", "reverify")).select("event_id", "received_at", "mail_id")
    replies = rows.join(asks.select("event_id").distinct(), "event_id", "left_semi").select("event_id", "received_at", "mail_id", "mode", "counted")
    marks = asks.withColumn("_ask", F.lit(True)).unionByName(replies.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    one = lambda c: F.when(c, 1).otherwise(0)
    placed = running_sums(
        marks, ["event_id"], "received_at", ["mail_id"],
        {"horizon": one(~F.col("_ask")), "signed": one(F.col("counted") & (F.col("mode") == "crypto")), "receipts": one(F.col("counted"))},
    ).filter("_ask").select("event_id", "mail_id", "horizon", "signed", "receipts").dropDuplicates(["event_id", "mail_id"])
    if base is None:
        return placed
    return placed.join(base.select("event_id", F.col("last").alias("_last")), "event_id", "left").withColumn(
        "horizon", F.col("horizon") + F.coalesce(F.col("_last"), F.lit(0))
    ).drop("_last")


def ingest_batch(
    mail: DataFrame,
    events: DataFrame,
    domain: str,
    ledger: DataFrame | None = None,
    signatures: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    reverify_log: DataFrame | None = None,
    activation: str = "log",
    cut: bool = True,
    dns_txt: DataFrame | None = None,
    heads: DataFrame | None = None,
    tagged: DataFrame | None = None,
) -> Batch:
    """Run the whole inbound pipeline over a batch.

    `mail`: schemas.MAIL, optionally with an `attachments` column that saves decoding. With `cut`
    the routed rows and the decided replies are written once to the checkpoint folder, so that
    the many outputs do not read the messages again. With `dns_txt(name, txt)` the key of each
    reply's picked signature is archived: `keys` holds it, or why there is none, and the entry
    names its file.

    `heads(event_id, last, reverify_last, receipts)` says where an earlier ledger ends, so that no entry is read for numbers or tallies; then
    `ledger` is only what verification looks at, and may be left to the events that are asked about. `tagged` is the mail
    if it went through `tagged_mail` before.
    """
    spark = mail.sparkSession
    hold = checkpointed if cut else (lambda df: df)
    # Records are joined a dozen times; written once, their size is known and the mail need not be shuffled to learn it.
    events = hold(events)
    routed = hold(routed_mail(tagged if tagged is not None else tagged_mail(mail), events))
    if heads is None and ledger is not None:
        heads = LG.heads(ledger, reverify_log)
    base = None if heads is None else heads.select("event_id", "last")
    d = decide_replies(hold(reply_rows(routed)), events, signatures=signatures, activation=activation, base=base)
    rows = hold(d.rows)
    locks = hold(d.locks)
    keys = None if dns_txt is None else hold(archived_keys(rows, dns_txt))
    entries = LG.build_reply_commits(rows if keys is None else with_key_files(rows, keys), events)
    new_signatures = LG.signature_rows(rows)
    after = LG.apply_decisions(events, rows, locks)
    completions = LG.completion_records(rows, locks, events)

    all_signatures = new_signatures if signatures is None else signatures.unionByName(new_signatures)
    whole = entries if ledger is None else ledger.unionByName(entries, allowMissingColumns=True)
    places = hold(asked(routed, rows, base))
    bounced = B.process_bounces(routed.filter("known and route = 'bounce'"), events)
    commands = routed.filter(F.col("route").isin("stats", "remind")).select(
        "mail_id", "received_at", "event_id", F.col("route").alias("command"), "sender", "trust_level"
    )
    # Commands see what the replies before them did, of this batch too.
    told = commands.select("mail_id", "event_id").join(places, ["mail_id", "event_id"])
    seen = C.seen_records(told, events, after, locks)
    if signatures is None:
        held = told.withColumn("signature_count", F.col("signed"))
    else:
        earlier = signatures.groupBy("event_id").agg(F.count("*").alias("_held"))
        held = told.join(earlier, "event_id", "left").withColumn("signature_count", F.col("signed") + F.coalesce("_held", F.lit(0)))
    seen = hold(seen.join(held.select("mail_id", "horizon", "signature_count"), "mail_id"))
    cmd = C.command_results(commands, events, seen)
    requests = routed.filter("known and route in ('verify', 'reverify')").join(places, ["event_id", "mail_id"]).select(
        F.col("mail_id").alias("request_id"), "received_at", "event_id", "route", "sender", "message_id", "horizon",
        F.col("commit_sequence").cast("bigint").alias("target_sequence"), "raw",
    )
    no_verdicts = spark.createDataFrame([], "raw_sha256 string, domain string, selector string, ok boolean, reason string")
    given = verdicts if verdicts is not None else no_verdicts
    # Decoded once for both kinds, whatever reads them.
    candidates = hold(extract_candidates(requests))
    # Requests see the entries that came before them, of this batch or an earlier one.
    verified = V.verify_candidates(candidates.filter("route = 'verify'"), whole, events, given, as_of=True)
    reverified = V.reverify(
        candidates.filter("route = 'reverify' and cand_pos = 0"), whole, events, given,
        None if heads is None else heads.select("event_id", F.col("reverify_last").alias("reverify_sequence")), as_of=True,
    )
    inquiries = candidates.select("request_id", "received_at", "sender").dropDuplicates(["request_id"])
    tallies = hold(LG.heads_after(heads, entries, reverified))
    notices = R.dispatch_results(
        N.transition_notices(rows, locks, after, tallies.select("event_id", F.col("receipts").alias("counted_commits"))),
        B.bounce_notices(bounced),
        C.stats_notices(cmd, C.stats_snapshot(seen.drop("horizon"))),
        C.remind_notices(cmd, seen.drop("signature_count"), all_signatures),
        report_notices(verified, inquiries, events, "verify_report"),
        report_notices(reverified, inquiries, events, "reverify_report"),
    )
    errors = B.latest_send_errors(bounced)
    return Batch(
        routed=routed.drop("raw"), rows=rows, locks=locks, ledger=entries, signatures=new_signatures, events=B.apply_send_errors(after, errors),
        completions=completions, send_errors=errors, bounced=bounced, commands=cmd,
        verified=verified, reverified=reverified, all_signatures=all_signatures,
        heads=tallies, keys=keys, outbox=N.compose(notices, domain), results=results(routed, rows, cmd, bounced),
    )


def report_notices(reports: DataFrame, asked: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """Answer whoever sent a verify or reverify request."""
    head = events.select(F.col("id").alias("event_id"), F.col("type").alias("event_type"), "title")
    seq = "sequence" if kind == "verify_report" else "target_sequence"
    df = reports.drop("received_at").join(asked, "request_id").join(head, "event_id")
    shared = ["event_id", "event_type", "title", F.col("received_at").alias("at"), F.col("request_id").cast("string").alias("cause"),
              F.col("sender").alias("to"), F.lit(kind).alias("kind"), F.col(seq).alias("sequence"), "reason", "dkim_ok", "dkim_reason"]
    if kind == "verify_report":
        return df.select(*shared, "matched", "match_type", "counted", "trust_level")
    return df.select(*shared, "found", "upgraded", F.col("trust_level_before").alias("trust_before"),
                     F.col("trust_level_after").alias("trust_after"))


def results(routed: DataFrame, rows: DataFrame, commands: DataFrame, bounced: DataFrame) -> DataFrame:
    """R3. One summary row per message of the batch."""
    text = lambda v: F.lit(v).cast("string")
    replies = rows.select(
        "mail_id", F.lit(True).alias("routed"), "mode", "event_id", "step_id", "trust_level",
        F.col("sequence").alias("committed_seq"), "counted", F.col("count_reason").alias("reason"),
        F.coalesce(F.col("sequence") == F.col("lock_seq"), F.lit(False)).alias("event_complete"), text(None).alias("command"),
    )
    cmd = commands.select("mail_id", F.lit(False).alias("routed"), "event_id", "command", "reason", "trust_level")
    rest = routed.filter(~F.col("route").isin("stats", "remind") & (F.col("mode").isNull() | ~F.col("known"))).select(
        "mail_id", F.lit(False).alias("routed"), "event_id", "step_id", "reason",
        F.when(F.col("route").isin("verify", "reverify"), F.col("route")).alias("command"),
        (F.col("route") == "bounce").alias("bounce"), (F.col("route") == "rejected").alias("rejected"),
    )
    return R.dispatch_results(replies, cmd, rest)


def archived_keys(rows: DataFrame, dns_txt: DataFrame) -> DataFrame:
    """J9 for a decided batch: the key of each reply's picked signature."""
    sigs = rows.filter(F.col("archive_signature").isNotNull()).select(
        "event_id", "sequence", "received_at",
        F.col("archive_signature.signingDomain").alias("domain"), F.col("archive_signature.selector").alias("selector"),
    )
    return V.archive_keys(sigs, dns_txt, F.col("received_at"))


def with_key_files(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Name the archived key's file on the replies that have one."""
    path = F.concat(F.lit("dkim_keys/commit-"), pad_seq("sequence"), F.lit(".pem"))
    files = keys.filter("pem is not null").select("event_id", "sequence", path.alias("dkim_key_file"))
    return rows.join(files, ["event_id", "sequence"], "left")


__all__ = ["Batch", "archived_keys", "decide_replies", "ingest_batch", "reply_rows", "results", "routed_mail", "tagged_mail", "with_key_files"]
