"""Bulk matching of forwarded messages and documents against the ledger.

The ledger side of every match is reduced to one row per (event, hash) before the join, so many
copies of one document or message cost one key, on either side.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions.hashing import norm_hash, pad_seq, salted_message_id_hash, salted_sender_hash
from countersign.functions.keys import extract_public_key, to_pem
from countersign.functions.trust import pick_signer, resolve_upgrade
from countersign.operators.decide import _yes
from countersign.operators.numbering import assign_sequence

# fixed values: match kinds, strongest first
MATCH_KINDS = ("raw_email", "message_id", "attachment", "none")


def attachment_rows(ledger: DataFrame, *carried: str) -> DataFrame:
    """One row per attachment of a ledger entry, in order."""
    return ledger.select(
        "event_id", "sequence", *carried, F.posexplode("attachments").alias("att_pos", "att")
    ).select("event_id", "sequence", *carried, "att_pos", F.col("att.filename").alias("filename"), F.col("att.sha256").alias("sha256"))


def find_match(candidates: DataFrame, ledger: DataFrame, as_of: bool = False) -> DataFrame:
    """J7/O2. Adds `match_type` and `sequence`: whole message, then Message-ID, then attachment.

    `candidates`: event_id, raw_sha256, message_id_hash and any columns to carry. Within a tier
    the lowest sequence wins. With `as_of` a candidate has a `horizon`, the last number its event had when it
    was asked, and sees no entry behind it: if the lowest number with a hash lies behind, all do.
    """

    def lowest(rows: DataFrame, key: str, out: str) -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).groupBy(
            F.col("event_id").alias(f"_e_{out}"), F.col(key).alias(f"_{out}")
        ).agg(F.min("sequence").alias(out))

    c = candidates
    tiers = (
        (lowest(ledger, "raw_sha256", "by_raw"), "raw_sha256", "by_raw"),
        (lowest(ledger, "message_id_hash", "by_mid"), "message_id_hash", "by_mid"),
        (lowest(attachment_rows(ledger), "sha256", "by_att"), "raw_sha256", "by_att"),
    )
    for side, key, out in tiers:
        same = (F.col("event_id") == F.col(f"_e_{out}")) & (F.col(key) == F.col(f"_{out}"))
        if as_of:
            same &= F.col(out) <= F.col("horizon")
        c = c.join(side, same, "left").drop(f"_e_{out}", f"_{out}")
    kind = (
        F.when(F.col("by_raw").isNotNull(), MATCH_KINDS[0])
        .when(F.col("by_mid").isNotNull(), MATCH_KINDS[1])
        .when(F.col("by_att").isNotNull(), MATCH_KINDS[2])
        .otherwise(MATCH_KINDS[3])
    )
    return c.withColumn("match_type", kind).withColumn(
        "sequence", F.coalesce("by_raw", "by_mid", "by_att")
    ).drop("by_raw", "by_mid", "by_att")


def verify_document(documents: DataFrame, ledger: DataFrame, events: DataFrame) -> DataFrame:
    """J8. Every ledger entry that carries a document, once per distinct question.

    `documents`: event_id, doc_sha256, email (may be NULL). The answer is keyed by those three;
    repeated questions join it, instead of multiplying it.
    """
    asked = documents.select(
        "event_id", norm_hash("doc_sha256").alias("doc_hash"), F.nullif(F.col("email"), F.lit("")).alias("email")
    ).distinct()
    salts = events.select(F.col("id").alias("event_id"), "salt")
    asked = asked.join(salts, "event_id").withColumn("_email_hash", salted_sender_hash("email", "salt")).drop("salt")
    first = (
        attachment_rows(ledger)
        .withColumn("doc_hash", norm_hash("sha256"))
        .groupBy("event_id", "doc_hash", "sequence")
        .agg(F.min_by("filename", "att_pos").alias("filename"))
    )
    entry = ledger.select(
        "event_id", "sequence", "received_at", "trust_level", "counted", "sender_domain", "sender_hash"
    )
    hits = asked.join(first, ["event_id", "doc_hash"]).join(entry, ["event_id", "sequence"])
    return hits.select(
        "event_id", "doc_hash", "email", "sequence", "received_at", "trust_level", "counted", "sender_domain",
        F.when(F.col("_email_hash").isNotNull(), _yes(F.col("sender_hash") == F.col("_email_hash"))).alias("sender_match"),
        "filename",
    )


def document_found(documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """J8. Per document row: `found` and how many entries carry it."""
    per_hash = (
        attachment_rows(ledger)
        .select("event_id", "sequence", norm_hash("sha256").alias("doc_hash"))
        .distinct()
        .groupBy("event_id", "doc_hash")
        .agg(F.count("*").alias("entries"))
    )
    return (
        documents.withColumn("doc_hash", norm_hash("doc_sha256"))
        .join(per_hash, ["event_id", "doc_hash"], "left")
        .withColumn("entries", F.coalesce("entries", F.lit(0)))
        .withColumn("found", F.col("entries") > 0)
    )


def archive_keys(signatures: DataFrame, dns_txt: DataFrame, fetched_at: Column) -> DataFrame:
    """J9. The published key of each picked signature, or why there is none.

    `signatures`: domain, selector + columns to carry; `dns_txt`: name, txt (NULL txt = no record).
    """
    label = r"^[a-zA-Z0-9._-]+$"
    given = (F.coalesce("domain", F.lit("")) != "") & (F.coalesce("selector", F.lit("")) != "")
    valid = F.col("domain").rlike(label) & F.col("selector").rlike(label)
    df = signatures.withColumn(
        "lookup", F.when(given & valid, F.concat("selector", F.lit("._domainkey."), "domain"))
    )
    # A name may have several TXT strings; one that holds a key comes first.
    rank = F.struct(F.nullif(extract_public_key("txt"), F.lit("")).isNull(), "txt")
    records = dns_txt.filter("txt is not null").groupBy(F.col("name").alias("lookup")).agg(F.min_by("txt", rank).alias("txt"))
    # Rows without a lookup go round the join, so that they do not meet in one partition.
    df = df.filter("lookup is not null").join(records, "lookup", "left").unionByName(df.filter("lookup is null"), allowMissingColumns=True)
    key = F.nullif(extract_public_key("txt"), F.lit(""))
    error = (
        F.when(~given, "missing domain/selector")
        .when(~valid, "invalid domain/selector")
        .when(F.col("txt").isNull(), "no TXT record")
        .when(key.isNull(), "no p= tag")
    )
    carried = [c for c in signatures.columns]
    return df.select(
        *carried, "lookup", key.alias("base64"), to_pem(key).alias("pem"),
        F.when(F.col("lookup").isNotNull(), fetched_at).alias("fetched_at"), error.alias("error"),
    )


def candidate_hashes(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Salt a candidate's Message-ID with its event's salt."""
    salts = events.select(F.col("id").alias("event_id"), "salt")
    return candidates.join(salts, "event_id").withColumn(
        "message_id_hash", salted_message_id_hash("message_id", "salt")
    ).drop("salt")


def _verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per message and key: a check that passed outweighs others, then the last reason by text."""
    best = F.max(F.struct(_yes(F.col("ok")).alias("ok"), F.col("reason"))).alias("v")
    return verdicts.groupBy("raw_sha256", F.col("domain").alias("_d"), F.col("selector").alias("_s")).agg(best).select(
        "raw_sha256", "_d", "_s", F.col("v.ok").alias("_ok"), F.col("v.reason").alias("_why")
    )


def verify_candidates(candidates: DataFrame, ledger: DataFrame, events: DataFrame, verdicts: DataFrame | None = None, as_of: bool = False) -> DataFrame:
    """C5. One report per verify request.

    `candidates`: request_id, event_id, cand_pos, raw_sha256, message_id. Positions count the
    attachments in order and then the forward itself. The first matching candidate speaks for the
    request, else the last one. `verdicts`: raw_sha256, domain, selector, ok, reason - the result
    of checking a message against an archived key. With `as_of` a request sees the entries up to its `horizon` (see
    `find_match`), so the answer is the same wherever a batch is cut, late mail included.
    """
    asked = ["horizon"] if as_of else []
    matched = find_match(candidate_hashes(candidates, events), ledger, as_of)
    hit = F.col("match_type") != "none"
    # Unmatched positions sort behind all matched ones, last position first.
    order = F.struct(F.when(hit, 0).otherwise(1), F.when(hit, F.col("cand_pos")).otherwise(-F.col("cand_pos")))
    pick = F.struct("cand_pos", "raw_sha256", "match_type", "sequence")
    best = matched.groupBy("request_id", "event_id", *asked).agg(F.min_by(pick, order).alias("b")).select("request_id", "event_id", *asked, "b.*")
    entry = ledger.select(
        "event_id", "sequence", "counted", "trust_level", "sender_domain", "dkim_key_file",
        F.get("dkim.signatures", F.lit(0)).alias("sig0"),
    )
    begun = ledger.groupBy("event_id").agg(F.min("sequence").alias("_begun"))
    there = F.col("_begun") <= F.col("horizon") if as_of else F.col("_begun").isNotNull()
    r = best.join(entry, ["event_id", "sequence"], "left").join(begun, "event_id", "left").withColumn("has_entries", F.when(there, True)).drop(*asked)
    checked = F.col("match_type").isin("raw_email", "message_id")
    testable = _yes(F.col("sig0.result") == "pass") & F.col("dkim_key_file").isNotNull()
    if verdicts is None:
        r = r.withColumn("_ok", F.lit(None).cast("boolean")).withColumn("_why", F.lit(None).cast("string"))
    else:
        v = _verdicts(verdicts)
        r = r.withColumns({"_d": F.col("sig0.domain"), "_s": F.col("sig0.selector")}).join(
            v, ["raw_sha256", "_d", "_s"], "left"
        )
    return r.select(
        "request_id", "event_id", "cand_pos",
        hit.alias("matched"),
        F.when(F.col("has_entries"), F.col("match_type")).alias("match_type"),
        F.when(F.col("has_entries").isNull(), F.lit("no_commits")).alias("reason"),
        F.col("raw_sha256").alias("hash"),
        "sequence", "counted", "trust_level", "sender_domain",
        F.when(checked, F.when(testable, _yes(F.col("_ok"))).otherwise(F.lit(False))).alias("dkim_ok"),
        F.when(checked, F.when(~testable, F.lit("no archived key or signature was not pass")).when(
            ~_yes(F.col("_ok")), F.coalesce("_why", F.lit("no verdict")))).alias("dkim_reason"),
    )


def reverify(requests: DataFrame, ledger: DataFrame, events: DataFrame, verdicts: DataFrame, log: DataFrame | None = None, as_of: bool = False) -> DataFrame:
    """J10/C6. Re-evaluate contested entries; one report per request, one log row per found entry.

    `requests`: request_id, received_at, event_id, target_sequence, raw_sha256, raw_size.
    The entry under review never changes. `evidence_matches` says whether the evidence is the
    very message the entry recorded; the upgrade rule does not ask for it.
    """
    target = ledger.select(
        "event_id", F.col("sequence").alias("target_sequence"),
        F.coalesce(F.nullif(F.col("trust_level"), F.lit("")), F.lit("unverified")).alias("trust_level_before"),
        F.col("raw_sha256").alias("_committed"), "dkim_key_file",
        pick_signer("dkim").alias("signer"), F.lit(True).alias("found"),
    )
    on = ["event_id", "target_sequence"]
    if as_of:  # as in `verify_candidates`
        target = target.withColumnsRenamed({c: f"_t_{c}" for c in on})
        same = (requests["event_id"] == F.col("_t_event_id")) & (requests["target_sequence"] == F.col("_t_target_sequence"))
        on = same & (F.col("_t_target_sequence") <= requests["horizon"])
    v = _verdicts(verdicts)
    r = requests.join(target, on, "left").withColumns(
        {"_d": F.col("signer.domain"), "_s": F.col("signer.selector"), "found": _yes(F.col("found"))}
    ).join(v, ["raw_sha256", "_d", "_s"], "left")
    signer, pem = F.col("signer").isNotNull(), F.col("dkim_key_file").isNotNull()
    ok = signer & pem & _yes(F.col("_ok"))
    why = (
        F.when(~signer, "no signing domain/selector in committed DKIM record")
        .when(~pem, "no archived DKIM key for this commit")
        .when(~ok, F.coalesce("_why", F.lit("no verdict")))
    )
    policy = resolve_upgrade("trust_level_before")
    upgraded = ok & policy["upgrade_to"].isNotNull()
    found = r.filter("found").withColumns(
        {
            "upgraded": upgraded,
            "trust_level_after": F.when(upgraded, policy["upgrade_to"]).otherwise(F.col("trust_level_before")),
            "policy_note": policy["reason"],
            "dkim_ok": ok,
            "dkim_reason": why,
            "evidence_matches": _yes(F.col("raw_sha256") == F.col("_committed")),
            "reason": F.lit(None).cast("string"),
        }
    )
    base = None
    if log is not None:
        base = log.groupBy("event_id").agg(F.max("reverify_sequence").alias("last"))
    found = assign_sequence(found, tie="request_id", base=base, out="reverify_sequence")
    missing = r.filter(~F.col("found")).withColumns(
        {
            "upgraded": F.lit(False),
            "reason": F.concat(F.lit("no commit-"), pad_seq("target_sequence"), F.lit(".json in "), F.col("event_id")),
        }
    )
    cols = [
        "request_id", "received_at", "event_id", "target_sequence", "reverify_sequence", "found", "upgraded",
        "trust_level_before", "trust_level_after", "policy_note", "dkim_ok", "dkim_reason",
        "raw_sha256", "raw_size", "evidence_matches", "reason",
    ]
    return found.unionByName(missing, allowMissingColumns=True).select(*cols)
