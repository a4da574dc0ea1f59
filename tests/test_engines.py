"""Set-based decisions, replay and the stream against the plain fold."""
import copy
import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from countersign import schemas
from countersign.operators.decide import decide
from countersign.operators.numbering import assign_sequence, rank_numbered, running_sums
from countersign.plans.ingest import ingest_batch
from countersign.plans.replay import replay
from countersign.sources import tables
from countersign.streaming import live
from countersign.workload import fixtures as fx
from tests import fold
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
REPLY = "event_id string, mail_id bigint, received_at timestamp, mode string, step_id string, sender string, trust_level string, attachments array<struct<filename:string,size:bigint,sha256:string>>"


def make_events(rng, n):
    events = []
    for i in range(n):
        ev = {f: None for f in schemas.COORD_EVENTS.fieldNames()}
        ev.update(
            id=f"e{i}", type=rng.choice(["crypto", "workflow"]), title="T", initiator="boss@x.org", salt=f"s{i}", status="open",
            created_at=T0, activated_at=rng.choice([None, T0, T0 + dt.timedelta(minutes=20)]),
            archived_at=rng.choice([None, None, None, T0 + dt.timedelta(minutes=200)]), manualCompletion=rng.random() < 0.15,
        )
        if ev["type"] == "crypto":
            ev.update(open=rng.random() < 0.5, signers=["a@x.org", "b@x.org", "c@x.org"], threshold=rng.randint(1, 4), requiredDocHash=rng.choice([None, "h1"]))
        else:
            ids = [f"s{j}" for j in range(rng.randint(1, 5))]
            steps = []
            for j, sid in enumerate(ids):
                deps = rng.sample(ids[:j] + (["nope"] if rng.random() < 0.1 else []), k=min(j, rng.randint(0, 2)))
                if rng.random() < 0.05 and j + 1 < len(ids):
                    deps.append(ids[j + 1])
                steps.append({f: None for f in schemas.STEP.fieldNames()} | dict(
                    id=sid, name=sid, participant=rng.choice(["a@x.org", "B@x.org", "c@x.org", None]), requires_attachment=rng.random() < 0.2,
                    status="pending", dependsOn=deps, minTrust=rng.choice([None, "forwarded", "unverified"]),
                ))
            ev.update(flow=rng.choice(["sequential", "custom"]), steps=steps)
        events.append(ev)
    return events


def make_replies(rng, events, n, hot=0.34):
    out = []
    for i in range(n):
        ev = events[0] if rng.random() < hot else rng.choice(events)
        mode = ("crypto" if ev["type"] == "crypto" else "workflow") if rng.random() < 0.95 else rng.choice(["crypto", "workflow"])
        out.append(dict(
            event_id=ev["id"], mail_id=i, received_at=T0 + dt.timedelta(seconds=rng.randint(0, 14_400)), mode=mode,
            step_id=f"s{rng.randint(0, 5)}" if mode == "workflow" else None, sender=rng.choice(["a@x.org", "b@x.org", "c@x.org", "d@x.org", "boss@x.org", ""]),
            trust_level=rng.choice(["verified", "verified", "verified", "forwarded", "authorized", "unverified"]),
            attachments=rng.choice([[], [dict(filename="f", size=1, sha256="h1")], [dict(filename="g", size=1, sha256="h2")]]),
        ))
    return out


def make_calls(rng, events):
    out = []
    for ev in events:
        for j in range(rng.randint(0, 4)):
            action = rng.choice(["edit", "complete", "reopen", "activate"])
            patch = [dict(id=f"s{rng.randint(0, 4)}", participant=rng.choice(["a@x.org", "c@x.org", "bad"]), deadline="2024-05-05", requires_attachment=rng.random() < 0.5,
                          details=None, fields=rng.sample(["participant", "deadline", "requires_attachment"], 2))]
            out.append(dict(
                action_id=f"{ev['id']}-{j}", event_id=ev["id"], at=T0 + dt.timedelta(seconds=rng.randint(0, 14_400)), action=action, reason="r",
                title=rng.choice([None, None, "New", " "]) if action == "edit" else None, steps=patch if action == "edit" and rng.random() < 0.9 else None,
                retract=[fold.sender_hash("a@x.org", ev["salt"])] if action == "reopen" else None, completed_at=None, organiser=None,
            ))
    return out


def folded(events, replies, calls):
    entries, states = [], {}
    for ev in copy.deepcopy(events):
        ev["signatures"] = []
        mine = [r for r in replies if r["event_id"] == ev["id"]]
        entries += [(ev["id"], *e) for e in fold.replay(ev, mine, [c for c in calls if c["event_id"] == ev["id"]])]
        states[ev["id"]] = ev
    return sorted(entries, key=repr), states


def frames(spark, events, replies, calls=None):
    ev = spark.createDataFrame([tuple(e[f] for f in schemas.COORD_EVENTS.fieldNames()) for e in events], schemas.COORD_EVENTS)
    rp = spark.createDataFrame(replies, REPLY)
    return ev, rp, None if calls is None else spark.createDataFrame(
        [tuple(c[f] for f in schemas.ACTIONS.fieldNames()) for c in calls], schemas.ACTIONS)


def test_decide_equals_fold_with_hot_event(spark):
    rng = random.Random(7)
    events = make_events(rng, 25)
    replies = make_replies(rng, events, 1500)
    # The fold breaks ties by the text of the id, so make instants distinct here.
    for i, r in enumerate(replies):
        r["received_at"] += dt.timedelta(microseconds=i)
    want, _ = folded(events, replies, [])
    ev, rp, _ = frames(spark, events, replies)
    d = decide(assign_sequence(rp), ev)
    got = d.rows.select("event_id", "sequence", F.lit("reply").alias("kind"), "mail_id", "counted", "count_reason")
    assert rows(got) == want
    assert {w[-1] for w in want} >= {None, "already_signed", "already_complete", "deps_unmet", "wrong_participant", "doc_hash_mismatch"}


def test_replay_equals_fold(spark):
    rng = random.Random(11)
    events = make_events(rng, 30)
    replies = make_replies(rng, events, 900)
    for i, r in enumerate(replies):
        r["received_at"] += dt.timedelta(microseconds=i + 1)
    calls = make_calls(rng, events)
    want, states = folded(events, replies, calls)
    h = replay(*frames(spark, events, replies, calls))
    assert rows(h.entries, "event_id", "sequence", "kind", "mail_id", "counted", "count_reason") == want
    got = {r["id"]: r for r in h.events.collect()}
    for eid, ev in states.items():
        assert (got[eid]["status"], got[eid]["title"], got[eid]["completed_at"]) == (ev["status"], ev["title"], ev["completed_at"])
        mine = [(s["id"], s["status"], s["participant"], s["commit_sequence"]) for s in ev["steps"] or []]
        assert [(s["id"], s["status"], s["participant"], s["commit_sequence"]) for s in got[eid]["steps"] or []] == mine
    want_sigs = sorted((e, s["sender_hash"], s["commit_sequence"]) for e, ev in states.items() for s in ev["signatures"])
    assert rows(h.signatures, "event_id", "sender_hash", "commit_sequence") == want_sigs
    assert {e[2] for e in want} == {"reply", "event_edit", "event_reopen"}


def test_second_batch_continues_the_first(spark):
    rng = random.Random(3)
    events = make_events(rng, 12)
    replies = make_replies(rng, events, 600)
    for i, r in enumerate(replies):
        r["received_at"] += dt.timedelta(microseconds=i)
    ev, rp, _ = frames(spark, events, replies)
    from countersign.operators import ledger as LG
    from countersign.plans.ingest import decide_replies

    cut = F.lit(T0 + dt.timedelta(seconds=5_000))
    one = decide_replies(rp.filter(F.col("received_at") < cut), ev).held()
    after, led, signed = LG.apply_decisions(ev, one.rows, one.locks), LG.build_reply_commits(one.rows, ev), LG.signature_rows(one.rows)
    two = decide_replies(rp.filter(F.col("received_at") >= cut), after, led, signed)
    cols = ("event_id", "sequence", "mail_id", "counted", "count_reason")
    both = one.rows.select(*cols).unionByName(two.rows.select(*cols))
    want, _ = folded(events, replies, [])
    assert rows(both) == sorted(((e, s, m, c, why) for e, s, _, m, c, why in want), key=repr)


def test_numbering_ties_and_blocks(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=i // 3), i) for i in range(400)] + [("b", T0, 1)], "event_id string, received_at timestamp, mail_id bigint")
    got = rows(assign_sequence(df), "event_id", "mail_id", "sequence")
    assert got == sorted([("a", i, i + 1) for i in range(400)] + [("b", 1, 1)], key=repr)
    ranked = rank_numbered(df.filter("event_id = 'a'").select("event_id", (F.col("mail_id") * 5).alias("n")), "event_id", "n", "r", block=64)
    assert rows(ranked, "n", "r") == sorted([(i * 5, i + 1) for i in range(400)], key=repr)
    sums = running_sums(df, ["event_id"], "received_at", ["mail_id"], {"even": F.when(F.col("mail_id") % 2 == 0, 1).otherwise(0)})
    assert ("a", 399, 200) in rows(sums, "event_id", "mail_id", "even")


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    mail = fx.mail(spark, SF).withColumn("mail_id", F.lpad(F.col("mail_id").cast("string"), 6, "0"))
    ev = fx.coord_events(spark, SF)
    day = F.ceil(F.dayofmonth("received_at") / 15).cast("int")
    # Older files first: the stream reads them in this order.
    for part in (1, 2, 3):
        mail.filter(day == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    live.seed_state(ev, f"{root}/state")
    stream = live.read_mail_stream(spark, f"{root}/in", files_per_batch=1, schema=mail.schema)
    live.start_ingest(stream, f"{root}/state", fx.DOMAIN).awaitTermination()
    whole = ingest_batch(mail, ev, fx.DOMAIN)
    cols = ("event_id", "sequence", "sender_hash", "counted", "count_reason")
    store = live.open_store(spark, f"{root}/state")
    assert rows(store.read("ledger").select(*cols)) == rows(whole.ledger.select(*cols))
    assert rows(store.read("events"), "id", "status", "completed_at") == rows(whole.events, "id", "status", "completed_at")
    sent = store.read("outbox")
    # All kinds and texts: commands and completions count what came before them, wherever the mail is cut.
    assert {"ack", "completion", "bounce", "stats", "verify_report", "reverify_report"} <= {r["kind"] for r in sent.select("kind").distinct().collect()}
    assert rows(sent, "event_id", "kind", "to", "cause", "body") == rows(whole.outbox, "event_id", "kind", "to", "cause", "body")
    numbers = ("event_id", "request_id", "target_sequence", "reverify_sequence", "found", "reason")
    assert rows(store.read("reverified"), *numbers) == rows(whole.reverified, *numbers)
    assert store.read("results").count() == mail.count()
    # The last micro-batch again, under its own id and with its rows or none, changes nothing.
    entries = rows(store.read("ledger").select(*cols))
    for again in (mail.filter(day == 3), mail.limit(0)):
        live.mail_micro_batch(f"{root}/state", fx.DOMAIN)(again, 2)
    assert rows(store.read("ledger").select(*cols)) == entries and store.read("results").count() == mail.count()


def test_a_ledger_that_ingest_wrote_verifies(spark):
    """Keys are archived with the entries, so later requests can check and upgrade them."""
    auth = lambda result, aligned: {"dkim": {"results": [{"status": {"result": result, "aligned": aligned}, "signingDomain": "d.example", "selector": "s"}]}, "dmarc": {"status": {"result": "none"}}, "arc": {"status": {"result": "none"}}, "spf": {"status": {"result": "none"}}}
    schema = schemas.MAIL
    envelope = lambda to: {"sender": "u1@d.example", "recipient": to, "client_ip": None, "client_helo": None}
    raw = b"From: u1@d.example\r\nMessage-ID: <1@d.example>\r\n\r\nyes"
    at = lambda n: T0 + dt.timedelta(seconds=n)
    event = fx.coord_events(spark, SF).filter("type = 'crypto' and activated_at is not null").first()["id"]
    names = schema.fieldNames()
    given = [
        ("m1", at(1), envelope(f"attest+{event}@{fx.DOMAIN}"), raw, auth("pass", None)),
        ("m0", at(0), envelope(f"verify+{event}@{fx.DOMAIN}"), raw, auth("pass", "d.example")),
        ("m2", at(2), envelope(f"verify+{event}@{fx.DOMAIN}"), raw, auth("pass", "d.example")),
        ("m3", at(3), envelope(f"reverify+{event}-1@{fx.DOMAIN}"), raw, auth("pass", "d.example")),
    ]
    fields = ("mail_id", "received_at", "envelope", "raw", "auth")
    mail = spark.createDataFrame([tuple(dict(zip(fields, g))[n] for n in names) for g in given], schema)
    sha = "sha256:" + __import__("hashlib").sha256(raw).hexdigest()
    verdicts = spark.createDataFrame([(sha, "d.example", "s", True, None), (sha, "d.example", "s", False, "old try")], "raw_sha256 string, domain string, selector string, ok boolean, reason string")
    txt = spark.createDataFrame([("s._domainkey.d.example", "v=DKIM1; p=AAAA")], "name string, txt string")
    ev = fx.coord_events(spark, SF)
    done = ingest_batch(mail, ev, fx.DOMAIN, verdicts=verdicts, dns_txt=txt)
    assert [r["dkim_key_file"] for r in done.ledger.collect()] == ["dkim_keys/commit-001.pem"] and done.keys.count() == 1
    reports = {r["request_id"]: r for r in done.verified.collect()}
    assert reports["m0"]["reason"] == "no_commits" and reports["m2"]["match_type"] == "raw_email" and reports["m2"]["dkim_ok"]
    assert [(r["found"], r["dkim_ok"]) for r in done.reverified.collect()] == [(True, True)]
    bare = ingest_batch(mail, ev, fx.DOMAIN, verdicts=verdicts, dns_txt=txt.limit(0))
    assert bare.ledger.first()["dkim_key_file"] is None and bare.keys.first()["error"] == "no TXT record"
