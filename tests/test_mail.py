"""Header reading and MIME decoding on hand-made messages."""
import base64

from countersign.functions import headers as H
from countersign.operators.ledger import digest_tree
from countersign.operators.lifecycle import edit_changes
from countersign.operators.routing import any_tag, from_address
from countersign.operators.verify import archive_keys
from countersign.sources.mail import _attachment_parts
from pyspark.sql import functions as F

INNER = b"From: a@b.example\r\nSubject: original\r\n\r\nfirst\r\n.second \r\n"


def test_forwarded_message_keeps_its_bytes():
    raw = b'Content-Type: multipart/mixed; boundary="q"\r\n\r\npreamble\r\n--q\r\nContent-Type: text/plain\r\n\r\nhello\r\n--q\r\nContent-Type: message/rfc822\r\n\r\n' + INNER + b"\r\n--q--\r\nepilogue"
    assert _attachment_parts(raw) == [(None, INNER)]


def test_attached_message_is_not_entered():
    nested = b'Content-Type: multipart/mixed; boundary="in"\r\n\r\n--in\r\nContent-Disposition: attachment; filename="x.bin"\r\n\r\nx\r\n--in--\r\n'
    raw = b'Content-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: message/rfc822\r\n\r\n' + nested + b"\r\n--q--\r\n"
    assert _attachment_parts(raw) == [(None, nested)]


def test_root_attachment_and_encodings():
    data = bytes(range(256))
    root = b'Content-Type: application/pdf; name="a.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\n' + base64.encodebytes(data)
    assert _attachment_parts(root) == [("a.pdf", data)]
    quoted = b'Content-Type: text/csv\r\nContent-Disposition: attachment; filename="t.csv"\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\na=3Db=\r\nc'
    assert _attachment_parts(quoted) == [("t.csv", b"a=bc")]
    assert _attachment_parts(b"Subject: plain\r\n\r\ntext") == [] and _attachment_parts(b"") == []


def test_headers_past_the_old_limit(spark):
    raw = b"X-Pad: " + b"p" * 70_000 + b"\r\nList-Id: <l.example>\r\nMessage-ID: <late@x>\r\nFrom: Late <late@x.example>\r\n\r\nbody"
    row = spark.createDataFrame([(raw,)], "raw binary").select(H.header_block("raw").alias("b")).select(
        H.raw_header("b", "List-Id").alias("l"), H.raw_header("b", "Message-ID").alias("m"), from_address(F.col("b")).alias("f")
    ).first()
    assert tuple(row) == ("<l.example>", "<late@x>", "late@x.example")


def test_from_address_ignores_display_names(spark):
    cases = {'From: "x <a@b.c>" <real@d.e>': "real@d.e", "From: (a@b.c) real@d.e": "real@d.e", 'From: "q \\" <a@b.c>" <real@d.e>': "real@d.e", "From: plain@d.e": "plain@d.e", "From: none": None}
    df = spark.createDataFrame([(k,) for k in cases], "b string")
    assert {r[0]: r[1] for r in df.select("b", from_address(F.col("b"))).collect()} == cases


def test_reverify_numbers_have_no_cap(spark):
    df = spark.createDataFrame([("reverify+abc-123456@x.example",), ("reverify+abc-0@x.example",), ("event+abc-@x.example",)], "r string")
    got = [tuple(r) for r in df.select(*[v.alias(n) for n, v in any_tag(F.col("r")).items()]).collect()]
    assert got == [("reverify", "abc", None, 123456), (None, None, None, None), ("event", "abc", "", None)]


def test_tree_grows_with_the_longest_event(spark):
    chain = spark.createDataFrame([("e", 1, "a"), ("e", 256**5 + 1, "b")], "event_id string, sequence bigint, digest string")
    assert digest_tree(chain).count() == 1


def test_key_lookup_gives_one_row_per_signature(spark):
    sigs = spark.createDataFrame([(1, "d.example", "s"), (2, None, None), (3, "d.example", "other")], "n int, domain string, selector string")
    txt = spark.createDataFrame([("s._domainkey.d.example", "v=spf1"), ("s._domainkey.d.example", "v=DKIM1; p=AAAA"), ("s._domainkey.d.example", None)], "name string, txt string")
    got = {r["n"]: (r["base64"], r["error"]) for r in archive_keys(sigs, txt, F.current_timestamp()).collect()}
    assert got == {1: ("AAAA", None), 2: (None, "missing domain/selector"), 3: (None, "no TXT record")}


def test_signoff_edit_takes_the_title_and_ignores_steps(spark):
    step = "struct<id:string,participant:string,deadline:string,requires_attachment:boolean,details:string,status:string>"
    patch = "struct<id:string,participant:string,deadline:string,requires_attachment:boolean,details:string,fields:array<string>>"
    events = spark.createDataFrame([("e", "Old", None, "open", None)], f"id string, title string, steps array<{step}>, status string, archived_at timestamp")
    given = [{"id": "s1", "participant": "x", "deadline": None, "requires_attachment": None, "details": None, "fields": ["participant"]}]
    calls = spark.createDataFrame([("a", "e", "edit", None, "\t New\n", given), ("b", "e", "edit", None, None, None)], f"action_id string, event_id string, action string, at timestamp, title string, steps array<{patch}>")
    changes, verdicts = edit_changes(calls, events)
    assert {r["action_id"]: r["error"] for r in verdicts.collect()} == {"a": None, "b": None}
    assert [(r["action_id"], r["field"], r["new"]) for r in changes.collect()] == [("a", "title", "New")]
