"""Small truth tables for the column functions."""
from pyspark.sql import functions as F

from countersign import functions as fn
from countersign import schemas
from countersign.operators import bounce, routing
from countersign.sources.mail import extract_candidates, parse_mail
from tests.conftest import rows


def each(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_addresses(spark):
    got = each(spark, ["event+abc-s-1@X.org", " EVENT+abc@x.org ", "event+-s@x", "event+a_b@x", "event+abc-@x", "attest+a1@x"], fn.event_tag)
    assert [g and tuple(g) for g in got] == [("abc", "s-1"), ("abc", None), None, None, ("abc", ""), None]
    got = each(spark, ["reverify+a1-3@x", "reverify+a1-0@x", "reverify+a1-100000@x", "reverify+a1-099@x", "reverify+a-b-3@x", "reverify+a1@x"], fn.reverify_tag)
    # No upper bound: a hot event's entries go past 99,999.
    assert [g and tuple(g) for g in got] == [("a1", 3), None, ("a1", 100000), ("a1", 99), None, None]
    assert each(spark, ["attest+a1-x@y", "attest+a1@y"], lambda c: fn.attest_tag(c)["event_id"]) == [None, "a1"]
    assert each(spark, ["stats+a@y", "close+a@y", "remind+b@y", None], lambda c: fn.initiator_command(c)["command"]) == ["stats", None, "remind", None]
    assert each(spark, ["a@b@c", "plain", ""], fn.sender_domain) == ["b", None, None]


def test_prefilter(spark):
    h = {
        "Auto-Submitted: auto-replied\r\nFrom: a@b.c": "auto-submitted: auto-replied",
        "auto-submitted: NO\r\nFrom: a@b.c": None,
        "Auto-Submitted: no; x": "auto-submitted: no; x",
        "List-Post: <mailto:x>\nFrom: a@b.c": "mailing list headers present",
        "Precedence: BULK": "precedence: bulk",
        "Precedence: first-class": None,
        "From: Desk <No-Reply@b.c>": "system sender: no-reply@b.c",
        "From: noreply2@b.c": None,
        "X-A: 1\r\n List-Id: folded": None,
    }
    got = each(spark, list(h), lambda c: routing.prefilter(c, routing.from_address(c))["reason"])
    assert got == list(h.values())


def test_header_block_and_headers(spark):
    assert each(spark, ["A: 1\r\n\r\nbody", "A: 1\n\nbody", "\n\nbody", "A: 1"], fn.header_block) == ["A: 1", "A: 1", "\n\nbody", "A: 1"]
    assert each(spark, ["Subject:  a\r\n\tb \r\nX: 1", "X: 1"], lambda c: fn.raw_header(c, "Subject")) == ["a b", None]
    bad = spark.sql("select X'46726F6D3A20FF40622E63' as raw").select(fn.header_block("raw")).first()[0]
    assert bad == "From: �@b.c"


def test_trust(spark):
    def auth(dkim, aligned, dmarc, arc, spf):
        return ({"results": [{"status": {"result": dkim, "aligned": aligned}}]}, {"status": {"result": spf}}, {"status": {"result": dmarc}}, {"status": {"result": arc}, "i": None})

    cases = [
        (auth("pass", "d", "pass", "pass", "pass"), "verified"), (auth("pass", None, "pass", "none", "pass"), "authorized"),
        (auth("pass", "d", "fail", "pass", "pass"), "forwarded"), (auth("fail", "d", "fail", "none", "pass"), "unverified"),
    ]
    df = spark.createDataFrame([(a, i) for i, (a, _) in enumerate(cases)], schemas.T.StructType([schemas.T.StructField("auth", schemas.AUTH), schemas.T.StructField("i", schemas.I)]))
    assert [r[0] for r in df.orderBy("i").select(fn.classify_trust("auth")).collect()] == [w for _, w in cases]
    assert spark.range(1).select(fn.classify_trust(F.lit(None).cast(schemas.AUTH))).first()[0] == "unverified"
    assert each(spark, ["verified", "odd", None], lambda c: fn.meets_trust(c, F.lit("unverified"))) == [True, False, False]


DSN = (
    "Content-Type: multipart/report; report-type=delivery-status;\r\n boundary=\"b1\"\r\nAuto-Submitted: auto-replied\r\n\r\npreamble\r\n--b1\r\nContent-Type: text/plain\r\n\r\nsorry\r\n"
    "--b1\r\nContent-Type: message/delivery-status\r\n\r\nReporting-MTA: dns; m\r\n\r\nOriginal-Recipient: rfc822;o@x.org\r\nFinal-Recipient: rfc822; f@x.org\r\nAction: Failed\r\nStatus: 5.1.1\r\n"
    "Diagnostic-Code: smtp; 550 5.1.1\r\n user unknown\r\n\r\nFinal-Recipient: rfc822;late@x.org\r\nAction: delayed\r\nStatus: 4.4.1\r\n\r\nFinal-Recipient: rfc822;no@x.org\r\nStatus: 5.2.2\r\n"
    "--b1\r\nContent-Type: message/rfc822\r\n\r\nSubject: x\r\n--b1--\r\nepilogue --b1 x"
)


def test_delivery_report(spark):
    df = bounce.with_failures(spark.createDataFrame([("m", DSN), ("n", DSN.replace("--b1--", "")), ("o", "From: a@b.c\r\n\r\nhi")], "mail_id string, raw string"))
    got = {r["mail_id"]: [tuple(f) for f in r["failed"]] for r in df.collect()}
    want = [("o@x.org", "f@x.org", "failed", "5.1.1", "smtp; 550 5.1.1 user unknown"), (None, "no@x.org", None, "5.2.2", None)]
    assert got == {"m": want, "n": want, "o": []}


def test_keys_and_text(spark):
    assert each(spark, ["k=rsa; p=AB C", "v=1", "sp=x; P = Y", "p="], fn.extract_public_key) == ["ABC", None, "Y", ""]
    pem = each(spark, ["a" * 64, "a" * 65], fn.to_pem)
    assert [p.count("\n") for p in pem] == [3, 4]
    assert each(spark, ["Bitcoin block 850123", "Block height: 7", "x BitcoinBlockHeaderAttestation(1) 123456", "none"], fn.parse_block_height) == [850123, 7, 123456, None]
    assert each(spark, ["7", "1234"], fn.pad_seq) == ["007", "1234"]
    assert each(spark, ["<A@B>", "  x ", ""], fn.normalise_message_id) == ["a@b", "x", ""]


def test_step_levels(spark):
    steps = [("a", []), ("b", ["a"]), ("c", ["b", "a"]), ("d", ["zz"]), ("e", ["f"]), ("f", ["e"]), ("g", ["d"])]
    full = [tuple({"id": i, "dependsOn": d, "status": "pending"}.get(f) for f in schemas.STEP.fieldNames()) for i, d in steps]
    df = spark.createDataFrame([(full,)], schemas.T.StructType([schemas.T.StructField("steps", schemas.COORD_EVENTS["steps"].dataType)]))
    assert df.select(fn.step_levels("steps")).first()[0] == [0, 1, 2, -1, -1, -1, -1]


def test_attachments(spark):
    raw = b"From: A <a@b.c>\r\nMessage-ID: <m@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nhi\r\n--q\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"d.pdf\"\r\nContent-Transfer-Encoding: base64\r\n\r\naGVsbG8=\r\n--q--\r\n"
    df = spark.createDataFrame([("1", bytearray(raw))], "mail_id string, raw binary")
    row = parse_mail(df).first()
    assert (row["from_address"], row["from_name"], row["message_id"], row["raw_size"]) == ("a@b.c", "A", "<m@x>", len(raw))
    assert [(a["filename"], a["size"], a["sha256"][:15]) for a in row["attachments"]] == [("d.pdf", 5, "sha256:2cf24dba")]
    cand = extract_candidates(df.select(F.col("mail_id").alias("request_id"), F.lit("e").alias("event_id"), F.lit("x").alias("message_id"), "raw"))
    assert [r[1] for r in rows(cand, "cand_pos", "raw_size")] == [5, len(raw)]
