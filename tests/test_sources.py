"""Folders of messages and event records."""
import json

from countersign.functions.steps import reference_clock
from countersign.operators.ledger import supersede_completions
from countersign.sources.mail import read_mail
from countersign.sources.tables import read_event_signatures, read_events
from pyspark.sql import functions as F


def test_messages_of_equal_names_keep_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.eml").write_bytes(folder.encode())
    (tmp_path / "top.eml").write_bytes(b"t")
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r["mail_id"]: bytes(r["raw"]) for r in read_mail(spark, path).collect()}
        assert got == {"a/1": b"a", "b/1": b"b", "top": b"t"}


def test_open_event_records(spark, tmp_path):
    record = {"id": "e1", "type": "crypto", "threshold": 2, "mood": "fine", "tags": ["x", {"y": 1}], "signatures": [{"sender_hash": "h", "commit_sequence": 7, "trust_level": "verified"}]}
    (tmp_path / "e1.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "e2.json").write_text('{"id": "e2", "type": "workflow"}')
    (tmp_path / "e3.json").write_text("{broken")
    (tmp_path / "not-an-id.json").write_text("{}")
    got = {r["id"]: r for r in read_events(spark, str(tmp_path)).collect()}
    assert set(got) == {"e1", "e2"} and got["e1"]["threshold"] == 2 and got["e2"]["extra"] is None
    extra = json.loads(got["e1"]["extra"])
    assert extra["mood"] == "fine" and json.loads(extra["tags"]) == ["x", {"y": 1}]
    assert [tuple(r) for r in read_event_signatures(spark, str(tmp_path)).select("event_id", "sender_hash", "commit_sequence").collect()] == [("e1", "h", 7)]


def test_clock_reads_dates_and_times(spark):
    row = "array<struct<status:string,deadline:string>>"
    df = spark.createDataFrame([("workflow", [("pending", "2024-03-01"), ("pending", "2024-03-01T12:00:00Z"), ("complete", "2030-01-01"), ("pending", "soon")])], f"t string, s {row}")
    clock = df.select(reference_clock("t", "s", F.lit("2024-01-01").cast("timestamp")).cast("string")).first()[0]
    assert clock == "2024-03-01 12:00:00"


def test_records_of_one_batch_take_following_versions(spark):
    schema = "event_id string, completed_at timestamp, triggering_commit_sequence bigint"
    new = spark.createDataFrame([("e", None, 9), ("e", None, 4)], schema)
    history = spark.createDataFrame([("e", None, 1, 1)], schema + ", version int")
    got = {r["triggering_commit_sequence"]: r["version"] for r in supersede_completions(history, new).collect()}
    assert got == {1: 1, 4: 2, 9: 3}
