"""Raw mail in: folders of messages, and the one place that decodes MIME.

Header fields and routes are computed natively. Only attachments need a MIME decoder, so the
Python stage sees nothing but mail that a known event asked for.
"""
from __future__ import annotations

import base64
import hashlib
import quopri
import re
from collections.abc import Iterator
from email import policy
from email.message import EmailMessage
from email.parser import BytesHeaderParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from countersign import schemas

_BLANK_LINE = re.compile(rb"\r?\n\r?\n")


def read_mail(spark: SparkSession, path: str, envelopes: DataFrame | None = None, glob: str = "*.eml") -> DataFrame:
    """S1. Messages under a folder as `mail` rows; the path below it without suffix is `mail_id`.

    `envelopes(mail_id, received_at, envelope, auth)` comes from the delivery log. Without it the
    file time stands in and envelope and verdict are NULL.
    """
    stem = r"([^/]+?)(?:\.[^./]*)?$"
    below = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/")) + r"/(.+?)(?:\.[^./]*)?$"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    mail = files.select(
        F.coalesce(F.nullif(F.regexp_extract("path", below, 1), F.lit("")), F.regexp_extract("path", stem, 1)).alias("mail_id"),
        F.col("modificationTime").alias("received_at"),
        F.col("content").alias("raw"),
    )
    if envelopes is None:
        return mail.withColumns(
            {"envelope": F.lit(None).cast(schemas.ENVELOPE), "auth": F.lit(None).cast(schemas.AUTH)}
        )
    return mail.drop("received_at").join(envelopes, "mail_id", "left").select(*schemas.MAIL.fieldNames())


def _parts(raw: bytes, default: str = "text/plain") -> Iterator[tuple[EmailMessage, bytes]]:
    """The leaf parts of a message: parsed header and the body's very bytes. An attached message is a leaf."""
    cut = _BLANK_LINE.search(raw)
    head, body = (raw[: cut.end()], raw[cut.end() :]) if cut else (raw, b"")
    if raw[:1] == b"\n" or raw[:2] == b"\r\n":  # a part may have no header at all
        head, body = b"", raw.split(b"\n", 1)[1]
    part = BytesHeaderParser(_class=EmailMessage, policy=policy.default).parsebytes(head)
    if default != "text/plain" and part["content-type"] is None:
        part["Content-Type"] = default
    boundary = part.get_boundary()
    if part.get_content_maintype() != "multipart" or not boundary:
        yield part, body
        return
    inner = "message/rfc822" if part.get_content_subtype() == "digest" else "text/plain"
    mark = re.escape(boundary.encode("utf-8", "surrogateescape"))
    pieces = re.split(rb"(?:^|\r?\n)--" + mark + rb"(--)?[ \t]*(?=\r?\n|\Z)", body)
    # Text, closing mark, text ...: what stands before the first mark and after the closing one is no part.
    for closing, piece in zip(pieces[1::2], pieces[2::2]):
        if closing:
            break
        yield from _parts(re.sub(rb"\A\r?\n", b"", piece), inner)


def _decoded(part: EmailMessage, body: bytes) -> bytes:
    how = str(part.get("content-transfer-encoding", "")).strip().lower()
    if how == "base64":
        digits = re.sub(rb"[^A-Za-z0-9+/]", b"", body.split(b"=", 1)[0])
        digits = digits[:-1] if len(digits) % 4 == 1 else digits
        return base64.b64decode(digits + b"=" * (-len(digits) % 4))
    return quopri.decodestring(body) if how == "quoted-printable" else body


def _attachment_parts(raw: bytes) -> list[tuple[str | None, bytes]]:
    """Name and bytes of every attachment: parts that say so, have a file name or are no text, the root included."""
    raw, found = bytes(raw), []
    cut = _BLANK_LINE.search(raw)
    # Without a header of that kind the message is plain text that no one called an attachment.
    if b"content-" not in (raw[: cut.end()] if cut else raw).lower():
        return found
    for part, body in _parts(raw):
        name = part.get_filename()
        if part.get_content_disposition() == "attachment" or name or part.get_content_maintype() not in ("text", "multipart"):
            found.append((name, _decoded(part, body)))
    return found


def _fingerprint(content: bytes) -> str:
    return "sha256:" + hashlib.sha256(content).hexdigest()


def parse_attachments(mail: DataFrame) -> DataFrame:
    """C11. Replace `raw` by `attachments`: name, size and hash of every part, never the bytes."""
    out = T.StructType(
        [f for f in mail.schema.fields if f.name != "raw"]
        + [T.StructField("attachments", T.ArrayType(schemas.ATTACHMENT))]
    )

    kind = to_arrow_type(out["attachments"].dataType)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                [{"filename": n, "size": len(c), "sha256": _fingerprint(c)} for n, c in _attachment_parts(raw.as_py())]
                for raw in b.column("raw")
            ]
            # The other columns go through as they came.
            yield b.drop_columns(["raw"]).append_column("attachments", pa.array(found, kind))

    return mail.mapInArrow(decode, out)


def parse_mail(mail: DataFrame) -> DataFrame:
    """C11. `parsed_mail` rows: From, Message-ID, attachment fingerprints, hash and size."""
    from countersign.functions import headers as H
    from countersign.functions.hashing import hash_document
    from countersign.operators.routing import address_in
    from countersign.session import evaluated_once

    mail = evaluated_once(mail.select("mail_id", "raw"), _block=H.header_block("raw"))
    mail = evaluated_once(mail, _from=H.raw_header("_block", "From"))
    block, sender = F.col("_block"), F.col("_from")
    name = F.nullif(F.regexp_replace(F.regexp_extract(sender, r"^(.*?)<", 1), r'^[\s"]+|[\s"]+$', ""), F.lit(""))
    df = mail.select(
        F.col("mail_id").cast("string").alias("mail_id"),
        address_in(sender).alias("from_address"),
        name.alias("from_name"),
        H.raw_header(block, "Message-ID").alias("message_id"),
        hash_document("raw").alias("raw_sha256"),
        F.octet_length("raw").cast("bigint").alias("raw_size"),
        "raw",
    )
    return parse_attachments(df).select(*schemas.PARSED_MAIL.fieldNames())


def extract_candidates(mail: DataFrame) -> DataFrame:
    """C12. What a verify request offers: each non-empty attachment in order, then the forward.

    Needs request_id, event_id, message_id, raw; the bytes are hashed where they are decoded.
    """
    out = T.StructType(
        [f for f in mail.schema.fields if f.name != "raw"]
        + [
            T.StructField("cand_pos", T.IntegerType()),
            T.StructField("raw_sha256", T.StringType()),
            T.StructField("raw_size", T.LongType()),
        ]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at, value in enumerate(b.column("raw")):
                raw = value.as_py()
                contents = [c for _, c in _attachment_parts(raw) if c] + [bytes(raw)]
                rows += [(at, i, _fingerprint(c), len(c)) for i, c in enumerate(contents)]
            at, position, digest, size = ([r[k] for r in rows] for k in range(4))
            heads = b.drop_columns(["raw"]).take(pa.array(at, pa.int64()))
            for name, values in (("cand_pos", pa.array(position, pa.int32())), ("raw_sha256", pa.array(digest, pa.string())), ("raw_size", pa.array(size, pa.int64()))):
                heads = heads.append_column(name, values)
            yield heads

    return mail.mapInArrow(decode, out)
