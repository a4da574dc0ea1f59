"""RFC-822 header and multipart text functions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ends of a header section and of a header line, and a header line by its name
_BLANK_LINE = r"\r?\n\r?\n"
_FOLD = r"\r?\n[ \t]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _group(text: Column, pattern: str, idx: int = 1) -> Column:
    """Regex group, NULL where the pattern (or the group) does not match.

    `nullif` would be spelled out as a condition that holds its operand twice, so that nested groups double at every level; a filter reads it once.
    """
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, idx)), lambda found: found != ""), F.lit(0))


def text_of(raw: Column | str) -> Column:
    """Bytes to text; malformed UTF-8 becomes U+FFFD instead of failing the job."""
    return F.make_valid_utf8(_col(raw).cast("string"))


def header_block(raw: Column | str, limit: int | None = None) -> Column:
    """P1. Everything up to the first blank line, wherever that is; of the leading `limit` bytes only if one is given."""
    data = _col(raw).cast("binary")
    whole = (data if limit is None else F.substring(data, 1, limit)).cast("string")
    # A blank line is a line feed followed by another, with or without a carriage return before either. Cutting at those bytes
    # neither validates nor counts the characters of what follows, attachments included.
    cut = F.substring_index(F.substring_index(whole, "\n\n", 1), "\n\r\n", 1)
    head = F.when(F.octet_length(cut) < F.octet_length(whole), F.regexp_replace(F.make_valid_utf8(cut), r"\r\z", "")).otherwise(F.make_valid_utf8(cut))
    return F.when(F.octet_length(head) > 0, head).otherwise(F.make_valid_utf8(whole))


def raw_header(block: Column | str, name: str, lowered: Column | None = None) -> Column:
    """P2. First header of that name: unfolded and trimmed, NULL when absent.

    With `lowered`, the block in lower case, only blocks that hold the name somewhere are searched for the header.
    """
    pattern = rf"(?im)^{re.escape(name)}\s*:\s*([^\r\n]+(?:\r?\n[ \t][^\r\n]+)*)"
    value = _strip(F.regexp_replace(_group(_col(block), pattern), _FOLD, " "))
    return value if lowered is None else F.when(lowered.contains(name.lower()), value)


def content_type(block: Column | str) -> Column:
    """P3. Content-Type after unfolding the whole block."""
    unfolded = F.regexp_replace(_col(block), _FOLD, " ")
    return _strip(_group(unfolded, r"(?im)^content-type:[ \t]*([^\r\n]+)"))


def is_delivery_status_report(block: Column | str, lowered: Column | None = None) -> Column:
    """F1. multipart/report with report-type=delivery-status; `lowered` as in `raw_header`."""
    ct = content_type(block)
    if lowered is not None:
        ct = F.when(lowered.contains("multipart/report"), ct)
    return F.coalesce(
        ct.rlike(r"(?i)multipart/report") & ct.rlike(r'(?i)report-type\s*=\s*"?delivery-status"?'),
        F.lit(False),
    )


def split_headers_body(text: Column | str) -> Column:
    """`[headers]` or `[headers, body]`, cut at the first blank line."""
    return F.split(_col(text), _BLANK_LINE, 2)


def extract_boundary(ct: Column | str) -> Column:
    """P42. The boundary parameter, quoted or bare."""
    pattern = r'(?i)boundary\s*=\s*(?:"([^"]+)"|([^;\s]+))'
    return F.coalesce(_group(_col(ct), pattern, 1), _group(_col(ct), pattern, 2))


def split_multipart(body: Column | str, boundary: Column | str) -> Column:
    """P42. Parts between boundary markers.

    Text before the first marker, after the closing marker, and a last part that no marker
    ends are left out.
    """
    marker = F.concat(F.lit(r"--\Q"), _col(boundary), F.lit(r"\E"))
    # Drop the preamble; what is left begins right behind a marker.
    pieces = F.filter(F.split(_col(body), marker), lambda p, i: i > 0)
    closing = F.array_position(F.transform(pieces, lambda p: p.startswith("--")), F.lit(True))
    # Without a closing marker the last piece is unterminated.
    keep = F.when(closing > 0, closing - 1).otherwise(F.greatest(F.size(pieces) - 1, F.lit(0)))
    parts = F.slice(pieces, F.lit(1), keep.cast("int"))
    cleaned = F.transform(
        parts,
        lambda p: F.regexp_replace(F.substr(p, F.instr(p, "\n") + 1), r"\r?\n\z", ""),
    )
    return F.when(_col(body).isNull() | _col(boundary).isNull(), F.array().cast("array<string>")).otherwise(cleaned)


def field_in_group(group: Column | str, name: str) -> Column:
    """One field of a `Name: value` group; the last of several wins."""
    hits = F.filter(_field_entries(_col(group)), lambda e: e["name"] == name)
    return F.try_element_at(hits, F.lit(-1))["value"]


def parse_field_group(group: Column | str) -> Column:
    """P41. Map of lower-cased field name to value, folded lines joined by one space."""

    def last_of_each(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
        return F.map_from_arrays(
            names,
            F.transform(
                names,
                lambda n: F.element_at(F.filter(entries, lambda e: e["name"] == n), -1)["value"],
            ),
        )

    # A lambda's variable holds the entries, so that the text is not cut again for every name.
    return F.get(F.transform(F.array(_field_entries(_col(group))), last_of_each), F.lit(0))


def _field_entries(group: Column) -> Column:
    lines = F.split(F.regexp_replace(group, r"[ \t]*\r?\n[ \t]+", " "), r"\r?\n")
    fields = F.filter(lines, lambda line: F.instr(line, ":") > 1)
    return F.transform(
        fields,
        lambda line: F.struct(
            F.lower(_strip(F.substring_index(line, ":", 1))).alias("name"),
            _strip(F.substr(line, F.instr(line, ":") + 1)).alias("value"),
        ),
    )


def strip_address_type(value: Column | str) -> Column:
    """P36. `rfc822; a@b` -> `a@b`."""
    return F.nullif(_strip(F.regexp_replace(_col(value), r"^[a-zA-Z0-9-]+\s*;\s*([^\r\n]+)$", "$1")), F.lit(""))
