"""Published-key records and proof-tool text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countersign.functions.headers import _col, _group


def extract_public_key(txt: Column | str) -> Column:
    """P23. The first `p=` value of a key record without its whitespace, NULL if none."""
    value = F.regexp_extract(_col(txt), r"(?i)(?:^|;)\s*p\s*=([^;]*)", 1)
    return F.when(_col(txt).rlike(r"(?i)(?:^|;)\s*p\s*="), F.regexp_replace(value, r"\s+", ""))


def to_pem(base64: Column | str) -> Column:
    """P24. 64-column lines between the key markers."""
    b = _col(base64)
    lines = F.regexp_replace(b, "(.{64})(?=.)", "$1\n")
    return F.when(
        b != "",
        F.concat(F.lit("-----BEGIN PUBLIC KEY-----\n"), lines, F.lit("\n-----END PUBLIC KEY-----\n")),
    )


# fixed values: the shapes in which proof tools print a block height, tried in order
BLOCK_HEIGHT_SHAPES = (
    r"(?i)Bitcoin\s+block\s+(?:height\s+)?(\d+)",
    r"(?i)Block\s+height[:\s]+(\d+)",
    r"(?is)BitcoinBlockHeaderAttestation.*?\b(\d{6,})\b",
)


def parse_block_height(text: Column | str) -> Column:
    """P25. First shape that yields a positive height, else NULL."""
    heights = [_group(_col(text), shape).try_cast("bigint") for shape in BLOCK_HEIGHT_SHAPES]
    return F.coalesce(*[F.when(h > 0, h) for h in heights])
