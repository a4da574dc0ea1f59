"""What the operators share: words, word hashes, and small batches for Python tasks."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

HASHED_WORDS = 250_000  # word hashes that one task remembers


def prepared(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; `bytes` methods touch ASCII only."""
    return utf8(text).lower().split()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words: a polynomial in an odd base over their hashes, then mixed."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out + np.uint64(n))


def mapped(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """`mapInArrow` over batches as dicts of column to list; `fn` yields dicts of column to list or array."""
    names = [f.strip().split()[0] for f in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for out in fn(b.to_pydict() for b in batches if b.num_rows):
            types = types or [_arrow(f) for f in _fields(schema)]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    depth, parts, at = 0, [], 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[at:i])
            at = i + 1
    return [*parts, schema[at:]]


def _arrow(field: str) -> pa.DataType:
    kind = field.strip().split(None, 1)[1].strip()
    simple = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if kind in simple:
        return simple[kind]
    if kind.startswith("array<"):
        return pa.list_(_arrow("x " + kind[6:-1]))
    raise ValueError(kind)


def joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, kind)


flat = chain.from_iterable
