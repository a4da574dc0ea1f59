"""Token ids in length-delimited binary records, with a separate index of offsets.

A shard file holds framed records: eight bytes of payload length, the masked CRC-32C of those eight bytes, the payload, and the
payload's masked CRC-32C (all little-endian). A payload is the document's id (eight bytes) and its token ids, two bytes each where
the vocabulary allows it, else four. The index is a Parquet table with a row per record: shard, file, offset, length, token counts.

A retried or speculative task writes a file of its own name; the index, which Spark commits, names only the files of tasks that
counted, so a lost executor leaves at most an unused file, and `write_records` removes those in the end.
"""
from __future__ import annotations

import functools
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countersign.llm.text import mapped
from countersign.session import shared_folder

BLOCK = 64
KEPT_WORDS = 300_000  # encoded words that one task remembers, twice at most
CASTAGNOLI = 0x82F63B78  # fixed value: the reflected CRC-32C polynomial
STOPS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
MASK_DELTA = 0xA282EAD8  # fixed value: the record format's mask
INDEX = "shard int, file string, ord long, doc_id long, offset long, length long, token_start long, n_tokens long"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each distance to a block's end, the CRC of each byte; and for each byte of a CRC, that CRC moved past one block."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CASTAGNOLI), one >> 1).astype(np.uint32)
    by_distance = np.empty((BLOCK, 256), np.uint32)
    by_distance[0] = one
    for d in range(1, BLOCK):
        by_distance[d] = (by_distance[d - 1] >> 8) ^ one[by_distance[d - 1] & 0xFF]
    past = np.empty((4, 256), np.uint32)
    for k in range(4):
        crc = (np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32)
        for _ in range(BLOCK):
            crc = (crc >> 8) ^ one[crc & 0xFF]
        past[k] = crc
    return by_distance, past


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload of at least four bytes; leading zeros leave the register at zero, so blocks align at the end."""
    by_distance, past = _tables() if not hasattr(crc32c, "tables") else crc32c.tables
    crc32c.tables = (by_distance, past)
    blocks = np.array([-(-len(p) // BLOCK) for p in payloads], np.int64)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    data = np.zeros(int(starts[-1]) * BLOCK, np.uint8)
    for p, end in zip(payloads, starts[1:] * BLOCK):
        part = data[end - len(p) : end]
        part[:] = np.frombuffer(p, np.uint8)
        part[:4] ^= 0xFF
    rows = data.reshape(-1, BLOCK)
    raw = np.zeros(len(rows), np.uint32)
    for at in range(BLOCK):
        raw ^= by_distance[BLOCK - 1 - at][rows[:, at]]
    order = np.argsort(-blocks, kind="stable")
    crc, counts, firsts = np.zeros(len(payloads), np.uint32), blocks[order], starts[:-1][order]
    for j in range(int(blocks.max(initial=0))):
        live = int(np.searchsorted(-counts, -j, side="left"))
        c = crc[:live]
        crc[:live] = past[0][c & 0xFF] ^ past[1][(c >> 8) & 0xFF] ^ past[2][(c >> 16) & 0xFF] ^ past[3][c >> 24] ^ raw[firsts[:live] + j]
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


class Encoder:
    """The tokenizer, asked once for each word between spaces.

    Its pre-tokenizer never joins what stands before a space to what stands behind it, where neither neighbour of the space is
    white space itself; it keeps a run of letters whole and parts it from the stops behind it and from new lines. So a word of letters
    goes straight to the tokenizer's model; the stops behind it and single new lines are encoded by themselves. Texts that have other white space next to a space, or a special token, are
    encoded whole.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.code = kind, "H" if kind == "<u2" else "I"
        # The model reads bytes as characters; the alphabet in byte order is printable bytes as themselves, the rest from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.bytes_as = {b: b if b in printable else next(others) for b in range(256)}
        self.byte_level = {chr(c) for c in self.bytes_as.values()} == set(pre_tokenizers.ByteLevel.alphabet()) and "ByteLevel" in str(self.tokenizer.pre_tokenizer) and sys.byteorder == "little"
        self.model, self.space = self.tokenizer.model, chr(self.bytes_as[32])
        self.newline = self.plain("\n")
        self.known: dict[str, bytes | None] = {}
        self.bare: dict[str, bytes] = {}
        self.before: dict[str, bytes | None] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def word(self, word: str) -> bytes | None:
        """Ids of a word behind a space; None where it cannot be told apart from its surroundings."""
        if word in self.before:
            ids = self.before[word]
        elif "\n" not in word:
            ids = self.piece(word, " ")
        else:
            head, *lines = word.split("\n")
            parts = [self.piece(head, " "), *[x for line in lines for x in (self.newline, self.piece(line, ""))]]
            ids = None if None in parts else b"".join(parts)
        self.known[word] = ids
        return ids

    def piece(self, text: str, space: str) -> bytes | None:
        """Ids of a run without spaces or new lines, behind a space or behind what never joins it."""
        core, stop = text, ""
        if not text.isalpha():
            core = text.rstrip(STOPS)
            stop = text[len(core) :]
        if not (self.byte_level and core.isalpha()):
            return None if not text or text[0].isspace() or text[-1].isspace() else self.plain(space + text)
        held = self.known if space else self.bare
        ids = held.get(core)
        if ids is None:
            shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.bytes_as)
            ids = held[core] = array(self.code, [t.id for t in self.model.tokenize((self.space if space else "") + shown)]).tobytes()
        return ids + self.plain_stop(stop) if stop else ids

    @functools.lru_cache(maxsize=4096)  # noqa: B019 - one encoder lives as long as its worker
    def plain_stop(self, stop: str) -> bytes:
        return self.plain(stop)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian bytes; a null counts as empty."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.plain(text)
        if len(self.known) > KEPT_WORDS:
            self.before, self.known = self.known, {}
        if len(self.bare) > KEPT_WORDS:
            self.bare.clear()
        first, *words = text.split(" ")
        parts = list(map(self.known.get, words))
        if None in parts:
            for i, w in enumerate(words):
                if parts[i] is None:
                    parts[i] = self.word(w)
                    if parts[i] is None:
                        return self.plain(text)
        start = self.bare.get(first) or self.start(first)
        return self.plain(text) if start is None else b"".join([start, *parts])

    def start(self, first: str) -> bytes | None:
        """Ids of what stands before a text's first space."""
        lines = [self.piece(line, "") for line in first.split("\n")]
        return None if None in lines else self.newline.join(lines)


@functools.lru_cache(maxsize=1)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, kind)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, order: list[Column] | None = None) -> DataFrame:
    """Encode every text, append `end_id`, write shards in the given order (default: ascending id, rows of one id by their texts' hashes) and return the index.

    Null and empty texts give the end id alone. Rows without an id come first, with id 0 in their record and null in the index.
    Repeated rows give a record each. No rows give an empty index. Other columns are not read. `folder` is a URI that Arrow's file
    systems can write; shards are cut by range over the order, so they follow one another.
    """
    spark = docs.sparkSession
    order = order or [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # hashes: sampled bounds never hold texts
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c for c in ("mix_file", "mix_row") if c in docs.columns])
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        from tokenizers import Tokenizer

        wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        kind = "<u4" if wide else "<u2"
        tokens_of, end = encoder(tokenizer, kind).encode, np.array([end_id], kind).tobytes()
        shard, at, tokens, ord_ = TaskContext.get().partitionId(), 0, 0, 0
        files, base = _filesystem(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        stream = None
        index = []
        for batch in batches:
            stream = stream or files.open_output_stream(f"{base}/{name}")
            payloads = [np.array([i or 0], "<i8").tobytes() + ids + end for i, ids in zip(batch["doc_id"], map(tokens_of, batch["text"]))]
            lengths = np.array([len(p) for p in payloads], "<u8")
            heads = masked(crc32c([n.tobytes() for n in lengths])).astype("<u4")
            tails = masked(crc32c(payloads)).astype("<u4")
            out = {c: [] for c in ("shard", "file", "ord", "doc_id", "offset", "length", "token_start", "n_tokens")}
            for i, p, n, h, t in zip(batch["doc_id"], payloads, lengths, heads, tails):
                stream.write(n.tobytes() + h.tobytes() + p + t.tobytes())
                count = (len(p) - 8) // (4 if wide else 2)
                for c, v in zip(out, (shard, name, ord_, i, at, len(p), tokens, count)):
                    out[c].append(v)
                at, tokens, ord_ = at + len(p) + 16, tokens + count, ord_ + 1
            index.append(out)
        if stream:
            stream.close()
        yield from index

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    mapped(ordered, write, INDEX).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    _remove_unused(index, folder)
    return index


def _remove_unused(index: DataFrame, folder: str) -> None:
    """Files of attempts that did not count; there are about as many names as write tasks."""
    from pyarrow import fs

    files, base = _filesystem(folder)
    used = {r.file for r in index.select("file").distinct().toLocalIterator()}
    for f in files.get_file_info(fs.FileSelector(base)):
        if f.base_name.endswith(".rec") and f.base_name not in used:
            files.delete_file(f.path)


def read_records(spark: SparkSession, folder: str, *, wide: bool = False) -> DataFrame:
    """Read every record through the index, check both checksums, and return a row per document.

    `start` counts the ids of all documents before it, in the order of writing.
    """
    index = spark.read.parquet(f"{folder}/index")
    size = 4 if wide else 2

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        files, base = _filesystem(folder)
        name, handle = None, None
        for b in batches:
            payloads, heads, tails = [], [], []
            for file, offset, length in zip(b["file"], b["offset"], b["length"]):
                if file != name:
                    name, handle = file, files.open_input_file(f"{base}/{file}")
                framed = handle.read_at(length + 16, offset)
                if int.from_bytes(framed[:8], "little") != length or len(framed) != length + 16:
                    raise ValueError(f"{file}: no record of {length} bytes at {offset}")
                heads.append(framed[8:12])
                payloads.append(framed[12:-4])
                tails.append(framed[-4:])
            lengths = [int(n).to_bytes(8, "little") for n in b["length"]]
            for data, stored in ((lengths, heads), (payloads, tails)):
                if (masked(crc32c(data)) != np.frombuffer(b"".join(stored), "<u4")).any():
                    raise ValueError(f"{name}: a checksum does not match")
            ids = [np.frombuffer(p, "<u4" if wide else "<u2", offset=8) for p in payloads]
            yield {
                "doc_id": [None if i is None else int.from_bytes(p[:8], "little", signed=True) for i, p in zip(b["doc_id"], payloads)],
                "shard": b["shard"],
                "token_start": b["token_start"],
                "n_tokens": [len(p) // size - 8 // size for p in payloads],
                "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
            }

    records = mapped(index, read, "doc_id long, shard int, token_start long, n_tokens long, ids_crc32 long")
    # A row per shard: as many as write tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return records.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("token_start")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    """A new folder for records beside the cut lineage, which all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
