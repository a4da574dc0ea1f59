"""Benchmark decontamination: word n-grams of the test items seed alignments, Smith-Waterman scores them.

1. Hash every four words that stand in order within five of every item, so a replaced, added or missing word leaves seeds around it. A bitmap of
   fixed size tells which hashes can be an item's.
2. Each document keeps the passages in which the bitmap lets enough different hashes through; most documents have none.
3. Join the passages' hashes with the items'. No hash is too common to seed; what is rare is their company: a passage and an item must share
   two different seeds (one, if the item is short). The join splits hot hashes, and counts are added before pairs are dealt.
4. Align every such (passage, item) in words, within twice the item's own length around the seeds; the score is the best local alignment over
   the item's alignment with itself. Pairs whose common words cannot reach the least score are not aligned.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countersign.llm.text import WordHashes, joined, mapped, mixed, utf8, window_hashes
from countersign.session import checkpointed

N = 4
SKIPS = ((0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
BITMAP_BITS = 26  # eight megabytes, however many items
SHORT = 12  # words of an item under which one seed suffices
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space part them."""
    return utf8((text or "").lower()).translate(TABLE).split()


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all four words in order within five; the hash tells the words, not where the gap is."""
    places, found = [np.arange(max(0, len(words) - N + 1))], [window_hashes(words, N)]
    for skip in SKIPS if len(words) > N else ():
        total = np.zeros(len(words) - N, np.uint64)
        for k in skip:
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - N + k]
        places.append(np.arange(len(words) - N))
        found.append(mixed(total + np.uint64(N)))
    return joined(places, np.int64), joined(found, np.uint64)


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score with linear gaps, and where in the passage it ends (the earliest such place)."""
    best, end = 0, 0
    row = np.zeros(len(passage) + 1, np.int64)
    climb = -GAP * np.arange(len(passage) + 1)
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum(np.maximum.accumulate(new + climb) - climb, 0)
        row[0] = 0
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item whose best alignment scores at least `least`: `doc_id, item_id, score, start_word, end_word, n_seeds`.

    `start_word` to `end_word` (exclusive) are the document's words that align. Texts and items of any length are searched whole. Items of fewer than four words are not sought. Null
    texts have no words; rows with null ids are searched too and give null ids; documents that share an id give one row per item, with the
    best score and then the first place; of rows that share an item id each counts. Without items or documents there are no rows; other
    columns are not read.
    """
    spark = docs.sparkSession

    def read_items(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for b in batches:
            words = [hashes.of(words_of(t)) for t in b["item_text"]]
            yield {"item_id": b["item_id"], "item": [w.astype(np.int64) for w in words], "grams": [np.unique(seeds_of(w)[1]).astype(np.int64) for w in words]}

    asked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    items = checkpointed(mapped(asked, read_items, "item_id long, item array<long>, grams array<long>").where(F.size("grams") > 0).withColumn("item_row", F.monotonically_increasing_id()))
    grams = items.select("item_row", F.explode("grams").alias("gram"))
    filled = grams.select(F.expr(f"pmod(gram, {1 << BITMAP_BITS}) div 32").alias("at"), F.expr(f"shiftleft(1L, int(pmod(gram, {1 << BITMAP_BITS}) % 32))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    bitmap = np.zeros(1 << BITMAP_BITS - 5, np.uint32)
    for r in filled.toLocalIterator():  # at most 2 ** 21 rows
        bitmap[r["at"]] = r["bits"]
    sizes = items.agg(F.max(F.size("item")).alias("longest"), F.min(F.size("item")).alias("shortest")).first()
    reach, enough = 2 * (sizes["longest"] or 0), 1 if (sizes["shortest"] or 0) < SHORT else 2
    sent = spark.sparkContext.broadcast(bitmap)

    def seek(batches: Iterator[dict]) -> Iterator[dict]:
        hashes, known = WordHashes(), sent.value
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "passage", "grams", "firsts", "lasts")}
            for doc_id, text in zip(b["doc_id"], b["text"]):
                words = hashes.of(words_of(text))
                places, found = seeds_of(words)
                low = (found & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                hit = np.flatnonzero(known[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1))
                if len(hit) < enough:
                    continue
                hit = hit[np.argsort(places[hit], kind="stable")]
                for part in np.split(hit, np.flatnonzero(np.diff(places[hit]) > reach) + 1):
                    grams, first, which = np.unique(found[part], return_index=True, return_inverse=True)
                    if len(grams) < enough:
                        continue
                    start = max(0, int(places[part[0]]) - reach)
                    last = np.zeros(len(grams), np.int64)
                    np.maximum.at(last, which, places[part])
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["passage"].append(words[start : int(places[part[-1]]) + N + 1 + reach].astype(np.int64))
                    out["grams"].append(grams.astype(np.int64))
                    out["firsts"].append(places[part[first]] - start)
                    out["lasts"].append(last - start)
            if out["doc_id"]:
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sought = mapped(rows, seek, "doc_id long, start long, passage array<long>, grams array<long>, firsts array<long>, lasts array<long>")
    passages = checkpointed(sought.withColumn("row", F.monotonically_increasing_id()))
    seeds = passages.select("row", F.inline(F.arrays_zip("grams", "firsts", "lasts"))).select("row", F.col("grams").alias("gram"), F.col("firsts").alias("lo"), F.col("lasts").alias("hi"))
    pairs = seeds.join(grams, "gram").groupBy("row", "item_row").agg(F.count("*").alias("n_seeds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known_items = items.select("item_row", "item_id", "item", F.size("item").alias("size"))
    likely = pairs.join(known_items, "item_row").where((F.col("n_seeds") > 1) | (F.col("size") < SHORT))
    begin = F.greatest(F.lit(0), F.col("lo") - 2 * F.col("size"))
    upto = F.col("hi") + N + 1 + 2 * F.col("size")
    both = likely.join(passages.select("row", "doc_id", "start", "passage"), "row").select(
        "doc_id", "item_id", (F.col("start") + begin).alias("first"), F.slice("passage", (begin + 1).cast("int"), (upto - begin).cast("int")).alias("passage"), "item", "n_seeds"
    )

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "score", "start_word", "end_word", "n_seeds")}
            for doc_id, item_id, first, passage, item, n in zip(b["doc_id"], b["item_id"], b["first"], b["passage"], b["item"], b["n_seeds"]):
                passage, item = np.array(passage, np.int64), np.array(item, np.int64)
                if np.isin(item, passage).sum() < least * len(item):  # no alignment matches more words
                    continue
                best, end = align(passage, item)
                share = best / (MATCH * len(item))
                if share >= least:
                    _, back = align(passage[:end][::-1], item[::-1])
                    for c, v in zip(out, (doc_id, item_id, share, first + end - back, first + end, n)):
                        out[c].append(v)
            yield out

    found = mapped(both, score, "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("back"), "end_word", "n_seeds")).alias("best")
    kept = found.groupBy("doc_id", "item_id").agg(best)
    return kept.select("doc_id", "item_id", F.round("best.score", 6).alias("score"), (-F.col("best.back")).alias("start_word"), "best.end_word", "best.n_seeds")
