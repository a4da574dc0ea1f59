"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class). A token's class is its ending's (eight of them) and whether it is among the
frequent tokens. The class has a softmax over hashed features of the context: the word before, the word before that (a skip), and the
classes of the three words before. The inner factor is a softmax over the class's tokens: a token's bias is the logarithm of its smoothed
count, and hashed n-gram and skip features pair its cell (one of CELLS, by its hash) with the word before and with the word before that.
Tokens of one cell share these weights, so the sum under the fraction needs the mass of each cell, not the vocabulary.

Training makes a few distributed updates. The gradient of a weight is how often its feature and class were seen less how often the
model means them to be: every task sums both over its share of the texts, Spark adds the sums up in two levels, and the weights move by
the logarithm of their ratio (iterative scaling, which cannot overshoot). The rounds' shares are disjoint and cover all training texts.

Counts of the frequent tokens (a table of fixed size) go to every task; counts of all others are joined by token, so that no hot token
meets in one task and no table that grows with the corpus is sent around.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.llm.text import HASHED_WORDS, lower_words, mapped, mixed
from countersign.session import checkpointed

FREQUENT = 1 << 18  # tokens whose counts every task has
ENDINGS, CLASSES = 8, 16
BUCKETS = 1 << 13  # weights rows of each word feature; the first ones are for contexts told by their class alone
NONE = CLASSES  # the class before a text's start
TRIPLES = (CLASSES + 1) ** 3
ROUNDS, CALM = 3, 4.0
SMOOTHING = 0.1
CHUNK = 1 << 16  # tokens that are scored at once
COUNTED = 1 << 20  # tokens that are counted at once
BLOCKS, FAN_IN = 32, 64
ROWS = 2 * BUCKETS + TRIPLES
CELLS, WORDS, SKIPS = 512, 512, 32  # of the inner factor: cells of tokens, rows for the word before and for the one before that
INNER_CALM = 2.0
LOG10 = np.log(10.0)


#: The class of a word's last letter, in groups that tell languages and word kinds apart; other last characters have class 0.
ENDING_OF = {letter: k for k, group in enumerate(("e", "s", "td", "n", "rlm", "hgk", "aoiuy"), 1) for letter in group.encode()}


class Tokens(dict):
    """A word's number: its hash, the last three bits replaced by the class of its ending."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHED_WORDS:
            self.clear()
        last = word.rstrip(b".,;:!?")[-1:]
        number = xxhash.xxh64_intdigest(word) >> 3 << 3 | (ENDING_OF.get(last[0], 0) if last else 0)
        value = self[word] = number - (1 << 64) if number >> 63 else number
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words and of its end, which is no word's."""
        words = lower_words(text)
        words.append(b" ")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Frequent:
    """Numbers and counts of the frequent tokens, ordered by number."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray):
        order = np.argsort(numbers)
        self.numbers, self.counts = numbers[order], counts[order]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token, or -1."""
        if not len(self.numbers):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.numbers, tokens), len(self.numbers) - 1)
        return np.where(self.numbers[at] == tokens, at, -1)


def classes(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (tokens & (ENDINGS - 1)) + ENDINGS * (place >= 0)


def _back(values: np.ndarray, n: int, none: int, at: np.ndarray) -> np.ndarray:
    out = np.full(len(values), none, np.int64)
    out[n:] = values[:-n] if n < len(values) else out[n:]
    out[at < n] = none
    return out


def _positions(sizes: list[int]) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def cells(tokens: np.ndarray) -> np.ndarray:
    """Hash bits that the class does not use."""
    return tokens >> 3 & (CELLS - 1)


def inner_contexts(tokens: np.ndarray, place: np.ndarray, cls: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the inner factor's two features: the word before and the word before that, rare ones by their class."""
    at, hashed = _positions(sizes), mixed(tokens.view(np.uint64)) >> np.uint64(20)

    def row(n: int, rows: int) -> np.ndarray:
        own = CLASSES + 1 + (hashed % np.uint64(rows - CLASSES - 1)).astype(np.int64)
        return _back(np.where(place >= 0, own, cls), n, NONE, at)

    return row(1, WORDS), row(2, SKIPS)


class Inner:
    """Weights of the inner factor and the logarithm of its sums, for the mass of each class's cells."""

    def __init__(self, mass: np.ndarray):
        self.mass, self.word, self.skip = mass, np.zeros((WORDS, CELLS)), np.zeros((SKIPS, CELLS))

    def sums(self) -> np.ndarray:
        """Of each class under each pair of rows: the features' exponentials multiply, so it is a product of matrices."""
        return np.stack([np.exp(self.word) @ (m * np.exp(self.skip)).T for m in self.mass])

    def learn(self, seen_word: np.ndarray, seen_skip: np.ndarray, met: np.ndarray) -> None:
        """One update by iterative scaling; `met` counts class and rows of each position, all that the expectations need."""
        by_word, by_skip = np.exp(self.word), np.exp(self.skip)
        meant_word, meant_skip = np.zeros_like(by_word), np.zeros_like(by_skip)
        for m, share in zip(self.mass, met / self.sums()):
            meant_word += by_word * (share @ (m * by_skip))
            meant_skip += by_skip * m * (share.T @ by_word)
        # Two features are active at a time.
        self.word += np.log((seen_word + INNER_CALM) / (meant_word + INNER_CALM)) / 2
        self.skip += np.log((seen_skip + INNER_CALM) / (meant_skip + INNER_CALM)) / 2

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both features' weights and the sums, all as log10."""
        return tuple(x.astype(np.float32) for x in (self.word / LOG10, self.skip / LOG10, np.log10(self.sums())))


def contexts(tokens: np.ndarray, place: np.ndarray, cls: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Three weight rows of each position of the texts that stand one behind another."""
    at = _positions(sizes)

    def back(values: np.ndarray, n: int, none: int) -> np.ndarray:
        return _back(values, n, none, at)

    own = CLASSES + 1 + (mixed(tokens.view(np.uint64)) % np.uint64(BUCKETS - CLASSES - 1)).astype(np.int64)
    word = np.where(place >= 0, own, cls)
    before = [back(cls, n, NONE) for n in (1, 2, 3)]
    triple = (before[0] * (CLASSES + 1) + before[1]) * (CLASSES + 1) + before[2]
    return np.stack([back(word, 1, NONE), BUCKETS + back(word, 2, NONE), 2 * BUCKETS + triple])


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = weights[rows[0]]
    logits += weights[rows[1]]
    logits += weights[rows[2]]
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def chunks(texts: list[str | None], tokens: Tokens) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Texts one behind another: tokens, sizes, and the texts' places; a chunk ends with the text that fills it."""
    parts, sizes, at, total = [], [], [], 0
    for i, text in enumerate(texts):
        parts.append(tokens.of(text))
        sizes.append(len(parts[-1]))
        at.append(i)
        total += sizes[-1]
        if total >= CHUNK or i == len(texts) - 1:
            yield np.concatenate(parts), sizes, at
            parts, sizes, at, total = [], [], [], 0


def count_tokens(rows: DataFrame) -> DataFrame:
    """`token, c` over all rows of `text`."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        tokens, held, size = Tokens(), [], 0
        for b in batches:
            for text in b["text"]:
                held.append(tokens.of(text))
                size += len(held[-1])
                if size >= COUNTED:
                    found, n = np.unique(np.concatenate(held), return_counts=True)
                    yield {"token": found, "c": n}
                    held, size = [], 0
        if held:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield {"token": found, "c": n}

    return mapped(rows.select("text"), count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame) -> Frequent:
    """The tokens above a count that at most FREQUENT of them reach; counts are compared by sixteenths of their binary logarithm."""
    level = F.floor(F.log2("c") * 16)
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"])  # about a thousand rows at most
    total, cut = 0, None
    for r in levels:
        total += r["n"]
        if total > FREQUENT:
            break
        cut = r["level"]
    if cut is None:
        return Frequent(np.empty(0, np.int64), np.empty(0, np.int64))
    table = counts.where(level >= cut).select("token", "c").toArrow()  # FREQUENT rows at most
    return Frequent(table["token"].to_numpy(), table["c"].to_numpy())


def class_totals(counts: DataFrame, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct tokens of each class."""
    by_ending = counts.groupBy(F.col("token").bitwiseAND(ENDINGS - 1).alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_ending:
        n[r["e"]], v[r["e"]] = r["n"], r["v"]
    ending = frequent.numbers & (ENDINGS - 1)
    n[ENDINGS:], v[ENDINGS:] = np.bincount(ending, frequent.counts, ENDINGS), np.bincount(ending, minlength=ENDINGS)
    n[:ENDINGS] -= n[ENDINGS:]
    v[:ENDINGS] -= v[ENDINGS:]
    return n, v


def cell_mass(counts: DataFrame, frequent: Frequent) -> np.ndarray:
    """Smoothed training tokens of each class's cells. The mass of the class's one unknown token, which may fall in any, is spread over them."""
    ending, cell = F.col("token").bitwiseAND(ENDINGS - 1), F.shiftright("token", 3).bitwiseAND(CELLS - 1)
    mass = np.full((CLASSES, CELLS), SMOOTHING / CELLS)
    for r in counts.groupBy(ending.alias("e"), cell.alias("cell")).agg(F.sum(F.col("c") + F.lit(SMOOTHING)).alias("n")).collect():  # ENDINGS x CELLS rows at most
        mass[r["e"], r["cell"]] += r["n"]
    at = (frequent.numbers & (ENDINGS - 1)) * CELLS + cells(frequent.numbers)
    common = np.bincount(at, frequent.counts + SMOOTHING, ENDINGS * CELLS).reshape(ENDINGS, CELLS)
    mass[ENDINGS:] += common
    mass[:ENDINGS] = np.maximum(mass[:ENDINGS] - common, SMOOTHING / CELLS)
    return mass


def train(rows: DataFrame, frequent, bias: np.ndarray, inner: Inner) -> np.ndarray:
    """Weights after ROUNDS updates, of `inner` too; round r sees the rows of `text, part` whose part is r."""
    spark = rows.sparkSession
    shapes = ((WORDS, CELLS), (SKIPS, CELLS), (CLASSES, WORDS, SKIPS))
    ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    step = -(-int(ends[-1]) // BLOCKS)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    size, calm = -(-ROWS // BLOCKS), CALM * np.exp(bias)
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)

        def sums(batches: Iterator[dict], sent=sent) -> Iterator[dict]:
            tokens, known, now = Tokens(), frequent.value, sent.value
            seen, meant = np.zeros(ROWS * CLASSES), np.zeros(ROWS * CLASSES)
            every, met = np.arange(CLASSES), np.zeros(step * BLOCKS)
            for b in batches:
                for found, sizes, _ in chunks(b["text"], tokens):
                    place = known.find(found)
                    cls = classes(found, place)
                    at = contexts(found, place, cls, sizes)
                    p = probabilities(now, bias, at).reshape(-1)
                    for rows_ in at:
                        first = rows_ * CLASSES
                        seen += np.bincount(first + cls, minlength=len(seen))
                        meant += np.bincount((first[:, None] + every).reshape(-1), p, len(meant))
                    cell, (word, skip) = cells(found), inner_contexts(found, place, cls, sizes)
                    for k, index in enumerate((word * CELLS + cell, skip * CELLS + cell, (cls * WORDS + word) * SKIPS + skip)):
                        met[ends[k] : ends[k + 1]] += np.bincount(index, minlength=ends[k + 1] - ends[k])
            for k in range(BLOCKS):
                part = slice(k * size * CLASSES, (k + 1) * size * CLASSES)
                yield {"block": [k], "task": [TaskContext.get().partitionId() // FAN_IN], "seen": [seen[part].astype(np.float32).tobytes()], "meant": [meant[part].astype(np.float32).tobytes()], "met": [met[k * step : (k + 1) * step].astype(np.float32).tobytes()]}

        form = "block int, task int, seen binary, meant binary, met binary"
        partial = mapped(rows.where(F.col("part") == r).select("text"), sums, form)
        added = partial.groupBy("block", "task").applyInArrow(_added, form).groupBy("block").applyInArrow(_added, form)
        counted = np.zeros(step * BLOCKS)
        for x in added.collect():  # BLOCKS rows
            part = slice(x["block"] * size, min(ROWS, (x["block"] + 1) * size))
            seen, meant = (np.frombuffer(x[c], np.float32).reshape(-1, CLASSES) for c in ("seen", "meant"))
            weights[part] += np.log((seen + calm) / (meant + calm)) / 3  # three features are active at a time
            counted[x["block"] * step : (x["block"] + 1) * step] = np.frombuffer(x["met"], np.float32)
        inner.learn(*(counted[ends[k] : ends[k + 1]].reshape(shape) for k, shape in enumerate(shapes)))
        sent.unpersist()
    return weights


def _added(group: pa.Table) -> pa.Table:
    """Sum of a group's arrays: of at most FAN_IN tasks, or of as many such sums as there are."""
    out = {c: sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in group[c]).astype(np.float32).tobytes() for c in ("seen", "meant", "met")}
    return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in out.items()}})


def score_texts(docs: DataFrame, *, learn_where: Column | None = None, part: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: `doc_id, n_tokens, n_known, train_tokens, base_score, score`.

    `learn_where`, a condition on `doc_id`, says which rows to learn from, and `part` (0 to ROUNDS - 1) in which round. `base_score` is
    the smoothed unigram log10 probability, `score` the model's. A text has a token for each word and one for its end; null and empty
    texts have the end alone. Rows with null ids (not learned from if the condition is null for them) and repeated rows are scored like
    any other. With nothing to learn from, counts are zero and the unigram has one unknown token. No rows give none; other columns are not
    read. Tokens are told apart by 61 bits of their hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    part = F.lit(0) if part is None else part
    learned = (rows if learn_where is None else rows.where(learn_where)).withColumn("part", part)
    counts = checkpointed(count_tokens(learned))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = most_frequent(counts)
    class_n, _ = class_totals(counts, frequent)
    bias = np.log((class_n + 1) / (class_n.sum() + CLASSES)).astype(np.float32)
    inner = Inner(cell_mass(counts, frequent))
    few = spark.sparkContext.broadcast(frequent)
    weights = spark.sparkContext.broadcast(train(learned, few, bias, inner))
    tables = spark.sparkContext.broadcast(inner.tables())

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        tokens, known = Tokens(), few.value
        logs, (by_word, by_skip, under) = np.log10(known.counts + SMOOTHING), tables.value
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_tokens": [], "common": [], "common_log": [], "outer_log": [], "rare": [], "times": []}
            for found, sizes, _ in chunks(b["text"], tokens):
                place = known.find(found)
                cls = classes(found, place)
                p = probabilities(weights.value, bias, contexts(found, place, cls, sizes))[np.arange(len(cls)), cls]
                cell, (word, skip) = cells(found), inner_contexts(found, place, cls, sizes)
                outer = np.log10(np.maximum(p, 1e-30)) + by_word[word, cell] + by_skip[skip, cell] - under[cls, word, skip]
                common = np.where(place >= 0, logs[place], 0.0) if len(logs) else np.zeros(len(place))
                start = 0
                for size in sizes:
                    own = slice(start, start + size)
                    rare, times = np.unique(found[own][place[own] < 0], return_counts=True)
                    for c, x in zip(list(out)[1:], (size, int((place[own] >= 0).sum()), float(common[own].sum()), float(outer[own].sum()), rare, times)):
                        out[c].append(x)
                    start += size
            yield out

    table = checkpointed(mapped(rows, score, "doc_id long, n_tokens long, common long, common_log double, outer_log double, rare array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id()))
    rare = table.where(F.size("rare") > 0).select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "token")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)
    summed = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("times") * log_c).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    whole = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0))
    return table.drop("rare", "times").join(summed, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (whole - F.col("n_tokens") * float(np.log10(n + SMOOTHING * (v + 1)))).alias("base_score"),
        (whole + F.col("outer_log")).alias("score"),
    )
