"""Quality by ordinal regression: a cumulative link over hashed text features with one weight vector and ordered thresholds.

P(grade <= j) = sigmoid(threshold_j - w.x). Features are relative frequencies of hashed words, word beginnings and word shapes, the
share of words that repeat their neighbour, and the text's length class. The gradient of all examples is summed by Spark tasks, a
row per task, and the driver takes the step.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.llm.text import joined, mapped, utf8
from countersign.session import checkpointed

BITS = 16
SIZE, OWN = 1 << BITS, 64  # weights in all, and those kept for what is not a word
MAX_EXAMPLES = 8192  # graded rows that are learned from: those of the smallest hashes
LEARN_TASKS = 8
STEPS, RATE, RIDGE = 40, 0.5, 1e-4
KEPT_WORDS = 300_000
SHAPE = bytes(ord("a") if 97 <= b <= 122 or b > 127 else ord("A") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


class Codes(dict):
    """Three feature numbers of a word in one integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        low = word.lower()
        names = (b"w" + low, b"p" + low[:5], b"s" + RUNS.sub(rb"\1", word.translate(SHAPE))[:12])
        a, b, c = (OWN + xxhash.xxh32_intdigest(n) % (SIZE - OWN) for n in names)
        value = self[word] = a | b << BITS | c << 2 * BITS
        return value

    def of(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, float]]]:
        """Word codes, and (feature, value) of the text as a whole."""
        words = utf8(text).split()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        echo = float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0
        return codes, [(0, 1.0), (1, echo), (2 + min(len(words).bit_length(), OWN - 3), 1.0)]


def parts(codes: np.ndarray) -> list[np.ndarray]:
    return [codes >> (i * BITS) & (SIZE - 1) for i in range(3)]


def features(codes: np.ndarray, whole: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(np.concatenate(parts(codes)), return_counts=True)
    return np.concatenate([[i for i, _ in whole], at]).astype(np.int32), np.concatenate([[v for _, v in whole], count / max(len(codes), 1)]).astype(np.float32)


def latent(codes: np.ndarray, whole: list[tuple[int, float]], weights: np.ndarray) -> float:
    return sum(weights[i] * v for i, v in whole) + (float(sum(weights[p].sum() for p in parts(codes))) / len(codes) if len(codes) else 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def below(s: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= j) by row, for j = -1 to the last grade."""
    inner = sigmoid(thresholds[None, :] - s[:, None])
    return np.concatenate([np.zeros((len(s), 1)), inner, np.ones((len(s), 1))], axis=1)


def fit(examples: DataFrame, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds from rows of `text, grade`; MAX_EXAMPLES rows at most."""

    def featured(batches: Iterator[dict]) -> Iterator[dict]:
        codes = Codes()
        for b in batches:
            rows = [features(*codes.of(t)) for t in b["text"]]
            # A row per batch, as the gradient wants it: one flat array each.
            flat = {"grade": np.array(b["grade"], np.int32), "size": np.array([len(a) for a, _ in rows], np.int32), "at": joined([a for a, _ in rows], np.int32), "value": joined([v for _, v in rows], np.float32)}
            yield {c: [x.tobytes()] for c, x in flat.items()}

    table = checkpointed(mapped(examples.repartition(LEARN_TASKS), featured, "grade binary, size binary, at binary, value binary"))
    weights, raw = np.zeros(SIZE), np.concatenate([[-1.0], np.zeros(grades - 2)])
    seen_w, seen_r = np.full(SIZE, 1e-8), np.full(grades - 1, 1e-8)
    for _ in range(STEPS):
        now = np.concatenate([raw[:1], np.exp(raw[1:])]).cumsum()
        sums = mapped(table, lambda batches, w=weights.astype(np.float32), t=now: _gradient(batches, w, t), "n long, at binary, thresholds binary")
        total, grad_w, grad_t = 0, np.zeros(SIZE), np.zeros(grades - 1)
        for r in sums.collect():  # a row per task of a bounded sample
            total += r["n"]
            grad_w += np.frombuffer(r["at"], np.float32)
            grad_t += np.frombuffer(r["thresholds"])
        if not total:
            break
        grad_w = grad_w / total + RIDGE * weights
        grad_r = grad_t[::-1].cumsum()[::-1] / total
        grad_r[1:] *= np.exp(raw[1:])
        seen_w += grad_w**2
        seen_r += grad_r**2
        weights -= 4 * RATE * grad_w / np.sqrt(seen_w)
        raw -= RATE * grad_r / np.sqrt(seen_r)
    return weights.astype(np.float32), np.concatenate([raw[:1], np.exp(raw[1:])]).cumsum()


def _gradient(batches: Iterator[dict], weights: np.ndarray, thresholds: np.ndarray) -> Iterator[dict]:
    """Gradient of the negative log-likelihood, summed over a task's rows."""
    n, grad, grad_t = 0, np.zeros(SIZE, np.float32), np.zeros(len(thresholds))
    for y, sizes, at, value in ((np.frombuffer(x, t) for x, t in zip(row, (np.int32, np.int32, np.int32, np.float32))) for b in batches for row in zip(b["grade"], b["size"], b["at"], b["value"])):
        s = np.bincount(np.repeat(np.arange(len(y)), sizes), weights[at] * value, len(y))
        cdf = below(s, thresholds)
        slope, row = cdf * (1 - cdf), np.arange(len(y))
        p = np.maximum(cdf[row, y + 1] - cdf[row, y], 1e-9)
        up, down = slope[row, y + 1] / p, slope[row, y] / p
        grad += np.bincount(at, np.repeat(up - down, sizes) * value, SIZE).astype(np.float32)
        for j in range(len(thresholds)):
            grad_t[j] += down[y == j + 1].sum() - up[y == j].sum()
        n += len(y)
    if n:
        yield {"n": [n], "at": [grad.tobytes()], "thresholds": [grad_t.tobytes()]}


def score_quality(docs: DataFrame, ratings: DataFrame, *, grades: int, learn_where: Column | None = None, select_grade: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> DataFrame:
    """A row per row: `doc_id, expected_grade, tail_probability, kept`.

    `tail_probability` is P(grade >= select_grade); `kept` where it is at least `least`. Ratings that are null, out of 0..grades-1 or
    without an id or a document are left out; an id with several ratings counts with the lowest. Null and empty texts are scored by
    their length class alone; rows with null ids and repeated rows are scored like any other; without ratings all weights are zero; no
    rows give none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
    if learn_where is not None:
        given = given.where(learn_where)
    sample = checkpointed(given.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES))
    weights, thresholds = fit(rows.join(F.broadcast(sample), "doc_id").select("text", "grade"), grades)  # MAX_EXAMPLES rows at most

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codes = Codes()
        for b in batches:
            cdf = below(np.array([latent(*codes.of(t), weights) for t in b["text"]]), thresholds)
            yield {"doc_id": b["doc_id"], "expected_grade": (1 - cdf[:, 1:-1]).sum(axis=1), "tail_probability": 1 - cdf[:, select_grade]}

    scored = mapped(rows, run, "doc_id long, expected_grade double, tail_probability double")
    return scored.select("*", (F.col("tail_probability") >= least).alias("kept"))
