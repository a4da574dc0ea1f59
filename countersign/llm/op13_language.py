"""Language identification by interpolated Kneser-Ney character models.

A model per language holds, for each order up to ORDER, the hashes of its n-grams and of their contexts in sorted arrays, with the
interpolated log probability of the one and the log back-off weight of the other. A character that a language has seen after its context
takes one look-up; otherwise the weight of the context is added and the next lower order asked. The language of the lowest cross-entropy a character is chosen.

N-grams are counted by tasks over a bounded sample of the labelled texts and summed by groups; the models of all languages together are
bounded by the sample and sent to every task. Texts of the sample that are held back calibrate the verdict: how often a lead of so many nats
over the second language was right gives the score, and the cross-entropies of a language's own texts give the bound above which a text is rejected.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countersign.llm.text import mapped, mixed
from countersign.session import checkpointed

ORDER = 5
MAX_CHARS = 400_000  # characters of a language that are learned from, at most
ALL_CHARS = 8_000_000  # of all languages together: more of them get less each
SYMBOLS = 4096  # characters among which an unseen one is guessed
WINDOW = 1 << 17  # characters whose n-grams are looked up together
HELD_BACK = 8  # one in so many sampled texts calibrates
PIECES = (1, 2, 4, 8, 16, 32, 64)  # words of the short texts that calibrate beside whole ones
BINS = 64
SENT = 10_000  # rows of a table of languages that is sent to every task
SPACE = 32


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one space for whatever stands between them, and the text each belongs to; text by text."""
    lowered = ["" if t is None else t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[codes]
    before = np.concatenate([[False], letter[:-1] & (owner[1:] == owner[:-1])]) if len(codes) else letter
    keep = letter | before
    return np.where(letter, codes, SPACE)[keep], owner[keep]


def grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Window by window: the owners of its characters, hashes of their n-grams (n from 1) and of the n-grams before them (n from 0)."""
    lead = ORDER
    starts = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, bool)
    at = np.arange(len(codes)) + lead * np.cumsum(starts)
    padded = np.full(len(codes) + lead * int(starts.sum()), SPACE, np.uint64)
    padded[at] = codes
    for begin in range(0, len(codes), WINDOW):
        here = at[begin : begin + WINDOW]
        low = here[0] - lead
        c = padded[low : here[-1] + 1]
        back = [c]
        for k in range(1, ORDER):
            back.append(np.concatenate([np.full(k, SPACE, np.uint64), c[:-k]]))
        three = (back[2] << np.uint64(42)) | (back[1] << np.uint64(21)) | c
        hashes = [
            mixed(c + np.uint64(1)),
            mixed((back[1] << np.uint64(21)) + c + np.uint64(1 << 42)),
            mixed(three | np.uint64(1 << 63)),
            mixed(mixed(three) + back[3] + np.uint64(1)),
            mixed(mixed(three) + (back[4] << np.uint64(21)) + back[3] + np.uint64(1 << 43)),
        ]
        place = here - low
        yield owner[begin : begin + WINDOW], [h[place] for h in hashes], [h[place - 1] for h in hashes[:-1]]


def _portions(langs: list, texts: list) -> Iterator[tuple[list, list]]:
    """Rows of a batch, as many together as fill a window."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= WINDOW:
            yield langs[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield langs[at:], texts[at:]


COUNTS = "lang string, n int, gram long, shorter long, context long, times long"


def _counted(batches: Iterator[dict]) -> Iterator[dict]:
    for b in batches:
        for langs, texts in _portions(b["lang"], b["text"]):
            codes, owner = normalised(texts)
            names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            of = np.array([names[x] for x in langs])
            for who, found, contexts in grams(codes, owner):
                lang_of = of[who]
                for name, i in names.items():
                    mine = lang_of == i
                    for n in range(ORDER, 0, -1):
                        values, first, times = np.unique(found[n - 1][mine], return_index=True, return_counts=True)
                        shorter = found[n - 2][mine][first] if n > 1 else np.zeros(len(values), np.uint64)
                        context = contexts[n - 2][mine][first] if n > 1 else np.zeros(len(values), np.uint64)
                        yield {
                            "lang": [name] * len(values), "n": np.full(len(values), n, np.int32), "gram": values.view(np.int64), "shorter": shorter.view(np.int64),
                            "context": context.view(np.int64), "times": times.astype(np.int64),
                        }


class Model:
    """One language: per order sorted hashes with log probabilities, and sorted contexts with log back-off weights."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], floor: float):
        self.orders, self.floor = orders, floor

    def log_probabilities(self, found: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Of each character after the ones before it, in nats."""
        out, left, owed = np.empty(len(found[0])), np.arange(len(found[0])), np.zeros(len(found[0]))
        for n in range(ORDER, 0, -1):
            hashes, logs, context_hashes, weights = self.orders[n - 1]
            value, hit = _looked_up(hashes, logs, found[n - 1][left])
            out[left[hit]] = owed[left[hit]] + value[hit]
            left = left[~hit]
            if n > 1:
                value, hit = _looked_up(context_hashes, weights, contexts[n - 2][left])
                owed[left[hit]] += value[hit]
        out[left] = owed[left] + self.floor
        return out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def fitted(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from `gram, shorter, context, times` of each order (sorted by gram): raw counts at the top, below it the
    number of longer n-grams that end in one, and a discount for each order from how many were seen once and twice."""
    orders: list = []
    shorter_probability = np.empty(0)
    for n in range(1, len(tables) + 1):
        gram, shorter, context, times = tables[n - 1]
        if n == len(tables):
            count = times.astype(np.float64)
        else:
            count = np.bincount(np.searchsorted(gram, tables[n][1]), minlength=len(gram)).astype(np.float64)
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.1
        contexts, which = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(which, count), np.bincount(which)
        weight = discount * kinds / total
        if n == 1:
            lower, floor = 1 / SYMBOLS, float(np.log(weight[0] / SYMBOLS)) if len(weight) else float(np.log(1 / SYMBOLS))
        else:
            lower = shorter_probability[np.searchsorted(tables[n - 2][0], shorter)]
        probability = np.maximum(count - discount, 0) / total[which] + weight[which] * lower
        orders.append((gram, np.log(probability).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
        shorter_probability = probability
    return Model(orders, floor)


MODEL = "lang string, n int, grams binary, logs binary, contexts binary, weights binary, floor double"


def _fit_language(frame: pd.DataFrame) -> pd.DataFrame:
    """The model of a language from its counts, a row for each order."""
    tables = []
    for n in range(1, ORDER + 1):
        part = frame[frame["n"] == n]
        columns = [part[c].to_numpy(np.int64).view(np.uint64) for c in ("gram", "shorter", "context")]
        order = np.argsort(columns[0])
        tables.append((*(c[order] for c in columns), part["times"].to_numpy()[order]))
    model = fitted(tables)
    lang = frame["lang"].iloc[0]
    rows = [(lang, n + 1, g.tobytes(), p.tobytes(), c.tobytes(), w.tobytes(), model.floor) for n, (g, p, c, w) in enumerate(model.orders)]
    return pd.DataFrame(rows, columns=["lang", "n", "grams", "logs", "contexts", "weights", "floor"])


def sample_texts(docs: DataFrame, learn: Column, max_chars: int, all_chars: int) -> DataFrame:
    """`lang, text, h`: whole texts of the smallest hashes, up to `max_chars` of a language; equal texts of a language count once."""
    usable = learn & F.col("lang").isNotNull() & (F.length("text") > 0)
    rows = docs.where(usable).select("lang", "text", (F.xxhash64("text").bitwiseAND((1 << 62) - 1)).alias("h"))
    keys = checkpointed(rows.select("lang", "h", F.length("text").cast("long").alias("chars")))
    sizes = checkpointed(keys.groupBy("lang").agg(F.sum("chars").alias("total"), F.count("*").alias("n")))
    languages = sizes.count()
    # A row for each language; texts meet them where they are read, unless there are very many.
    beside = F.broadcast if languages <= SENT else (lambda df: df)
    bound = F.lit(min(max_chars, all_chars // max(languages, 1)))
    # Of a large language only about half as many again as will be taken are ranked.
    few = keys.join(beside(sizes), "lang").where(F.col("h") / float(1 << 62) < 1.5 * bound / F.col("total") + 64 / F.col("n")).groupBy("lang", "h").agg(F.min("chars").alias("chars"))
    before = F.coalesce(F.sum("chars").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = checkpointed(few.withColumn("before", before).where(F.col("before") < bound).groupBy("lang").agg(F.max("h").alias("cut")))
    return checkpointed(rows.join(beside(cuts), "lang").where("h <= cut").dropDuplicates(["lang", "h"]).select("lang", "text", "h"))


def learn_models(sample: DataFrame) -> dict[str, Model]:
    """A model for each language of the sample; as large as the sample's distinct n-grams."""
    counts = mapped(sample.select("lang", "text"), _counted, COUNTS)
    summed = counts.groupBy("lang", "n", "gram").agg(F.min("shorter").alias("shorter"), F.min("context").alias("context"), F.sum("times").alias("times"))
    rows = summed.groupBy("lang").applyInPandas(_fit_language, MODEL).collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"].encode(), r["n"])):
        arrays = tuple(np.frombuffer(r[c], t) for c, t in (("grams", np.uint64), ("logs", np.float32), ("contexts", np.uint64), ("weights", np.float32)))
        kept.setdefault(r["lang"], [r["floor"], []])[1].append(arrays)
    return {lang: Model(orders, floor) for lang, (floor, orders) in kept.items()}


def cross_entropies(texts: list[str | None], models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Nats a character of each text (rows) under each model (columns), and the characters of the texts."""
    codes, owner = normalised(texts)
    length = np.bincount(owner, minlength=len(texts))
    sums = np.zeros((len(texts), len(models)))
    for who, found, contexts in grams(codes, owner):
        # Each different n-gram is looked up once for all its places.
        _, first, back = np.unique(found[-1], return_index=True, return_inverse=True)
        found, contexts = [f[first] for f in found], [c[first] for c in contexts]
        for k, model in enumerate(models):
            sums[:, k] -= np.bincount(who, model.log_probabilities(found, contexts)[back], len(texts))
    return sums / np.maximum(length, 1)[:, None], length


def _judged(texts: list[str | None], models: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best model, its cross-entropy, its lead over the second in nats, and the number of characters."""
    entropy, length = cross_entropies(texts, models)
    best = np.argmin(entropy, axis=1)
    lowest = entropy[np.arange(len(texts)), best]
    rest = entropy.copy()
    rest[np.arange(len(texts)), best] = np.inf
    lead = (rest.min(axis=1) - lowest) * length if len(models) > 1 else np.zeros(len(texts))
    return best, lowest, lead, length


def _bin(lead: np.ndarray) -> np.ndarray:
    """Eight bins for each doubling of the lead, from 1/16 nat on."""
    return np.clip(np.floor(8 * np.log2(np.maximum(lead, 1e-9) * 16)) + 1, 0, BINS - 1).astype(np.int64)


def isotonic(right: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Shares that never fall from one bin to the next, by pooling neighbours that do; one right and one wrong case are added to each pool
    of the whole, shared out evenly."""
    pools: list[list[float]] = []
    for r, n in zip(right + 1 / len(right), all_ + 2 / len(right)):
        pools.append([r, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            r1, n1, k1 = pools.pop()
            pools[-1] = [pools[-1][0] + r1, pools[-1][1] + n1, pools[-1][2] + k1]
    return np.concatenate([np.full(int(k), r / n) for r, n, k in pools])


def _calibrated(held: DataFrame, models: dict[str, Model], shared, quantile: float) -> tuple[np.ndarray, dict[str, float]]:
    """Score of each bin of leads, and the cross-entropy above which a text is rejected as none of a language's."""

    def judge(batches: Iterator[dict]) -> Iterator[dict]:
        names, own = list(shared.value), list(shared.value.values())
        for b in batches:
            for langs, texts in _portions(b["lang"], b["text"]):
                pieces, of, whole = [], [], []
                for lang, text in zip(langs, texts):
                    words = text.split(None, PIECES[-1])
                    for k in PIECES:
                        if len(words) > k:
                            pieces.append(" ".join(words[:k]))
                            of.append(lang)
                            whole.append(False)
                    pieces.append(text)
                    of.append(lang)
                    whole.append(True)
                best, lowest, lead, length = _judged(pieces, own)
                some = np.flatnonzero(length > 0)
                yield {
                    "lang": [of[i] for i in some], "right": [names[best[i]] == of[i] for i in some], "bin": _bin(lead[some]), "entropy": lowest[some], "whole": [whole[i] for i in some],
                }

    judged = checkpointed(mapped(held.select("lang", "text"), judge, "lang string, right boolean, bin long, entropy double, whole boolean"))
    right, all_ = np.zeros(BINS), np.zeros(BINS)
    for r in judged.groupBy("bin").agg(F.sum(F.col("right").cast("long")).alias("right"), F.count("*").alias("n")).collect():
        right[r["bin"]], all_[r["bin"]] = r["right"], r["n"]
    bounds = judged.where("right and whole").groupBy("lang").agg(F.percentile_approx("entropy", quantile).alias("most")).collect()
    return isotonic(right, all_), {r["lang"]: r["most"] for r in bounds}


def identify_languages(docs: DataFrame, *, learn_where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_chars: int = MAX_CHARS, all_chars: int = ALL_CHARS, quantile: float = 0.999, slack: float = 1.1, least_score: float = 0.5) -> DataFrame:
    """`doc_id, lang_pred, score, cross_entropy, rejected` of every row.

    Learns from rows of `learn_where` that have a language, from `max_chars` characters of a language and `all_chars` of all at most. `lang_pred` is
    the language of the lowest cross-entropy, of equal ones the first by its bytes; `score` the share of held-back texts that were right at
    such a lead. `rejected` marks texts below `least_score` or above `slack` times the cross-entropy that one in 1 / (1 - `quantile`) of the language's own
    texts passes. A null text and one without a letter give `und`, score 0 and rejected, and so does every text where there is nothing to
    learn from. Very long texts are scored whole, window by window; repeated rows get equal results; other columns are not read.
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn_where is None else F.coalesce(learn_where, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), learn.alias("learn"))
    sample = sample_texts(rows, F.col("learn"), max_chars, all_chars)
    models = learn_models(sample.where(f"h % {HELD_BACK} <> 0"))
    shared = spark.sparkContext.broadcast(models)
    shares, bounds = _calibrated(sample.where(f"h % {HELD_BACK} = 0"), models, shared, quantile) if models else (np.zeros(BINS), {})

    def judge(batches: Iterator[dict]) -> Iterator[dict]:
        names, own = list(shared.value), list(shared.value.values())
        most = np.array([slack * bounds.get(n, np.inf) for n in names])
        for b in batches:
            for ids, texts in _portions(b["doc_id"], b["text"]):
                if not own:
                    yield {"doc_id": ids, "lang_pred": ["und"] * len(ids), "score": [0.0] * len(ids), "cross_entropy": [None] * len(ids), "rejected": [True] * len(ids)}
                    continue
                best, lowest, lead, length = _judged(texts, own)
                known, score = length > 0, np.where(length > 0, shares[_bin(lead)], 0.0)
                yield {
                    "doc_id": ids,
                    "lang_pred": [names[k] if ok else "und" for k, ok in zip(best, known)],
                    "score": score,
                    "cross_entropy": [float(x) if ok else None for x, ok in zip(lowest, known)],
                    "rejected": ~known | (score < least_score) | (lowest > most[best]),
                }

    return mapped(rows.select("doc_id", "text"), judge, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
