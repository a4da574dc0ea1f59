"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Vectors hold every word of a text, and word beginnings that stand out in toxic examples. IDF counts all documents. How much a term stands out in toxic examples
is a weight, not a filter: words that do not weigh WEAK as much. The index keeps postings of every term of the examples, block by block of examples, with the maximum
of each term in each block: blocks are visited by their upper bound until no other can hold a nearer example, so the neighbours are
exact. Terms that many examples hold have a value for every place of a block, so that a block's share of them is one product. Votes weigh by distance; the vote is calibrated on the examples themselves, each left out of its own vote.
"""
from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import batched

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.llm.text import flat, mapped, utf8
from countersign.session import checkpointed

MAX_EXAMPLES = 4096  # labelled rows that are indexed unless a caller says otherwise: those of the smallest hashes
MAX_TERMS = 256  # terms that weigh fully
WEAK = 0.1  # weight of all others
LEAST_TOXIC = 5  # toxic examples that a term must be in
LEAST_CHI2 = 30.0
BEGINNINGS = range(4, 9)
NEIGHBOURS = 15
CLOSEST = 0.002  # least distance: a copy of an example outweighs all that are not
BLOCK = 64
FIRST = 8  # blocks that are looked into before bounds decide on the others
THRESHOLD = 0.3
TOGETHER = 64  # texts that are compared with the common terms at once
KEPT_WORDS = 300_000
COMMON = 32  # a term that one in so many examples holds is common
STOPS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    return utf8((text or "").lower()).translate(STOPS).decode("utf-8", "surrogatepass").split()


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def learn_terms(examples: DataFrame) -> list[str]:
    """The terms most associated with toxic examples (`text, toxic`), of equal ones the longest."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            toxic, all_ = Counter(), Counter()
            for text, label in zip(b["text"], b["toxic"]):
                found = set(flat(map(terms_of, set(words_of(text)))))
                all_.update(found)
                if label:
                    toxic.update(found)
            yield {"term": list(all_), "toxic": [toxic[t] for t in all_], "n": list(all_.values())}

    totals = examples.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("t")).first()
    n, t = totals["n"], totals["t"] or 0
    if not t or t == n:
        return []
    a, b = F.col("toxic"), F.col("n") - F.col("toxic")
    chi2 = n * F.pow(a * (n - t - b) - b * (t - a), F.lit(2.0)) / (F.lit(float(t)) * (n - t) * (a + b) * (n - a - b))
    counted = mapped(examples, count, "term string, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    strong = counted.where((a >= LEAST_TOXIC) & (F.col("n") < n) & (a * (n - t) > b * t)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    terms: list[str] = []
    seen: dict[tuple[int, int], list[str]] = {}
    for r in strong.orderBy(F.desc("chi2"), F.desc(F.length("term")), "term").limit(4 * MAX_TERMS).collect():
        same = seen.setdefault((r["toxic"], r["n"]), [])
        if not any(x.startswith(r["term"].rstrip("*")) for x in same):
            same.append(r["term"])
            terms.append(r["term"])
    return terms[:MAX_TERMS]


class Words(dict):
    """A number of its own for each word, and with it the word's place in a vocabulary (or -1) and its strong beginnings."""

    def __init__(self, at: dict[str, int], strong: dict[str, int]):
        self.at, self.strong, self.heads = at, strong, {w[: BEGINNINGS[0]] for w in strong}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.term, self.begun, self.begin = array("q"), array("q"), array("q", [0])

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        self.term.append(self.at.get(word, -1))
        if word[: BEGINNINGS[0]] in self.heads:
            self.begun.extend([self.strong[word[:n]] for n in BEGINNINGS if n < len(word) and word[:n] in self.strong])
        self.begin.append(len(self.begun))
        return value


class Terms:
    """Numbers of the words of a vocabulary and of the strong beginnings of any word."""

    def __init__(self, words: list[str], strong: list[str]):
        self.names = [*dict.fromkeys([*strong, *words])]
        self.at = {t: i for i, t in enumerate(self.names)}
        self.strong = {t[:-1]: self.at[t] for t in strong if t.endswith("*")}
        self.words = Words(self.at, self.strong)

    def _found(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the different words of each text and of their beginnings: which text, the number (-1: not of the vocabulary), the count."""
        if len(self.words) >= KEPT_WORDS:
            self.words.forget()
        size: list[int] = []

        def words() -> Iterator[list[str]]:
            for text in texts:
                found = words_of(text)
                size.append(len(found))
                yield found

        own = np.fromiter(map(self.words.__getitem__, flat(words())), np.int64)
        kinds, names = max(1, len(self.words)), max(1, len(self.names))
        own, n = np.unique(np.repeat(np.arange(len(texts)) * kinds, size) + own, return_counts=True)
        text, own = np.divmod(own, kinds)
        term, begun, begin = (np.array(x, np.int64) for x in (self.words.term, self.words.begun, self.words.begin))
        pick, times = spans(begin[own], begin[own + 1])
        begun, at = np.unique(np.repeat(text * names, times) + begun[pick], return_inverse=True)
        text_of, begun = np.divmod(begun, names)
        n_begun = np.bincount(at, np.repeat(n, times), len(begun)).astype(np.int64)
        return np.concatenate([text, text_of]), np.concatenate([term[own], begun]), np.concatenate([n, n_begun])

    def of(self, texts: Sequence[str | None]) -> np.ndarray:
        """Numbers of the different words of each text, of the vocabulary or -1, and of their beginnings, each once a text."""
        return self._found(texts)[1]

    def count(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the numbers and counts of its terms, and counts of its words that the vocabulary lacks."""
        text, ids, n = self._found(texts)
        known = ids >= 0
        most, names, at = int(n.max(initial=0)) + 1, max(1, len(self.names)), np.arange(len(texts) + 1)
        key = text[known] * names + ids[known]
        order = np.argsort(key)
        key, counts = key[order], n[known][order]
        others = np.sort(text[~known] * most + n[~known])
        own, rest = np.searchsorted(key, at * names), np.searchsorted(others, at * most)
        # Four bytes each: the driver keeps the terms of all examples at once.
        ids, counts, others = (x.astype(np.int32) for x in (key % names, counts, others % most))
        return [(ids[a:b], counts[a:b], others[c:d]) for a, b, c, d in zip(own, own[1:], rest, rest[1:])]


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[int, np.ndarray]:
    """Documents in all, and those that hold each term: a task adds up its own and gives one row a term."""
    names, strong = terms.names, [f"{t}*" for t in sorted(terms.strong)]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own, sums, all_ = Terms(names, strong), np.zeros(len(names) + 1, np.int64), 0
        for b in batches:
            for begin in range(0, len(b["text"]), TOGETHER):
                sums += np.bincount(own.of(b["text"][begin : begin + TOGETHER]) + 1, minlength=len(sums))
            all_ += len(b["text"])
        sums = np.append(sums[1:], all_)  # words that the vocabulary lacks came first
        some = np.flatnonzero(sums)
        yield {"term": some, "n": sums[some]}

    # As Arrow: rows of a whole vocabulary would take the driver a hundred times the room of their numbers.
    found = mapped(docs, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(len(names) + 1, np.int64)
    sums[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(sums[-1]), sums[:-1]


def spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of several ranges one behind another, and the length of each."""
    size = end.astype(np.int64) - first
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size), size


class Index:
    """Block-max inverted index over unit TF-IDF vectors; equal vectors share an entry with their number and toxic number."""

    def __init__(self, weights: np.ndarray, strange: float, rows: list[tuple]):
        """`weights` of the terms (IDF times association), that of a word outside the vocabulary, and rows of doc_id, terms, counts, counts of other words, toxic."""
        self.weights, self.strange = weights, strange
        vectors = [self.query(at, counts, others) for _, at, counts, others, _ in rows]
        # Examples with the same strongest term stand in the same blocks.
        top = [int(at[np.argmax(q)]) if len(at) else -1 for at, q in vectors]
        order = sorted(range(len(rows)), key=lambda r: (top[r], len(vectors[r][0]), r))
        merged: dict[bytes, int] = {}
        self.entry_of = np.zeros(len(rows), np.int64)
        kept, self.ids, number, toxic = [], [], [], []
        for r in order:
            at, q = vectors[r]
            e = merged.setdefault(sha256(at.tobytes() + np.round(q, 6).tobytes()).digest(), len(merged))
            if e == len(kept):
                kept.append(r)
                self.ids.append(rows[r][0])
                number.append(0)
                toxic.append(0)
            self.entry_of[r] = e
            self.ids[e] = min(self.ids[e], rows[r][0])
            number[e] += 1
            toxic[e] += int(rows[r][4])
        self.number, self.toxic = np.array(number, float), np.array(toxic, float)
        self.blocks = -(-len(kept) // BLOCK)
        self.places = np.arange(self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        size = [len(vectors[r][0]) for r in kept]
        entry = np.repeat(np.arange(len(kept), dtype=np.int32), size)
        term = np.concatenate([vectors[r][0] for r in kept]) if kept else np.empty(0, np.int32)
        value = np.concatenate([vectors[r][1] for r in kept], dtype=np.float32, casting="same_kind") if kept else np.empty(0, np.float32)
        del vectors
        # Postings stand by term and block. Only cells that have some are kept: their block, their maximum, and where their postings begin.
        by = np.argsort(term, kind="stable")
        entry, term, value = entry[by], term[by], value[by]
        # Common terms: a strip of values over all places.
        held = np.bincount(term, minlength=len(weights))
        common = np.flatnonzero(held * COMMON > max(len(kept), COMMON))
        self.strip_of = np.full(len(weights), -1, np.int32)
        self.strip_of[common] = np.arange(len(common))
        self.strips = np.zeros((len(common), self.blocks * BLOCK), np.float32, order="F")
        mine = self.strip_of[term] >= 0
        self.strips[self.strip_of[term[mine]], entry[mine]] = value[mine]
        entry, term, value = entry[~mine], term[~mine], value[~mine]
        self.entries, self.values = entry, value
        block = entry // BLOCK
        fresh = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, np.int64)
        self.cell_block = block[fresh].astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.values, fresh) if len(fresh) else np.empty(0, np.float32)
        self.cell_begin = np.append(fresh, len(term)).astype(np.int32)
        self.term_begin = np.searchsorted(term[fresh], np.arange(len(weights) + 1)).astype(np.int32)
        self.calibration = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def query(self, terms: np.ndarray, counts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(terms, np.int32)
        q = (1 + np.log(np.array(counts, float))) * self.weights[at]
        rest = (1 + np.log(np.array(others, float))) * self.strange
        return at, q / math.sqrt(float(q @ q + rest @ rest) or 1.0)

    def shares(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosine of each query with the entry of each place."""
        of = np.zeros((len(queries), len(self.strips)), np.float32)
        for row, (at, q) in zip(of, queries):
            strip = self.strip_of[at]
            row[strip[strip >= 0]] = q[strip >= 0]
        return of @ self.strips

    def _scored(self, cells: np.ndarray, q: np.ndarray, common: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some blocks and their cosines, from the query's cells in them and the shares of common terms."""
        pick, size = spans(self.cell_begin[cells], self.cell_begin[cells + 1])
        found = np.bincount(self.entries[pick], self.values[pick] * np.repeat(q, size), self.blocks * BLOCK)
        ids = self.places[blocks].reshape(-1)
        if (blocks == self.blocks - 1).any():  # the last one may be filled in part
            ids = ids[ids < len(self.number)]
        return ids, found[ids] + common[ids]

    def _ranked(self, entries: np.ndarray, scores: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entries that can be among the nearest, best first, ties by entry; how many examples each is, and the place where NEIGHBOURS are reached."""
        if len(scores) > 4 * NEIGHBOURS:
            # An entry may be left out as the query's own, hence one more.
            some = scores >= np.partition(scores, len(scores) - NEIGHBOURS - 2)[len(scores) - NEIGHBOURS - 2] - 1e-4
            entries, scores = entries[some], scores[some]
        ranked = np.lexsort((entries, -np.round(scores, 5)))
        entries, scores = entries[ranked], scores[ranked]
        number = self.number[entries] - (entries == without)
        return entries, scores, number, int(np.searchsorted(np.cumsum(number), NEIGHBOURS))

    def nearest(self, at: np.ndarray, q: np.ndarray, without: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, cosines and example numbers of the nearest NEIGHBOURS examples, the last entry in part; exact with ties."""
        common = self.shares([(at, q)])[0] if common is None else common
        own = self.strip_of[at] < 0
        at, q = at[own], q[own]
        cells, size = spans(self.term_begin[at], self.term_begin[at + 1])
        q = np.repeat(q, size)
        # A block's bound: the best share of common terms that it holds, and the maxima of its other terms.
        block_of = self.cell_block[cells]
        bounds = np.bincount(block_of, self.cell_max[cells] * q, self.blocks) + common.reshape(self.blocks, BLOCK).max(axis=1)
        order = np.argsort(-bounds, kind="stable")
        wanted = np.zeros(self.blocks, bool)
        wanted[order[:FIRST]] = True
        first = wanted[block_of]
        ids, found = self._scored(cells[first], q[first], common, order[:FIRST])
        entries, scores, number, reach = self._ranked(ids, found, without)
        # Blocks whose bound does not reach the last neighbour so far hold no nearer example.
        least = scores[reach] - 1e-5 if reach < len(entries) else -1.0
        rest = order[FIRST:]
        rest = rest[bounds[rest] >= least]
        if len(rest):
            wanted[:] = False
            wanted[rest] = True
            second = wanted[block_of]
            more, found = self._scored(cells[second], q[second], common, rest)
            some = found >= least
            entries, scores, number, reach = self._ranked(np.concatenate([entries, more[some]]), np.concatenate([scores, found[some]]), without)
        reach = min(int(np.searchsorted(np.cumsum(number), NEIGHBOURS)) + 1, len(entries))
        number = number[:reach].copy()
        number[-1] -= max(0.0, number.sum() - NEIGHBOURS)
        return entries[:reach], scores[:reach], number

    def vote(self, at: np.ndarray, q: np.ndarray, without: int = -1, own: int = 0, common: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        entries, scores, number = self.nearest(at, q, without, common)
        mine = entries == without
        share = (self.toxic[entries] - mine * own) / np.maximum(self.number[entries] - mine, 1)
        weight = number / (1 + CLOSEST - np.minimum(scores, 1.0))
        return float(weight @ share / weight.sum()) if weight.sum() else 0.0, entries, scores

    def calibrate(self, rows: list[tuple]) -> None:
        """Monotone mean label by vote (pooled adjacent violators) over the examples, each without itself."""
        votes = []
        for at in range(0, len(rows), TOGETHER):
            some = rows[at : at + TOGETHER]
            queries = [self.query(t, c, o) for _, t, c, o, _ in some]
            for i, (q, common, row) in enumerate(zip(queries, self.shares(queries), some), at):
                votes.append((self.vote(*q, int(self.entry_of[i]), int(row[4]), common)[0], int(row[4])))
        votes.sort()
        pools: list[list[float]] = []
        for v, y in votes:
            if pools and pools[-1][3] == v:
                pools[-1][0] += y
                pools[-1][1] += 1
            else:
                pools.append([y, 1, v, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] and pools[-1][2] != pools[-2][3]:
                y2, n2, _, high = pools.pop()
                pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], high]
        self.calibration = (np.array([(a + b) / 2 for _, _, a, b in pools]), np.array([y / n for y, n, _, _ in pools]))

    def score(self, counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[float, list[int], list[float]]]:
        """Of each text: calibrated score, the nearest examples and their cosines; one that shares no term with any example has no neighbour and no vote."""
        out = []
        for begin in range(0, len(counted), TOGETHER):
            queries = [self.query(*c) for c in counted[begin : begin + TOGETHER]]
            for (at, q), common in zip(queries, self.shares(queries)):
                if not len(at):
                    out.append((float(np.interp(0.0, *self.calibration)), [], []))
                    continue
                vote, entries, scores = self.vote(at, q, common=common)
                out.append((float(np.interp(vote, *self.calibration)), [self.ids[e] for e in entries[:3]], [round(float(s), 4) for s in scores[:3]]))
        return out


def score_toxicity(docs: DataFrame, labels: DataFrame, *, learn_where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """A row per row: `doc_id, score, predicted, evidence, similarity` (the nearest examples' smallest ids and their cosines).

    `labels` has ids and 0/1 labels; `learn_where` is a condition on `doc_id` that labels must meet to be learned from. At most
    `max_examples` of them are indexed, with all their words. Labels that are null or without an id or a document are left out; an id with several labels
    counts as toxic if one says so. Null and empty texts are scored as texts without terms; very long texts are scored whole; rows with null ids and repeated rows are
    scored like any other; without labelled rows every score is 0; no rows give none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if learn_where is not None:
        given = given.where(learn_where)
    sample = checkpointed(given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    # `max_examples` rows at most; an id that repeats among the documents gives one example, of the smallest text hash.
    few = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    few = checkpointed(few)
    strong = learn_terms(few.select("text", "toxic"))
    texts = {r["doc_id"]: (r["text"], r["toxic"]) for r in few.orderBy("doc_id").toLocalIterator()}
    terms = Terms(sorted(set(flat(words_of(t) for t, _ in texts.values()))), strong)
    total, df = document_frequencies(rows.select("text"), terms)
    idf = np.log((total + 1) / (df + 1)) + 1
    weights = idf * np.array([1.0 if i < len(strong) else WEAK for i in range(len(idf))])
    counted = flat(terms.count([t for t, _ in part]) for part in batched(texts.values(), TOGETHER))
    known = [(i, *c, toxic) for (i, (_, toxic)), c in zip(texts.items(), counted)]
    names = terms.names
    del texts, terms, counted
    index = Index(weights, WEAK * (math.log((total + 1) / 2) + 1), known) if known else None
    if index:
        index.calibrate(known)
    shared = docs.sparkSession.sparkContext.broadcast((names, strong, index))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        names, strong, index = shared.value
        own = Terms(names, strong)
        for b in batches:
            found = [(0.0, [], [])] * len(b["text"]) if index is None else [*flat(index.score(own.count(part)) for part in batched(b["text"], TOGETHER))]
            yield {"doc_id": b["doc_id"], "score": [s for s, _, _ in found], "evidence": [e for _, e, _ in found], "similarity": [s for _, _, s in found]}

    scored = mapped(rows, run, "doc_id long, score double, evidence array<long>, similarity array<double>")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "similarity")
