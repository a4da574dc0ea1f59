"""Quality rules on repetition: characters inside duplicated n-grams of several lengths and inside duplicated lines.

Rolling hashes of the words give every n-gram of a length one number; equal numbers mark repeats. An n-gram can only repeat where
the shorter one does, so lengths are tried upwards until none repeats.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countersign.llm.text import WordHashes, mapped, utf8, window_hashes

# Published limits on repetition, as shares of a text's characters in words.
TOP_GRAM = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINE_CHARS = 0.20
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, top_gram double, dup_gram double, dup_line double, base_failed boolean, kept boolean"


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words that begins at one of `starts`."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def repetition(text: str | None, hashes: WordHashes) -> dict:
    """The counts and shares of one text; see `repetition_rules`."""
    text = text or ""
    words = utf8(text).split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    dup_lines = sum(lines.values()) - len(lines)
    dup_line_chars = sum((k - 1) * len(line) for line, k in lines.items() if k > 1)
    line_share = dup_line_chars / len(text) if text else 0.0
    top = dup = 0.0
    top_over = dup_over = False
    repeats = 0
    if n > 1:
        hashed, ends = hashes.of(words), None
        for size in range(2, 11):
            if n < size:
                break
            grams = window_hashes(hashed, size)
            ranked = np.sort(grams)
            runs = np.diff(np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])))
            if (most := int(runs.max())) == 1:
                break
            if ends is None:
                lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
                ends = np.concatenate([[0], np.cumsum(lengths)])
            if size in TOP_GRAM:
                at = np.flatnonzero(np.isin(grams, ranked[np.cumsum(runs)[runs == most] - 1]))
                share = (most - 1) * int((ends[at + size] - ends[at]).max()) / chars  # the longest of equally frequent ones
                top, top_over = max(top, share), top_over or share > TOP_GRAM[size]
            if size == 3 or size in DUPLICATED:
                _, first, where, count = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
                if size == 3:
                    repeats = int(covered(np.flatnonzero(count[where] > 1), 3, n).sum())
                else:
                    again = np.ones(len(where), bool)
                    again[first] = False
                    share = int(lengths[covered(np.flatnonzero(again), size, n)].sum()) / chars
                    dup, dup_over = max(dup, share), dup_over or share - line_share > DUPLICATED[size]
    failed = n < 50 or 100 * repeats > 50 * n
    over = top_over or dup_over or line_share > DUP_LINE_CHARS
    symbols = sum(map(text.count, SYMBOLS))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats,
        "top_gram": top, "dup_gram": dup, "dup_line": line_share, "base_failed": failed, "kept": not (failed or bool(over)),
    }


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row with its counts, repetition shares and verdict.

    Shares are of characters, and a first occurrence never counts: `top_gram` is that of the most frequent 2-, 3- or 4-gram, `dup_gram`
    the largest inside repeated 5- to 10-grams (its limits hold for what exceeds `dup_line`), `dup_line` that of repeated lines. `base_failed`: under 50 words, or
    over half of them in repeated 3-word windows. `kept` is false for those and where a share is over its limit. Null and empty texts
    have no words and fail; null ids and repeated rows are rows like any other; no rows give none; other columns are not read.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for b in batches:
            rows = [repetition(t, hashes) for t in b["text"]]
            yield {"doc_id": b["doc_id"], **{c: [r[c] for r in rows] for c in rows[0]}}

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, COLUMNS)


def repetition_sql() -> str:
    """The same rows as DuckDB SQL over `documents`, from the n-grams' texts."""
    limits = ", ".join(f"({n}, {v})" for n, v in {**TOP_GRAM, **DUPLICATED}.items())
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
lim(n, most) as (values {limits}),
word as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from docs),
chars as (select r, sum(length(w)) as chars from word group by 1),
ten as (select r, i, [w, {", ".join(f"lead(w, {k}) over p" for k in range(1, 10))}] as ten from word window p as (partition by r order by i)),
named as (select r, n, i, array_to_string(ten[1:n], ' ') as g from ten cross join lim where ten[n] is not null),
freq as (select r, n, g, count(*) as k, min(i) as first, length(g) - n + 1 as len from named group by 1, 2, 3 having count(*) > 1),
spot as (select distinct r, n, unnest(range(i, i + n)) as i from named join freq using (r, n, g) where n = 3 or n >= 5 and i > first),
covered as (select r, n, count(*) as words, sum(length(w)) as covered from spot join word using (r, i) group by 1, 2),
repeats as (select r, words as n_repeat from covered where n = 3),
dup as (select r, n, covered from covered where n >= 5),
top as (select r, n, max((k - 1) * len) as covered from freq join (select r, n, max(k) as k from freq where n <= 4 group by 1, 2) using (r, n, k) group by 1, 2),
lines as (select r, l, count(*) as k from (select r, unnest(string_split(t, chr(10))) as l from docs) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1, 2),
line as (select r, sum(k - 1) as n_dup, sum((k - 1) * length(l)) as covered from lines group by 1),
shares as (select docs.*, coalesce(chars, 0) as chars, coalesce(n_repeat, 0) as n_repeat, coalesce(n_dup, 0) as n_dup, case when t = '' then 0.0 else coalesce(line.covered, 0)::double / length(t) end as line_share
 from docs left join chars using (r) left join repeats using (r) left join line using (r)),
judged as (select shares.*, coalesce((select max(top.covered::double / chars) from top where top.r = shares.r), 0.0) as top_gram, coalesce((select max(coalesce(dup.covered, 0)::double / chars) from dup where dup.r = shares.r), 0.0) as dup_gram,
 coalesce((select bool_or(top.covered::double / chars > lim.most) from top join lim using (n) where top.r = shares.r), false) or coalesce((select bool_or(coalesce(dup.covered, 0)::double / chars - line_share > lim.most) from dup join lim using (n) where dup.r = shares.r), false)
 or line_share > {DUP_LINE_CHARS} as too_much, len(ws) < 50 or 100 * n_repeat > 50 * len(ws) as failed from shares)
select doc_id, len(ws)::bigint as n_words, chars::bigint as word_chars, (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::bigint as n_symbols, n_dup::bigint as n_dup_lines, n_repeat::bigint as n_repeat_words,
 top_gram::double as top_gram, dup_gram::double as dup_gram, line_share::double as dup_line, failed as base_failed, not failed and not too_much as kept from judged"""
