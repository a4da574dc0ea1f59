"""op8: a token's share of its class depends on the words before it, and shares of a class sum to one."""
import numpy as np
from pyspark.sql import functions as F

from countersign.llm import op8_language_model as O


def test_inner_shares_sum_to_one_and_learn():
    rng = np.random.default_rng(5)
    mass = rng.random((O.CLASSES, O.CELLS)) + 0.01
    inner = O.Inner(mass)
    word, skip = rng.integers(0, O.WORDS, 4000), rng.integers(0, O.SKIPS, 4000)
    cls, cell = np.full(4000, 3), (word * 7 + 5) % O.CELLS  # the word before tells the cell
    seen, seen_skip, met = np.zeros((O.WORDS, O.CELLS)), np.zeros((O.SKIPS, O.CELLS)), np.zeros((O.CLASSES, O.WORDS, O.SKIPS))
    for where, index in ((seen, (word, cell)), (seen_skip, (skip, cell)), (met, (cls, word, skip))):
        np.add.at(where, index, 1)

    def mean():
        by_word, by_skip, under = inner.tables()
        shares = mass[3] * 10 ** (by_word[word].astype(float) + by_skip[skip]) / 10 ** under[3, word, skip].astype(float)[:, None]
        assert np.allclose(shares.sum(axis=1), 1, atol=1e-4)
        return np.log10(shares[np.arange(4000), cell]).mean()

    scores = [mean()]
    for _ in range(3):
        inner.learn(seen, seen_skip, met)
        scores.append(mean())
    assert scores == sorted(scores) and scores[-1] > scores[0] + 0.1


def test_context_does_not_cross_texts():
    tokens = np.arange(8, 8 + 8 * 6, 8, dtype=np.int64)
    place, cls = np.zeros(6, np.int64), np.full(6, O.ENDINGS)
    word, skip = O.inner_contexts(tokens, place, cls, [4, 2])
    assert list(word[[0, 4]]) == [O.NONE] * 2 and list(skip[[0, 1, 4, 5]]) == [O.NONE] * 4 and (word[[1, 2, 3, 5]] > O.CLASSES).all()
    assert O.cells(np.array([-1, -8, 7], np.int64)).tolist() == [O.CELLS - 1, O.CELLS - 1, 0]


def test_equal_bags_of_one_class_differ_by_order(spark):
    # Both orders have the same classes throughout; in training `ba` follows `aa`, and `ca` follows `da`.
    texts = ["aa ba da ca"] * 400 + ["da ca aa ba"] * 400
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "aa ba da ca", "aa ca da ba"])], "doc_id long, text string")
    n = len(texts)
    got = {r["doc_id"]: r for r in O.score_texts(docs, learn_where=F.col("doc_id") < n, part=F.col("doc_id") % O.ROUNDS).collect()}
    assert got[n]["base_score"] == got[n + 1]["base_score"]
    assert got[n]["score"] > got[n + 1]["score"] + 0.2
