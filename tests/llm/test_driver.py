"""What the driver's Python holds while it learns."""
import tracemalloc

import numpy as np

from countersign.llm import op4_toxicity


def _rows(examples, size, terms):
    rng = np.random.default_rng(3)
    for i in range(examples):
        at = np.sort(rng.choice(terms, size, replace=False)).astype(np.int32)
        yield i, at, np.ones(size, np.int32), np.empty(0, np.int32), i % 5 == 0


def test_counts_take_four_bytes():
    terms = op4_toxicity.Terms(["a", "b", "planned"], ["plan*"])
    assert {x.dtype.itemsize for found in terms.count(["a b b planned z", None, ""]) for x in found} == {4}


def test_the_index_is_built_in_little_room():
    rows = list(_rows(1000, 300, 100_000))
    tracemalloc.start()
    op4_toxicity.Index(np.linspace(1, 5, 100_000), 3.0, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 121 bytes a posting when keys and eight-byte numbers of all vectors were held beside them, 67 since.
    assert most / (1000 * 300) < 90


def test_frequencies_do_not_come_as_rows(spark, monkeypatch):
    docs = spark.createDataFrame([("a b",), ("a planning",), (None,), ("zz a a",)], "text string")
    monkeypatch.setattr(type(docs), "collect", lambda self: (_ for _ in ()).throw(AssertionError("rows")))
    terms = op4_toxicity.Terms(["a", "b", "never"], ["plan*"])
    total, df = op4_toxicity.document_frequencies(docs, terms)
    assert total == 4
    assert dict(zip(terms.names, df.tolist())) == {"plan*": 1, "a": 3, "b": 1, "never": 0}
