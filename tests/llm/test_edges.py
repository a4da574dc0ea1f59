"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator and stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from countersign.llm import queries
from countersign.llm.op1_license import scan_licenses
from countersign.llm.op2_neardup import near_duplicates
from countersign.llm.op3_records import new_folder, read_records, write_records
from countersign.llm.op4_toxicity import score_toxicity
from countersign.llm.op5_quality import score_quality
from countersign.llm.op6_repetition import repetition_rules
from countersign.llm.op7_mix import mix_sources
from countersign.llm.op8_language_model import score_texts
from countersign.llm.op9_pii import pseudonymise
from countersign.llm.op10_decontaminate import find_contaminated

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, token string, bucket int, slot string, class_id string, a long, item_id long"
LONG = "word and another, ünïcode " * 40_000
ITEM = "one two three four five six seven eight nine ten"
ROWS = [
    (1, "Released under the MIT License. " + ITEM), (1, "Released under the MIT License. " + ITEM), (1, "quite another text under one id, longer than five words"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here, but words enough for a shingle"),
    (None, None), (5, LONG), (6, LONG), (7, "idiot scum"), (8, "a b"), (9, "A B"), (-10, "nul \x00 and \x1f marks <|endoftext|>"), (2**62, "4111 1111 1111 1111"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None if r[0] == 3 else "s", None, 1, "x", "y", 2, "z", "w", 3, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def labels(spark, rows=((7, 0, 1), (7, 0, 0), (8, 1, 0), (None, 1, 1), (9, None, None), (77, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("grade", F.col("quality"))


def records(spark, df):
    folder = new_folder(spark)
    write_records(df, folder, queries.tokenizer_path())
    return read_records(spark, folder)


OPERATORS = {
    "op1": lambda s, d: scan_licenses(d),
    "op2": lambda s, d: near_duplicates(d),
    "op3": records,
    "op4": lambda s, d: score_toxicity(d, labels(s)),
    "op5": lambda s, d: score_quality(d, labels(s), grades=3),
    "op6": lambda s, d: repetition_rules(d),
    "op7": lambda s, d: mix_sources(d),
    "op8": lambda s, d: score_texts(d),
    "op9": lambda s, d: pseudonymise(d, b"key"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(spark, docs, none, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in ROWS)
    assert OPERATORS[name](spark, none).collect() == []


def by_id(rows):
    return {r["doc_id"]: r.asDict() for r in rows}


def test_defined_results(spark, docs):
    one = by_id(scan_licenses(docs).where("doc_id > 1").collect())
    assert one[2]["n_words"] == 0 and one[2]["first_word"] is None and one[3]["labels"] == "" and one[3]["score"] == 0.0
    two = near_duplicates(docs).collect()
    assert {r["component_id"] for r in two if r["doc_id"] in (5, 6)} == {5} and {r["component_id"] for r in two if r["doc_id"] in (8, 9)} == {8}
    assert all(r["component_id"] is None and r["kept"] for r in two if r["doc_id"] is None)
    assert all(r["component_id"] == 1 and r["kept"] for r in two if r["doc_id"] == 1)
    assert all(r["n_shingles"] == 0 and r["kept"] for r in two if r["doc_id"] in (2, 3, 4))
    three = sorted(records(spark, docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in three[:3]] == [None, None, -10] and by_id(three)[2]["n_tokens"] == 1
    eight = by_id(score_texts(docs).collect())
    assert eight[2]["n_tokens"] == 1 and eight[2]["score"] == eight[3]["score"] < 0
    nine = by_id(pseudonymise(docs, b"key").collect())
    assert nine[2]["text"] is None and nine[3]["text"] == "" and nine[2**62]["n_card"] == 1
    six = by_id(repetition_rules(docs).collect())
    assert six[2]["base_failed"] and not six[2]["kept"] and six[5]["base_failed"]


def test_nothing_to_learn_from(spark, docs):
    empty = labels(spark, ())
    assert {r["score"] for r in score_toxicity(docs, empty).collect()} == {0.0}
    assert score_quality(docs, empty, grades=3).count() == len(ROWS)
    assert score_texts(docs, learn_where=F.lit(False)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_decontamination_edges(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = {(r["doc_id"], r["item_id"]) for r in find_contaminated(docs, items).collect()}
    assert found == {(1, 1), (1, None)}
    assert find_contaminated(none, items).collect() == [] and find_contaminated(docs, items.limit(0)).collect() == []


def test_mix_keeps_every_row_in_order(spark, docs):
    whole = mix_sources(docs, in_order=True)
    assert whole.columns == docs.columns and whole.count() == len(ROWS)
    assert mix_sources(docs, {"s": 0.9}).count() == len(ROWS)


@pytest.fixture(scope="module")
def small(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_return_documents(spark, docs, none, small):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns, name
        assert stage(spark, none, small).collect() == []
    left = corpus_pipeline.near_duplicate_groups(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [-10, 1, 2, 3, 4, 5, 7, 8, 2**62] and sum(r["doc_id"] is None for r in left) == 2
    clean = corpus_pipeline.decontamination(spark, docs, small).collect()
    assert len(clean) == len(ROWS) - 3 and all(r["doc_id"] != 1 for r in clean)


def test_run_on_odd_rows(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == {None, -10, 2, 3, 4, 5, 7, 8, 2**62}


def test_run_writes_the_mixture(spark):
    """Each stage on what its predecessor kept, and records in the order of the mixture."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-2]:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, sf))
    slots = {r["doc_id"]: r["slot"] for r in mix_sources(docs).collect()}
    rows = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["start"])
    order = [slots[r["doc_id"]] for r in rows]
    assert len(rows) == len(slots) and order == sorted(order)
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
