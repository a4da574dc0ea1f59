"""A training-corpus pipeline of five stages, each an operator of `countersign.llm`.

Every stage takes `(spark, docs, sf_dir)` and works on all its predecessor kept; its result is written as Parquet and read again. The
first four return rows of `documents` with all their columns; the last writes token records and returns a row per document from them.
Rows without a `doc_id` cannot be named by a verdict: the filters keep them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.llm.op2_neardup import near_duplicates
from countersign.llm.op3_records import new_folder, read_records, write_records
from countersign.llm.op4_toxicity import fold, score_toxicity
from countersign.llm.op7_mix import mix_sources
from countersign.llm.op10_decontaminate import find_contaminated
from countersign.llm.queries import tokenizer_path
from countersign.llm.text import prepared
from countersign.session import checkpointed


#: Percent of common five-word shingles from which documents are near duplicates. The op2 query has a threshold of its own.
NEAR_SHARE = 80


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select(F.col("doc_id").alias("_rejected")).distinct(), F.col("doc_id") == F.col("_rejected"), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null and empty texts share no word with an example and stay; very long texts are scored whole; repeated rows share a verdict; rows without an
    id stay; no rows give none; columns keep their names whatever they are called.
    """
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, learn_where=fold(F.col("doc_id"), 4) != 2)
    return _without(docs, checkpointed(scored.where("predicted = 1").select("doc_id")))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; rows that share an id are one document, of which the
    smallest row in column order stays. Documents are near duplicates from a similarity of NEAR_SHARE on.

    Null and empty texts are near to nothing and stay, as do rows without an id; very long texts are compared whole; ties go to the smallest id; no rows give none.
    """
    prepared(spark)
    verdict = near_duplicates(docs, share=NEAR_SHARE)
    left = _without(docs, checkpointed(verdict.where(~F.col("kept")).select("doc_id")))
    repeated = left.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    repeated = checkpointed(repeated)
    # The minimum aggregates before the shuffle, so an id that repeats often is no hot task.
    several = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*left.columns)).alias("row")).select("row.*")
    return _without(left, repeated).unionByName(several)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a benchmark item go.

    Null and empty texts and items hold no passage; very long texts are searched whole; repeated rows and items change nothing; rows without an
    id stay; no rows or no items leave the documents as they are.
    """
    benchmark = prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, checkpointed(find_contaminated(docs, benchmark).select("doc_id")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their slots: the files that are written hold the mixture one behind another.

    A null source is a source. Texts are only hashed: null, empty and very long ones take a slot like any other, repeated rows one each, in
    neighbouring places. No rows give none.
    """
    prepared(spark)
    return mix_sources(docs, in_order=True)


def _place(name: Column) -> Column:
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long"), F.lit(0))
    return number(r"^part-(\d+)") * (1 << 20) + number(r"-c(\d+)\.")


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token records in the order of the mixture (of `doc_id` where `docs` was not read from files) and read them back.

    Null and empty texts give the end id alone; very long ones one long record; repeated rows a record each; rows without an id a record with a null
    id; no rows give none. Files stand by the number of their task, then of the file, not by name: names of more than 100,000 do not sort.
    """
    prepared(spark)
    folder, order = new_folder(spark), None
    try:
        placed = docs.select("doc_id", "text", _place(F.col("_metadata.file_name")).alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
        order = [F.col("mix_file"), F.col("mix_row")]
    except AnalysisException:
        placed = docs.select("doc_id", "text")
    write_records(placed, folder, tokenizer_path(), order=order)
    return read_records(spark, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_records", token_records),
]

#: Nearest neighbours, sketches, alignments and a tokenizer are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over `documents`."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
