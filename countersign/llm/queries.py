"""The operators' registered queries, over whole tables with production parameters, and their SQL where there is one."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.llm.op10_decontaminate import find_contaminated
from countersign.llm.op11_trie import prefix_trie, read_turns, spliced, trie_sql
from countersign.llm.op12_merkle import LOWER, UPPER, manifest_sql, merkle_manifest
from countersign.llm.op13_language import identify_languages
from countersign.llm.op1_license import license_sql, scan_licenses
from countersign.llm.op2_neardup import near_duplicate_sql, near_duplicates
from countersign.llm.op3_records import new_folder, read_records, write_records
from countersign.llm.op4_toxicity import fold, score_toxicity
from countersign.llm.op5_quality import score_quality
from countersign.llm.op6_repetition import repetition_rules, repetition_sql
from countersign.llm.op7_mix import mix_sources
from countersign.llm.op8_language_model import ROUNDS, score_texts
from countersign.llm.op9_pii import pseudonymise
from countersign.llm.text import prepared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    write_records(_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_records(spark, folder)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    scored = score_toxicity(docs, _table(spark, sf_dir, "labels"), learn_where=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence", "similarity")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Grades: 0 poor, 1 sound but toxic, 2 sound.
    labels = _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade")).where(F.col("quality").isNotNull())
    held_out = fold(F.col("doc_id"), 4) == 2
    scored = score_quality(_table(spark, sf_dir, "documents"), ratings, grades=3, learn_where=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "expected_grade", "tail_probability", "kept")


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(number % 10 == 0, F.lit(False))
    part = F.coalesce(F.floor(number / 10) % ROUNDS, F.lit(0))
    scored = score_texts(_table(spark, sf_dir, "documents"), learn_where=~held_out, part=part)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Production passes its own secret; this one makes the query repeatable.
    return pseudonymise(_table(spark, sf_dir, "documents"), b"countersign public demonstration key")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = spliced(read_turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, convs)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle_manifest(
        _table(spark, sf_dir, "documents"),
        ["doc_id", "source", "lang", "n_chars", "text"],
        changed=fold(F.col("doc_id"), 3) == 0,
        changes={"text": F.translate("text", UPPER, LOWER)},
    )
    return manifest.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    found = identify_languages(docs, learn_where=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_records": op3_token_records,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_repetition_rules": op6_repetition_rules,
    "op7_mix_sources": op7_mix_sources,
    "op8_language_model": op8_language_model,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_id": op13_language_id,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op2_near_duplicates": near_duplicate_sql(),
    "op6_repetition_rules": repetition_sql(),
    "op11_conversation_trie": trie_sql(),
    "op12_merkle_manifest": manifest_sql(),
}
