"""The operators on whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.alignment import align_tokens
from quillmap.llm.ann import nearest
from quillmap.llm.bpe import bpe_round_trip
from quillmap.llm.common import read_table
from quillmap.llm.licenses import scan_licenses
from quillmap.llm.oracles import ORACLES
from quillmap.llm.packing import pack_documents
from quillmap.llm.periodic_runs import find_runs
from quillmap.llm.pu_quality import score_quality
from quillmap.llm.quality_rules import quality_rules
from quillmap.llm.simhash import near_duplicates
from quillmap.llm.substring_dedup import remove_repeated_windows
from quillmap.llm.suffix_dedup import remove_repeated_bytes
from quillmap.llm.token_counts import count_tokens
from quillmap.llm.toxicity import score_toxicity, train_toxicity


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(read_table(spark, sf_dir, "documents"), window=35)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read_table(spark, sf_dir, "documents"), length=100)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), radius=3)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(read_table(spark, sf_dir, "documents"), plant=True, whole=False)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_nearest": op7_nearest,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality": op13_quality,
}

__all__ = ["ORACLES", "QUERIES", "vocabulary"]
