"""A training corpus from raw documents: five stages, each an operator of quillmap.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import read_table
from quillmap.llm.packing import pack_documents
from quillmap.llm.quality_rules import clean_lines
from quillmap.llm.queries import vocabulary
from quillmap.llm.simhash import keep_one
from quillmap.llm.suffix_dedup import cut_repeated_bytes
from quillmap.llm.toxicity import drop_toxic, train_toxicity
from quillmap.session import store


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars counted anew where there is such a column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))
    return docs.select(*like.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the factorization machine, fitted on labels that are not held out."""
    return drop_toxic(docs, train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return _with_length(clean_lines(docs).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 100 bytes that start earlier; characters cut in two go whole."""
    return _with_length(cut_repeated_bytes(docs, 100), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", packing),
]

#: SQL cannot express a fitted model or a packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store(docs, f"stage{number}")
    return docs
