"""CSV datasets, BibTeX and vector files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.schemas import (
    DATASET_DEFAULTS,
    DATASET_TEXT,
    PAPER_OPTIONAL,
    PAPER_REQUIRED,
    conform,
)
from quillmap.session import exact_rank

BOM = "\ufeff"


def read_dataset(
    spark: SparkSession, path: str, columns: list[str] | None = None, conformed: bool = True
) -> DataFrame:
    """CSV with header, quoted line breaks and an optional byte order mark.

    ``columns`` keeps those that exist. A conformed dataset has all dataset columns with defaults.
    """
    df = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    df = df.toDF(*[c.removeprefix(BOM) for c in df.columns])
    if columns is not None:
        return df.select(*[c for c in columns if c in df.columns])
    return conform(df, DATASET_DEFAULTS, DATASET_TEXT) if conformed else df


def ordered_columns(df: DataFrame) -> DataFrame:
    """Required paper columns first (blank where absent), then optional ones, then the rest."""
    required = [
        F.col(c) if c in df.columns else F.lit("").alias(c) for c in PAPER_REQUIRED
    ]
    optional = [F.col(c) for c in PAPER_OPTIONAL if c in df.columns]
    known = set(PAPER_REQUIRED + PAPER_OPTIONAL)
    return df.select(*required, *optional, *[F.col(c) for c in df.columns if c not in known])


def write_dataset(df: DataFrame, path: str, paper_order: bool = True) -> None:
    """CSV with header; every part file starts with a byte order mark."""
    out = ordered_columns(df) if paper_order else df
    first = out.columns[0]
    (
        out.withColumnRenamed(first, BOM + first)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def bibtex_entry(position: Column) -> Column:
    """One BibTeX entry; the key is last name of the first author, year and row position."""
    authors = F.coalesce("authors", F.lit(""))
    first_author = F.trim(F.element_at(F.split(authors, ";"), 1))
    last_name = F.when(
        first_author != "", F.element_at(F.split(first_author, "\\s+"), -1)
    ).otherwise("Unknown")
    year = F.coalesce(F.col("year").cast("int"), F.lit(0)).cast("string")
    line = lambda name, value: F.concat(F.lit(f"\n  {name} = {{"), F.coalesce(value, F.lit("")), F.lit("},"))
    return F.concat(
        F.lit("@article{"), last_name, year, F.lit("_"), position.cast("string"), F.lit(","),
        line("title", F.col("title")),
        line("author", authors),
        line("journal", F.col("journal")),
        line("year", year),
        line("doi", F.col("doi")),
        F.lit("\n}"),
    )


def bibtex_lines(df: DataFrame, order: list[Column]) -> DataFrame:
    """(position, entry) for every paper; positions count from 0 in the given order."""
    ranked = exact_rank(df, [], order, "_rank").withColumn("position", F.col("_rank") - 1)
    return ranked.select("position", bibtex_entry(F.col("position")).alias("entry"))


def export_bibtex(df: DataFrame, path: str, order: list[Column]) -> None:
    entries = bibtex_lines(df, order).orderBy("position").select("entry")
    entries.write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(id, embedding, model, dim) as Parquet, one folder per model."""
    df.write.mode(mode).partitionBy("model").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("model") == model) if model else df
