"""Partitioned Parquet tables, views and the search table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.schemas import SEARCH_COLUMNS


def write_lakehouse(
    df: DataFrame, path: str, partition_by: str | None = "publication_year", mode: str = "overwrite"
) -> None:
    """Snappy Parquet, one folder per partition value.

    By default the folders that the rows belong to are replaced and others stay, so a job that runs
    twice leaves one copy; without partitions the whole table is replaced.

    The rebalance hint gathers each value in few tasks, so few files arise, and lets adaptive
    execution split the values that hold most of the rows.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", F.col(partition_by))
    out = writer.write.mode(mode).option("compression", "snappy")
    if partition_by:
        out = out.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def load_works(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a folder as one table, partition columns included."""
    return spark.read.parquet(path)


def materialize(df: DataFrame, table: str) -> DataFrame:
    """Store a result as a managed table and return the table."""
    df.write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def register_views(spark: SparkSession, tables: dict[str, DataFrame | str]) -> None:
    """Temporary views for SQL; a path stands for its Parquet files."""
    for name, source in tables.items():
        df = spark.read.parquet(source) if isinstance(source, str) else source
        df.createOrReplaceTempView(name)


def search_table(works: DataFrame, doc_type: str = "article") -> DataFrame:
    """Articles under the column names the search uses; absent text columns become blank."""
    columns = []
    for source, name in SEARCH_COLUMNS.items():
        column = F.col(source) if source in works.columns else F.lit("")
        columns.append(column.alias(name))
    return works.where(F.col("type") == doc_type).select(*columns)


def build_search_table(works: DataFrame, path: str) -> DataFrame:
    search_table(works).write.mode("overwrite").parquet(path)
    return works.sparkSession.read.parquet(path)


def list_datasets(
    spark: SparkSession,
    suffix: str = "_clustered",
    pinned: str = "worldmap",
    titles: dict[str, str] | None = None,
) -> DataFrame:
    """Result tables of the catalog by suffix, the pinned one first; titles gives labels for stems."""
    titles = titles or {}
    stems = sorted(
        t.name[: -len(suffix)] for t in spark.catalog.listTables() if t.name.endswith(suffix)
    )
    ordered = [s for s in stems if s == pinned] + [s for s in stems if s != pinned]
    rows = [
        (i, titles.get(s, s.replace("_", " ").title()), s + suffix) for i, s in enumerate(ordered)
    ]
    return spark.createDataFrame(rows, "position int, label string, table string")
