"""What the operators of this subpackage share: table access, row keys, sizes and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is the empty one. Extra columns never reach an operator."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id. Rows with equal doc_id and text have the same key and result."""
    return F.xxhash64(text)


def map_arrow(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType
) -> DataFrame:
    """Run a batch function, built once per task, over Arrow batches; it returns columns by name."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch))

    return df.mapInArrow(task, schema)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return dict(df.dtypes)[name]


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes sketches and shards, never decides what is processed."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
