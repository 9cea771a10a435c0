"""Stored query results: reuse only where the key and all filter values agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incremental_queries(
    requested: DataFrame, cache: DataFrame, key: list[str], filters: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cached rows that answer a request, and requests without an answer.

    Filter values are compared as text, null equal to null.
    """
    names = [*key, *filters]

    def on(left: str, right: str):
        return [
            F.col(f"{left}.{c}").cast("string").eqNullSafe(F.col(f"{right}.{c}").cast("string"))
            for c in names
        ]

    asked = requested.select(*names).distinct()
    held = cache.select(*names).distinct()
    hits = cache.alias("c").join(asked.alias("a"), on("c", "a"), "left_semi")
    misses = requested.alias("r").join(held.alias("h"), on("r", "h"), "left_anti")
    return hits, misses


def merge_results(hits: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cached and newly fetched results together."""
    return hits.unionByName(fetched, allowMissingColumns=True)
