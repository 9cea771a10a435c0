"""Duplicates of papers and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.session import top_n


def dedupe_papers(
    df: DataFrame,
    seq: list[Column],
    key: str = "openalex_id",
    tags: str = "streams",
    citations: str = "citation_count",
    tag_sep: str = "; ",
) -> DataFrame:
    """One row per id: sorted union of tags, largest citations, other columns of the first row.

    One shuffle. ``collect_set`` keeps only distinct tag lists and combines before the shuffle, so
    a paper with very many copies costs no more than its distinct lists.
    """
    rest = [c for c in df.columns if c not in (key, tags, citations)]
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(seq)])
    lists = F.collect_set(F.split(F.coalesce(tags, F.lit("")), tag_sep, -1))
    aggregates = [
        F.array_join(F.array_sort(F.array_distinct(F.flatten(lists))), tag_sep).alias(tags),
        F.max(citations).alias(citations),
    ]
    if rest:
        aggregates.append(F.min_by(F.struct(*rest), position).alias("_first"))
    merged = df.groupBy(key).agg(*aggregates)
    columns = [F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]
    return merged.select(*columns)


def dedupe_authors(authorships: DataFrame, order_by: list[Column]) -> DataFrame:
    """(author_id, name, orcid): first name and first non-blank ORCID in the given order."""
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_by)])
    filled = F.when(F.coalesce("orcid", F.lit("")) != "", position)
    return (
        authorships.where(F.coalesce(F.col("author_id").cast("string"), F.lit("")) != "")
        .groupBy("author_id")
        .agg(
            F.min_by("author_name", position).alias("name"),
            F.min_by("orcid", filled).alias("orcid"),
        )
    )


def author_profiles(authorships: DataFrame, order_by: list[Column]) -> DataFrame:
    """(author_id, name, institution) of the first record with an institution, else of the first."""
    blank = F.coalesce("institution", F.lit("")) == ""
    position = F.struct(
        blank.cast("int").alias("blank"), *[c.alias(f"o{i}") for i, c in enumerate(order_by)]
    )
    record = F.struct(F.col("author_name").alias("name"), "institution")
    return (
        authorships.groupBy("author_id")
        .agg(F.min_by(record, position).alias("r"))
        .select("author_id", "r.name", F.coalesce("r.institution", F.lit("")).alias("institution"))
    )


def dedupe_by_priority(df: DataFrame, key: list[str], priority: list[Column]) -> DataFrame:
    """First row of each key by priority."""
    return top_n(df, key, priority, 1, "_rank").drop("_rank")
