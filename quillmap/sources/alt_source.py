"""Records of a second source, journal name resolution and the user's own list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.text import author_list, blank_safe_key, doi_url
from quillmap.session import top_n


def normalize_alt_source(
    records: DataFrame,
    stream: str = "",
    journals: DataFrame | None = None,
    prefix: str = "s2:",
    author_names: int | None = 10,
) -> DataFrame:
    """Second-source records in the paper schema; ``author_names`` None: all names.

    Records without abstract are dropped. ``journals(name)`` is an optional allow-list, compared
    without case.
    """
    journal = F.coalesce("journal.name", F.lit(""))
    papers = records.where(F.coalesce("abstract", F.lit("")) != "").select(
        F.concat(F.lit(prefix), F.coalesce("paperId", F.lit(""))).alias("openalex_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        "abstract",
        F.coalesce("citationCount", F.lit(0)).alias("citation_count"),
        F.coalesce("year", F.lit(0)).alias("year"),
        journal.alias("journal"),
        doi_url(F.col("externalIds.DOI")).alias("doi"),
        F.coalesce(
            author_list(F.transform("authors", lambda a: F.coalesce(a["name"], F.lit(""))), author_names), F.lit("")
        ).alias("authors"),
        F.lit(stream).alias("streams"),
    )
    if journals is None:
        return papers
    allowed = journals.select(F.lower("name").alias("_allowed")).distinct()
    return papers.join(allowed, F.lower("journal") == F.col("_allowed"), "left_semi")


def name_key(name: Column) -> Column:
    """Journal name without case, punctuation and repeated blanks."""
    return F.trim(F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]+", " "))


def resolve_sources(names: DataFrame, sources: DataFrame) -> DataFrame:
    """Best source of each journal name: same spelling first, then the larger, then the smaller id.

    names(name), sources(source_id, source_name, works_count). Names without letters and digits match nothing.
    """
    asked = names.select("name").distinct().withColumn("_key", name_key(F.col("name"))).where(F.col("_key") != "")
    held = sources.withColumn("_key", name_key(F.col("source_name"))).where(F.col("_key") != "")
    pairs = asked.join(held, "_key").withColumn(
        "exact", (F.col("name") == F.col("source_name")).cast("int")
    )
    order = [F.desc("exact"), F.desc("works_count"), F.col("source_id")]
    return top_n(pairs, ["name"], order, 1).select(
        "name", "source_id", "source_name", "works_count", "exact"
    )


def mark_user_papers(papers: DataFrame, mine: DataFrame) -> DataFrame:
    """Adds ``is_mine``: the DOI or the title, compared without case, is in the user's list."""
    out = papers
    marks = []
    for column in ("doi", "title"):
        if column not in mine.columns:
            continue
        listed = (
            mine.select(F.lower(column).alias("_listed"))
            .where(F.coalesce("_listed", F.lit("")) != "")
            .distinct()
            .withColumn(f"_by_{column}", F.lit(True))
        )
        key = blank_safe_key(F.col(column), F.col("openalex_id"))
        out = out.join(listed, key == F.col("_listed"), "left").drop("_listed")
        marks.append(F.coalesce(f"_by_{column}", F.lit(False)))
    flag = F.lit(False)
    for m in marks:
        flag = flag | m
    return out.withColumn("is_mine", flag).drop("_by_doi", "_by_title")
