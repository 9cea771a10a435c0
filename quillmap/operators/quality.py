"""Counts, completeness and the verification report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.scores import percent
from quillmap.operators.works import spot_check
from quillmap.session import durable, top_n


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) != ""


def top_values(df: DataFrame, column: str, n: int, skip_blank: bool = True) -> DataFrame:
    """(column, n) of the most frequent values; ties by value."""
    rows = df.where(_filled(column)) if skip_blank else df
    return (
        rows.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def works_by_year(works: DataFrame, newest: int = 10) -> DataFrame:
    return (
        works.groupBy("publication_year")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("publication_year"))
        .limit(newest)
    )


def top_fields(works: DataFrame, n: int = 10) -> DataFrame:
    return top_values(works, "field", n)


def works_by_type(works: DataFrame, n: int = 8) -> DataFrame:
    return top_values(works, "type", n)


def distinct_authors(links: DataFrame, approximate: bool = False) -> DataFrame:
    """Links and distinct authors; the approximate form needs no shuffle of ids."""
    count = F.approx_count_distinct("author_id") if approximate else F.countDistinct("author_id")
    return links.agg(F.count(F.lit(1)).alias("n_links"), count.alias("n_authors"))


def completeness(works: DataFrame, columns: list[str]) -> DataFrame:
    """Filled values and their share for each column, from one pass over the table."""
    counts = works.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(_filled(c)).alias(c) for c in columns]
    )
    return counts.unpivot(["total"], columns, "column_name", "filled").select(
        "column_name", "filled", percent(F.col("filled"), F.col("total")).alias("pct")
    )


def verify_lakehouse(
    works: DataFrame,
    authorships: DataFrame,
    columns: list[str],
    newest: int = 10,
    fields: int = 10,
    types: int = 8,
    spot: int = 3,
    spot_citations: int = 500,
) -> DataFrame:
    """Verification report as (metric, key, value).

    Year, field and type counts, the total and the filled counts come from one pass over the works
    (grouping sets), authorship counts from one over the links.
    """
    flags = [F.when(_filled(c), 1).otherwise(0).alias(f"_f{i}") for i, c in enumerate(columns)]
    narrow = works.select("publication_year", "field", "type", *flags)
    sets = narrow.groupingSets(
        [["publication_year"], ["field"], ["type"], []], "publication_year", "field", "type"
    ).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).cast("long").alias("n"),
        *[F.sum(f"_f{i}").cast("long").alias(f"_f{i}") for i in range(len(columns))],
    )
    # bit order of gid: publication_year, field, type; a set bit means "not in this grouping"
    named = F.when(F.col("gid") == 3, "year").when(F.col("gid") == 5, "field").when(
        F.col("gid") == 6, "type"
    ).otherwise("total")
    key = F.coalesce(F.col("publication_year").cast("string"), "field", "type", F.lit(""))
    # years + fields + types: read by each part of the report
    base = durable(sets.withColumn("metric", named).withColumn("key", key))
    ranked = top_n(
        base.where((F.col("metric") != "total") & (F.col("key") != "")).withColumn(
            "_order", F.when(F.col("metric") == "year", F.col("publication_year")).otherwise(F.col("n"))
        ),
        ["metric"],
        [F.desc("_order"), F.col("key")],
        max(newest, fields, types),
    )
    most = F.when(F.col("metric") == "year", newest).when(F.col("metric") == "field", fields)
    tops = ranked.where(F.col("rank") <= most.otherwise(types)).select(
        "metric", "key", F.col("n").cast("double").alias("value")
    )
    total = base.where(F.col("metric") == "total")
    filled = total.select(
        F.lit("filled").alias("metric"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("key"), F.col(f"_f{i}").cast("double").alias("value"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("e"),
    ).select("metric", "e.*")
    totals = total.select("metric", F.lit("works").alias("key"), F.col("n").cast("double").alias("value"))
    links = distinct_authors(authorships)
    link_counts = links.select(
        F.lit("total").alias("metric"),
        F.explode(
            F.array(
                F.struct(F.lit("authorships").alias("key"), F.col("n_links").cast("double").alias("value")),
                F.struct(F.lit("authors").alias("key"), F.col("n_authors").cast("double").alias("value")),
            )
        ).alias("e"),
    ).select("metric", "e.*")
    picked = spot_check(works, spot, spot_citations).select(
        F.lit("spot").alias("metric"),
        F.col("openalex_id").cast("string").alias("key"),
        F.col("cited_by_count").cast("double").alias("value"),
    )
    return tops.unionByName(totals).unionByName(filled).unionByName(link_counts).unionByName(picked)


def db_stats(papers: DataFrame, top: int = 20) -> DataFrame:
    """(metric, key, n): papers per tier, largest subfields, distinct journals, year range, total."""
    tiers = papers.groupBy(F.col("journal_tier").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    subfields = top_values(papers, "subfield", top, skip_blank=False)
    totals = papers.agg(
        F.count(F.lit(1)).alias("papers"),
        F.countDistinct("journal").alias("journals"),
        F.min("year").cast("long").alias("year_min"),
        F.max("year").cast("long").alias("year_max"),
    ).unpivot([], ["papers", "journals", "year_min", "year_max"], "key", "n")
    return (
        tiers.select(F.lit("tier").alias("metric"), "key", "n")
        .unionByName(subfields.select(F.lit("subfield").alias("metric"), F.col("subfield").alias("key"), "n"))
        .unionByName(totals.select(F.lit("total").alias("metric"), "key", "n"))
    )


def top_journals(papers: DataFrame, n: int = 20) -> DataFrame:
    return (
        papers.groupBy("journal", "journal_tier")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "journal")
        .limit(n)
    )


def alignment_check(papers: DataFrame, vectors: DataFrame, paper_key: str, vector_key: str) -> DataFrame:
    """Papers without vector and vectors without paper."""
    p = papers.select(F.col(paper_key).alias("id")).distinct()
    v = vectors.select(F.col(vector_key).alias("id")).distinct()
    lost = p.join(v, "id", "left_anti").select(F.lit("paper_without_vector").alias("side"), "id")
    extra = v.join(p, "id", "left_anti").select(F.lit("vector_without_paper").alias("side"), "id")
    return lost.unionByName(extra)


def author_sketches(links: DataFrame, per: str = "publication_year", bits: int = 16) -> DataFrame:
    """(per, n_links, sketch): links and a sketch of the distinct authors of each year; at most 2^bits bytes a row.

    Stored beside the links, they answer distinct counts over any years without another pass.
    """
    return links.groupBy(per).agg(F.count(F.lit(1)).alias("n_links"), F.hll_sketch_agg("author_id", F.lit(bits)).alias("sketch"))


def merge_sketches(*tables: DataFrame, per: str = "publication_year") -> DataFrame:
    """Sketches of several batches as one table, as if all links had come at once."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    return rows.groupBy(per).agg(F.sum("n_links").alias("n_links"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_authors_by_sketch(sketches: DataFrame, per: str | None = None) -> DataFrame:
    """(per, n_links, n_authors): about how many distinct authors, per value or over all rows."""
    counts = [F.sum("n_links").alias("n_links"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_authors")]
    return sketches.groupBy(per).agg(*counts) if per else sketches.agg(*counts)
