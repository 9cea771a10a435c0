"""From nested work records to flat tables, and the filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import author_list, rebuild_abstract
from quillmap.operators.tiers import add_journal_tier


def _text(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(""))


def _has_year() -> Column:
    return F.coalesce("publication_year", F.lit(0)) != 0


def project_works(works_raw: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """Flat works: missing values become blank, 0 or false; works without year are dropped."""
    flat = works_raw.where(_has_year()).select(
        _text("id").alias("openalex_id"),
        _text("doi").alias("doi"),
        _text("title").alias("title"),
        rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        "publication_year",
        _text("publication_date").alias("publication_date"),
        _text("language").alias("language"),
        _text("type").alias("type"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
        _text("primary_location.source.id").alias("source_id"),
        _text("primary_location.source.display_name").alias("source_name"),
        _text("primary_location.source.issn_l").alias("source_issn"),
        _text("primary_location.landing_page_url").alias("landing_page_url"),
        _text("best_oa_location.pdf_url").alias("pdf_url"),
        _text("primary_topic.field.display_name").alias("field"),
        _text("primary_topic.subfield.display_name").alias("subfield"),
        _text("primary_topic.display_name").alias("topic"),
        F.coalesce("referenced_works_count", F.lit(0)).alias("referenced_works_count"),
    )
    return add_journal_tier(flat, tiers)


def explode_authorships(works_raw: DataFrame) -> DataFrame:
    """One row per (work, author) with id; corresponding by own flag or by the work's list."""
    rows = works_raw.where(_has_year()).select(
        _text("id").alias("paper_id"),
        "publication_year",
        F.coalesce("corresponding_author_ids", F.array().cast("array<string>")).alias("_ids"),
        F.posexplode("authorships").alias("ordinal", "a"),
    )
    author_id = _text("a.author.id")
    return rows.where(author_id != "").select(
        "paper_id",
        author_id.alias("author_id"),
        _text("a.author.display_name").alias("author_name"),
        _text("a.author.orcid").alias("orcid"),
        _text("a.author_position").alias("position"),
        (
            F.coalesce("a.is_corresponding", F.lit(False))
            | F.array_contains("_ids", author_id)
        ).alias("is_corresponding"),
        F.coalesce(F.get("a.institutions", F.lit(0))["display_name"], F.lit("")).alias("institution"),
        "ordinal",
        "publication_year",
    )


def paper_author_links(authorships: DataFrame) -> DataFrame:
    """(paper_id, author_id, position) with the pair as key; the first position wins."""
    return authorships.groupBy("paper_id", "author_id").agg(F.min("ordinal").alias("position"))


def match_subfield(works_raw: DataFrame, targets: list[str]) -> DataFrame:
    """Adds ``matched_subfield``: the primary subfield if it is a target, else the first further one.

    Compared without case; blank where nothing matches. ``targets`` is a parameter list.
    """
    wanted = [t.lower() for t in targets]
    primary = _text("primary_topic.subfield.display_name")
    names = F.transform("topics", lambda t: F.coalesce(t["subfield"]["display_name"], F.lit("")))
    further = F.get(F.filter(names, lambda n: F.lower(n).isin(wanted)), F.lit(0))
    return works_raw.withColumn(
        "matched_subfield",
        F.when(F.lower(primary).isin(wanted), primary).otherwise(F.coalesce(further, F.lit(""))),
    )


def filter_subject(
    works_raw: DataFrame,
    targets: list[str],
    year_min: int = 2000,
    year_max: int = 2026,
    min_abstract: int = 50,
    doc_type: str = "article",
    tiers: DataFrame | None = None,
    author_names: int | None = 10,
) -> DataFrame:
    """Papers of the target subfields with a usable abstract; ``author_names`` None: all names.

    The abstract is rebuilt only for rows that pass the cheap tests. ``subfield`` is the primary
    one, ``matched_subfield`` the one that led to the match.
    """
    cheap = works_raw.where(
        (F.col("type") == doc_type) & F.col("publication_year").between(year_min, year_max)
    )
    matched = match_subfield(cheap, targets).where(F.col("matched_subfield") != "")
    papers = (
        matched.select(
            _text("id").alias("openalex_id"),
            _text("title").alias("title"),
            rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"),
            F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
            F.col("publication_year").alias("year"),
            _text("primary_location.source.display_name").alias("journal"),
            _text("doi").alias("doi"),
            _author_names(author_names).alias("authors"),
            F.col("matched_subfield").alias("streams"),
            _text("primary_topic.field.display_name").alias("field"),
            _text("primary_topic.subfield.display_name").alias("subfield"),
            _text("primary_topic.display_name").alias("topic"),
            "matched_subfield",
        )
        .where(F.length("abstract") >= min_abstract)
    )
    return add_journal_tier(papers, tiers, journal="journal")


def _author_names(most: int | None) -> Column:
    names = F.transform(
        "authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))
    )
    return F.coalesce(author_list(names, most), F.lit(""))


def project_papers(works_raw: DataFrame, stream: str = "", author_names: int | None = 10) -> DataFrame:
    """Work records in the paper schema; title-only works stay; ``author_names`` None: all names."""
    abstract = F.when(_text("abstract") != "", F.col("abstract")).otherwise(
        rebuild_abstract(F.col("abstract_inverted_index"))
    )
    return works_raw.select(
        _text("id").alias("openalex_id"),
        _text("title").alias("title"),
        abstract.alias("abstract"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
        F.coalesce("publication_year", F.lit(0)).alias("year"),
        _text("primary_location.source.display_name").alias("journal"),
        _text("doi").alias("doi"),
        _author_names(author_names).alias("authors"),
        F.lit(stream).alias("streams"),
        _text("id").alias("openalex_url"),
    ).where((F.col("abstract") != "") | (F.col("title") != ""))


def with_abstract(papers: DataFrame) -> DataFrame:
    """Papers whose abstract is not blank."""
    return papers.where(F.trim(F.coalesce("abstract", F.lit(""))) != "")


def restrict_to_papers(works: DataFrame, papers: DataFrame, key: str = "openalex_id") -> DataFrame:
    """Works whose id is in the paper table."""
    return works.join(papers.select(key).distinct(), key, "left_semi")


def filter_high_impact(
    works: DataFrame, min_citations: int = 500, doc_type: str = "article", strict: bool = False
) -> DataFrame:
    """Articles with many citations, a field and a title."""
    cited = F.col("cited_by_count")
    enough = cited > min_citations if strict else cited >= min_citations
    filled = (_text("field") != "") & (_text("title") != "")
    return works.where((F.col("type") == doc_type) & enough & filled)


def filter_landscape(
    df: DataFrame,
    year_range: tuple[int, int] | None = None,
    min_citations: int = 0,
    labels: list[str] | None = None,
    year: str = "year",
    citations: str = "citation_count",
    label: str = "cluster_label",
) -> DataFrame:
    """Rows of a map by year range, citations and labels; no label list means all."""
    out = df
    if year_range:
        out = out.where(F.col(year).between(*year_range))
    if min_citations:
        out = out.where(F.col(citations) >= min_citations)
    return out.where(F.col(label).isin(labels)) if labels else out


def export_subset(
    papers: DataFrame, tiers: list[str], min_citations: int = 0, strict: bool = True
) -> DataFrame:
    """Papers of some tiers, most cited first, with the subfield as stream."""
    cited = F.col("citation_count")
    enough = cited > min_citations if strict else cited >= min_citations
    return (
        papers.where(F.col("journal_tier").isin(tiers) & enough)
        .withColumn("streams", F.col("subfield"))
        .orderBy(F.desc("citation_count"), "openalex_id")
    )


def spot_check(works: DataFrame, n: int = 3, min_citations: int = 500) -> DataFrame:
    """A few highly cited works, picked by hash so that every run picks the same."""
    return (
        works.where((_text("title") != "") & (F.col("cited_by_count") > min_citations))
        .withColumn("_pick", F.md5(F.col("openalex_id").cast("string")))
        .orderBy("_pick", "openalex_id")
        .limit(n)
        .drop("_pick")
    )
