"""Schemas of the data model and the adaptive projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field names of the data model.
# One raw work record per JSON line; only the fields that are read.
RAW_WORK = """
    id string, doi string, title string, abstract string,
    abstract_inverted_index map<string, array<int>>,
    publication_year int, publication_date string, language string, type string,
    cited_by_count int, is_retracted boolean, referenced_works_count int,
    referenced_works array<string>,
    corresponding_author_ids array<string>,
    primary_location struct<
        landing_page_url: string,
        source: struct<id: string, display_name: string, issn_l: string>>,
    best_oa_location struct<pdf_url: string>,
    primary_topic struct<
        display_name: string,
        subfield: struct<display_name: string>,
        field: struct<display_name: string>>,
    topics array<struct<subfield: struct<display_name: string>>>,
    authorships array<struct<
        author_position: string, is_corresponding: boolean,
        author: struct<id: string, display_name: string, orcid: string>,
        institutions: array<struct<display_name: string>>>>
""".replace("\n", " ").strip()

# One record of the second source.
RAW_ALT = (
    "paperId string, title string, abstract string, citationCount int, year int, "
    "journal struct<name: string>, authors array<struct<name: string>>, "
    "externalIds struct<DOI: string>"
)

PAPER_REQUIRED = [
    "openalex_id", "title", "abstract", "citation_count", "year",
    "journal", "doi", "authors", "streams",
]
PAPER_OPTIONAL = ["openalex_url", "pdf_url"]

# Column -> (type, value where the column is absent) of a clustered dataset.
DATASET_DEFAULTS = {
    "x": ("double", 0.0),
    "y": ("double", 0.0),
    "cluster_id": ("int", -1),
    "cluster_label": ("string", "Unknown"),
    "topic_words": ("string", ""),
    "citation_count": ("int", 0),
    "year": ("int", 0),
    "title": ("string", ""),
    "abstract": ("string", ""),
    "authors": ("string", ""),
    "journal": ("string", ""),
    "doi": ("string", ""),
    "streams": ("string", ""),
    "openalex_id": ("string", ""),
    "journal_tier": ("string", ""),
    "subfield": ("string", ""),
    "field": ("string", ""),
}
# Text columns in which a null becomes an empty string.
DATASET_TEXT = [
    "cluster_label", "topic_words", "abstract", "authors", "doi", "streams",
    "journal_tier", "subfield", "field",
]

SEARCH_COLUMNS = {
    "openalex_id": "openalex_id",
    "title": "title",
    "abstract": "abstract",
    "publication_year": "year",
    "cited_by_count": "citation_count",
    "source_name": "journal",
    "doi": "doi",
    "subfield": "subfield",
    "field": "field",
    "journal_tier": "journal_tier",
}


def conform(df: DataFrame, defaults: dict[str, tuple[str, object]], fill: list[str] = ()) -> DataFrame:
    """Add missing columns with their default, cast the known ones, blank out nulls in ``fill``.

    Known columns come first in the given order, further columns stay behind them.
    """
    known = []
    for name, (kind, value) in defaults.items():
        column = F.col(name).cast(kind) if name in df.columns else F.lit(value).cast(kind)
        if name in fill:
            column = F.coalesce(column, F.lit(""))
        known.append(column.alias(name))
    extra = [F.col(c) for c in df.columns if c not in defaults]
    return df.select(*known, *extra)
