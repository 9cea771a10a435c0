"""Authors and their papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import truncate_text
from quillmap.session import broadcast_if_small, exact_rank, top_n


def author_papers(links: DataFrame, papers: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """Papers of authors: one row per (author_id, paper)."""
    held = links.select("author_id", F.col("paper_id").alias("openalex_id"))
    if authors is not None:
        asked = broadcast_if_small(authors.select("author_id").distinct())
        held = broadcast_if_small(held.join(asked, "author_id", "left_semi"))
    return papers.join(held, "openalex_id")


def author_totals(papers: DataFrame, links: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """Paper count (all links) and citation sum (known papers) per author, 0 where there are none.

    One left join and one aggregation serve both numbers.
    """
    cited = papers.select(F.col("openalex_id").alias("paper_id"), "citation_count")
    totals = (
        links.join(cited, "paper_id", "left")
        .groupBy("author_id")
        .agg(
            F.count(F.lit(1)).alias("paper_count"),
            F.coalesce(F.sum("citation_count"), F.lit(0)).cast("long").alias("total_citations"),
        )
    )
    if authors is None:
        return totals
    zero = {"paper_count": 0, "total_citations": 0}
    return authors.join(totals, "author_id", "left").fillna(zero)


def active_authors(authors: DataFrame, min_papers: int = 3) -> DataFrame:
    return authors.where(F.col("paper_count") >= min_papers)


def top_authors(authors: DataFrame, n: int = 10) -> DataFrame:
    return authors.orderBy(F.desc("total_citations"), "author_id").limit(n)


def top_paper_per_author(papers_of_authors: DataFrame) -> DataFrame:
    """Most cited paper of each author."""
    order = [F.desc("citation_count"), F.col("openalex_id")]
    return top_n(papers_of_authors, ["author_id"], order, 1).drop("rank")


def find_authors(
    authors: DataFrame,
    query: str,
    links: DataFrame | None = None,
    papers: DataFrame | None = None,
    min_papers: int = 2,
    n: int = 10,
) -> DataFrame:
    """Authors whose name contains the text, most cited first; with their top paper if asked for."""
    found = (
        active_authors(authors, min_papers)
        .where(F.contains(F.lower("name"), F.lit(query.strip().lower())))
        .orderBy(F.desc("total_citations"), "author_id")
        .limit(n)
    )
    if links is None or papers is None:
        return found
    best = top_paper_per_author(author_papers(links, papers, found)).select(
        "author_id",
        F.col("openalex_id").alias("top_paper_id"),
        F.col("title").alias("top_paper_title"),
        F.col("citation_count").alias("top_paper_citations"),
    )
    return found.join(best, "author_id", "left")


def author_texts(
    links: DataFrame, papers: DataFrame, abstract_chars: int | None = 300, chunk_papers: int = 1000
) -> DataFrame:
    """(author_id, chunk, n_papers, text): an author's papers, most cited first, as running text.

    Each paper adds ``title. abstract`` with the abstract cut to a length (None: whole). An author may have any
    number of papers, so the text comes in chunks of at most ``chunk_papers`` papers; the chunks in
    order, joined by a blank, are the whole text.
    """
    whole = F.coalesce("abstract", F.lit(""))
    short = truncate_text(F.col("abstract"), abstract_chars, "") if abstract_chars else whole
    part = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), short)
    # ids are ranked and placed alone; the text joins them once
    order = [F.desc("citation_count"), F.col("openalex_id")]
    ranked = exact_rank(author_papers(links, papers).select("author_id", "openalex_id", "citation_count"), ["author_id"], order)
    told = papers.select("openalex_id", part.alias("part"))
    return (
        ranked.join(told, "openalex_id").withColumn("chunk", F.floor((F.col("rank") - 1) / chunk_papers).cast("int"))
        .groupBy("author_id", "chunk")
        .agg(F.count(F.lit(1)).alias("n_papers"), F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("p"))
        .select(
            "author_id", "chunk", "n_papers",
            F.array_join(F.transform("p", lambda x: x["part"]), " ").alias("text"),
        )
    )
