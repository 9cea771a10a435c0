"""Queries on the full-text index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators import search as se
from quillmap.registry.base import Tables, query
from quillmap.session import durable, store


def _index(t: Tables):
    """The index is a stored table; queries read it many times."""
    postings, stats = se.build_search_index(t.search_docs)
    return store(postings, "postings"), store(stats, "doc_stats")


def _filters(t: Tables) -> DataFrame:
    """Every query has its own filters, derived from its id."""
    return t.raw("benchmark").select(
        F.col("item_id").alias("query_id"),
        (F.lit(1990) + F.col("item_id") % 10).alias("year_min"),
        F.lit(2020).alias("year_max"),
        (F.col("item_id") * 20).alias("citation_min"),
        F.when(F.col("item_id") > 10, F.array(F.lit("fr"), F.lit("en"))).alias("journal_tiers"),
        F.lit(None).cast("array<string>").alias("subfields"),
        (F.col("item_id") + 1).alias("limit"),
    )


@query("search_bm25", "fx_scored fx_docs", """
    SELECT query_id, openalex_id, round(score, 6) AS score, title, citation_count, CAST(rk AS INT) AS rank FROM (
        SELECT s.query_id, s.doc_id AS openalex_id, s.score, d.title, d.cited_by_count AS citation_count,
               row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, d.cited_by_count DESC, s.doc_id) AS rk
        FROM fx_scored s JOIN fx_docs d ON d.openalex_id = s.doc_id) WHERE rk <= 50""")
def search_bm25(t: Tables) -> DataFrame:
    found = se.search(_index(t), t.search_docs, t.queries, limit=50)
    return found.select("query_id", "openalex_id", F.round("score", 6).alias("score"), "title", "citation_count", "rank")


@query("search_filtered", "fx_scored fx_docs", """
    SELECT query_id, openalex_id, round(score, 6) AS score, short AS abstract, CAST(rk AS INT) AS rank FROM (
        SELECT s.query_id, s.doc_id AS openalex_id, s.score,
               CASE WHEN length(d.abstract) > 300 THEN substring(d.abstract, 1, 300) || '...' ELSE d.abstract END AS short,
               row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, d.cited_by_count DESC, s.doc_id) AS rk
        FROM fx_scored s JOIN fx_docs d ON d.openalex_id = s.doc_id
        WHERE d.publication_year BETWEEN 1990 + s.query_id % 10 AND 2020 AND d.cited_by_count >= s.query_id * 20
          AND (s.query_id <= 10 OR d.language IN ('fr', 'en')))
    WHERE rk <= least(200, query_id + 1)""")
def search_filtered(t: Tables) -> DataFrame:
    found = se.search(_index(t), t.search_docs, t.queries, _filters(t))
    return se.result_view(found).select("query_id", "openalex_id", F.round("score", 6).alias("score"), "abstract", "rank")


TOP10 = """
    hits AS (SELECT query_id, openalex_id FROM (
        SELECT s.query_id, s.doc_id AS openalex_id,
               row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, d.cited_by_count DESC, s.doc_id) AS rk
        FROM fx_scored s JOIN fx_docs d ON d.openalex_id = s.doc_id) WHERE rk <= 10),
    firsts AS (SELECT openalex_id, min(query_id) AS query_id FROM hits GROUP BY 1),
    log AS (SELECT q.query_id, coalesce(r.n, 0) AS results, coalesce(f.n, 0) AS new,
                   sum(coalesce(f.n, 0)) OVER (ORDER BY q.query_id)::BIGINT AS total
            FROM (SELECT DISTINCT query_id FROM fx_terms) q
            LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) r ON r.query_id = q.query_id
            LEFT JOIN (SELECT query_id, count(*) AS n FROM firsts GROUP BY 1) f ON f.query_id = q.query_id)"""


@query("multi_search_log", "fx_scored fx_docs", f"""
    SELECT * FROM (WITH {TOP10} SELECT query_id, results, new, total FROM log)""")
def multi_search_log(t: Tables) -> DataFrame:
    results = se.search(_index(t), t.search_docs, t.queries, limit=10)
    return se.multi_search(results, t.queries)[1]


@query("multi_search_papers", "fx_scored fx_docs", f"""
    SELECT * FROM (WITH {TOP10} SELECT f.openalex_id, f.query_id FROM firsts f JOIN log l ON l.query_id = f.query_id
                   WHERE l.total - l.new < 60)""")
def multi_search_papers(t: Tables) -> DataFrame:
    results = durable(se.search(_index(t), t.search_docs, t.queries, limit=10).select("query_id", "openalex_id"))
    return se.multi_search(results, t.queries, cap=60)[0].select("openalex_id", "query_id")


@query("match_count", "fx_scored", """
    SELECT q.query_id, count(s.doc_id) AS n FROM (SELECT DISTINCT query_id FROM fx_terms) q
    LEFT JOIN fx_scored s ON s.query_id = q.query_id GROUP BY 1""")
def match_count(t: Tables) -> DataFrame:
    return se.match_count(_index(t), t.queries)


@query("search_postings", "fx_postings", "SELECT token, doc_id, CAST(tf AS INT) AS tf, CAST(dl AS INT) AS dl FROM fx_postings")
def search_postings(t: Tables) -> DataFrame:
    return se.build_search_index(t.search_docs)[0]
