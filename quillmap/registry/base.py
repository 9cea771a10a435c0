"""Fixture views on the test tables and the query register.

A fixture is one SQL text that both engines read, so Spark and the check see the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.text import tokens
from quillmap.session import broadcast_if_small, deal, spread_scan, store

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {
    "fx_works": """
        SELECT o.o_orderkey AS openalex_id,
               'Paper ' || CAST(o.o_orderkey AS STRING) AS title,
               CAST(year(o.o_orderdate) AS INT) AS publication_year,
               CASE WHEN o.o_orderstatus = 'P' THEN 'preprint' ELSE 'article' END AS type,
               CAST(floor(o.o_totalprice / 1000) AS INT) AS cited_by_count,
               o.o_orderpriority AS source_name,
               r.r_name AS field,
               n.n_name AS subfield,
               n.n_name || '/' || c.c_mktsegment AS topic
        FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
    """,
    "fx_tiers": """
        SELECT * FROM (VALUES ('1-urgent', 'Tier1'), ('2-high', 'Tier2'), ('3-medium', 'Tier3')) AS t(name, tier)
    """,
    # papers under the names of the search table
    "fx_papers": """
        SELECT w.openalex_id, w.title, w.publication_year AS year, w.cited_by_count AS citation_count,
               w.source_name AS journal, w.field, w.subfield, w.topic, w.type,
               coalesce(t.tier, 'Other') AS journal_tier
        FROM fx_works w LEFT JOIN fx_tiers t ON lower(trim(w.source_name)) = t.name
    """,
    # authors are parts: about four per paper, sparse enough for second-layer authors
    "fx_links": """
        SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS author_id FROM lineitem
    """,
    "fx_authors": """
        SELECT p.p_partkey AS author_id, p.p_name AS name,
               CASE WHEN p.p_size < 10 THEN '' ELSE p.p_brand END AS institution,
               CAST(coalesce(t.paper_count, 0) AS BIGINT) AS paper_count,
               CAST(coalesce(t.total_citations, 0) AS BIGINT) AS total_citations
        FROM part p LEFT JOIN (
            SELECT l.author_id, count(*) AS paper_count, sum(w.cited_by_count) AS total_citations
            FROM fx_links l LEFT JOIN fx_works w ON l.paper_id = w.openalex_id
            GROUP BY l.author_id) t ON p.p_partkey = t.author_id
    """,
    # all authors with a matching name that have papers to share
    "fx_focals": """
        SELECT author_id, name FROM fx_authors
        WHERE lower(name) LIKE '%ring%' AND paper_count >= 2
    """,
    # a dense network: authors are suppliers
    "fx_slinks": """
        SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author_id FROM lineitem
    """,
    # all authors in groups of five, by number of papers
    "fx_groups": """
        SELECT CAST(floor((seq - 1) / 5) AS INT) AS group_id, author_id, seq FROM (
            SELECT author_id, CAST(row_number() OVER (ORDER BY n DESC, author_id) AS INT) AS seq FROM (
                SELECT author_id, count(*) AS n FROM fx_slinks GROUP BY author_id) m) s
    """,
    "fx_authorships": """
        SELECT d.l_orderkey AS paper_id, d.l_suppkey AS author_id, s.s_name AS author_name,
               CASE WHEN (d.l_orderkey + d.l_suppkey) % 3 = 0 THEN 'ORC-' || CAST(d.l_suppkey AS STRING) ELSE '' END AS orcid,
               CASE WHEN d.l_orderkey % 4 = 0 THEN '' ELSE n.n_name END AS institution,
               CAST(row_number() OVER (PARTITION BY d.l_orderkey ORDER BY d.l_suppkey) - 1 AS INT) AS position
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) d
        JOIN supplier s ON d.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey
    """,
    "fx_docs": """
        SELECT doc_id AS openalex_id,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract,
               lang AS language, source AS source_name,
               CAST(1990 + doc_id % 35 AS INT) AS publication_year,
               CAST(n_chars AS INT) AS cited_by_count
        FROM documents
    """,
}
_NEEDS = {
    "fx_papers": ["fx_works", "fx_tiers"],
    "fx_authors": ["fx_works", "fx_links"],
    "fx_focals": ["fx_authors"],
    "fx_groups": ["fx_slinks"],
}

# Fixtures whose text differs between the engines only in the name of a function or an index base.
DUCK: dict[str, str] = {
    "fx_points": """
        SELECT vec_id AS openalex_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               label AS cluster_id, 'L' || CAST(label AS STRING) AS territory FROM embeddings
    """,
    "fx_words": r"""
        SELECT openalex_id,
               regexp_extract_all(lower(strip_accents(title)), '[\p{L}\p{N}]+')
               || regexp_extract_all(lower(strip_accents(abstract)), '[\p{L}\p{N}]+') AS words
        FROM fx_docs
    """,
    "fx_terms": r"""
        SELECT query_id, group_id, token, count(*) AS times,
               count(*) OVER (PARTITION BY query_id, group_id) AS n_tokens
        FROM (SELECT query_id, CAST(floor((pos - 1) / 2) AS INT) AS group_id, token FROM (
            SELECT item_id AS query_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
                SELECT item_id, list_filter(
                    regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), lambda t: length(t) >= 1) AS w
                FROM benchmark)))
        GROUP BY query_id, group_id, token
    """,
    "fx_postings": """
        SELECT openalex_id AS doc_id, token, count(*) AS tf, any_value(dl) AS dl
        FROM (SELECT openalex_id, len(words) AS dl, unnest(words) AS token FROM fx_words) GROUP BY 1, 2
    """,
    "fx_scored": """
        SELECT query_id, doc_id, sum(score) AS score FROM (
            SELECT t.query_id, t.group_id, p.doc_id,
                   sum(t.times * greatest(CASE WHEN i.idf > 0 THEN i.idf ELSE 1e-6 END, 1e-6) * p.tf * 2.2
                       / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
            FROM fx_terms t JOIN fx_postings p ON t.token = p.token
            JOIN (SELECT q.token, ln(((SELECT count(*) FROM fx_words) - q.df + 0.5) / (q.df + 0.5)) AS idf
                  FROM (SELECT token, count(*) AS df FROM fx_postings GROUP BY 1) q) i ON i.token = t.token,
            (SELECT avg(len(words)) AS avgdl FROM fx_words) s
            GROUP BY t.query_id, t.group_id, p.doc_id
            HAVING count(*) = any_value(t.n_tokens))
        GROUP BY query_id, doc_id
    """,
    "fx_edges": """
        SELECT a.author_id AS focal_id, b.author_id, count(*) AS shared_papers,
               avg(CASE WHEN w.publication_year <> 0 THEN pow(0.85, 2026 - w.publication_year) END) AS recency
        FROM fx_links a JOIN fx_focals f ON a.author_id = f.author_id
        JOIN fx_links b ON a.paper_id = b.paper_id AND a.author_id <> b.author_id
        LEFT JOIN fx_works w ON w.openalex_id = a.paper_id
        GROUP BY 1, 2
    """,
    "fx_scores": """
        SELECT e.focal_id, e.author_id, e.shared_papers, e.recency,
               0.4 * ln(1 + e.shared_papers) + 0.35 * coalesce(e.recency, 0)
               + 0.25 * e.shared_papers / greatest(
                   greatest(a.paper_count, 1) + greatest(b.paper_count, 1) - e.shared_papers, 1) AS score
        FROM fx_edges e JOIN fx_authors a ON e.focal_id = a.author_id JOIN fx_authors b ON e.author_id = b.author_id
    """,
    "fx_circle": """
        SELECT r.focal_id, r.author_id, r.shared_papers, r.score, r.rk FROM (
            SELECT *, row_number() OVER (PARTITION BY focal_id ORDER BY score DESC, author_id) AS rk
            FROM (SELECT * REPLACE (round(score, 12) AS score) FROM fx_scores) WHERE shared_papers >= 2) r
        LEFT JOIN (
            SELECT focal_id, greatest(2, least(15, arg_max(rk, {'g': gap, 'r': -rk}))) AS size FROM (
                SELECT focal_id, rk, score - lead(score) OVER (PARTITION BY focal_id ORDER BY rk) AS gap FROM (
                    SELECT focal_id, score, row_number() OVER (PARTITION BY focal_id ORDER BY score DESC, author_id) AS rk
                    FROM (SELECT * REPLACE (round(score, 12) AS score) FROM fx_scores) WHERE shared_papers >= 2))
            WHERE gap IS NOT NULL GROUP BY focal_id) c ON r.focal_id = c.focal_id
        WHERE r.rk <= coalesce(c.size, 1)
    """,
    "fx_pairs": """
        SELECT DISTINCT m.focal_id, a.author_id AS author_a, b.author_id AS author_b
        FROM fx_circle m JOIN fx_links a ON m.author_id = a.author_id
        JOIN fx_links b ON a.paper_id = b.paper_id AND a.author_id < b.author_id
        JOIN fx_circle n ON n.focal_id = m.focal_id AND n.author_id = b.author_id
    """,
    "fx_hops": """
        SELECT e.focal_id, e.author_id AS layer1_id, h.b AS author_id
        FROM fx_edges e JOIN (
            SELECT x.author_id AS a, y.author_id AS b, count(*) AS n
            FROM fx_links x JOIN fx_links y ON x.paper_id = y.paper_id AND x.author_id <> y.author_id
            GROUP BY 1, 2 HAVING count(*) >= 2) h ON h.a = e.author_id
        WHERE h.b <> e.focal_id
          AND NOT EXISTS (SELECT 1 FROM fx_edges k WHERE k.focal_id = e.focal_id AND k.author_id = h.b)
    """,
    "fx_layer2": """
        SELECT * FROM (
            SELECT h.focal_id, h.author_id, h.n_links, a.total_citations,
                   row_number() OVER (PARTITION BY h.focal_id ORDER BY a.total_citations DESC, h.author_id) AS rk
            FROM (SELECT focal_id, author_id, count(*) AS n_links FROM fx_hops GROUP BY 1, 2) h
            JOIN fx_authors a ON a.author_id = h.author_id WHERE h.n_links >= 2)
        WHERE rk <= 100
    """,
    "fx_track": """
        SELECT l.author_id AS focal_id, l.paper_id, w.field AS cluster_id, w.publication_year AS year,
               w.cited_by_count AS citations
        FROM fx_links l JOIN fx_works w ON l.paper_id = w.openalex_id
    """,
    "fx_kdocs": """
        SELECT d.doc_id AS openalex_id, d.text, coalesce(e.label, -1) AS cluster_id
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    """,
    "fx_kwords": r"""
        SELECT openalex_id, cluster_id, list_filter(
            regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'),
            lambda t: length(t) >= 2 AND NOT list_contains(@stop, t)) AS words
        FROM fx_kdocs
    """,
}
_DUCK_NEEDS = {
    "fx_words": ["fx_docs"],
    "fx_postings": ["fx_words"],
    "fx_scored": ["fx_terms", "fx_postings", "fx_words"],
    "fx_edges": ["fx_links", "fx_focals", "fx_works"],
    "fx_scores": ["fx_edges", "fx_authors"],
    "fx_circle": ["fx_scores"],
    "fx_pairs": ["fx_circle", "fx_links"],
    "fx_hops": ["fx_edges", "fx_links"],
    "fx_layer2": ["fx_hops", "fx_authors"],
    "fx_track": ["fx_links", "fx_works"],
    "fx_kwords": ["fx_kdocs"],
}
NEEDS = {**_NEEDS, **_DUCK_NEEDS}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def check(names: str, body: str) -> str:
    """SQL for the check: the named fixtures as common table expressions, then the body."""
    from quillmap.functions.text import STOP_WORDS

    text = {**FIXTURES, **DUCK}
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    # a view that several others read is computed once
    parts = [f"{n} AS MATERIALIZED ({text[n].replace('@stop', stop)})" for n in _ordered(names.split())]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


class Tables:
    """Fixtures of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, name: str) -> DataFrame:
        """A fixture from its SQL text."""
        for table in TABLES:
            if table in FIXTURES[name]:
                rows = self.raw(table)
                (spread_scan(rows) if table == "documents" else rows).createOrReplaceTempView(table)
        for needed in _NEEDS.get(name, []):
            self.sql(needed).createOrReplaceTempView(needed)
        return self.spark.sql(FIXTURES[name])

    works = cached_property(lambda self: self.sql("fx_works"))
    papers = cached_property(lambda self: self.sql("fx_papers"))
    tiers = cached_property(lambda self: self.sql("fx_tiers"))
    # links and authors are stored tables of the data model
    links = cached_property(lambda self: store(self._links(), "links"))
    authors = cached_property(lambda self: store(self._authors(), "authors"))
    focals = cached_property(lambda self: store(self._focals(), "focals"))
    slinks = cached_property(lambda self: store(self.sql("fx_slinks"), "links"))
    groups = cached_property(lambda self: self.sql("fx_groups"))
    authorships = cached_property(lambda self: self._authorships())
    docs = cached_property(lambda self: self.sql("fx_docs"))

    def _links(self) -> DataFrame:
        rows = self.raw("lineitem").select("l_orderkey", "l_partkey")
        deal(rows, rows.count(), "l_orderkey", "l_partkey").createOrReplaceTempView("lineitem")
        return self.spark.sql(FIXTURES["fx_links"])

    def _authors(self) -> DataFrame:
        n = self.links.count()
        deal(self.links, n, "paper_id").createOrReplaceTempView("fx_links")
        deal(self.works, n, "openalex_id").createOrReplaceTempView("fx_works")
        self.raw("part").createOrReplaceTempView("part")
        return self.spark.sql(FIXTURES["fx_authors"])

    def _authorships(self) -> DataFrame:
        # dealt by paper once: distinct authors, positions and lists of a paper need no other shuffle
        rows = self.raw("lineitem").select("l_orderkey", "l_suppkey")
        deal(rows, rows.count(), "l_orderkey").createOrReplaceTempView("lineitem")
        broadcast_if_small(self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")).createOrReplaceTempView("supplier")
        self.raw("nation").createOrReplaceTempView("nation")
        return self.spark.sql(FIXTURES["fx_authorships"])

    def _focals(self) -> DataFrame:
        self.authors.createOrReplaceTempView("fx_authors")
        return self.spark.sql(FIXTURES["fx_focals"])

    @cached_property
    def points(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("openalex_id"),
            F.col("embedding")[0].cast("double").alias("x"),
            F.col("embedding")[1].cast("double").alias("y"),
            F.col("label").alias("cluster_id"),
            F.concat(F.lit("L"), F.col("label").cast("string")).alias("territory"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("openalex_id"), "embedding")

    @cached_property
    def queries(self) -> DataFrame:
        """All words of each benchmark text; neighbours form an AND group."""
        words = self.raw("benchmark").select(
            F.col("item_id").alias("query_id"), F.posexplode(tokens(F.col("text"))).alias("pos", "token")
        )
        return words.groupBy("query_id", F.floor(F.col("pos") / 2).cast("int").alias("group_id")).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " "
            ).alias("keyword")
        )

    @cached_property
    def search_docs(self) -> DataFrame:
        """Documents under the names of the search table."""
        return self.docs.select(
            "openalex_id", "title", "abstract", F.col("publication_year").alias("year"),
            F.col("cited_by_count").alias("citation_count"), F.col("source_name").alias("journal"),
            F.col("language").alias("journal_tier"), F.col("source_name").alias("subfield"),
        )

    @cached_property
    def labelled_docs(self) -> DataFrame:
        """All documents, whole, with the label of their vector as cluster; those without one are noise."""
        return spread_scan(self.raw("documents")).select(F.col("doc_id").alias("openalex_id"), "text").join(
            self.raw("embeddings").select(F.col("vec_id").alias("openalex_id"), F.col("label").alias("cluster_id")),
            "openalex_id", "left",
        ).withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))

    @cached_property
    def track(self) -> DataFrame:
        """Papers of all authors with their field as cluster."""
        return self.links.join(self.works, F.col("paper_id") == F.col("openalex_id")).select(
            F.col("author_id").alias("focal_id"), "paper_id", F.col("field").alias("cluster_id"),
            F.col("publication_year").alias("year"), F.col("cited_by_count").alias("citations"),
        )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", oracle: str | None = None):
    """Register a function of Tables under a name, with the body of its check."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = check(needs, oracle)
        return fn

    return add


def r6(*names: str):
    """Columns rounded to six digits, for comparison."""
    return [F.round(F.col(n), 6).alias(n) for n in names]
