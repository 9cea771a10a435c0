"""Queries on look-ups of names, citations, shared papers, stored sketches and vector expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.vectors import cosine, dot
from quillmap.operators import citations as ct
from quillmap.operators import lookup
from quillmap.operators import network as nw
from quillmap.operators import quality
from quillmap.operators import similar as si
from quillmap.operators import vector_index as vi
from quillmap.registry.base import Tables, query, r6
from quillmap.session import durable, scratch_path


def name_parts(t: Tables) -> DataFrame:
    """All words of all names, and their first two and first letters."""
    words = t.authors.select(F.explode(F.split(F.lower("name"), " ")).alias("w")).where(F.col("w") != "")
    parts = words.select(F.explode(F.array("w", F.substring("w", 1, 2), F.substring("w", 1, 1))).alias("text")).distinct()
    return parts.select(F.col("text").alias("query_id"), F.concat(F.lit(" "), F.upper("text")).alias("text"))


FOUND = """
    parts AS (SELECT DISTINCT unnest([w, w[1:2], w[1:1]]) AS query_id FROM (SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS w FROM fx_authors) WHERE w <> ''),
    found AS (SELECT * FROM (
        SELECT q.query_id, a.author_id, a.name, a.institution, a.paper_count, a.total_citations,
               CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY a.total_citations DESC, a.author_id) AS INT) AS rank
        FROM parts q JOIN fx_authors a ON contains(lower(a.name), q.query_id) WHERE a.paper_count >= 2) WHERE rank <= 10)"""


@query("find_authors_batch", "fx_authors fx_links fx_papers", f"""
    SELECT * FROM (WITH {FOUND}
    SELECT f.*, b.top_paper_id, b.top_paper_title, b.top_paper_citations FROM found f LEFT JOIN (
        SELECT l.author_id, p.openalex_id AS top_paper_id, p.title AS top_paper_title, p.citation_count AS top_paper_citations
        FROM fx_links l JOIN fx_papers p ON p.openalex_id = l.paper_id
        QUALIFY row_number() OVER (PARTITION BY l.author_id ORDER BY p.citation_count DESC, p.openalex_id) = 1) b ON b.author_id = f.author_id)""")
def find_authors_batch(t: Tables) -> DataFrame:
    index = lookup.store_name_index(t.authors, scratch_path(t.spark, "names"), 16)
    return lookup.find_authors_batch(index, t.authors, name_parts(t), links=t.links, papers=t.papers, buckets=16)


@query("rarest_grams", "fx_authors", f"""
    SELECT * FROM (WITH {FOUND},
    grams AS (SELECT DISTINCT query_id, CASE WHEN length(query_id) < 3 THEN query_id ELSE query_id[k:k + 2] END AS gram
              FROM (SELECT query_id, unnest(generate_series(1, greatest(1, length(query_id) - 2))) AS k FROM parts)),
    counted AS (SELECT g.gram, count(a.author_id) AS n FROM (SELECT DISTINCT gram FROM grams) g LEFT JOIN fx_authors a ON contains(lower(a.name), g.gram) GROUP BY 1)
    SELECT query_id, gram, n FROM grams JOIN counted USING (gram)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n, gram) = 1 AND n > 0)""")
def rarest_grams(t: Tables) -> DataFrame:
    index = lookup.store_name_index(t.authors, scratch_path(t.spark, "names"), 16)
    return lookup.rarest_grams(index, name_parts(t), 16).select("query_id", "gram", "n")


# a work cites the work before it of each of its authors, and the first of them
CITES = """
    cites AS (SELECT DISTINCT src, dst FROM (
        SELECT paper_id AS src, unnest([lag(paper_id) OVER w, first_value(paper_id) OVER w]) AS dst
        FROM fx_links WINDOW w AS (PARTITION BY author_id ORDER BY paper_id)) WHERE dst IS NOT NULL AND src <> dst)"""


def cited(t: Tables) -> DataFrame:
    """Work records with the list of works they cite."""
    own = Window.partitionBy("author_id").orderBy("paper_id")
    both = F.array(F.lag("paper_id").over(own), F.first("paper_id").over(own))
    rows = t.links.select("paper_id", both.alias("r")).groupBy("paper_id").agg(F.flatten(F.collect_list("r")).alias("r"))
    return t.works.join(rows, F.col("paper_id") == F.col("openalex_id"), "left").select(
        F.col("openalex_id").cast("string").alias("id"), F.transform("r", lambda w: w.cast("string")).alias("referenced_works"))


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("openalex_id", F.col("openalex_id").cast("long"))


@query("citation_edges", "fx_links fx_works", f"""
    SELECT * FROM (WITH {CITES} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM cites)""")
def citation_edges(t: Tables) -> DataFrame:
    return ct.citation_edges(cited(t))


@query("citation_degrees", "fx_links fx_works", f"""
    SELECT * FROM (WITH {CITES} SELECT w.openalex_id, coalesce(o.n, 0) AS n_cited, coalesce(i.n, 0) AS n_citing FROM fx_works w
    LEFT JOIN (SELECT src, count(*) AS n FROM cites GROUP BY 1) o ON o.src = w.openalex_id
    LEFT JOIN (SELECT dst, count(*) AS n FROM cites GROUP BY 1) i ON i.dst = w.openalex_id)""")
def citation_degrees(t: Tables) -> DataFrame:
    raw = cited(t)
    return _numbered(ct.citation_degrees(raw.withColumnRenamed("id", "openalex_id"), ct.citation_edges(raw)))


def _rounds(n: int) -> str:
    """Ranks after n rounds as chained tables."""
    out = ["r0 AS MATERIALIZED (SELECT openalex_id AS v, 1.0::DOUBLE AS r FROM fx_works)"]
    for k in range(n):
        out.append(f"""g{k} AS MATERIALIZED (SELECT e.dst AS v, sum(r.r / o.n) AS g FROM known e JOIN r{k} r ON r.v = e.src JOIN o ON o.src = e.src GROUP BY 1),
        d{k} AS MATERIALIZED (SELECT coalesce(sum(r), 0) / (SELECT count(*) FROM fx_works) AS d FROM r{k} WHERE v NOT IN (SELECT src FROM o)),
        r{k + 1} AS MATERIALIZED (SELECT r.v, 0.15 + 0.85 * (coalesce(g.g, 0) + (SELECT d FROM d{k})) AS r FROM r{k} r LEFT JOIN g{k} g ON g.v = r.v)""")
    return ", ".join(out)


@query("citation_rank", "fx_links fx_works", f"""
    SELECT * FROM (WITH {CITES},
    known AS MATERIALIZED (SELECT src, dst FROM cites WHERE src IN (SELECT openalex_id FROM fx_works) AND dst IN (SELECT openalex_id FROM fx_works)),
    o AS MATERIALIZED (SELECT src, count(*) AS n FROM known GROUP BY 1),
    {_rounds(6)} SELECT v AS openalex_id, round(r, 6) AS rank FROM r6)""")
def citation_rank(t: Tables) -> DataFrame:
    raw = durable(cited(t))
    ranks = ct.citation_rank(raw.withColumnRenamed("id", "openalex_id"), ct.citation_edges(raw), rounds=6, tolerance=0.0)
    return _numbered(ranks.select("openalex_id", *r6("rank")))


@query("shared_papers_of", "fx_circle fx_links fx_papers", """
    SELECT c.focal_id, c.author_id, p.openalex_id, p.title, p.citation_count,
           row_number() OVER (PARTITION BY c.focal_id, c.author_id ORDER BY p.citation_count DESC, p.openalex_id) AS rank
    FROM fx_circle c JOIN fx_links a ON a.author_id = c.focal_id JOIN fx_links b ON b.author_id = c.author_id AND b.paper_id = a.paper_id
    JOIN fx_papers p ON p.openalex_id = a.paper_id""")
def shared_papers_of(t: Tables) -> DataFrame:
    circle = nw.inner_circle(nw.collaboration_scores(durable(nw.coauthor_edges(t.focals, t.links, t.papers)), t.authors))
    return nw.shared_papers_of(circle, t.links, t.papers).select("focal_id", "author_id", "openalex_id", "title", "citation_count", "rank")


@query("distinct_authors_by_sketch", "fx_links fx_works", """
    SELECT CAST(w.publication_year AS VARCHAR) AS years, count(*) AS n_links, TRUE AS within FROM fx_links l JOIN fx_works w ON w.openalex_id = l.paper_id GROUP BY 1
    UNION ALL SELECT 'all', count(*), TRUE FROM fx_links l JOIN fx_works w ON w.openalex_id = l.paper_id""")
def distinct_authors_by_sketch(t: Tables) -> DataFrame:
    """Sketches of two batches, stored and merged, held against exact counts: within two per cent."""
    dated = t.links.join(t.works.select(F.col("openalex_id").alias("paper_id"), "publication_year"), "paper_id")
    first, second = (quality.author_sketches(dated.where(F.col("paper_id") % 2 == k)) for k in (0, 1))
    stored = durable(quality.merge_sketches(first, second))
    exact = dated.groupBy(F.col("publication_year").cast("string").alias("years")).agg(F.countDistinct("author_id").alias("n")).unionByName(
        dated.agg(F.lit("all").alias("years"), F.countDistinct("author_id").alias("n")))
    per_year = quality.distinct_authors_by_sketch(stored, "publication_year").withColumn("years", F.col("publication_year").cast("string"))
    counts = per_year.select("years", "n_links", "n_authors").unionByName(
        quality.distinct_authors_by_sketch(stored).select(F.lit("all").alias("years"), "n_links", "n_authors"))
    return counts.join(exact, "years").select("years", "n_links", (F.abs(F.col("n_authors") - F.col("n")) <= 0.02 * F.col("n")).alias("within"))


@query("vector_similarity", "", """
    SELECT a.vec_id, b.vec_id AS next_id, round(list_dot_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a
    JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def vector_similarity(t: Tables) -> DataFrame:
    own = t.raw("embeddings").select("vec_id", F.col("embedding").alias("a"))
    following = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("a").alias("b"))
    both = own.join(following, "vec_id")
    return both.select("vec_id", "next_id", F.round(dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


NEAREST = """
    u AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.v, c.v) AS score,
                    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 12) DESC, c.vec_id) AS INT) AS rank
             FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 10 = 3)"""


def _asked(t: Tables) -> DataFrame:
    return t.vectors.where("openalex_id % 10 = 3").withColumnRenamed("openalex_id", "query_id")


@query("vector_search_exact", "", f"""
    SELECT * FROM (WITH {NEAREST} SELECT query_id, rank, id, round(score, 6) AS score FROM near WHERE rank <= 10)""")
def vector_search_exact(t: Tables) -> DataFrame:
    index = vi.store_vector_index(t.vectors, scratch_path(t.spark, "vectors"))
    return vi.search_vectors(index, _asked(t), 10, vi.MOST_CELLS, True).select("query_id", "rank", "id", *r6("score"))


@query("vector_search", "", """
    SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS n, TRUE AS pruned, TRUE AS good FROM embeddings WHERE vec_id % 10 = 3""")
def vector_search(t: Tables) -> DataFrame:
    """Three of four cells are read, as these vectors lie evenly; nine of ten of the exact neighbours are found."""
    index = vi.store_vector_index(t.vectors, scratch_path(t.spark, "vectors"))
    cells = index[1].count()
    found = durable(vi.search_vectors(index, _asked(t), 10, 3 * cells // 4, True))
    exact = vi.search_vectors(index, _asked(t), 10, cells, True).select("query_id", "id", F.lit(1).alias("hit"))
    counts = found.join(exact, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    recall = counts.agg((F.avg("hits") >= 9).alias("good"))
    return counts.crossJoin(F.broadcast(recall)).select("query_id", "n", F.lit(3 * cells // 4 < cells).alias("pruned"), "good")


@query("similar_papers", "", """
    SELECT vec_id AS openalex_id, CAST(10 AS BIGINT) AS n, TRUE AS exact_scores, TRUE AS good FROM embeddings""")
def similar_papers(t: Tables) -> DataFrame:
    """Ten neighbours of every vector; nine of ten are those of the exact search, which asks all cells."""
    found = durable(si.similar_items(t.vectors))
    index = vi.store_vector_index(t.vectors, scratch_path(t.spark, "vectors"))
    asked = t.vectors.withColumnRenamed("openalex_id", "query_id")
    exact = vi.search_vectors(index, asked, 10, vi.MOST_CELLS, True).select(
        F.col("query_id").alias("openalex_id"), F.col("id").alias("similar_id"), F.col("score").alias("_s"))
    joined = found.join(exact, ["openalex_id", "similar_id"], "left").groupBy("openalex_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("_s").alias("hits"),
        (F.coalesce(F.max(F.abs(F.col("score") - F.col("_s"))), F.lit(0.0)) < 1e-9).alias("exact_scores"))
    recall = joined.agg((F.avg("hits") >= 9).alias("good"))
    return joined.crossJoin(F.broadcast(recall)).select("openalex_id", "n", "exact_scores", "good")
