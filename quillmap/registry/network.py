"""Queries on co-author networks and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators import authors as au
from quillmap.operators import network as nw
from quillmap.operators import trajectory as tr
from quillmap.registry.base import Tables, query, r6
from quillmap.session import durable


def _once(t: Tables, name: str, make) -> DataFrame:
    """A table that several steps of one query read: built once and stored."""
    held = t.__dict__.setdefault("_held", {})
    if name not in held:
        held[name] = durable(make())
    return held[name]


def _edges(t: Tables) -> DataFrame:
    return _once(t, "edges", lambda: nw.coauthor_edges(t.focals, t.links, t.papers))


def _layer1(t: Tables, scored: bool = False) -> DataFrame:
    """``scored``: from the edges that the circle needs as well."""
    edges = lambda: _edges(t).drop("recency") if scored else nw.coauthor_edges(t.focals, t.links)
    return _once(t, "layer1", lambda: nw.ego_layer1(edges(), t.authors))


def _hops(t: Tables) -> DataFrame:
    return _once(t, "hops", lambda: nw.layer2_links(_layer1(t), t.links))


def _circle(t: Tables) -> DataFrame:
    return _once(t, "circle", lambda: nw.inner_circle(nw.collaboration_scores(_edges(t), t.authors)))


@query("coauthor_edges", "fx_edges", """
    SELECT focal_id, author_id, shared_papers, round(recency, 6) AS recency FROM fx_edges""")
def coauthor_edges(t: Tables) -> DataFrame:
    return _edges(t).select("focal_id", "author_id", "shared_papers", *r6("recency"))


@query("ego_layer1", "fx_edges fx_authors", """
    SELECT e.focal_id, e.author_id, e.shared_papers, a.name, a.institution, a.paper_count, a.total_citations
    FROM fx_edges e JOIN fx_authors a ON a.author_id = e.author_id""")
def ego_layer1(t: Tables) -> DataFrame:
    return _layer1(t)


@query("collaboration_scores", "fx_scores", """
    SELECT focal_id, author_id, shared_papers, round(score, 6) AS score FROM fx_scores""")
def collaboration_scores(t: Tables) -> DataFrame:
    return nw.collaboration_scores(_edges(t), t.authors).select("focal_id", "author_id", "shared_papers", *r6("score"))


@query("inner_circle", "fx_circle", """
    SELECT focal_id, author_id, shared_papers, round(score, 6) AS score, rk AS rank FROM fx_circle""")
def inner_circle(t: Tables) -> DataFrame:
    return _circle(t).select("focal_id", "author_id", "shared_papers", *r6("score"), "rank")


@query("pair_edges", "fx_pairs", "SELECT focal_id, author_a, author_b FROM fx_pairs")
def pair_edges(t: Tables) -> DataFrame:
    return nw.pair_edges(_circle(t), t.links)


@query("circle_density", "fx_circle fx_pairs", """
    SELECT focal_id, n_members, n_edges, round(density, 6) AS density,
           CASE WHEN density >= 0.7 THEN 'high' WHEN density >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM (
        SELECT c.focal_id, c.n AS n_members, coalesce(p.n, 0) AS n_edges,
               CASE WHEN c.n > 1 THEN coalesce(p.n, 0) / (c.n * (c.n - 1) / 2.0) ELSE 0.0 END AS density
        FROM (SELECT focal_id, count(*) AS n FROM fx_circle GROUP BY 1) c
        LEFT JOIN (SELECT focal_id, count(*) AS n FROM fx_pairs GROUP BY 1) p ON p.focal_id = c.focal_id)""")
def circle_density(t: Tables) -> DataFrame:
    return nw.circle_density(_circle(t), t.links).select("focal_id", "n_members", "n_edges", *r6("density"), "band")


@query("circle_topics", "fx_circle fx_links fx_works", """
    SELECT * FROM (SELECT focal_id, topic, n, CAST(row_number() OVER (PARTITION BY focal_id ORDER BY n DESC, topic) AS INT) AS rank FROM (
        SELECT c.focal_id, w.topic, count(*) AS n FROM fx_circle c JOIN fx_links l ON l.author_id = c.author_id
        JOIN fx_works w ON w.openalex_id = l.paper_id WHERE w.topic <> '' GROUP BY 1, 2)) WHERE rank <= 5""")
def circle_topics(t: Tables) -> DataFrame:
    return nw.circle_topics(_circle(t), t.links, t.papers)


@query("ego_layer2", "fx_layer2", """
    SELECT focal_id, author_id, n_links, total_citations, CAST(rk AS INT) AS rank FROM fx_layer2""")
def ego_layer2(t: Tables) -> DataFrame:
    return nw.ego_layer2(_hops(t), t.authors).select("focal_id", "author_id", "n_links", "total_citations", "rank")


@query("ego_edges", "fx_edges fx_circle fx_pairs fx_hops fx_layer2", """
    SELECT e.focal_id, 'layer1' AS kind, e.focal_id AS src, e.author_id AS dst,
           CASE WHEN c.author_id IS NOT NULL THEN greatest(least(e.shared_papers, 8), 3) ELSE least(e.shared_papers, 8) END AS weight
    FROM fx_edges e LEFT JOIN fx_circle c ON c.focal_id = e.focal_id AND c.author_id = e.author_id
    UNION ALL SELECT focal_id, 'circle', author_a, author_b, 3 FROM fx_pairs
    UNION ALL SELECT h.focal_id, 'layer2', h.author_id, h.layer1_id, 1 FROM fx_hops h
    JOIN fx_layer2 l ON l.focal_id = h.focal_id AND l.author_id = h.author_id""")
def ego_edges(t: Tables) -> DataFrame:
    return nw.ego_edges(_layer1(t, True), _circle(t), nw.ego_layer2(_hops(t), t.authors), _hops(t), t.links)


@query("edge_coordinates", "fx_edges", """
    SELECT e.focal_id, e.author_id, e.shared_papers, CAST(a.p_size AS DOUBLE) AS x0, round(a.p_retailprice, 6) AS y0,
           CAST(b.p_size AS DOUBLE) AS x1, round(b.p_retailprice, 6) AS y1
    FROM fx_edges e JOIN part a ON a.p_partkey = e.focal_id JOIN part b ON b.p_partkey = e.author_id
    WHERE b.p_size > 5 AND a.p_size > 5""")
def edge_coordinates(t: Tables) -> DataFrame:
    coords = t.raw("part").where("p_size > 5").select(
        F.col("p_partkey").alias("author_id"), F.col("p_size").cast("double").alias("x"), F.round("p_retailprice", 6).alias("y"))
    edges = nw.coauthor_edges(t.focals, t.links)
    return nw.edge_coordinates(edges, coords, "focal_id", "author_id")


TOP15 = """(SELECT * FROM (SELECT focal_id, author_id, shared_papers, row_number() OVER (
    PARTITION BY focal_id ORDER BY shared_papers DESC, author_id) AS rk FROM fx_edges) WHERE rk <= 15)"""


@query("territory_papers", "fx_edges fx_focals fx_links fx_works", f"""
    SELECT p.focal_id, l.paper_id AS openalex_id, arg_min(p.author_id, p.rk) AS owner_id
    FROM (SELECT focal_id, author_id, rk FROM {TOP15} UNION ALL SELECT author_id, author_id, 0 FROM fx_focals) p
    JOIN fx_links l ON l.author_id = p.author_id JOIN fx_works w ON w.openalex_id = l.paper_id GROUP BY 1, 2""")
def territory_papers(t: Tables) -> DataFrame:
    return nw.territory_papers(t.focals, _layer1(t), t.links, t.papers).select("focal_id", "openalex_id", "owner_id")


@query("author_profile", "fx_edges fx_focals fx_links fx_papers", f"""
    SELECT f.author_id, 'paper' AS part, CAST(p.citation_count AS BIGINT) AS rank_value, p.openalex_id AS ref_id
    FROM fx_focals f JOIN fx_links l ON l.author_id = f.author_id JOIN fx_papers p ON p.openalex_id = l.paper_id
    UNION ALL SELECT focal_id, 'coauthor', shared_papers, author_id FROM {TOP15}""")
def author_profile(t: Tables) -> DataFrame:
    return nw.author_profile(t.focals, au.author_papers(t.links, t.papers, t.focals), _layer1(t))


@query("shared_papers", "fx_groups fx_slinks", """
    SELECT group_id, paper_id, array_to_string(list(author_id ORDER BY author_id), ',') AS owners FROM (
        SELECT DISTINCT g.group_id, l.paper_id, g.author_id FROM fx_groups g JOIN fx_slinks l ON l.author_id = g.author_id)
    GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_papers(t: Tables) -> DataFrame:
    return nw.shared_papers(t.groups, t.slinks).select("group_id", "paper_id", F.array_join(F.col("owners").cast("array<string>"), ",").alias("owners"))


@query("solo_papers", "fx_groups fx_slinks", """
    SELECT group_id, author_id, paper_id FROM (
        SELECT g.group_id, l.paper_id, g.author_id, count(*) OVER (PARTITION BY g.group_id, l.paper_id) AS n
        FROM fx_groups g JOIN fx_slinks l ON l.author_id = g.author_id) WHERE n = 1""")
def solo_papers(t: Tables) -> DataFrame:
    return nw.solo_papers(t.groups, t.slinks)


@query("compare_authors_points", "fx_groups fx_slinks", """
    SELECT g.group_id, l.paper_id, arg_min(g.author_id, g.seq) AS owner_id, count(*) AS n_owners, count(*) >= 2 AS shared
    FROM fx_groups g JOIN fx_slinks l ON l.author_id = g.author_id GROUP BY 1, 2""")
def compare_authors_points(t: Tables) -> DataFrame:
    return nw.compare_points(t.groups, t.slinks)


@query("fork_origins", "fx_track", """
    SELECT s.focal_id, s.cluster_id, s.first_year, (
        SELECT arg_max(p.paper_id, {'y': p.year, 'c': -p.citations, 'i': p.paper_id}) FROM fx_track p
        WHERE p.focal_id = s.focal_id AND p.year < s.first_year) AS origin_id
    FROM (SELECT focal_id, cluster_id, min(year) AS first_year FROM fx_track GROUP BY 1, 2) s""")
def fork_origins(t: Tables) -> DataFrame:
    return tr.fork_origins(t.track)


@query("trajectory_edges", "fx_track", """
    SELECT * FROM (WITH ranked AS (
        SELECT *, row_number() OVER (PARTITION BY focal_id, cluster_id, year ORDER BY citations DESC, paper_id) AS rk FROM fx_track),
    spine AS (SELECT focal_id, cluster_id, year, paper_id FROM ranked WHERE rk = 1),
    starts AS (SELECT focal_id, cluster_id, min(year) AS year FROM fx_track GROUP BY 1, 2)
    SELECT focal_id, cluster_id, 'spine' AS edge_kind, prev AS from_id, paper_id AS to_id FROM (
        SELECT *, lag(paper_id) OVER (PARTITION BY focal_id, cluster_id ORDER BY year) AS prev FROM spine) WHERE prev IS NOT NULL
    UNION ALL SELECT r.focal_id, r.cluster_id, 'spoke', s.paper_id, r.paper_id FROM ranked r
    JOIN spine s ON s.focal_id = r.focal_id AND s.cluster_id = r.cluster_id AND s.year = r.year WHERE r.rk > 1
    UNION ALL SELECT focal_id, cluster_id, 'fork', origin, paper_id FROM (
        SELECT b.focal_id, b.cluster_id, n.paper_id, (
            SELECT arg_max(p.paper_id, {'y': p.year, 'c': -p.citations, 'i': p.paper_id}) FROM fx_track p
            WHERE p.focal_id = b.focal_id AND p.year < b.year) AS origin
        FROM starts b JOIN spine n ON n.focal_id = b.focal_id AND n.cluster_id = b.cluster_id AND n.year = b.year)
    WHERE origin IS NOT NULL)""")
def trajectory_edges(t: Tables) -> DataFrame:
    return tr.trajectory_edges(t.track)


@query("cumulative_by_year", "fx_works", """
    SELECT field, publication_year, n, sum(n) OVER (PARTITION BY field ORDER BY publication_year)::BIGINT AS n_until FROM (
        SELECT field, publication_year, count(*) AS n FROM fx_works GROUP BY 1, 2)""")
def cumulative_by_year(t: Tables) -> DataFrame:
    return tr.cumulative_by_year(t.works, "publication_year", ["field"])


@query("landscape_until", "fx_works", """
    SELECT openalex_id, publication_year, publication_year = 1998 AS in_slice FROM fx_works WHERE publication_year <= 1998""")
def landscape_until(t: Tables) -> DataFrame:
    until = tr.landscape_until(t.works, 1998, year="publication_year").select("openalex_id", "publication_year")
    year = tr.landscape_until(t.works, 1998, "slice", "publication_year").select("openalex_id", F.lit(True).alias("_in"))
    return until.join(year, "openalex_id", "left").select("openalex_id", "publication_year", F.coalesce("_in", F.lit(False)).alias("in_slice"))


@query("cluster_evolution", "fx_points", """
    SELECT cluster_id, year, n_until, round(sx / n_until, 6) AS x, round(sy / n_until, 6) AS y, round(sqrt(n_until) * 12, 6) AS bubble FROM (
        SELECT cluster_id, year, sum(n) OVER w::BIGINT AS n_until, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy FROM (
            SELECT cluster_id, CAST(1990 + openalex_id % 35 AS INT) AS year, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM fx_points GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY cluster_id ORDER BY year))""")
def cluster_evolution(t: Tables) -> DataFrame:
    dated = t.points.withColumn("year", (F.lit(1990) + F.col("openalex_id") % 35).cast("int"))
    return tr.cluster_evolution(dated).select("cluster_id", "year", "n_until", *r6("x", "y", "bubble"))
