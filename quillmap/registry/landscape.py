"""Queries on samples, clusters, labels, vectors and territories."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import STOP_WORDS
from quillmap.functions.vectors import l2_norm
from quillmap.operators import clustering as cl
from quillmap.operators import density as de
from quillmap.operators import embedding as em
from quillmap.operators import keyed
from quillmap.operators import labels as lb
from quillmap.operators import terms as tm
from quillmap.operators import territory as te
from quillmap.operators.quality import alignment_check
from quillmap.operators.sampling import sqrt_quotas, stratified_sample
from quillmap.operators.works import filter_high_impact
from quillmap.plans import maps
from quillmap.registry import network  # noqa: F401  its checks are parts of those of the jobs
from quillmap.registry.base import ORACLES, Tables, query, r6
from quillmap.session import broadcast_if_small, durable

QUOTA = """
    SELECT {s} AS stratum, n, greatest({floor}, CAST(floor(sqrt(n) / sum(sqrt(n)) OVER () * {target}) AS BIGINT)) AS quota
    FROM (SELECT {s}, count(*) AS n FROM {table} GROUP BY 1)"""
DOC_QUOTA = QUOTA.format(s="language", floor=20, target=200, table="fx_docs")


@query("sqrt_quotas", "fx_docs", f"SELECT stratum AS language, n, quota FROM ({DOC_QUOTA})")
def quotas(t: Tables) -> DataFrame:
    return sqrt_quotas(t.docs, "language", 200, 20)


@query("stratified_sample", "fx_docs", f"""
    SELECT openalex_id, language FROM (
        SELECT d.openalex_id, d.language, q.quota,
               row_number() OVER (PARTITION BY d.language ORDER BY md5('42|' || CAST(d.openalex_id AS VARCHAR)), d.openalex_id) AS rk
        FROM fx_docs d JOIN ({DOC_QUOTA}) q ON q.stratum = d.language) WHERE rk <= quota""")
def sample(t: Tables) -> DataFrame:
    return stratified_sample(t.docs, "language", sqrt_quotas(t.docs, "language", 200, 20)).select("openalex_id", "language")


DIGEST = """
    SELECT {c} AS {name}, min({label}) AS label, count(*) AS n, min(year) AS year_min, max(year) AS year_max,
           sum(citation_count)::BIGINT AS citations,
           string_agg(CASE WHEN rk <= 3 THEN substring(title, 1, 60) END, '|' ORDER BY rk) AS top_titles,
           string_agg(CASE WHEN rk <= 3 THEN CAST(year AS VARCHAR) END, '|' ORDER BY rk) AS top_years,
           string_agg(CASE WHEN rk <= 3 THEN CAST(citation_count AS VARCHAR) END, '|' ORDER BY rk) AS top_citations
    FROM (SELECT *, row_number() OVER (PARTITION BY {c} ORDER BY citation_count DESC, openalex_id) AS rk FROM {table})
    WHERE {c} <> {noise} GROUP BY 1"""
HIGH = "(SELECT * FROM fx_papers WHERE type = 'article' AND citation_count >= 400 AND field <> '' AND title <> '')"
SAMPLED = f"""(SELECT * FROM (
        SELECT d.*, q.quota, row_number() OVER (PARTITION BY d.field ORDER BY md5('42|' || CAST(d.openalex_id AS VARCHAR)), d.openalex_id) AS pos
        FROM {HIGH} d JOIN ({QUOTA.format(s='field', floor=10, target=300, table=HIGH)}) q ON q.stratum = d.field) WHERE pos <= quota)"""


def _flat(digest: DataFrame) -> DataFrame:
    """The list of papers as three strings, which SQL engines compare alike."""
    one = lambda f: F.array_join(F.transform("top_papers", lambda x: x[f].cast("string")), "|")
    names = {"top_titles": one("title"), "top_years": one("year"), "top_citations": one("citation_count")}
    return digest.withColumns(names).drop("top_papers")


@query("sample_digest", "fx_papers", DIGEST.format(c="field", name="field", label="field", table=SAMPLED, noise="''"))
def sample_digest(t: Tables) -> DataFrame:
    renamed = {"cited_by_count": "citation_count", "publication_year": "year"}
    high = filter_high_impact(t.works, 400).withColumnsRenamed(renamed)
    picked = durable(stratified_sample(high, "field", sqrt_quotas(high, "field", 300, 10)))
    return _flat(lb.cluster_digest(picked, "field", "field", noise=""))


@query("cluster_digest", "fx_papers", DIGEST.format(c="topic", name="topic", label="subfield", table="fx_papers", noise="''"))
def cluster_digest(t: Tables) -> DataFrame:
    return _flat(lb.cluster_digest(t.papers, "topic", "subfield", noise=""))


@query("cluster_dossier", "fx_docs", """
    SELECT language, publication_year AS year, openalex_id, title, source_name AS journal, cited_by_count AS citation_count,
           CASE WHEN length(abstract) > 300 THEN substring(abstract, 1, 300) || '...' ELSE abstract END AS abstract,
           count(*) OVER w AS n, min(publication_year) OVER w AS year_min, max(publication_year) OVER w AS year_max,
           sum(cited_by_count) OVER w::BIGINT AS citations
    FROM fx_docs WINDOW w AS (PARTITION BY language)""")
def cluster_dossier(t: Tables) -> DataFrame:
    papers = t.docs.withColumnsRenamed(
        {"publication_year": "year", "source_name": "journal", "cited_by_count": "citation_count"})
    return lb.cluster_dossier(papers, "language")


@query("cluster_summary", "fx_points", """
    SELECT cluster_id - 1 AS cluster_id, count(*) AS n, (SELECT count(*) FROM fx_points) AS total,
           (SELECT count(DISTINCT cluster_id) FROM fx_points WHERE cluster_id <> 0) AS n_clusters,
           (SELECT count(*) FROM fx_points WHERE cluster_id = 0) AS n_outliers,
           round((SELECT count(*) FROM fx_points WHERE cluster_id = 0) * 100.0 / (SELECT count(*) FROM fx_points), 6) AS outlier_pct,
           (SELECT count(*) FROM fx_points WHERE cluster_id = 0) > 0.4 * (SELECT count(*) FROM fx_points) AS warn
    FROM fx_points GROUP BY 1""")
def cluster_summary(t: Tables) -> DataFrame:
    shifted = t.points.withColumn("cluster_id", F.col("cluster_id") - 1)
    return lb.cluster_summary(shifted).withColumn("outlier_pct", F.round("outlier_pct", 6))


MAJORITY = """
    SELECT {g}, CASE WHEN a.n > 0.5 * a.total OR b.v IS NULL THEN a.v ELSE a.v || ' / ' || b.v END AS label,
           round(CAST(a.n AS DOUBLE) / a.total, 6) AS top_share
    FROM (SELECT * FROM ranked WHERE rk = 1) a LEFT JOIN (SELECT * FROM ranked WHERE rk = 2) b USING ({g})"""
RANKED = """ranked AS (SELECT {g}, v, n, total, row_number() OVER (PARTITION BY {g} ORDER BY n DESC, v) AS rk FROM (
    SELECT {g}, {v} AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY {g}) AS total FROM fx_works GROUP BY 1, 2))"""


def _majority(g: str, v: str) -> str:
    return f"SELECT * FROM (WITH {RANKED.format(g=g, v=v)} {MAJORITY.format(g=g)})"


@query("majority_label", "fx_works", _majority("topic", "type"))
def majority_label(t: Tables) -> DataFrame:
    return lb.majority_label(t.works, "topic", "type").select("topic", "label", *r6("top_share"))


@query("majority_label_pairs", "fx_works", _majority("field", "topic"))
def majority_label_pairs(t: Tables) -> DataFrame:
    return lb.majority_label(t.works, "field", "topic").select("field", "label", *r6("top_share"))


@query("label_clusters", "fx_works", """
    SELECT * FROM (WITH RECURSIVE rows AS (SELECT publication_year - 1996 AS cluster_id, topic FROM fx_works),
    turns AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS turn FROM rows WHERE cluster_id <> -1 GROUP BY 1),
    cand AS (SELECT t.turn, c.topic, row_number() OVER (PARTITION BY t.turn ORDER BY c.n DESC, c.topic) AS rk FROM (
        SELECT cluster_id, topic, count(*) AS n FROM rows GROUP BY 1, 2) c JOIN turns t ON t.cluster_id = c.cluster_id),
    pick(turn, used, label) AS (
        SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), ''
        UNION ALL
        SELECT p.turn + 1, list_append(p.used, arg_min(c.topic, c.rk)), arg_min(c.topic, c.rk)
        FROM pick p JOIN cand c ON c.turn = p.turn + 1 AND NOT list_contains(p.used, c.topic) GROUP BY p.turn, p.used)
    SELECT t.cluster_id, p.label, true AS labelled FROM turns t JOIN pick p ON p.turn = t.turn
    UNION ALL SELECT DISTINCT -1, 'Outlier', false FROM rows WHERE cluster_id = -1)""")
def label_clusters(t: Tables) -> DataFrame:
    return lb.label_clusters(t.works.withColumn("cluster_id", F.col("publication_year") - 1996))


@query("label_author_clusters", "fx_authors", """
    SELECT paper_count AS cluster_id, arg_min(name || CASE WHEN institution <> '' THEN ' (' || substring(institution, 1, 30) || ')' ELSE '' END,
           {'c': -total_citations, 'a': author_id}) AS label FROM fx_authors GROUP BY 1""")
def label_author_clusters(t: Tables) -> DataFrame:
    return lb.label_author_clusters(t.authors.withColumn("cluster_id", F.col("paper_count")))


# --- vectors ------------------------------------------------------------------------------------


@query("author_vectors", "fx_docs", """
    SELECT a.author_id, a.n_papers, CAST(v.pos AS INT) AS pos, round(v.m / sqrt(sum(v.m * v.m) OVER (PARTITION BY a.author_id)), 5) AS value
    FROM (SELECT vec_id % 50 AS author_id, count(*) AS n_papers FROM embeddings GROUP BY 1 HAVING count(*) >= 3) a
    JOIN (SELECT author_id, pos, sum(w * v) / sum(w) AS m FROM (
        SELECT e.vec_id % 50 AS author_id, greatest(ln(1 + d.cited_by_count), 0.1) AS w,
               unnest(CAST(e.embedding AS DOUBLE[])) AS v, generate_subscripts(e.embedding, 1) - 1 AS pos
        FROM embeddings e JOIN fx_docs d ON d.openalex_id = e.vec_id) GROUP BY 1, 2) v ON v.author_id = a.author_id""")
def author_vectors(t: Tables) -> DataFrame:
    links = t.vectors.select((F.col("openalex_id") % 50).alias("author_id"), F.col("openalex_id").alias("paper_id"))
    papers = t.docs.select("openalex_id", F.col("cited_by_count").alias("citation_count"))
    own = em.author_vectors(links, t.vectors, papers)
    return own.select("author_id", "n_papers", F.posexplode("embedding").alias("pos", "value")).select(
        "author_id", "n_papers", "pos", F.round("value", 5).alias("value"))


def label_means(t: Tables) -> DataFrame:
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return t.raw("embeddings").groupBy(F.col("label").alias("cluster_id")).agg(mean.alias("m")).select(
        "cluster_id", vector_to_array("m").alias("embedding"))


@query("assign_nearest", "", """
    SELECT vec_id AS openalex_id, arg_min(cluster_id, {'d': d, 'c': cluster_id}) AS cluster_id, round(sqrt(min(d)), 5) AS distance FROM (
        SELECT e.vec_id, c.cluster_id, sum((e.v - c.v) * (e.v - c.v)) AS d
        FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) e
        JOIN (SELECT label AS cluster_id, pos, avg(v) AS v FROM (
            SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) c
        ON c.pos = e.pos GROUP BY 1, 2) GROUP BY 1""")
def assign_nearest(t: Tables) -> DataFrame:
    near = em.assign_nearest(t.vectors, label_means(t), "openalex_id")
    return near.select("openalex_id", "cluster_id", F.round("distance", 5).alias("distance"))


@query("alignment_check", "", """
    SELECT 'paper_without_vector' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'vector_without_paper', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def alignment(t: Tables) -> DataFrame:
    return alignment_check(t.raw("documents"), t.raw("embeddings"), "doc_id", "vec_id")


# --- terms --------------------------------------------------------------------------------------


@query("tfidf_terms", "fx_kwords", """
    SELECT * FROM (WITH tok AS (SELECT openalex_id, cluster_id, token, count(*) AS tf FROM (
        SELECT openalex_id, cluster_id, unnest(words) AS token FROM fx_kwords) GROUP BY 1, 2, 3),
    vocab AS (SELECT token, ln((1.0 + (SELECT count(*) FROM fx_kdocs)) / (1.0 + count(*))) + 1 AS idf FROM tok
              GROUP BY 1 ORDER BY sum(tf) DESC, token LIMIT 10000),
    unit AS (SELECT cluster_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY openalex_id)) AS u FROM (
        SELECT t.openalex_id, t.cluster_id, t.token, t.tf * v.idf AS w FROM tok t JOIN vocab v ON v.token = t.token)),
    means AS (SELECT u.cluster_id, u.token, sum(u.u) / any_value(s.n) AS weight FROM unit u
              JOIN (SELECT cluster_id, count(*) AS n FROM fx_kdocs GROUP BY 1) s ON s.cluster_id = u.cluster_id GROUP BY 1, 2)
    SELECT cluster_id, token, round(weight, 6) AS weight, CAST(rk AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, token) AS rk FROM means) WHERE rk <= 10)""")
def tfidf_terms(t: Tables) -> DataFrame:
    return tm.tfidf_terms(t.labelled_docs).select("cluster_id", "token", *r6("weight"), "rank")


CT = """
    counts AS (SELECT cluster_id, token, count(*) AS n FROM ({terms}) GROUP BY 1, 2),
    totals AS (SELECT cluster_id, sum(n) AS total FROM counts GROUP BY 1),
    weights AS (SELECT c.cluster_id, c.token, CAST(c.n AS DOUBLE) / t.total * ln(1 + (SELECT avg(total) FROM totals) / f.f) AS weight
        FROM counts c JOIN totals t ON t.cluster_id = c.cluster_id
        JOIN (SELECT token, sum(n) AS f FROM counts GROUP BY 1) f ON f.token = c.token)"""


@query("ctfidf_terms", "fx_kwords", "SELECT * FROM (WITH " + CT.format(terms="""
        SELECT cluster_id, unnest(words) AS token FROM fx_kwords UNION ALL
        SELECT cluster_id, z[1] || ' ' || z[2] FROM (
            SELECT cluster_id, unnest(list_zip(words[1:len(words) - 1], words[2:len(words)])) AS z FROM fx_kwords WHERE len(words) > 1)""") + """
    SELECT cluster_id, token, round(weight, 8) AS weight, CAST(rk AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 12) DESC, token) AS rk FROM weights) WHERE rk <= 10)""")
def ctfidf_terms(t: Tables) -> DataFrame:
    return tm.ctfidf_terms(t.labelled_docs).select("cluster_id", "token", F.round("weight", 8).alias("weight"), "rank")


@query("reduce_outliers", "fx_kwords", "SELECT * FROM (WITH " + CT.format(
    terms="SELECT cluster_id, unnest(words) AS token FROM fx_kwords WHERE cluster_id > 0") + """,
    unit AS (SELECT cluster_id, token, weight / sqrt(sum(weight * weight) OVER (PARTITION BY cluster_id)) AS w FROM weights),
    best AS (SELECT openalex_id, arg_max(cluster_id, {'s': round(s, 9), 'c': -cluster_id}) AS cluster_id FROM (
        SELECT k.openalex_id, u.cluster_id, sum(u.w) AS s FROM (
            SELECT openalex_id, unnest(words) AS token FROM fx_kwords WHERE cluster_id <= 0) k
        JOIN unit u ON u.token = k.token GROUP BY 1, 2) GROUP BY 1)
    SELECT d.openalex_id, coalesce(b.cluster_id, CASE WHEN d.cluster_id = 0 THEN -1 ELSE d.cluster_id END) AS cluster_id
    FROM fx_kdocs d LEFT JOIN best b ON b.openalex_id = d.openalex_id)""")
def reduce_outliers(t: Tables) -> DataFrame:
    docs = t.labelled_docs.withColumn("cluster_id", F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id")))
    return tm.reduce_outliers(docs)


# --- positions and territories --------------------------------------------------------------------


@query("group_medians", "fx_points", """
    SELECT territory, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y
    FROM fx_points GROUP BY 1 HAVING count(*) >= 5""")
def group_medians(t: Tables) -> DataFrame:
    return te.group_medians(t.points, "territory").select("territory", "n", *r6("x", "y"))


@query("cluster_centroids", "fx_points", """
    SELECT cluster_id, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM fx_points GROUP BY 1 HAVING count(*) >= 3""")
def cluster_centroids(t: Tables) -> DataFrame:
    return te.cluster_centroids(t.points).select("cluster_id", "n", *r6("x", "y"))


@query("cluster_ellipses", "fx_points", """
    SELECT cluster_id, n, round(2 * sqrt(greatest((vx + vy + d) / 2, 1e-6)), 6) AS half_major,
           round(2 * sqrt(greatest((vx + vy - d) / 2, 1e-6)), 6) AS half_minor, round(atan2(2 * c, vx - vy) / 2, 6) AS angle
    FROM (SELECT *, sqrt((vx - vy) * (vx - vy) + 4 * c * c) AS d FROM (
        SELECT cluster_id, count(*) AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c
        FROM fx_points GROUP BY 1 HAVING count(*) >= 3))""")
def cluster_ellipses(t: Tables) -> DataFrame:
    return te.cluster_ellipses(t.points).select("cluster_id", "n", *r6("half_major", "half_minor", "angle"))


@query("assign_territories", "fx_works", """
    SELECT w.openalex_id, coalesce(f.field, 'Other') AS territory, coalesce(s.subfield, 'Other') AS detail FROM fx_works w
    LEFT JOIN (SELECT field FROM fx_works GROUP BY 1 ORDER BY count(*) DESC, field LIMIT 4) f ON f.field = w.field
    LEFT JOIN (SELECT subfield FROM fx_works GROUP BY 1 ORDER BY count(*) DESC, subfield LIMIT 7) s ON s.subfield = w.subfield""")
def assign_territories(t: Tables) -> DataFrame:
    detail = te.assign_territories(t.works, "subfield").withColumnRenamed("territory", "detail")
    return te.assign_territories(detail).select("openalex_id", "territory", "detail")


@query("territory_labels", "fx_points", """
    SELECT territory, n, x, y, row_number() OVER (ORDER BY territory = 'Other', n DESC, territory) AS position FROM (
        SELECT territory, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y
        FROM fx_points GROUP BY 1 HAVING count(*) >= 5)""")
def territory_labels(t: Tables) -> DataFrame:
    return te.territory_labels(t.points).select("territory", "n", *r6("x", "y"), "position")


def _kde(support: str) -> str:
    """Densities on a 20 x 20 grid from support points (territory, px, py, w)."""
    return f"""
    ext AS (SELECT min(x) - p AS x0, max(x) + p AS x1, min(y) - p AS y0, max(y) + p AS y1
            FROM fx_points, (SELECT (max(x) - min(x)) * 0.08 AS p FROM fx_points) GROUP BY p),
    step AS (SELECT x0, y0, (x1 - x0) / 19 AS dx, (y1 - y0) / 19 AS dy FROM ext),
    mom AS (SELECT territory, count(*) AS n, var_samp(x) * 0.04 AS vx, var_samp(y) * 0.04 AS vy, covar_samp(x, y) * 0.04 AS c
            FROM fx_points GROUP BY 1 HAVING count(*) >= 10),
    support AS ({support}),
    grid AS (SELECT territory, gx, gy, x, y, sum(w * exp(-((x - px) * (x - px) * vy - 2 * (x - px) * (y - py) * c + (y - py) * (y - py) * vx)
                    / (2 * (vx * vy - c * c)))) / any_value(n * 2 * pi() * sqrt(vx * vy - c * c)) AS density
             FROM (SELECT s.territory, s.px, s.py, s.w, m.n, m.vx, m.vy, m.c, CAST(g.i % 20 AS INT) AS gx, CAST(g.i // 20 AS INT) AS gy,
                          t.x0 + (g.i % 20) * t.dx AS x, t.y0 + (g.i // 20) * t.dy AS y
                   FROM support s JOIN mom m ON m.territory = s.territory, range(400) g(i), step t) GROUP BY 1, 2, 3, 4, 5)"""


EXACT = _kde("SELECT territory, x AS px, y AS py, 1 AS w FROM fx_points")
BINNED = _kde("""SELECT p.territory, t.x0 + i * t.dx AS px, t.y0 + j * t.dy AS py, count(*) AS w FROM (
    SELECT territory, round((x - x0) / dx) AS i, round((y - y0) / dy) AS j FROM fx_points, step) p, step t GROUP BY 1, 2, 3""")


@query("kde_grid", "fx_points", f"""
    SELECT * FROM (WITH {EXACT} SELECT territory, gx, gy, round(x, 6) AS x, round(y, 6) AS y, round(density, 6) AS density FROM grid)""")
def kde_grid(t: Tables) -> DataFrame:
    return te.kde_grid(t.points, bins=20).select("territory", "gx", "gy", *r6("x", "y", "density"))


@query("kde_grid_binned", "fx_points", f"""
    SELECT * FROM (WITH {BINNED} SELECT territory, gx, gy, round(density, 6) AS density FROM grid)""")
def kde_grid_binned(t: Tables) -> DataFrame:
    return te.kde_grid(t.points, bins=20, binned=True).select("territory", "gx", "gy", *r6("density"))


@query("kde_grid_200", "fx_points", f"""
    SELECT * FROM (WITH {BINNED.replace("/ 19", "/ 199").replace("range(400)", "range(40000)").replace("g.i % 20", "g.i % 200").replace("g.i // 20", "g.i // 200")}
    SELECT territory, gx, gy, round(density, 6) AS density FROM grid)""")
def kde_grid_200(t: Tables) -> DataFrame:
    return te.kde_grid(t.points, binned=True).select("territory", "gx", "gy", *r6("density"))


@query("territory_cells", "fx_points", f"""
    SELECT * FROM (WITH {EXACT},
    win AS (SELECT gx, gy, arg_max(territory, {{'d': density, 't': territory}}) AS territory, max(density) AS density FROM grid GROUP BY 1, 2)
    SELECT w.gx, w.gy, w.territory, round(w.density, 6) AS density, round(w.density / k.peak, 6) AS share FROM win w
    JOIN (SELECT territory, max(density) AS peak FROM grid GROUP BY 1) k ON k.territory = w.territory
    WHERE w.density > 0 AND w.density >= (SELECT quantile_cont(density, 0.08) FROM win WHERE density > 0))""")
def territory_cells(t: Tables) -> DataFrame:
    grid = durable(te.kde_grid(t.points, bins=20))
    return te.territory_cells(grid).select("gx", "gy", "territory", *r6("density", "share"))


@query("dominance_peaks", "fx_points", f"""
    SELECT * FROM (WITH {EXACT},
    lead AS (SELECT g.territory, g.gx, g.gy, g.x, g.y, g.density - greatest(0, coalesce(max(o.density), 0)) AS dominance
             FROM grid g LEFT JOIN grid o ON o.gx = g.gx AND o.gy = g.gy AND o.territory <> g.territory GROUP BY 1, 2, 3, 4, 5, g.density)
    SELECT territory, round(arg_max(x, k), 6) AS x, round(arg_max(y, k), 6) AS y, round(arg_max(dominance, k), 6) AS dominance FROM (
        SELECT *, {{'d': round(dominance, 12), 'r': -gy, 'c': -gx}} AS k FROM lead) GROUP BY 1)""")
def dominance_peaks(t: Tables) -> DataFrame:
    grid = durable(te.kde_grid(t.points, bins=20))
    return te.dominance_peaks(grid, t.points).select("territory", *r6("x", "y", "dominance"))


@query("density_cluster", "fx_points", """
    SELECT * FROM (WITH RECURSIVE placed AS (
        SELECT openalex_id, CAST(floor(x / 0.02) AS BIGINT) AS i, CAST(floor(y / 0.02) AS BIGINT) AS j FROM fx_points),
    cells AS (SELECT i, j, count(*) AS n, i || '/' || j AS cell FROM placed GROUP BY 1, 2),
    dense AS (SELECT c.i, c.j, c.n, c.cell FROM cells c JOIN cells o ON abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1
              GROUP BY 1, 2, 3, 4 HAVING sum(o.n) >= 5),
    reach(a, b) AS (SELECT cell, cell FROM dense UNION
        SELECT r.a, o.cell FROM reach r JOIN dense d ON d.cell = r.b JOIN dense o ON abs(o.i - d.i) <= 1 AND abs(o.j - d.j) <= 1),
    comp AS (SELECT a AS cell, min(b) AS component FROM reach GROUP BY 1),
    lab AS (SELECT c.cell, c.n, arg_max(m.component, {'o': CAST(d.cell = c.cell AS INT), 's': d.n, 'c': d.cell}) AS component
            FROM cells c JOIN dense d ON abs(d.i - c.i) <= 1 AND abs(d.j - c.j) <= 1 JOIN comp m ON m.cell = d.cell GROUP BY 1, 2),
    num AS (SELECT component, row_number() OVER (ORDER BY sum(n) DESC, component) - 1 AS cluster_id FROM lab GROUP BY 1 HAVING sum(n) >= 10)
    SELECT p.openalex_id, CAST(coalesce(u.cluster_id, -1) AS INT) AS cluster_id FROM placed p
    LEFT JOIN lab l ON l.cell = p.i || '/' || p.j LEFT JOIN num u ON u.component = l.component)""")
def density_cluster(t: Tables) -> DataFrame:
    return cl.density_cluster(t.points, 0.02)


# five dimensions, two of three hundredths of the variance of a unit vector each
@query("density_cluster_nd", "", """
    SELECT * FROM (WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding[1:5] AS DOUBLE[]) AS v FROM embeddings),
    pair AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON list_distance(a.v, b.v) <= 0.10),
    core AS MATERIALIZED (SELECT a AS id FROM pair GROUP BY 1 HAVING count(*) >= 5),
    link AS MATERIALIZED (SELECT a, b FROM pair WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1),
    num AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS cluster_id FROM comp GROUP BY 1 HAVING count(*) >= 10)
    SELECT p.id AS openalex_id, CAST(coalesce(n.cluster_id, -1) AS INT) AS cluster_id FROM p LEFT JOIN comp c ON c.id = p.id LEFT JOIN num n ON n.component = c.component)""")
def density_cluster_nd(t: Tables) -> DataFrame:
    return de.density_cluster_nd(t.vectors.withColumn("embedding", F.slice("embedding", 1, 5)), 0.10)


# --- models and jobs -------------------------------------------------------------------------------
# SQL cannot follow a fitted model, but it can say which rows a job must return, and each row carries tests of
# what the model must hold: places that are numbers, axes that are principal, clusters that are nearest, names that differ.


def _placed() -> F.Column:
    return ~(F.isnan("x") | F.isnan("y")) & F.col("x").isNotNull() & F.col("y").isNotNull()


def _named(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """The map with ``named``: every cluster has one label that is not blank, and no two have the same one."""
    labels = mapped.groupBy(*keys, "cluster_id").agg(F.min("cluster_label").alias("a"), F.max("cluster_label").alias("b"))
    one = (F.col("a") == F.col("b")) & (F.trim("a") != "")
    sound = labels.groupBy(*keys).agg((F.min(one) & (F.countDistinct("a") == F.count(F.lit(1)))).alias("named"))
    return mapped.join(F.broadcast(sound), keys) if keys else mapped.crossJoin(F.broadcast(sound))


def _near_share(rows: DataFrame, id: str, found: DataFrame) -> DataFrame:
    """(id, cluster_id, near): whether 95 of 100 rows lie in the cluster whose mean is nearest; rows has ``embedding``."""
    # the size estimate of vectors is far too small for a broadcast by it
    held = durable(rows.select(id, F.col("embedding").cast("array<double>").alias("v")).hint("merge").join(found.select(id, "cluster_id"), id))
    means = held.groupBy("cluster_id").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"))
    far = lambda m: F.aggregate(F.zip_with("v", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    # at most 200 means
    table = means.agg(F.collect_list(F.struct("cluster_id", "m")).alias("all"))
    tested = held.crossJoin(F.broadcast(table)).select(
        id, "cluster_id",
        F.array_min(F.transform("all", lambda c: far(c["m"]))).alias("least"),
        far(F.filter("all", lambda c: c["cluster_id"] == F.col("cluster_id"))[0]["m"]).alias("own"))
    share = tested.agg((F.avg((F.col("own") <= F.col("least") + 1e-9).cast("int")) >= 0.95).alias("near"))
    return tested.select(id, "cluster_id").crossJoin(F.broadcast(share))


@query("project_2d", "", "SELECT vec_id AS openalex_id, TRUE AS placed, TRUE AS principal FROM embeddings")
def project_2d(t: Tables) -> DataFrame:
    """Means and covariance are zero, the first axis has the greater variance, and no single component has more."""
    points = durable(em.project_2d(t.vectors))
    v = t.vectors.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "e"))
    most = v.groupBy("k").agg(F.var_pop("e").alias("v")).agg(F.max("v").alias("most"))
    near0 = lambda c: F.abs(c) < 1e-6
    held = points.agg((near0(F.avg("x")) & near0(F.avg("y")) & near0(F.covar_pop("x", "y")) & (F.var_pop("x") >= F.var_pop("y"))).alias("centred"), F.var_pop("x").alias("vx"))
    sound = held.crossJoin(most).select((F.col("centred") & (F.col("vx") >= F.col("most") - 1e-9)).alias("principal"))
    return points.crossJoin(F.broadcast(sound)).select("openalex_id", _placed().alias("placed"), "principal")


@query("cluster_papers", "", """
    SELECT vec_id AS openalex_id, TRUE AS placed, TRUE AS in_range, TRUE AS near FROM embeddings""")
def cluster_papers(t: Tables) -> DataFrame:
    found = durable(cl.cluster_papers(t.vectors))
    k = cl.paper_cluster_count(found.count())
    near = _near_share(t.vectors, "openalex_id", found).drop("cluster_id")
    return found.join(near, "openalex_id").select("openalex_id", _placed().alias("placed"), F.col("cluster_id").between(0, k - 1).alias("in_range"), "near")


@query("cluster_authors", "fx_authors", """
    SELECT author_id, TRUE AS placed, TRUE AS in_range, TRUE AS near FROM fx_authors""")
def cluster_authors(t: Tables) -> DataFrame:
    vectors = durable(em.embed_texts(t.authors.withColumn("text", F.concat_ws(" ", "name", "institution")), "author_id", "text"))
    found = durable(cl.cluster_authors(vectors))
    k = cl.author_cluster_count(found.count())
    near = _near_share(vectors, "author_id", found).drop("cluster_id")
    return found.join(near, "author_id").select("author_id", _placed().alias("placed"), F.col("cluster_id").between(0, k - 1).alias("in_range"), "near")


LEVELS = """
    levels AS (SELECT n, greatest(3, least(8, CAST(floor(pow(n, 0.33)) AS INT))) AS coarse,
                      greatest(8, least(30, CAST(floor(sqrt(n) / 2) AS INT))) AS fine FROM (SELECT count(*) AS n FROM embeddings))"""


def _levels(t: Tables) -> DataFrame:
    """Two nested levels of all points as one map."""
    return durable(keyed.hierarchy_by(t.points.withColumn("map", F.lit(0)), "map").drop("map"))


@query("cluster_hierarchy", "", f"""
    SELECT * FROM (WITH {LEVELS} SELECT vec_id AS openalex_id, CAST(coarse AS BIGINT) AS n_coarse, CAST(greatest(fine, coarse + 2) AS BIGINT) AS n_fine,
                          TRUE AS nested, TRUE AS told FROM embeddings, levels)""")
def cluster_hierarchy(t: Tables) -> DataFrame:
    """All numbers of clusters are exact, every fine cluster has one parent, and single ones are told."""
    rows = _levels(t)
    parents = rows.groupBy("fine_id").agg(F.countDistinct("coarse_id").alias("p"))
    only = rows.groupBy("coarse_id").agg(((F.countDistinct("fine_id") == 1) == F.max("only_child")).alias("told"))
    counts = rows.agg(F.countDistinct("coarse_id").alias("n_coarse"), F.countDistinct("fine_id").alias("n_fine"))
    sound = counts.crossJoin(parents.agg((F.max("p") == 1).alias("nested"))).crossJoin(only.agg(F.min("told").alias("told")))
    return rows.select("openalex_id").crossJoin(F.broadcast(sound))


@query("embed_texts", "", r"""
    SELECT doc_id, CAST(64 AS INT) AS dim, 'hashing' AS model, md5(text) AS text_hash,
           CASE WHEN len(list_filter(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), lambda t: NOT list_contains(@stop, t))) > 0
           THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents""".replace("@stop", str(list(STOP_WORDS))))
def embed_texts(t: Tables) -> DataFrame:
    vectors = em.embed_texts(t.raw("documents"), "doc_id", "text")
    return vectors.select("doc_id", "dim", "model", F.round(l2_norm(F.col("embedding")), 3).alias("norm"), "text_hash")


HIGH_WORKS = "(SELECT * FROM fx_works WHERE type = 'article' AND cited_by_count >= 400 AND field <> '' AND title <> '')"


@query("build_worldmap", "fx_works", f"""
    SELECT openalex_id, field, TRUE AS placed, TRUE AS named FROM (
        SELECT d.openalex_id, d.field, q.quota, row_number() OVER (PARTITION BY d.field ORDER BY md5('42|' || CAST(d.openalex_id AS VARCHAR)), d.openalex_id) AS pos
        FROM {HIGH_WORKS} d JOIN ({QUOTA.format(s='field', floor=20, target=400, table=HIGH_WORKS)}) q ON q.stratum = d.field) WHERE pos <= quota""")
def build_worldmap(t: Tables) -> DataFrame:
    mapped = durable(maps.build_worldmap(t.works, 400, 400, 20))
    return _named(mapped, []).select("openalex_id", "field", _placed().alias("placed"), "named")


@query("build_landscape", "fx_docs", "SELECT openalex_id, TRUE AS placed, TRUE AS named FROM fx_docs")
def build_landscape(t: Tables) -> DataFrame:
    docs = t.search_docs.withColumn("topic", F.concat_ws("/", "journal_tier", "journal"))
    return _named(durable(maps.build_landscape(docs)), []).select("openalex_id", _placed().alias("placed"), "named")


@query("build_landscape_density", "fx_docs", "SELECT openalex_id, TRUE AS placed, TRUE AS named FROM fx_docs")
def build_landscape_density(t: Tables) -> DataFrame:
    docs = t.search_docs.withColumn("topic", F.concat_ws("/", "journal_tier", "journal"))
    mapped = maps.build_landscape(docs, method="density", eps=0.05)
    return _named(durable(mapped), []).select("openalex_id", _placed().alias("placed"), "named")


@query("build_author_map", "fx_authors fx_links", """
    SELECT author_id, name, institution, paper_count, total_citations, TRUE AS placed, TRUE AS labelled FROM fx_authors
    WHERE author_id IN (SELECT author_id FROM fx_links GROUP BY 1 HAVING count(*) >= 3)""")
def build_author_map(t: Tables) -> DataFrame:
    # a few large row groups would leave the encoding to a few tasks
    titles = t.papers.select("openalex_id", F.concat_ws(" ", "title", "topic").alias("text")).repartition("openalex_id")
    vectors = em.embed_texts(titles, "openalex_id", "text")
    mapped = maps.build_author_map(t.links, t.papers, vectors.select("openalex_id", "embedding"), t.authors)
    return mapped.select("author_id", "name", "institution", "paper_count", "total_citations", _placed().alias("placed"), (F.trim("cluster_label") != "").alias("labelled"))


@query("compare_authors", "fx_groups fx_slinks", """
    SELECT g.group_id, l.paper_id AS openalex_id, arg_min(g.author_id, g.seq) AS owner_id, count(*) >= 2 AS shared, TRUE AS placed, TRUE AS named
    FROM fx_groups g JOIN fx_slinks l ON l.author_id = g.author_id GROUP BY 1, 2""")
def compare_authors(t: Tables) -> DataFrame:
    points, _ = maps.compare_authors(t.groups, t.slinks, t.papers)
    return _named(points, ["group_id"]).select("group_id", "openalex_id", "owner_id", "shared", _placed().alias("placed"), "named")


@query("build_ego_map", "", f"SELECT *, TRUE AS placed FROM ({ORACLES['ego_edges']})")
def build_ego_map(t: Tables) -> DataFrame:
    """The edges of the map are those of the network, and both ends have the places of the people."""
    texts = t.papers.join(t.docs.select("openalex_id", "abstract"), "openalex_id", "left")
    people, edges = maps.build_ego_map(t.focals, t.links, texts, t.authors)
    place = durable(people.select("focal_id", "author_id", "x", "y").distinct())
    ends = edges
    for end, x, y in (("src", "x0", "y0"), ("dst", "x1", "y1")):
        own = place.select("focal_id", F.col("author_id").alias(end), F.col("x").alias(f"_{x}"), F.col("y").alias(f"_{y}"))
        ends = ends.join(own, ["focal_id", end], "left")
    same = [(F.col(c) == F.col(f"_{c}")) & ~F.isnan(c) for c in ("x0", "y0", "x1", "y1")]
    return ends.select("focal_id", "kind", "src", "dst", "weight", F.coalesce(same[0] & same[1] & same[2] & same[3], F.lit(False)).alias("placed"))


@query("describe_hierarchy", "fx_docs", f"""
    SELECT * FROM (WITH {LEVELS} SELECT level, CAST(clusters AS BIGINT) AS clusters, papers, TRUE AS named, TRUE AS inside FROM (
        SELECT 'coarse' AS level, coarse AS clusters FROM levels UNION ALL SELECT 'fine', greatest(fine, coarse + 2) FROM levels),
        (SELECT count(*) AS papers FROM embeddings JOIN fx_docs ON openalex_id = vec_id))""")
def describe_hierarchy(t: Tables) -> DataFrame:
    """Clusters and papers of both levels, all with names, and fine clusters only inside coarse ones that are described."""
    docs = t.search_docs.withColumn("topic", F.concat_ws("/", "journal_tier", "journal"))
    rows = durable(maps.describe_hierarchy(docs, _levels(t), durable(t.points)))
    coarse = rows.where("level = 'coarse'").select(F.col("cluster_id").alias("parent_id"), F.lit(True).alias("_in"))
    joined = rows.join(coarse, "parent_id", "left")
    return joined.groupBy("level").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("papers"), F.min(F.trim("label") != "").alias("named"),
        F.min((F.col("level") == "coarse") | F.coalesce("_in", F.lit(False))).alias("inside"))


@query("build_trajectories", "", f"SELECT *, TRUE AS placed, TRUE AS in_tree FROM ({ORACLES['territory_papers']})")
def build_trajectories(t: Tables) -> DataFrame:
    """All papers of the territories have places and clusters, and every own paper but the first of all is reached once."""
    placed, _, edges = maps.build_trajectories(t.focals, t.links, t.papers, t.authors)
    reached = durable(edges).groupBy("focal_id", F.col("to_id").alias("openalex_id")).agg(F.count(F.lit(1)).alias("times"))
    own = placed.where(F.col("owner_id") == F.col("focal_id")).select("focal_id", "openalex_id").join(reached, ["focal_id", "openalex_id"], "left")
    once = own.groupBy("focal_id").agg((F.coalesce(F.max("times"), F.lit(1)) <= 1).alias("once"))
    known = F.col("coarse_id").isNotNull() & F.col("fine_id").isNotNull()
    tested = placed.select("focal_id", "openalex_id", "owner_id", (_placed() & known).alias("placed")).join(broadcast_if_small(once), "focal_id", "left")
    return tested.select("focal_id", "openalex_id", "owner_id", "placed", F.coalesce("once", F.lit(True)).alias("in_tree"))
