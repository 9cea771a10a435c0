"""Steps whose cost grew faster than their input, with small blocks and by what their plans say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import citations as ct
from quillmap.operators import clustering as cl
from quillmap.operators import density
from quillmap.operators import embedding as em
from quillmap.operators import search as se
from quillmap.operators import terms as tm
from quillmap.plans import maps
from quillmap.registry import landscape


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _size_digits(df) -> int:
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _authors(spark, n=60, dim=8):
    draw = np.random.default_rng(1)
    return spark.createDataFrame([(i, [float(x) for x in draw.normal(size=dim)]) for i in range(n)], "author_id long, embedding array<float>")


def test_vectors_are_not_broadcast_by_their_size_estimate(spark):
    vectors = _authors(spark).checkpoint() if spark.sparkContext.getCheckpointDir() else _authors(spark)
    found = cl.cluster_authors(vectors)
    assert "BroadcastHashJoin" not in _plan(found)
    assert found.count() == 60
    near = landscape._near_share(vectors, "author_id", found)
    assert near.count() == 60 and near.select("near").distinct().count() == 1


@pytest.mark.parametrize("most", [2, 10_000])
def test_ranks_of_many_rounds_keep_their_size_estimate(spark, monkeypatch, most):
    monkeypatch.setattr(ct, "LIST", most)  # a work that cites seven has them in several lists
    works = spark.createDataFrame([(c,) for c in "ABCDEFGHI"] + [("A",)], "openalex_id string")
    own = [("A", c) for c in "BCDEFGH"] + [("B", "A"), ("C", "A"), ("C", "B"), ("I", "A"), ("C", "A"), ("X", "A"), ("A", "Y")]
    ranks = ct.citation_rank(works, spark.createDataFrame(own, "src string, dst string"), rounds=9, tolerance=0.0)
    want = {c: 1.0 for c in "ABCDEFGHI"}
    cites = {s: sorted({d for x, d in own if x == s and d in want}) for s in want}
    for _ in range(9):
        lost = sum(r for c, r in want.items() if not cites[c]) / len(want)
        want = {c: 0.15 + 0.85 * (sum(r / len(cites[s]) for s, r in want.items() if c in cites[s]) + lost) for c in want}
    assert {r[0]: r[1] for r in ranks.collect()} == pytest.approx(want)
    assert _size_digits(ranks) < 30


def test_points_are_compared_inside_tasks(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 5)
    monkeypatch.setattr(density, "PARTS", 2)
    monkeypatch.setattr(density, "PAIRS", 16)
    draw = np.random.default_rng(2)
    points = 1000 + draw.integers(0, 40, size=(120, 3)) / 32  # on a grid, so many distances are eps itself
    eps = 5 / 32
    vectors = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "id long, v array<double>")
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= eps * eps
    found = density.core_points(vectors, [0, 1, 2], eps, 3)
    assert {r["id"] for r in found.collect()} == {k for k in range(120) if near[k].sum() >= 3}
    assert "CoGroups" in _plan(found)
    nodes = vectors.withColumn("node", F.col("id"))
    pairs = {(r["a"], r["b"]) for r in density._linked_nodes(nodes, [0, 1, 2], eps).collect()}
    assert pairs == {(i, j) for i in range(120) for j in range(i + 1, 120) if near[i, j]}


def test_pairs_of_postings_and_terms_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(se, "PAIRS", 5)
    texts = ["red fox", "red red fox den", "fox", "blue fox red", "", None, "den", "red fox"]
    docs = spark.createDataFrame(list(enumerate(texts)), "openalex_id long, abstract string")
    index = se.build_search_index(docs, ("abstract",))
    queries = spark.createDataFrame([(1, 0, "red fox"), (1, 1, "den"), (2, 0, "blue"), (3, 0, "owl")], "query_id long, group_id int, keyword string")
    found = se.match_documents(index, queries)
    assert "hashpartitioning(query_id" not in _plan(found) and "hashpartitioning(doc_id" in _plan(found)
    assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == [(1, d) for d in (0, 1, 3, 6, 7)] + [(2, 3)]


def test_terms_are_counted_once_and_bounded(spark):
    draw = np.random.default_rng(4)
    rows = [(k, int(k % 4), " ".join(f"w{x}" for x in draw.zipf(1.4, size=60) % 300)) for k in range(80)] + [(99, 7, "lone words here"), (100, None, "w1 w2")]
    docs = spark.createDataFrame(rows, "openalex_id long, cluster_id int, text string")
    found = tm.ctfidf_terms(docs, top=5)
    assert "Generate" not in _plan(found)  # what was counted is not counted again
    weights = tm.ctfidf_weights(docs).collect()
    want = {}
    for r in sorted(weights, key=lambda r: (-round(r["weight"], 12), r["token"])):
        want.setdefault(r["cluster_id"], []).append(r["token"])
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["cluster_id"], []).append(r["token"])
    assert got == {c: t[:5] for c, t in want.items()} and set(got) == {0, 1, 2, 3, 7}


def test_documents_are_weighed_inside_their_row(spark):
    rows = [(1, 0, "red fox red den"), (1, 1, "red blue owl"), (2, 0, "fox fox owl lake"), (None, 1, "owl den"), (None, 1, "owl red"), (3, 1, ""), (4, 0, None)]
    docs = spark.createDataFrame(rows, "openalex_id long, cluster_id int, text string")
    found = tm.tfidf_terms(docs, top=9)
    assert "openalex_id" not in _plan(found).split("Window [")[0] and "hashpartitioning(openalex_id" not in _plan(found)
    bags = [(i, c, {w: (t or "").split().count(w) for w in (t or "").split()}) for i, c, t in rows]
    idf = lambda w: np.log((1 + len(bags)) / (1 + sum(w in b for _, _, b in bags))) + 1
    length = lambda own: np.sqrt(sum((n * idf(w)) ** 2 for i, _, b in bags if i == own for w, n in b.items()))
    want = {}
    for i, c, b in bags:
        for w, n in b.items():
            want[c, w] = want.get((c, w), 0) + n * idf(w) / length(i) / sum(k == c for _, k, _ in bags)
    assert {(r["cluster_id"], r["token"]): r["weight"] for r in found.collect()} == pytest.approx(want)
    none = tm.tfidf_terms(docs.where("openalex_id = 3"))
    assert none.columns == found.columns and none.isEmpty()


def test_words_are_split_once_for_each_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 0, "red fox"), (2, 1, "")], "openalex_id long, cluster_id int, text string")
    assert _plan(tm._document_terms(docs, "cluster_id", "text", "openalex_id", None)).count("split(") == 1
    held = []
    monkeypatch.setattr(tm, "store", lambda df, name="table": held.append(df) or df)
    tm._class_counts(docs, "cluster_id", "text", False, None)
    assert _plan(held[0]).count("split(") == 1


def test_texts_of_a_landscape_are_composed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(maps, "_with_text", lambda papers, own=maps._with_text: seen.append(1) or own(papers))
    papers = spark.createDataFrame([(k, f"title {k}", f"w{k % 3} body") for k in range(12)], "openalex_id long, title string, abstract string")
    for method in ("kmeans", "density"):
        assert maps.build_landscape(papers, method=method).count() == 12 and len(seen) == 1
        seen.clear()


def test_author_vectors_are_plain_sums(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (3, 13)], "author_id long, paper_id long")
    vectors = spark.createDataFrame([(10, [1.0, 2.0]), (11, [0.0, -1.0]), (12, [3.0, 3.0])], "openalex_id long, embedding array<float>")
    papers = spark.createDataFrame([(10, 5), (11, None), (12, -3)], "openalex_id long, citation_count int")
    found = em.author_vectors(links, vectors, papers, 1)
    assert "ObjectHashAggregate" not in _plan(found)
    mean = np.log1p(5) * np.array([1.0, 2.0]) + 0.1 * np.array([0.0, -1.0]) + 0.1 * np.array([3.0, 3.0])
    got = {r["author_id"]: r["embedding"] for r in found.collect()}
    assert got[1] == pytest.approx(list(mean / np.linalg.norm(mean))) and got[3] == [0.0, 0.0]
    assert got[2] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    none = em.author_vectors(links, vectors.limit(0), papers, 1)
    assert {tuple(r["embedding"]) for r in none.collect()} == {()}
    uneven = vectors.unionByName(spark.createDataFrame([(13, [1.0])], vectors.schema))
    papers = papers.unionByName(spark.createDataFrame([(13, 1)], papers.schema))
    with pytest.raises(Exception, match="differ in length"):
        em.author_vectors(links, uneven, papers, 1).collect()
