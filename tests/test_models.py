"""Vectors, clusters, labels, territories against NumPy and on edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import clustering as cl
from quillmap.operators import dedupe, labels, sampling, territory
from quillmap.operators import embedding as em
from quillmap.plans import maps
from quillmap.session import exact_rank, top_n


def points(spark, xy, groups=None):
    rows = [(i, float(x), float(y), groups[i] if groups else "g") for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "openalex_id int, x double, y double, territory string")


def test_exact_rank_with_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("v"))
    got = exact_rank(df, ["k"], [F.desc("v")])
    want = {}
    for v in range(5000):
        want.setdefault(v % 50 if v % 3 == 0 else -1, []).append(v)
    want = {k: {v: i + 1 for i, v in enumerate(sorted(vs, reverse=True))} for k, vs in want.items()}
    rows = got.collect()
    assert len(rows) == 5000 and all(want[r["k"]][r["v"]] == r["rank"] for r in rows)
    whole = exact_rank(df.select("v"), [], [F.col("v")])
    assert whole.where("rank <> v + 1").count() == 0


def test_exact_rank_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert sorted((r["v"], r["rank"]) for r in exact_rank(df, ["k"], [F.col("v")]).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_top_n_large_limit(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), "id")
    got = top_n(df, ["k"], [F.col("id")], 1500)
    assert got.count() == 3000 and got.agg(F.max("id")).first()[0] == 2999


def test_sample_is_exact_and_stable(spark):
    df = spark.range(3000).select(F.col("id").alias("openalex_id"), F.when(F.col("id") < 2900, "big").otherwise("small").alias("f"))
    quotas = sampling.sqrt_quotas(df, "f", 120, 20)
    got = {r["f"]: (r["n"], r["quota"]) for r in quotas.collect()}
    total = math.sqrt(2900) + 10
    assert got == {"big": (2900, int(math.sqrt(2900) / total * 120)), "small": (100, 20)}
    import hashlib

    picked = sampling.stratified_sample(df, "f", quotas)
    ids = {r["openalex_id"] for r in picked.collect()}
    order = lambda vs: sorted(vs, key=lambda v: (hashlib.md5(f"42|{v}".encode()).hexdigest(), v))
    assert ids == set(order(range(2900))[: got["big"][1]]) | set(order(range(2900, 3000))[:20])
    one = spark.createDataFrame([("big", 2900, 5000), ("small", 100, 3)], "f string, n long, quota long")
    assert sampling.stratified_sample(df, "f", one).count() == 2903


def test_dedupe_union_of_tags(spark):
    rows = [("a", "y; x", 5, 1, "first"), ("a", "x; z", 9, 2, "second"), ("a", "w", 1, 3, "third"), ("b", "", 0, 1, "only")]
    df = spark.createDataFrame(rows, "openalex_id string, streams string, citation_count int, seq int, title string")
    got = {r["openalex_id"]: r for r in dedupe.dedupe_papers(df, [F.col("seq")]).collect()}
    assert (got["a"]["streams"], got["a"]["citation_count"], got["a"]["title"]) == ("w; x; y; z", 9, "first")
    assert got["b"]["streams"] == ""


def test_author_vectors(spark):
    links = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(3)] + [(3, 0)] + [(4, 7 + i) for i in range(3)], "author_id int, paper_id int")
    links = links.where("author_id <> 2 OR paper_id < 2").unionByName(spark.createDataFrame([(2, 9)], "author_id int, paper_id int"))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "openalex_id int, embedding array<float>")
    papers = spark.createDataFrame([(0, 0), (1, 0), (2, 100)], "openalex_id int, citation_count int")
    got = {r["author_id"]: np.array(r["embedding"]) for r in em.author_vectors(links, vectors, papers).collect()}
    w = np.array([0.1, 0.1, math.log(101)])
    want = (w @ np.array([[1, 0], [0, 1], [1, 1]])) / w.sum()
    assert np.allclose(got[1], want / np.linalg.norm(want))
    assert np.allclose(got[2], [math.sqrt(0.5)] * 2)
    assert sorted(got) == [1, 2, 4] and np.allclose(got[4], 0)


def test_projection_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "openalex_id int, embedding array<double>")
    got = np.array([[r["x"], r["y"]] for r in em.project_2d(df).orderBy("openalex_id").collect()])
    centred = data - data.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert [tuple(r) for r in em.project_2d(df.limit(3)).select("x", "y").distinct().collect()] == [(0.0, 0.0)]


def test_embedding_incremental_and_custom_encoder(spark):
    df = spark.createDataFrame([(1, "graph networks"), (2, "graph networks"), (3, "")], "id int, text string")
    first = em.embed_texts(df, "id", "text", dim=16)
    got = {r["id"]: r["embedding"] for r in first.collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not any(got[3])
    changed = spark.createDataFrame([(1, "graph networks"), (2, "new text"), (4, "more")], "id int, text string")
    again = em.embed_incremental(changed, "id", "text", first, dim=16)
    assert sorted(r["id"] for r in again.collect()) == [2, 4]
    length = lambda: (lambda texts: np.stack([[len(t), 1.0] for t in texts]))
    own = em.embed_texts(df, "id", "text", length, "length", 2)
    assert {r["id"]: r["embedding"][0] for r in own.collect()} == {1: 14.0, 2: 14.0, 3: 0.0}


def test_assign_nearest_in_blocks(spark):
    rng = np.random.default_rng(8)
    xs, cs = rng.normal(size=(60, 5)), rng.normal(size=(40, 5))
    cs[7] = cs[3]  # a tie goes to the smaller cluster
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "id int, embedding array<double>")
    centres = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(cs)], "cluster_id int, embedding array<double>")
    far = np.sqrt(((xs[:, None] - cs[None]) ** 2).sum(axis=2))
    want = {i: (int(far[i].argmin()), round(float(far[i].min()), 9)) for i in range(60)}
    for size in (1 << 20, 400):
        rows = em.assign_nearest(df, centres, "id", block_bytes=size).collect()
        assert {r["id"]: (r["cluster_id"], round(r["distance"], 9)) for r in rows} == want


def test_small_inputs_form_one_cluster(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "openalex_id int, embedding array<double>")
    assert {(r["x"], r["y"], r["cluster_id"]) for r in cl.cluster_papers(df).collect()} == {(0.0, 0.0, 0)}
    assert cl.paper_cluster_count(50_000) == 158 and cl.paper_cluster_count(10) == 3 and cl.author_cluster_count(10**6) == 50
    assert cl.hierarchy_counts(1000) == (8, 15)


def test_hierarchy_is_nested(spark):
    rng = np.random.default_rng(2)
    df = points(spark, rng.normal(size=(200, 2)))
    rows = cl.cluster_hierarchy(df).collect()
    parents = {}
    for r in rows:
        parents.setdefault(r["fine_id"], set()).add(r["coarse_id"])
    assert len(rows) == 200 and all(len(p) == 1 for p in parents.values())


def test_density_cluster(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 0.05, (80, 2)), rng.normal(3, 0.05, (40, 2))
    tiny, far = rng.normal(-3, 0.01, (6, 2)), [(50.0, 50.0), (-40.0, 9.0)]
    df = points(spark, [*a, *b, *tiny, *far])
    got = [r["cluster_id"] for r in cl.density_cluster(df, 0.2).orderBy("openalex_id").collect()]
    assert set(got[:80]) == {0} and set(got[80:120]) == {1} and set(got[120:]) == {-1}


def test_components_of_a_chain(spark):
    nodes = spark.range(40).select(F.format_string("%03d", "id").alias("node"))
    edges = spark.range(39).where("id <> 19").select(F.format_string("%03d", "id").alias("a"), F.format_string("%03d", F.col("id") + 1).alias("b"))
    got = {r["node"]: r["component"] for r in cl.components(nodes, edges).collect()}
    assert {v for k, v in got.items() if k < "020"} == {"000"} and {v for k, v in got.items() if k >= "020"} == {"020"}


def test_labels_are_unique(spark):
    rows = [(1, "A")] * 5 + [(1, "B")] * 2 + [(2, "A")] * 4 + [(2, "B")] * 1 + [(3, "A")] * 3 + [(3, "B")] + [(5, "A"), (6, "A"), (-1, "A")]
    rows += [(4, ""), (7, "")]
    df = spark.createDataFrame(rows, "cluster_id int, topic string")
    spare = spark.createDataFrame([(3, "x, y"), (6, "x, z"), (7, "net, data"), (4, "net, data")], "cluster_id int, fallback_label string")
    got = {r["cluster_id"]: (r["label"], r["labelled"]) for r in labels.label_clusters(df, fallback_terms=spare).collect()}
    assert got == {
        1: ("A", True), 2: ("B", True), 3: ("A (x)", False), 5: ("A #5", False), 6: ("A (x) #6", False),
        4: ("net, data", False), 7: ("net, data #7", False), -1: ("Outlier", False),
    }


def test_labels_equal_the_sequence(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), f"t{int(t)}") for c, t in zip(rng.integers(0, 12, 400), rng.integers(0, 9, 400))]
    df = spark.createDataFrame(rows, "cluster_id int, topic string")
    sizes = Counter(c for c, _ in rows)
    taken, want = set(), {}
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        counts = Counter(t for k, t in rows if k == c)
        free = [t for t in sorted(counts, key=lambda t: (-counts[t], t)) if t not in taken]
        if free:
            want[c] = free[0]
            taken.add(free[0])
    got = {r["cluster_id"]: r["label"] for r in labels.label_clusters(df).collect() if r["labelled"]}
    assert got == want


def test_summary_all_noise(spark):
    df = spark.createDataFrame([(-1,)] * 3, "cluster_id int")
    r = labels.cluster_summary(df).first()
    assert (r["n_clusters"], r["n_outliers"], r["outlier_pct"], r["warn"]) == (0, 3, 100.0, True)


def test_ellipses(spark):
    rng = np.random.default_rng(5)
    xy = rng.normal(size=(50, 2)) @ np.array([[2.0, 1.0], [0.0, 0.5]])
    line = [(i, 2.0 * i) for i in range(4)]
    groups = ["a"] * 50 + ["b"] * 2 + ["c"] * 4
    df = points(spark, [*xy, (0, 0), (1, 1), *line], groups)
    got = {r["territory"]: r for r in territory.cluster_ellipses(df, "territory").collect()}
    values, vectors = np.linalg.eigh(np.cov(xy.T))
    assert abs(got["a"]["half_major"] - 2 * math.sqrt(values[1])) < 1e-9
    assert abs(got["a"]["half_minor"] - 2 * math.sqrt(values[0])) < 1e-9
    angle = math.atan2(vectors[1, 1], vectors[0, 1])
    assert abs(math.sin(got["a"]["angle"] - angle)) < 1e-9
    assert "b" not in got and abs(got["c"]["half_minor"] - 2e-3) < 1e-9


def test_territories_fall_back(spark):
    rows = [(i, float(i), 0.0, "F" if i < 2 else "", f"s{i % 9}") for i in range(20)]
    df = spark.createDataFrame(rows, "openalex_id int, x double, y double, field string, subfield string")
    got = {r["territory"] for r in territory.assign_territories(df).collect()}
    assert len(got) == 5 and "Other" in got and "s0" in got
    bare = df.withColumn("subfield", F.lit(""))
    assert all(r["territory"].startswith("Group ") for r in territory.assign_territories(bare).collect())


def test_kde_matches_formula(spark):
    rng = np.random.default_rng(6)
    xy = rng.normal(size=(30, 2))
    df = points(spark, [*xy, *rng.normal(5, 1, (4, 2))], ["a"] * 30 + ["b"] * 4)
    rows = territory.kde_grid(df, bins=8).collect()
    assert {r["territory"] for r in rows} == {"a"} and len(rows) == 64
    h = 0.04 * np.cov(xy.T)
    inv, norm = np.linalg.inv(h), 2 * math.pi * math.sqrt(np.linalg.det(h)) * 30
    for r in rows[::7]:
        d = np.array([r["x"], r["y"]]) - xy
        want = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inv, d)).sum() / norm
        assert abs(r["density"] - want) < 1e-9
    grid = territory.kde_grid(df, bins=8)
    peaks = {r["territory"]: r["dominance"] for r in territory.dominance_peaks(grid, df).collect()}
    assert peaks["a"] > 0 and peaks["b"] is None


def test_landscape_checks_alignment(spark):
    papers = spark.createDataFrame([(1, "a")], "openalex_id int, title string")
    vectors = spark.createDataFrame([(2, [0.0])], "openalex_id int, embedding array<double>")
    with pytest.raises(ValueError):
        maps.build_landscape(papers, vectors)
