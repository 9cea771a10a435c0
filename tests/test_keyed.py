"""Spaces and clusters of many keys at once: the same alone and in a batch."""

import numpy as np

from pyspark.sql import functions as F

from quillmap.operators import keyed, labels
from quillmap.plans import maps
from quillmap.registry.base import Tables


def table(spark, sizes=(3, 5, 60, 140), dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        scale = np.linspace(3, 0.2, dim)
        rows += [(f"k{k}", 1000 * k + i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dim)) * scale + k)]
    return spark.createDataFrame(rows, "key string, id int, embedding array<double>").repartition(5)


def rows_of(df, *columns):
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect()]
    return sorted(rows, key=repr)


def test_projection_equals_numpy_and_stands_alone(spark):
    df = table(spark)
    got = rows_of(keyed.project_2d_by(df, "key", "id"), "key", "id", "x", "y")
    for k in ("k2", "k3"):
        own = sorted((r["id"], r["embedding"]) for r in df.where(F.col("key") == k).collect())
        x = np.array([v for _, v in own])
        x -= x.mean(axis=0)
        axes = np.linalg.svd(x, full_matrices=False)[2][:2]
        axes *= np.sign(axes[[0, 1], np.abs(axes).argmax(axis=1)])[:, None]
        want = x @ axes.T
        mine = np.array([r[2:] for r in got if r[0] == k])
        assert np.abs(mine - want).max() < 1e-5
        alone = rows_of(keyed.project_2d_by(df.where(F.col("key") == k), "key", "id"), "key", "id", "x", "y")
        assert alone == [r for r in got if r[0] == k]
    assert all(r[2:] == (0.0, 0.0) for r in got if r[0] == "k0")


def test_kmeans_settles_on_nearest_centres(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    rows = [(1, i, (centres[i % 3] + rng.normal(0, 0.3, 2)).tolist()) for i in range(90)] + [(2, i, [float(i), 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "key int, id int, v array<double>")
    counts = spark.createDataFrame([(1, 6), (2, 9)], "key int, k int")
    got = {(r["key"], r["id"]): r["cluster_id"] for r in keyed.kmeans_by(df, ["key"], "id", "v", counts, 9).collect()}
    assert len(got) == 94 and len({c for (k, _), c in got.items() if k == 2}) == 4
    for c in {c for (k, _), c in got.items() if k == 1}:
        assert len({i % 3 for (k, i), own in got.items() if k == 1 and own == c}) == 1


def test_hierarchy_is_nested_exact_and_stands_alone(spark):
    points = keyed.project_2d_by(table(spark), "key", "id")
    got = rows_of(keyed.hierarchy_by(points, "key", "id"), "key", "id", "coarse_id", "fine_id", "only_child")
    for k, n, coarse, fine in (("k0", 3, 1, 1), ("k1", 5, 3, 5), ("k2", 60, 3, 8), ("k3", 140, 5, 8)):
        own = [r for r in got if r[0] == k]
        assert len(own) == n
        assert len({r[2] for r in own}) <= coarse and len({r[3] for r in own}) <= fine
        parents = {}
        for r in own:
            parents.setdefault(r[3], set()).add(r[2])
        assert all(len(p) == 1 for p in parents.values())
        assert all(r[4] == (len({q[3] for q in own if q[2] == r[2]}) == 1) for r in own)
    assert len({r[3] for r in got if r[0] == "k3"}) == 8
    alone = keyed.hierarchy_by(points.where(F.col("key") == "k2"), "key", "id")
    assert rows_of(alone, "key", "id", "coarse_id", "fine_id", "only_child") == [r for r in got if r[0] == "k2"]


def test_labels_of_a_key_stand_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{g}", int(c), f"t{int(t)}") for g in range(4) for c, t in zip(rng.integers(-1, 6, 80), rng.integers(0, 5, 80))]
    df = spark.createDataFrame(rows, "key string, cluster_id int, topic string")
    every = rows_of(labels.label_clusters(df, per="key"), "key", "cluster_id", "label", "labelled")
    for g in range(4):
        own = rows_of(labels.label_clusters(df.where(F.col("key") == f"g{g}").drop("key")), "cluster_id", "label", "labelled")
        assert own == [r[1:] for r in every if r[0] == f"g{g}"]
        names = [r[1] for r in own]
        assert len(set(names)) == len(names)


def test_trajectories_and_comparisons_stand_alone(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    focals = t.focals.orderBy("author_id").limit(3)
    placed, clusters, edges = maps.build_trajectories(focals, t.links, t.papers, t.authors)
    one = focals.limit(1)
    focal = one.first()["author_id"]
    alone = maps.build_trajectories(one, t.links, t.papers, t.authors)
    for batch, single in zip((placed, clusters, edges), alone):
        assert rows_of(batch.where(F.col("focal_id") == focal), *single.columns) == rows_of(single, *single.columns)
        assert single.count() > 0
    group = t.groups.select("group_id").distinct().orderBy("group_id").first()[0]
    points, centroids = maps.compare_authors(t.groups, t.slinks, t.papers)
    own = maps.compare_authors(t.groups.where(F.col("group_id") == group), t.slinks, t.papers)
    for batch, single in zip((points, centroids), own):
        columns = [c for c in single.columns if c != "topic_words"]
        assert rows_of(batch.where(F.col("group_id") == group), *columns) == rows_of(single, *columns)
