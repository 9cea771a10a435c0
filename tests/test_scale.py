"""Steps that were mended because they did not finish on large tables, with small blocks."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.functions.text import tokens
from quillmap.operators import keyed
from quillmap.operators import similar as si
from quillmap.operators import vector_index as vi
from quillmap.registry import corpus
from quillmap.sources import gzip_lines as gl


def _vectors(spark, n, dim=6, seed=3):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in draw.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(rows + [(n + i, rows[i][1]) for i in range(5)], "openalex_id long, embedding array<double>")


def test_files_are_packed_in_members_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gl, "MEMBER", 64)  # a few lines; workers are forked with it or use whole members
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("f"), F.col("id").alias("line_no"), F.concat(F.lit("line "), F.col("id")).alias("value"))
    gl.write_gzip(rows, str(tmp_path / "out"), [2])
    for f in (0, 1):
        got = gzip.open(tmp_path / "out" / f"part{f}.gz", "rt").read().split("\n")[:-1]
        assert got == [f"line {i}" for i in range(3000) if i % 3 == f]
    lines = gl.snapshot_lines(spark, str(tmp_path / "out"))
    assert [r["n_lines"] for r in gl.bad_files(lines).collect()] == [1000]
    assert lines.where("value is not null").count() == 3000


def test_members_end_where_files_do():
    import pyarrow as pa
    from unittest import mock

    batch = pa.RecordBatch.from_pylist([{"f": f, "value": "x" * 50} for f in (0, 0, 0, 1)])
    with mock.patch.object(gl, "MEMBER", 100), mock.patch.object(gl, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 7
        found = [r for b in gl._pack(iter([batch])) for r in b.to_pylist()]
    assert [(r["f"], r["member"], len(gzip.decompress(r["packed"])) // 51) for r in found] == [(0, 0, 2), (0, 1, 1), (1, 2, 1)]


def test_word_index_of_batches(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "\u00e9t\u00e9 a"), (5, "z")], "openalex_id long, abstract string")
    got = {r[0]: r[1] and list(r[1].items()) for r in corpus.inverted_indexes(docs).collect()}
    assert got == {1: [("a", [1]), ("b", [0, 2])], 2: None, 3: None, 4: [("a", [1]), ("ete", [0])], 5: [("z", [0])]}
    assert docs.select(tokens(F.col("abstract"))).count() == 5


@pytest.mark.parametrize("probes", [3, 8])
def test_blocks_find_what_cells_find(spark, tmp_path, monkeypatch, probes):
    monkeypatch.setattr(vi, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vi, "VECTOR_BLOCK", 11)
    vectors = _vectors(spark, 60)
    index = vi.store_vector_index(vectors, str(tmp_path / "index"), cells=8)
    queries = vectors.withColumnRenamed("openalex_id", "query_id")
    got = vi.search_vectors(index, queries, 4, probes, True)
    units = vi.usable_vectors(queries, "query_id", "embedding").withColumnsRenamed({"id": "query_id", "embedding": "q"})
    asked = vi.nearest_cells(index, units, probes)
    pairs = index[0].join(asked, "cell").where("id <> query_id").select("query_id", "id", vi.dot(F.col("q"), F.col("embedding")).alias("score"))
    want = vi.top_n(pairs, ["query_id"], [F.desc(F.round("score", 12)), F.col("id")], 4)
    columns = ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_pairs_of_items_arise_inside_tasks(spark):
    vectors = _vectors(spark, 80)
    got = {(r["openalex_id"], r["rank"]): (r["similar_id"], r["score"]) for r in si.similar_items(vectors, 5, 20, rounds=8).collect()}
    x = np.array([r["embedding"] for r in vectors.orderBy("openalex_id").collect()])
    x /= np.linalg.norm(x, axis=1)[:, None]
    score = np.round(x @ x.T, 12)
    np.fill_diagonal(score, -2)
    for i in range(len(x)):
        best = np.lexsort((np.arange(len(x)), -score[i]))[:5]
        assert [got[i, r + 1][0] for r in range(5)] == best.tolist()
    assert not hasattr(si, "_scored")  # no join of two vectors a pair


def test_small_keys_in_one_task_and_large_ones_in_many_agree(spark):
    rows = _vectors(spark, 90).select((F.col("openalex_id") % 3).alias("k"), "openalex_id", "embedding")
    counts = rows.select("k").distinct().withColumn("k_", F.lit(4)).withColumnRenamed("k_", "n_k").select("k", F.col("n_k"))
    by_key = rows.withColumnRenamed("k", "key")
    wanted = counts.select(F.col("k").alias("key"), F.col("n_k").alias("k"))
    found = [
        sorted(map(tuple, keyed.kmeans_by(by_key, ["key"], "openalex_id", "embedding", wanted, 9, local_rows=n).select("key", "openalex_id", "cluster_id").collect()))
        for n in (0, 1000)
    ]
    assert found[0] == found[1]
    placed = [sorted(keyed.project_2d_by(by_key, "key", "openalex_id", local_rows=n).collect(), key=lambda r: r["openalex_id"]) for n in (0, 1000)]
    assert [r["openalex_id"] for r in placed[0]] == [r["openalex_id"] for r in placed[1]]
    for c in "xy":
        assert np.allclose([r[c] for r in placed[0]], [r[c] for r in placed[1]], atol=1e-9)


def test_ids_in_several_rows_keep_all_their_pairs(spark):
    vectors = _vectors(spark, 20)
    twice = vectors.unionByName(vectors.where("openalex_id < 4"))
    got = si.similar_items(twice, 30, 50).groupBy("openalex_id", "similar_id").count().collect()
    times = lambda i: 2 if i < 4 else 1
    assert got and all(r["count"] == times(r["openalex_id"]) * times(r["similar_id"]) for r in got if r["openalex_id"] >= 4)
