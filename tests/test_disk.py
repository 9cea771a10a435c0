"""Steps that wrote more than their share to disk: what is written, by whom, and the same rows as before."""

import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.operators import keyed
from quillmap.operators import vector_index as vi
from quillmap.plans import maps
from quillmap.registry import corpus
from quillmap.registry.base import Tables
from quillmap.sources import gzip_lines as gl
from quillmap.streaming import ingest


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _points(spark, sizes=(3, 40, 150), seed=4):
    draw = np.random.default_rng(seed)
    rows = [(k, 1000 * k + i, f"o{i % 3}", float(x), float(y)) for k, n in enumerate(sizes) for i, (x, y) in enumerate(draw.normal(size=(n, 2)))]
    rows += [(1, 1000 + i, "again", 2.0 + i, 1.0) for i in (3, 3, 9)] + [(1, None, "none", 0.5, 0.5)]
    return spark.createDataFrame(rows, "key int, id int, owner string, x double, y double")


def test_levels_of_small_keys_in_one_task_are_those_of_large_ones(spark):
    points = _points(spark).checkpoint() if spark.sparkContext.getCheckpointDir() else _points(spark)
    plain = ["key", "id", "coarse_id", "fine_id", "only_child"]
    some, many = (keyed.hierarchy_by(points, "key", "id", local_rows=n) for n in (1000, 0))
    assert some.columns == many.columns == plain
    count = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert count(some) == count(many) and some.where("id = 1003").count() == 9 and some.where("id is null").isEmpty()
    with_places = [keyed.hierarchy_by(points, "key", "id", local_rows=n, places=["owner", "x", "y"]) for n in (1000, 0)]
    joined = some.join(points, ["key", "id"]).select(*plain, "owner", "x", "y")
    assert count(with_places[0]) == count(with_places[1]) == count(joined)


def test_vectors_of_small_keys_are_not_written(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(k % 3, k, f"o{k}", [float(x) for x in draw.normal(size=5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "key int, id int, owner string, embedding array<float>")
    written, own = [], keyed.durable
    monkeypatch.setattr(keyed, "durable", lambda table: written.append(table.dtypes) or own(table))
    placed = keyed.project_2d_by(df, "key", "id", keep=["owner"])
    counts = spark.createDataFrame([(k, 4) for k in range(3)], "key int, k int")
    assert placed.columns == ["key", "id", "owner", "x", "y"] and placed.where(F.col("owner") == F.concat(F.lit("o"), "id")).count() == 60
    assert keyed.kmeans_by(df, ["key"], "id", "embedding", counts, 9).count() == 60
    assert written and not [t for t in written if any("array" in kind for _, kind in t)]
    large = keyed.project_2d_by(df, "key", "id", local_rows=0, keep=["owner"])
    for a, b in zip(placed.orderBy("id").collect(), large.orderBy("id").collect()):
        assert a["owner"] == b["owner"] and (a["x"], a["y"]) == pytest.approx((b["x"], b["y"]))


def test_papers_in_many_territories_are_joined_at_the_end(spark, monkeypatch):
    links = spark.createDataFrame([(a, p) for a in range(6) for p in range(12) if (a + p) % 3], "author_id long, paper_id long")
    papers = spark.createDataFrame([(p, f"title {p}", 2000 + p, p, f"t{p % 2}", f"s{p % 2}") for p in [*range(12), 4]],
                                   "openalex_id long, title string, year int, citation_count int, topic string, subfield string")
    authors = spark.createDataFrame([(a, f"n{a}") for a in range(6)], "author_id long, name string")
    asked, own = [], maps.network.territory_papers
    monkeypatch.setattr(maps.network, "territory_papers", lambda focals, layer1, links, papers, n: asked.append(papers.columns) or own(focals, layer1, links, papers, n))
    placed, clusters, _ = maps.build_trajectories(authors.where("author_id < 3"), links, papers, authors)
    assert asked == [["openalex_id"]]
    assert placed.columns == ["focal_id", *papers.columns, "owner_id", "x", "y", "coarse_id", "fine_id", "only_child"]
    times = {r["openalex_id"]: r["count"] for r in placed.where("focal_id = 0").groupBy("openalex_id").count().collect()}
    assert times == {p: 16 if p == 4 else 1 for p in range(12)}  # as often as the joins of its two rows give
    assert clusters.where("level = 'coarse'").agg(F.sum("n")).first()[0] == placed.count()


def test_rows_that_stay_are_not_shuffled(spark):
    rows = spark.createDataFrame([("f", k, "x" * 50) for k in range(20)], "file string, line_no long, payload string")
    named = rows.select("file", "line_no")
    new = named.where("line_no % 5 <> 0")
    kept = ingest.without_losers(rows, named, new, ["file", "line_no"])
    assert sorted(r["line_no"] for r in kept.collect()) == [k for k in range(20) if k % 5]
    assert "hashpartitioning" not in _plan(kept)
    assert ingest.without_losers(rows, named, named, ["file", "line_no"]) is rows
    lost = named.where("line_no = 3")  # rows without a name stay, whatever is new
    assert ingest.without_losers(rows, lost, lost.limit(0), ["file", "line_no"]).count() == 19


def test_blocks_hold_the_lines_of_files(tmp_path):
    data = gzip.compress("".join(f'{{"id": "W{k * k % 9973}", "title": "one of many titles", "publication_year": 2001}}\n' for k in range(60_000)).encode())
    (tmp_path / "whole.gz").write_bytes(data)
    (tmp_path / "cut.gz").write_bytes(data[: len(data) // 2])
    (tmp_path / "empty.gz").write_bytes(b"")
    names = pa.RecordBatch.from_pylist([{"path": f"file:{tmp_path}/{n}.gz"} for n in ("whole", "cut", "empty")])
    rows = lambda batches: [tuple(r.values()) for b in batches for r in b.to_pylist()]
    blocks = list(gl.read_blocks(iter([names])))
    want = rows(gl.read_files(iter([names])))
    assert rows(gl.open_blocks(iter(blocks))) == want and [r[3] for r in want if r[3]][0].startswith("EOFError")
    size = sum(len(b.column("packed")[0].as_py()) for b in blocks)
    assert size < 0.4 * sum(len(v or "") for _, _, v, _ in want)


def test_packed_bytes_are_not_shuffled_and_pieces_go(spark, tmp_path, monkeypatch):
    seen, own = [], gl.durable
    monkeypatch.setattr(gl, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(gl, "durable", lambda df: seen.append((df.columns, own(df), len(list((tmp_path / "pieces").iterdir())))) or seen[-1][1])
    rows = spark.range(900).select((F.col("id") % 3).cast("int").alias("f"), F.col("id").alias("line_no"), F.concat(F.lit("line "), F.col("id")).alias("value"))
    gl.write_gzip(rows, str(tmp_path / "out"), [2])
    assert seen[0][0] == ["f", "task", "member"] and seen[0][2] >= 3
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    assert gzip.open(tmp_path / "out" / "part1.gz", "rt").read().split() == " ".join(f"line {k}" for k in range(1, 900, 3)).split()


def _small_tables(spark, folder):
    write = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    write("lineitem", [(o, 1 + (o * s) % 4) for o in range(1, 30) for s in range(3)], "l_orderkey long, l_suppkey long")
    write("supplier", [(s, f"S{s}", s % 2) for s in range(1, 5)], "s_suppkey long, s_name string, s_nationkey int")
    write("nation", [(0, "N0"), (1, "N1")], "n_nationkey int, n_name string")
    return Tables(spark, str(folder))


def test_authorships_are_dealt_by_paper_once(spark, tmp_path):
    people = _small_tables(spark, tmp_path).authorships
    lists = people.groupBy("paper_id").agg(F.sort_array(F.collect_list("position")).alias("p"))
    assert _plan(lists).count("Exchange hashpartitioning") == 1
    got = {r["paper_id"]: list(r["p"]) for r in lists.collect()}
    assert got == {o: list(range(len({(o * s) % 4 for s in range(3)}))) for o in range(1, 30)}


def test_indexes_arise_after_the_shuffle(spark, tmp_path):
    t = _small_tables(spark, tmp_path)
    works = [(1, "t1", 2000, "article", 3, "src", "F", "S", "T"), (2, "t2", 2001, "article", 4, "src", "F", "S", "T")]
    t.__dict__["works"] = spark.createDataFrame(works, "openalex_id long, title string, publication_year int, type string, cited_by_count int, source_name string, field string, subfield string, topic string")
    t.__dict__["docs"] = spark.createDataFrame([(1, "b a b"), (7, "z")], "openalex_id long, abstract string")
    lines = corpus.raw_lines(t)
    plan = _plan(lines)
    assert plan.index("MapInArrow") < plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "BroadcastHashJoin")  # printed from the top
    got = {r["openalex_id"]: r["value"] for r in lines.collect()}
    assert '"abstract_inverted_index":{"a":[1],"b":[0,2]}' in got[1] and "abstract_inverted_index" not in got[2] and set(got) == {1, 2}


def test_a_block_without_vectors_has_no_best():
    asked = pa.table({"query_id": [1], "q": [[1.0, 0.0]], "cells": [[0]]})
    held = pa.table({"id": [2], "embedding": [[1.0, 0.0]], "cell": [0]})
    for some, other, n in ((asked, held, 1), (asked[:0], held, 0), (asked, held[:0], 0)):
        assert vi._best_of(3, True, True)(some, other).num_rows == n
