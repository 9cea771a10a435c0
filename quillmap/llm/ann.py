"""Nearest neighbours with a forest of hash prefixes.

Vectors are dealt to shards of bounded size and queries to blocks of bounded size; each (shard, block) cell
is one group. In a cell every tree is a sorted array of long hash strings. A query descends to its place in
each tree; then all trees ascend together, bit by bit, until the ranges that share the prefix hold enough
candidates. Candidates are ranked by their exact distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm.common import id_type
from quillmap.session import durable, top_n


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def tree_hashes(vectors: np.ndarray, center: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """trees x rows hash strings: signs of random projections, the first bit highest."""
    planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], trees * bits))
    signs = ((vectors - center) @ planes > 0).reshape(len(vectors), trees, bits)
    out = np.zeros((trees, len(vectors)), np.uint64)
    for k in range(bits):
        out = (out << np.uint64(1)) | signs[:, :, k].T.astype(np.uint64)
    return out


def forest_candidates(index: np.ndarray, queries: np.ndarray, trees: int, bits: int, enough: int, seed: int) -> list[np.ndarray]:
    """Rows of index for each query. All trees stand at one depth, the deepest with ``enough`` entries or all."""
    center = index.mean(axis=0)
    hashes = tree_hashes(index, center, trees, bits, seed)
    orders = np.argsort(hashes, axis=1, kind="stable")
    arrays = np.take_along_axis(hashes, orders, axis=1)
    asked = tree_hashes(queries, center, trees, bits, seed)
    n = len(queries)
    low, high = np.zeros((trees, n), np.int64), np.full((trees, n), len(index))
    open_ = np.ones(n, bool)
    for depth in range(bits, 0, -1):
        if not open_.any():
            break
        below = np.uint64((1 << (bits - depth)) - 1)
        for t in range(trees):
            low[t, open_] = np.searchsorted(arrays[t], asked[t, open_] & ~below)
            high[t, open_] = np.searchsorted(arrays[t], asked[t, open_] | below, "right")
        open_ &= (high - low).sum(axis=0) < min(enough, trees * len(index))
    low[:, open_], high[:, open_] = 0, len(index)  # the roots
    return [np.unique(np.concatenate([orders[t, low[t, q] : high[t, q]] for t in range(trees)])) for q in range(n)]


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, summed component by component."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        d = vectors[:, k] - query[k]
        total += d * d
    return np.sqrt(total)


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = 24,
    bits: int = 40,
    enough: float = 1.5,
    shard_rows: int = 16_384,
    block_rows: int = 4_096,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows found for every query row: query_id, rank, vec_id, score.

    enough: candidates gathered over all trees of a shard, as a multiple of its rows; a row in several trees
    counts for each. Equal distances go by the smaller
    id. Rows whose vector is null, empty, zero or not finite, or whose id is null, take no part. Vectors of
    different lengths are never compared. Equal vectors are indexed once with their k + 1 smallest ids, which
    is all a result can name, so a vector in most rows is one entry. Repeated rows count once; an empty table
    gives an empty result; extra columns are dropped.
    """
    kind, vector_kind = id_type(table, id_col), id_type(table, vector_col)
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("vec")) & F.col("id").isNotNull()).distinct()
    first = top_n(rows.select("id", "vec").distinct(), ["vec"], [F.col("id")], k + 1)
    index = durable(first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asking = rows.where("asks").select("id", "vec")
    queries = durable(asking.groupBy("vec").agg(F.min("id").alias("qkey")))
    shards, blocks = -(-max(index.count(), 1) // shard_rows), -(-max(queries.count(), 1) // block_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int")
    parts = index.select(place(shards).alias("shard"), every(blocks).alias("block"), F.size("vec").alias("dim"), "vec", "ids", F.lit(None).cast(kind).alias("qkey"))
    asked = queries.select(every(shards).alias("shard"), place(blocks).alias("block"), F.size("vec").alias("dim"), "vec", F.lit(None).cast(f"array<{kind}>").alias("ids"), "qkey")

    def cell(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        mine = np.array(group.column("ids").is_valid())
        dim = group.column("dim")[0].as_py()
        flat = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        vectors, wanted = flat[mine], flat[~mine]
        ids = group.column("ids").filter(pa.array(mine)).to_pylist()
        keys = group.column("qkey").filter(pa.array(~mine)).to_pylist()
        out: list[tuple] = []
        if len(vectors) and len(wanted):
            for q, found in enumerate(forest_candidates(vectors, wanted, trees, bits, int(enough * len(vectors)) + k + 1, seed)):
                far = distances(vectors[found], wanted[q])
                if len(far) > k + 1:
                    near = far <= np.partition(far, k)[k]
                    found, far = found[near], far[near]
                best = sorted((d, i) for d, r in zip(far.tolist(), found.tolist()) for i in ids[r])[: k + 1]
                out += [(keys[q], i, d) for d, i in best]
        id_kind = group.schema.field("qkey").type
        return pa.table({"qkey": pa.array([o[0] for o in out], id_kind), "vec_id": pa.array([o[1] for o in out], id_kind), "score": pa.array([o[2] for o in out], pa.float64())})

    found = parts.union(asked).groupBy("shard", "block", "dim").applyInArrow(cell, f"qkey {kind}, vec_id {kind}, score double")
    best = top_n(found, ["qkey"], [F.col("score"), F.col("vec_id")], k + 1).drop("rank")
    members = asking.join(queries, "vec").select(F.col("id").alias("query_id"), "qkey")
    own = members.join(best, "qkey").where(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
