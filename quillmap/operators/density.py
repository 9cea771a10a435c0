"""Density clusters of vectors of any number of dimensions, exact, without comparing all pairs.

A point is a core point if at least ``min_samples`` points, itself included, lie within ``eps``: its core distance is then
at most eps. Cutting the spanning forest of mutual reachability at eps leaves the components of core points whose
distance is at most eps; components below a least size, and points that are no core points, are noise.

Points meet in cells of side eps over the few axes in which they vary most, and are compared in all. Core points that share a
cell of diagonal eps over all axes are connected without a comparison and count as one node from then on.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from quillmap.operators.clustering import components
from quillmap.session import broadcast_if_small, exact_rank, store

#: A cell with more points is split, so that no join key holds more than about this many.
BLOCK = 2000
#: Blocks of one cell that are sent around together.
PARTS = 50
#: Pairs of points that a task compares at a time.
PAIRS = 1 << 20


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of a lie within eps of which rows of b; what rounding cannot tell apart is compared by differences."""
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    squares = a2[:, None] + b2 - 2 * (a @ b.T)
    slack = 1e-12 * (a.shape[1] + 1) * (a2.max() + b2.max() + eps * eps)
    near = squares <= eps * eps
    i, j = np.nonzero(np.abs(squares - eps * eps) <= slack)
    exact = np.zeros(len(i))
    for x, y in zip(a[i].T, b[j].T):
        exact += (x - y) * (x - y)
    near[i, j] = exact <= eps * eps
    return near


def _met(rows: DataFrame, axes: list[int], eps: float, carry: list[str]) -> PandasCogroupedOps:
    """Points of one block of a cell, with all points of the cells around it, as a pair of groups.

    Blocks hold about BLOCK points. Points around come in parts of at most PARTS blocks a cell, so no group grows with a crowded cell.
    """
    names = [f"_c{k}" for k in range(len(axes))]
    cells = [F.floor(F.element_at("v", a + 1) / eps).cast("long").alias(n) for a, n in zip(axes, names)]
    placed = rows.select("id", "v", *carry, F.size("v").alias("_size"), *cells)
    crowded = broadcast_if_small(placed.groupBy("_size", *names).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).where(F.col("_blocks") > 1))
    parts = ((crowded.agg(F.max("_blocks")).first()[0] or 1) - 1) // PARTS + 1
    blocks, keys = F.coalesce("_blocks", F.lit(1)), ["_size", *names, "_block", "_part"]
    own = placed.join(crowded, ["_size", *names], "left").withColumn("_block", F.pmod(F.xxhash64("id"), blocks).cast("int")).drop("_blocks")
    home = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(step)], F.lit(0).alias("none")) for step in itertools.product((-1, 0, 1), repeat=len(axes))])
    around = own.withColumn("_part", F.floor(F.col("_block") / PARTS).cast("int")).withColumn("_d", F.explode(steps)).select(
        *[F.col(c).alias(c) for c in ("id", "v", *carry, "_size", "_part")], *[(F.col(n) + F.col(f"_d.d{k}")).alias(n) for k, n in enumerate(names)]
    )
    probe = around.join(crowded, ["_size", *names], "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return home.groupBy(*keys).cogroup(probe.groupBy(*keys))


def core_points(rows: DataFrame, axes: list[int], eps: float, min_samples: int) -> DataFrame:
    """(id) of the core points; neighbours are counted inside a task, no pair leaves it."""

    def count(home: pa.Table, probe: pa.Table) -> pa.Table:
        a, n = probe["v"], np.zeros(len(probe), dtype=np.int64)
        if len(home) and len(probe):
            a, b = _matrix(a), _matrix(home["v"])
            step = max(1, PAIRS // len(b))
            for i in range(0, len(a), step):
                n[i : i + step] = _near(a[i : i + step], b, eps).sum(axis=1)
        return pa.table({"id": probe["id"], "n": n}).filter(pa.array(n > 0))

    kind = rows.schema["id"].dataType.simpleString()
    counts = _met(rows, axes, eps, []).applyInArrow(count, f"id {kind}, n long")
    return counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id")


def _linked_nodes(held: DataFrame, axes: list[int], eps: float) -> DataFrame:
    """(a, b): nodes a < b with points within eps of each other, once for each task that meets them."""

    def link(home: pa.Table, probe: pa.Table) -> pa.Table:
        ends = np.concatenate([probe["node"].to_numpy(), home["node"].to_numpy()])
        names, codes = np.unique(ends, return_inverse=True)
        own, other = codes[: len(probe)], codes[len(probe) :]
        found = [np.zeros(0, dtype=np.int64)]
        if len(home) and len(probe):
            a, b = _matrix(probe["v"]), _matrix(home["v"])
            step = max(1, PAIRS // len(b))
            for s in range(0, len(a), step):
                i, j = np.nonzero(_near(a[s : s + step], b, eps) & (own[s : s + step, None] < other))
                found.append(np.unique(own[s + i] * len(names) + other[j]))
        pairs = np.unique(np.concatenate(found))
        kind = probe.schema.field("node").type
        return pa.table({"a": pa.array(names[pairs // max(1, len(names))], kind), "b": pa.array(names[pairs % max(1, len(names))], kind)})

    kind = held.schema["node"].dataType.simpleString()
    return _met(held, axes, eps, ["node"]).applyInArrow(link, f"a {kind}, b {kind}")


def density_cluster_nd(
    vectors: DataFrame,
    eps: float,
    min_samples: int = 5,
    min_cluster_size: int = 10,
    id: str = "openalex_id",
    embedding: str = "embedding",
    join_axes: int = 3,
) -> DataFrame:
    """(id, cluster_id): clusters of core points by size, noise -1.

    ids are distinct. Rows with a null vector or one with null or infinite parts are noise. ``join_axes`` axes make the cells
    in which points meet; every point looks into 3^join_axes of them.
    """
    whole = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = vectors.where(whole).select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = store(usable, "points")
    spread = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "k").collect()  # one row per dimension
    dim = len(spread)
    axes = [r["k"] for r in spread[:join_axes]]
    core = rows.join(core_points(rows, axes, eps, min_samples), "id", "left_semi")
    fine = F.transform("v", lambda x: F.floor(x * (math.sqrt(max(dim, 1)) / eps)))
    celled = store(core.withColumn("_fine", F.array_join(fine.cast("array<string>"), "/")), "core")
    nodes = celled.groupBy("_fine").agg(F.min("id").alias("node"))
    held = store(celled.join(nodes, "_fine").select("id", "v", "node"), "nodes")
    joined = components(held.select("node").distinct(), _linked_nodes(held, axes, eps).distinct())
    labelled = held.select("id", "node").join(joined, "node").select("id", "component")
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_cluster_size)
    numbers = exact_rank(sizes, [], [F.desc("size"), F.col("component")], "_number")
    named = labelled.join(numbers, "component").select(F.col("id").alias(id), (F.col("_number") - 1).cast("int").alias("cluster_id"))
    return vectors.select(id).join(named, id, "left").select(id, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
