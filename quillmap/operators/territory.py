"""Positions, outlines, densities and territories on the map."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.operators.quality import top_values
from quillmap.session import broadcast_if_small, exact_rank


def group_medians(points: DataFrame, group: str, min_points: int = 5) -> DataFrame:
    """(group, n, x, y): median position of groups with enough points.

    Exact medians by rank, so a group of any size never gathers in one aggregation buffer.
    """
    sizes = points.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)
    sizes = broadcast_if_small(sizes)
    out = sizes
    for axis in ("x", "y"):
        ranked = exact_rank(points.select(group, axis), [group], [F.col(axis)], "_rank")
        middle = ranked.join(sizes, group).where(
            (F.col("_rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("_rank") == F.floor(F.col("n") / 2) + 1)
        )
        out = out.join(middle.groupBy(group).agg(F.avg(axis).alias(axis)), group)
    return out


def cluster_centroids(points: DataFrame, group: str = "cluster_id", min_points: int = 3) -> DataFrame:
    """(group, n, x, y): mean position of clusters with enough points."""
    return (
        points.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
        .where(F.col("n") >= min_points)
    )


def cluster_ellipses(
    points: DataFrame, group: str = "cluster_id", scale: float = 2.0, min_points: int = 3, floor: float = 1e-6
) -> DataFrame:
    """(group, n, x, y, half_major, half_minor, angle): confidence ellipse from the 2 x 2 covariance."""
    moments = points.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"),
    ).where(F.col("n") >= min_points)
    trace = F.col("vx") + F.col("vy")
    gap = F.sqrt(F.pow(F.col("vx") - F.col("vy"), 2) + 4 * F.pow(F.col("c"), 2))
    half = lambda value: scale * F.sqrt(F.greatest(value / 2, F.lit(floor)))
    return moments.select(
        group, "n", "x", "y",
        half(trace + gap).alias("half_major"),
        half(trace - gap).alias("half_minor"),
        (F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2).alias("angle"),
    )


def assign_territories(
    df: DataFrame, level: str = "field", top_n_values: int | None = None, min_fill: float = 0.3,
    other: str = "Other",
) -> DataFrame:
    """Adds ``territory``: one of the most frequent fields (4) or subfields (7), else Other.

    If too few rows have the wanted column, the other one is used; if that is as empty, geometric
    groups of the coordinates are.
    """
    column, spare = ("field", "subfield") if level == "field" else ("subfield", "field")
    most = top_n_values or (4 if level == "field" else 7)
    fill = {c: F.avg((F.coalesce(c, F.lit("")) != "").cast("int")) for c in (column, spare) if c in df.columns}
    shares = df.agg(*[v.alias(c) for c, v in fill.items()], F.count(F.lit(1)).alias("_rows")).first()
    used = next((c for c in fill if (shares[c] or 0.0) >= min_fill), None)
    if used is None:
        return _geometric_groups(df, min(most, max(3, shares["_rows"] // 50)))
    # at most top_n_values rows
    names = top_values(df, used, most).select(F.col(used).alias("territory"))
    return df.join(F.broadcast(names), F.col(used) == F.col("territory"), "left").withColumn(
        "territory", F.coalesce("territory", F.lit(other))
    )


def _geometric_groups(df: DataFrame, k: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x", "y"], outputCol="_v").transform(df)
    model = KMeans(k=k, seed=42, featuresCol="_v", predictionCol="_g").fit(rows)
    return model.transform(rows).withColumn(
        "territory", F.concat(F.lit("Group "), F.col("_g").cast("string"))
    ).drop("_v", "_g")


def map_extent(points: DataFrame, pad: float = 0.08) -> DataFrame:
    """One row (x_min, x_max, y_min, y_max), padded on all sides by a share of the x range."""
    room = (F.max("x") - F.min("x")) * pad
    return points.agg(
        (F.min("x") - room).alias("x_min"), (F.max("x") + room).alias("x_max"),
        (F.min("y") - room).alias("y_min"), (F.max("y") + room).alias("y_max"),
    )


def kde_grid(
    points: DataFrame,
    group: str = "territory",
    bins: int = 200,
    bandwidth: float = 0.2,
    pad: float = 0.08,
    min_points: int = 10,
    binned: bool = False,
    spread: int = 16,
) -> DataFrame:
    """(group, gx, gy, x, y, density): Gaussian kernel density of each group on a bins x bins grid.

    Kernel covariance is bandwidth^2 times the group's sample covariance. Groups with fewer than
    min_points or a singular covariance are left out. Every point enters by itself, whatever the size
    of its group: the work is linear in the points, a group is dealt to ``spread`` tasks, and a task
    adds up whole grids without a row per point and cell. With ``binned`` the points are first
    counted per nearest grid cell, for all groups alike, and the counts of each group are convolved with its
    kernel once: the counting combines before the shuffle, and the rest no longer grows with the points.
    """
    # four numbers, needed as constants for the grid
    e = map_extent(points, pad).first()
    step_x = (e["x_max"] - e["x_min"]) / (bins - 1) if e["x_min"] is not None else 0.0
    step_y = (e["y_max"] - e["y_min"]) / (bins - 1) if e["y_min"] is not None else 0.0
    at_x = lambda i: F.lit(e["x_min"]) + i * step_x
    at_y = lambda i: F.lit(e["y_min"]) + i * step_y
    moments = points.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
        F.covar_samp("x", "y").alias("c"),
    )
    h = bandwidth * bandwidth
    det = (F.col("vx") * F.col("vy") - F.col("c") * F.col("c")) * (h * h)
    kernel = moments.where(F.col("n") >= min_points).withColumn("det", det).where(F.col("det") > 1e-300).select(
        group,
        (F.col("vy") * h / F.col("det")).alias("ixx"),
        (F.col("vx") * h / F.col("det")).alias("iyy"),
        (-F.col("c") * h / F.col("det")).alias("ixy"),
        (F.col("n") * 2 * math.pi * F.sqrt("det")).alias("scale"),
    )
    if binned:
        return _binned_grid(points, kernel, group, bins, e, step_x, step_y).select(
            group, "gx", "gy", at_x(F.col("gx")).alias("x"), at_y(F.col("gy")).alias("y"), "density"
        )
    support = points.select(group, F.col("x").alias("px"), F.col("y").alias("py"), F.lit(1).cast("long").alias("w"))
    dealt = support.join(broadcast_if_small(kernel), group).repartition(
        F.col(group), F.pmod(F.xxhash64("px", "py"), F.lit(spread))
    )
    if e["x_min"] is None:
        xs = ys = np.zeros(bins)
    else:
        xs, ys = e["x_min"] + np.arange(bins) * step_x, e["y_min"] + np.arange(bins) * step_y
    parts = dealt.mapInPandas(_grid_sums(group, xs, ys), f"{group} {dict(points.dtypes)[group]}, grid array<double>")
    cell = F.col("cell")
    gx, gy = F.pmod(cell, F.lit(bins)).cast("int"), F.floor(cell / bins).cast("int")
    return (
        parts.select(group, F.posexplode("grid").alias("cell", "part"))
        .groupBy(group, "cell")
        .agg(F.sum("part").alias("density"))
        .select(group, gx.alias("gx"), gy.alias("gy"), at_x(gx).alias("x"), at_y(gy).alias("y"), "density")
    )


def _binned_grid(points: DataFrame, kernel: DataFrame, group: str, bins: int, extent, step_x: float, step_y: float) -> DataFrame:
    """(group, gx, gy, density) from counts per cell; a group has at most bins * bins of them, whatever its points."""
    near = lambda v, low, step: F.when(F.lit(step) > 0, F.round((v - low) / (step or 1.0))).otherwise(0).cast("int")
    counts = points.groupBy(
        group, near(F.col("x"), extent["x_min"], step_x).alias("i"), near(F.col("y"), extent["y_min"], step_y).alias("j")
    ).agg(F.count(F.lit(1)).alias("w"))
    offsets = (np.arange(2 * bins) + bins) % (2 * bins) - bins  # 0, 1, ..., -2, -1: a kernel laid round the corner
    dx, dy = offsets[None, :] * step_x, offsets[:, None] * step_y
    gy, gx = np.divmod(np.arange(bins * bins, dtype=np.int32), bins)

    def convolve(own: pd.DataFrame) -> pd.DataFrame:
        k = own.iloc[0]
        held = np.zeros((2 * bins, 2 * bins))
        held[own["j"].to_numpy(), own["i"].to_numpy()] = own["w"].to_numpy()
        bell = np.exp(-(dx * dx * k["ixx"] + 2 * dx * dy * k["ixy"] + dy * dy * k["iyy"]) / 2) / k["scale"]
        out = np.fft.irfft2(np.fft.rfft2(held) * np.fft.rfft2(bell), held.shape)[:bins, :bins]
        return pd.DataFrame({group: k[group], "gx": gx, "gy": gy, "density": np.maximum(out, 0.0).ravel()})

    kind = dict(points.dtypes)[group]
    return counts.join(kernel, group).groupBy(group).applyInPandas(convolve, f"{group} {kind}, gx int, gy int, density double")


def _grid_sums(group: str, xs: np.ndarray, ys: np.ndarray, held: int = 64, block: int = 64):
    """Task: sum of the kernels of its points on the whole grid, one row per group; at most ``held`` grids at a time."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids: dict = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame({group: list(grids), "grid": [g.ravel() for g in grids.values()]})

        for batch in batches:
            for name, own in batch.groupby(group, sort=False):
                k = own.iloc[0]
                grid = grids.setdefault(name, np.zeros((len(ys), len(xs))))
                px, py, w = (own[c].to_numpy(dtype=float) for c in ("px", "py", "w"))
                for at in range(0, len(own), block):
                    dx = (xs[None, :] - px[at : at + block, None])[:, None, :]
                    dy = (ys[None, :] - py[at : at + block, None])[:, :, None]
                    energy = dx * dx * k["ixx"] + 2 * dx * dy * k["ixy"] + dy * dy * k["iyy"]
                    grid += np.tensordot(w[at : at + block], np.exp(-energy / 2), axes=1) / k["scale"]
                if len(grids) >= held:
                    yield rows()
                    grids.clear()
        if grids:
            yield rows()

    return task


def territory_cells(grid: DataFrame, group: str = "territory", percentile: float = 0.08) -> DataFrame:
    """(gx, gy, group, density, share): winner of each cell; cells of very low density stay empty.

    The threshold is a percentile of the winners' positive densities; share is the winner's density
    over its own largest one. The grid has a fixed number of cells per group.
    """
    winner = grid.groupBy("gx", "gy").agg(
        F.max_by(F.struct(F.col(group), "density"), F.struct("density", F.col(group))).alias("w")
    ).select("gx", "gy", f"w.{group}", "w.density")
    bound = winner.where(F.col("density") > 0).agg(F.percentile("density", F.lit(percentile)).alias("v")).scalar()
    peaks = grid.groupBy(group).agg(F.max("density").alias("_peak"))
    return (
        winner.where(F.col("density") >= bound).where(F.col("density") > 0)
        .join(peaks, group)
        .select("gx", "gy", group, "density", (F.col("density") / F.col("_peak")).alias("share"))
    )


def dominance_peaks(
    grid: DataFrame, points: DataFrame | None = None, group: str = "territory"
) -> DataFrame:
    """(group, x, y, dominance): cell where a group's density most exceeds all others.

    Ties go to the first cell, row by row. Groups of the points that have no density get their
    median position.
    """
    cell = Window.partitionBy("gx", "gy")
    order = cell.orderBy(F.desc("density"), group)
    ranked = grid.withColumn("_place", F.row_number().over(order))
    best = F.max(F.when(F.col("_place") == 1, F.col("density"))).over(cell)
    second = F.max(F.when(F.col("_place") == 2, F.col("density"))).over(cell)
    rival = F.when(F.col("_place") == 1, F.coalesce(second, F.lit(0.0))).otherwise(best)
    lead = ranked.withColumn("dominance", F.col("density") - rival)
    first = F.struct(F.round("dominance", 12).alias("d"), (-F.col("gy")).alias("r"), (-F.col("gx")).alias("c"))
    peaks = lead.groupBy(group).agg(F.max_by(F.struct("x", "y", "dominance"), first).alias("p")).select(
        group, "p.x", "p.y", "p.dominance"
    )
    if points is None:
        return peaks
    rest = points.join(peaks.select(group), group, "left_anti")
    medians = group_medians(rest, group, 1).select(group, "x", "y", F.lit(None).cast("double").alias("dominance"))
    return peaks.unionByName(medians)


def territory_labels(points: DataFrame, group: str = "territory", min_points: int = 5) -> DataFrame:
    """(group, n, x, y, position): label places of territories, largest first, Other last."""
    medians = group_medians(points, group, min_points)
    last = (F.col(group) == "Other").cast("int")
    ordered = medians.withColumn("_last", last)
    ranked = exact_rank(ordered, [], [F.col("_last"), F.desc("n"), F.col(group)], "position")
    return ranked.drop("_last")
