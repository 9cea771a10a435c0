"""Research trajectories and the map over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import durable

KEY = ["focal_id", "cluster_id"]


def year_nodes(papers: DataFrame) -> DataFrame:
    """(focal_id, cluster_id, year, spine_id, last): one row per cluster and year of a trajectory.

    spine_id is the most cited paper, ties to the smaller id. ``last`` holds the last paper in the
    order most cited first, then id. One aggregation with map-side combination serves all edges.
    """
    order = F.struct((-F.col("citations")).alias("c"), F.col("paper_id").alias("i"))
    return papers.groupBy(*KEY, "year").agg(F.min(order)["i"].alias("spine_id"), F.max(order).alias("last"))


def _origins(nodes: DataFrame) -> DataFrame:
    timeline = nodes.groupBy("focal_id", "year").agg(F.max("last")["i"].alias("_last"))
    by_year = Window.partitionBy("focal_id").orderBy("year")
    timeline = timeline.select(
        "focal_id", F.col("year").alias("first_year"), F.lag("_last").over(by_year).alias("origin_id")
    )
    starts = nodes.groupBy(*KEY).agg(F.min("year").alias("first_year"))
    return starts.join(timeline, ["focal_id", "first_year"])


def fork_origins(papers: DataFrame) -> DataFrame:
    """(focal_id, cluster_id, first_year, origin_id): where a cluster branches off.

    papers(focal_id, paper_id, cluster_id, year, citations). The origin is the last paper of any
    cluster in the order (year, most cited first, id) before the cluster's first year; null for a
    cluster that starts the trajectory. The timeline is reduced to one row per year first, then the
    previous row is the answer, so there is no range join.
    """
    return _origins(durable(year_nodes(papers)))


def trajectory_edges(papers: DataFrame) -> DataFrame:
    """(focal_id, cluster_id, edge_kind, from_id, to_id): fork, spine and spoke edges.

    Spine edges join consecutive years of a cluster, a fork edge leads from the origin to the first
    spine paper, spokes from a spine paper to the other papers of its year.
    """
    nodes = durable(year_nodes(papers))
    spine = nodes.drop("last")
    by_year = Window.partitionBy(*KEY).orderBy("year")
    steps = spine.withColumn("_from", F.lag("spine_id").over(by_year))
    backbone = steps.where(F.col("_from").isNotNull()).select(
        *KEY, F.lit("spine").alias("edge_kind"), F.col("_from").alias("from_id"), F.col("spine_id").alias("to_id")
    )
    forks = (
        _origins(nodes)
        .where(F.col("origin_id").isNotNull())
        .withColumnRenamed("first_year", "year")
        .join(spine, [*KEY, "year"])
        .select(*KEY, F.lit("fork").alias("edge_kind"), F.col("origin_id").alias("from_id"), F.col("spine_id").alias("to_id"))
    )
    spokes = (
        papers.join(spine, [*KEY, "year"])
        .where(F.col("paper_id") != F.col("spine_id"))
        .select(*KEY, F.lit("spoke").alias("edge_kind"), F.col("spine_id").alias("from_id"), F.col("paper_id").alias("to_id"))
    )
    return backbone.unionByName(forks).unionByName(spokes)


def landscape_until(df: DataFrame, at: int, mode: str = "cumulative", year: str = "year") -> DataFrame:
    """Papers up to a year, or of that year only."""
    if mode not in ("cumulative", "slice"):
        raise ValueError(f"unknown mode: {mode}")
    return df.where(F.col(year) <= at) if mode == "cumulative" else df.where(F.col(year) == at)


def cumulative_by_year(df: DataFrame, year: str = "year", keys: list[str] = ()) -> DataFrame:
    """Papers per year and up to each year, per key. Counting comes first, the window sees years."""
    counts = df.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("n_until", F.sum("n").over(running))


def cluster_evolution(
    df: DataFrame, cluster: str = "cluster_id", year: str = "year", size: float = 12.0
) -> DataFrame:
    """(cluster, year, n_until, x, y, bubble): cumulative size and centroid of each cluster by year."""
    sums = df.groupBy(cluster, year).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("x").alias("_sx"), F.sum("y").alias("_sy")
    )
    running = Window.partitionBy(cluster).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("_n").over(running)
    return sums.select(
        cluster, year, n.alias("n_until"),
        (F.sum("_sx").over(running) / n).alias("x"),
        (F.sum("_sy").over(running) / n).alias("y"),
        (F.sqrt(n) * size).alias("bubble"),
    )
