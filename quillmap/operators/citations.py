"""Citation network: edges, degrees and rank of works by iterated propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import broadcast_if_small, store

#: A work that cites more works has them in several lists.
LIST = 10_000


def citation_edges(works_raw: DataFrame) -> DataFrame:
    """(src, dst): a work and each other work that it cites, once."""
    cited = F.array_distinct(F.filter("referenced_works", lambda w: w.isNotNull() & (w != "")))
    rows = works_raw.where(F.coalesce("id", F.lit("")) != "").select(F.col("id").alias("src"), F.explode(cited).alias("dst"))
    return rows.where(F.col("src") != F.col("dst")).distinct()


def citation_degrees(works: DataFrame, edges: DataFrame, id: str = "openalex_id") -> DataFrame:
    """(id, n_cited, n_citing): how many works each work cites and how many known works cite it.

    Both counts come from one aggregation over both ends of the edges, combined before the shuffle, so a work
    that everybody cites is no hot task.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )).alias("e"))
    counts = ends.groupBy(F.col("e.id").alias(id)).agg(F.sum("e.out").alias("n_cited"), F.sum("e.into").alias("n_citing"))
    return works.select(id).distinct().join(counts, id, "left").fillna({"n_cited": 0, "n_citing": 0})


def citation_rank(
    works: DataFrame,
    edges: DataFrame,
    damping: float = 0.85,
    rounds: int = 30,
    tolerance: float = 1e-6,
    id: str = "openalex_id",
) -> DataFrame:
    """(id, rank): the standing of works by who cites them; the mean rank is 1.

    In each round a work hands ``damping`` of its rank on to the works it cites, in equal parts; works that cite none
    hand it on to all. It stops after ``rounds``, or when the mean change of a rank is below the tolerance.
    Edges with an end that is no known work do not count.

    Works are numbered once and the works that one cites are kept as lists of numbers, about LIST in one at most, so
    a round shuffles one row per list, and ranks. Sums are combined before the shuffle. Rounds are stored tables: a
    checkpoint's size estimate is multiplied in each join.
    """
    nodes = store(works.select(F.col(id).alias(id)).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select(id, F.lit(1.0).alias("rank"))
    numbers = nodes.select(F.col(id).alias("dst"), F.col("node").alias("_dst"))
    crowded = broadcast_if_small(edges.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("_parts")).where(F.col("_parts") > 1))
    known = edges.select("src", "dst").join(numbers, "dst").select("src", "_dst").join(crowded, "src", "left")
    part = F.pmod(F.xxhash64("_dst"), F.coalesce("_parts", F.lit(1))).alias("_part")
    cited = known.repartition("src").groupBy("src", part).agg(F.array_distinct(F.collect_list("_dst")).alias("cited"))
    share = 1 / F.sum(F.size("cited")).over(Window.partitionBy("src"))
    own = nodes.select(F.col(id).alias("src"), "node")
    lists = store(cited.withColumn("share", share).join(own, "src").select("node", "cited", "share"), "lists")
    citing = lists.select("node").distinct().withColumn("_citing", F.lit(True))
    ranks = store(nodes.join(citing, "node", "left").select("node", F.col("_citing").isNull().alias("dangling"), F.lit(1.0).alias("rank")), "ranks")
    handed_on = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
    lost = ranks.agg(handed_on).first()[0]
    for _ in range(rounds):
        shares = lists.join(ranks.select("node", "rank"), "node").select(F.explode("cited").alias("node"), (F.col("share") * F.col("rank")).alias("given"))
        given = shares.groupBy("node").agg(F.sum("given").alias("given"))
        new = F.lit(1 - damping) + F.lit(damping) * (F.coalesce("given", F.lit(0.0)) + F.lit(lost / n))
        step = store(ranks.join(given, "node", "left").select("node", "dangling", new.alias("rank"), F.col("rank").alias("_old")), "ranks")
        ranks = step.drop("_old")
        change, lost = step.agg(F.avg(F.abs(F.col("rank") - F.col("_old"))), handed_on).first()
        if change < tolerance:
            break
    return nodes.join(ranks, "node").select(id, "rank")
