"""Square-root-proportional stratified sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import broadcast_if_small, durable


def sqrt_quotas(df: DataFrame, stratum: str, target: int = 50_000, floor: int = 100) -> DataFrame:
    """(stratum, n, quota): target shared out by the root of the stratum sizes, with a floor."""
    sizes = durable(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")))
    all_roots = sizes.agg(F.sum(F.sqrt("n")).alias("s")).scalar()
    share = F.floor(F.sqrt("n") / all_roots * target)
    return sizes.withColumn("quota", F.greatest(F.lit(floor), share).cast("long"))


def stratified_sample(
    df: DataFrame, stratum: str, quotas: DataFrame, id: str = "openalex_id", seed: int = 42,
    salts: int = 64,
) -> DataFrame:
    """Up to ``quota`` rows of each stratum, those with the smallest hash of seed and id.

    quotas(stratum, n, quota). Hashes are uniform, so nearly all rows can be dropped in the scan by
    a bound on the hash that leaves a little more than the quota. The rows left are counted; should
    a stratum fall short, the bound is given up and all rows take part, so the result is exact.
    They are ranked in salted parts of the stratum first and then as a whole, and the payload joins
    back by id.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id).cast("string")))
    plan = broadcast_if_small(quotas.select(stratum, "n", "quota"))
    every = df.select(stratum, id, digest.alias("_hash")).join(plan, stratum)
    generous = F.col("quota") + 8 * F.sqrt("quota") + 64
    bound = F.lpad(F.lower(F.hex(F.floor(generous / F.col("n") * 2**32))), 8, "0")
    few = durable(
        every.where((generous >= F.col("n")) | (F.substring("_hash", 1, 8) < bound))
    )
    held = few.groupBy(stratum).agg(F.count(F.lit(1)).alias("_held"))
    short = quotas.join(held, stratum, "left").where(
        F.coalesce("_held", F.lit(0)) < F.least("n", "quota")
    )
    ranked = (few if short.isEmpty() else every).withColumn("_salt", F.pmod(F.xxhash64(id), F.lit(salts)))
    for keys in ([stratum, "_salt"], [stratum]):
        w = Window.partitionBy(*keys).orderBy("_hash", id)
        ranked = ranked.withColumn("_rank", F.row_number().over(w)).where("_rank <= quota").drop("_rank")
    return df.join(broadcast_if_small(ranked.select(id)), id, "left_semi")
