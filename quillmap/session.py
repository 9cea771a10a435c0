"""Session helpers shared by all operators: durable intermediates and skew-proof ranking."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and scratch tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``. A temporary folder is used only
    in local mode, where driver and executors share one disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="quillmap-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Materialise once in reliable storage and cut the lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Materialise a side that should be small, and broadcast it only if it is.

    Size estimates of aggregated or semi-joined tables are those of their inputs, so Spark would
    shuffle the large side. The rows are counted instead; beyond the bound the table is returned
    as it is and Spark joins by shuffle.
    """
    stored = durable(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


#: Rows of a join or a grouping that one task gets; the number of tasks grows with the rows, not the share of a task.
ROWS_A_TASK = 250_000


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as ``rows`` asks for, to all cores at least.

    Joins and groupings by the keys use this placement. With the session's number of partitions, or what
    adaptive execution merges by bytes, a task would hold more rows the larger the tables are.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // ROWS_A_TASK)), *keys)


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join of two large tables that together have about ``rows`` rows, both dealt by the keys."""
    return deal(left, rows, *keys).join(deal(right, rows, *keys), keys, how)


def join_selected(big: DataFrame, selected: DataFrame, keys: list[str], rows: int, how: str = "inner", max_rows: int = 500_000) -> DataFrame:
    """Join of a table of ``rows`` rows with a selection: broadcast if that is small, else both are dealt."""
    stored = store(selected, "selected")
    n = stored.count()
    if n <= max_rows:
        return big.join(F.broadcast(stored), keys, how)
    return join_dealt(big, stored, keys, rows + n, how)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back; for results that are read column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread_scan(scan: DataFrame) -> DataFrame:
    """A file scan with fewer splits than cores, dealt out to all cores; other scans stay as they are.

    For costly work per row, such as parsing text, on few files or row groups.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of an integer value up to each row inside its key, also when one key holds most of the rows.

    A window over the key alone would sort a hot key in one task. Here rows are placed by range on
    (key, order), summed inside each (placement, key), and shifted by the sums of the earlier
    placements of the same key. Only keys cut by a range border need a shift, so the shift table
    has fewer rows than there are partitions and may be broadcast. The placement is checkpointed
    because its borders are sampled and must be the same for both passes. The order must be total.
    """
    part, given = "_placement", "_given"
    placed = durable(
        df.withColumn(given, value.cast("long"))
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn(part, F.spark_partition_id())
    )
    sums = placed.groupBy(part, *keys).agg(F.sum(given).alias("_sum"))
    # per key a row for each placement it touches; without keys one row per partition
    by_part = Window.partitionBy(*keys).orderBy(part) if keys else Window.orderBy(part)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        sums.withColumn("_shift", F.sum("_sum").over(earlier))
        .where(F.col("_shift").isNotNull())
        .drop("_sum")
    )
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn(name, F.sum(given).over(inside))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [part, *keys]]
    return (
        summed.alias("l")
        .join(F.broadcast(shift).alias("r"), on, "left")
        .select(
            *[F.col(f"l.{c}") for c in df.columns],
            (F.col(f"l.{name}") + F.coalesce("r._shift", F.lit(0))).cast("long").alias(name),
        )
    )


def exact_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows 1..n inside each key without gathering a key in one task."""
    return running_sum(df, keys, order, F.lit(1), name)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank"):
    """First n rows per key.

    With a constant n, Spark adds a partial group limit before the shuffle, so each task sends at
    most n rows per key whatever the skew. Above Spark's threshold for that rule the same is done by hand
    in two rounds over a salted key.
    """
    spark = df.sparkSession
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n >= limit:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(256))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_first", F.row_number().over(first))
            .where(F.col("_first") <= n)
            .drop("_first", "_salt")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
