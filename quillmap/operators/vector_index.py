"""Semantic search: vectors stored by coarse cell, queries that read only the cells nearest to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.vectors import dot, l2_norm, l2_normalize
from quillmap.operators.embedding import embed_texts
from quillmap.session import broadcast_if_small, durable, top_n

#: (vectors(cell, id, embedding), centres(cell, centre)), stored.
VectorIndex = tuple[DataFrame, DataFrame]

MOST_CELLS = 4096


def cell_count(n: int) -> int:
    """About as many cells as vectors in each, within bounds."""
    return max(1, min(MOST_CELLS, int(n**0.5)))


def usable_vectors(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """Unit vectors; null and zero ones and those with null or infinite parts take no part."""
    rows = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("_v"))
    whole = F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # not a number is not smaller
    return rows.where(whole & (l2_norm(F.col("_v")) > 0)).select("id", l2_normalize(F.col("_v")).alias("embedding"))


def store_vector_index(
    vectors: DataFrame,
    path: str,
    id: str = "openalex_id",
    embedding: str = "embedding",
    cells: int | None = None,
    train_rows: int = 100_000,
    seed: int = 42,
) -> VectorIndex:
    """Write all vectors below a folder, one folder per cell.

    The centres are fitted on at most ``train_rows`` vectors, those with the smallest hash of their id; every vector
    is stored. The rebalance hint lets adaptive execution split a cell with very many vectors.
    """
    spark = vectors.sparkSession
    rows = durable(usable_vectors(vectors, id, embedding))
    n = rows.count()
    sample = rows.withColumn("_order", F.xxhash64("id")).orderBy("_order", "id").limit(train_rows) if n > train_rows else rows
    trained = durable(sample.select(array_to_vector("embedding").alias("_v")))
    if n:
        model = KMeans(k=cells or cell_count(n), seed=seed, featuresCol="_v", predictionCol="cell").fit(trained)
        placed = model.transform(rows.withColumn("_v", array_to_vector("embedding"))).drop("_v")
        centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
    else:
        placed, centres = rows.withColumn("cell", F.lit(0)), []
    placed.select("id", "embedding", "cell").hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    schema = f"id {dict(rows.dtypes)['id']}, embedding array<double>, cell int"
    return spark.read.schema(schema).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centres")


def nearest_cells(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, q, cell) of the cells whose centres point most in the direction of each query."""
    asked = _asked_cells(index, queries, probes)
    return asked.select("query_id", "q", F.explode("cells").alias("cell"))


def _asked_cells(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, q, cells): as an array."""
    # at most MOST_CELLS centres, one row
    table = index[1].agg(F.collect_list(F.struct("cell", l2_normalize(F.col("centre")).alias("c"))).alias("_all"))
    scored = lambda q: F.transform("_all", lambda c: F.struct((-dot(q, c["c"])).alias("d"), c["cell"].alias("cell")))
    best = F.slice(F.sort_array(scored(F.col("q"))), 1, probes)
    return queries.crossJoin(F.broadcast(table)).select("query_id", "q", F.transform(best, lambda b: b["cell"]).alias("cells"))


#: Queries and vectors that one task compares at a time.
QUERY_BLOCK, VECTOR_BLOCK = 8192, 65536


def _best_of(k: int, without_self: bool, masked: bool):
    """Task: the k best vectors of a part for each query of a block, by matrix products in slices."""

    def task(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids = asked["query_id"].combine_chunks(), held["id"].combine_chunks()
        if not len(names) or not len(ids):  # a block without a part of the vectors, or the other way round
            return pa.table({"query_id": names[:0], "id": ids[:0], "score": pa.array([], pa.float64())})
        q, v = (np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1) for c in (asked["q"], held["embedding"]))
        found_q, found_v, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        if without_self:
            code = pa.concat_arrays([names, ids]).dictionary_encode().indices.to_numpy()
        if masked:
            cell = held["cell"].to_numpy()
            cells = asked["cells"].combine_chunks()
            owner = np.repeat(np.arange(len(names)), np.asarray(cells.value_lengths()))
            open_ = np.zeros((len(names), max(cell.max(initial=0), np.asarray(cells.flatten()).max(initial=0)) + 1), bool)
            open_[owner, np.asarray(cells.flatten())] = True
        step = max(1, (1 << 23) // max(1, len(v)))
        for i in range(0, len(q) if len(v) else 0, step):
            score = q[i : i + step] @ v.T
            if masked:
                score[~open_[i : i + step][:, cell]] = -np.inf
            if without_self:
                score[code[i : i + len(score), None] == code[None, len(names) :]] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k] if len(v) > k else np.full(len(score), -np.inf)
            # what rounding may tell apart otherwise is compared again
            at, to = np.nonzero((score >= (least - 1e-9)[:, None]) & (score > -np.inf))
            # added up one by one, as ``dot`` does
            exact = np.concatenate([np.zeros(0)] + [np.cumsum(q[i + at[j : j + 65536]] * v[to[j : j + 65536]], axis=1)[:, -1] for j in range(0, len(at), 65536)])
            order = np.lexsort((place[to], -np.round(exact, 12), at))
            first = np.searchsorted(at[order], np.arange(len(score)))
            kept = order[np.arange(len(order)) - first[at[order]] < k]
            found_q.append(i + at[kept])
            found_v.append(to[kept])
            found_s.append(exact[kept])
        own, other = pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_v))
        return pa.table({"query_id": names.take(own), "id": ids.take(other), "score": pa.array(np.concatenate(found_s))})

    return task


def _search_blocks(index: VectorIndex, asked: DataFrame, k: int, masked: bool, without_self: bool) -> DataFrame:
    """(query_id, id, score) with the best k of each part of the vectors; asked(query_id, q[, cells]).

    Blocks of queries meet parts of the vectors, both bounded, so a task holds little whatever the number of either,
    and all that leaves it is k rows a query.
    """
    asked = durable(asked)
    n, rows = asked.count(), index[0].count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = max(1, -(-rows // VECTOR_BLOCK), -(-4 * asked.sparkSession.sparkContext.defaultParallelism // blocks))
    spread = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("_block", spread("query_id", blocks)).withColumn("_part", every(parts))
    # the parts of equal ids are the same, so the hash is salted against that of the blocks
    right = index[0].select("id", "embedding", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("_part")).withColumn("_block", every(blocks))
    kinds = dict(asked.dtypes)["query_id"], dict(index[0].dtypes)["id"]
    near = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part"))
    return near.applyInArrow(_best_of(k, without_self, masked), f"query_id {kinds[0]}, id {kinds[1]}, score double")


def search_vectors(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 16, without_self: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k most similar vectors of each query by cosine, ties to the smaller id.

    queries(query_id, embedding). If each query asks few cells, only the folders of the asked ones are read; queries are
    counted and broadcast if they are few, so vectors are not shuffled, and each task keeps k rows a query. From a
    quarter of the cells on, blocks of queries are compared with all vectors as matrix products, and those in other
    cells masked. As many probes as cells give the exact answer.
    """
    units = usable_vectors(queries, "query_id", "embedding").withColumnsRenamed({"id": "query_id", "embedding": "q"})
    # equal vectors tie whatever the order in which their products were added
    order: list[Column] = [F.desc(F.round("score", 12)), F.col("id")]
    cells = index[1].count()
    if 0 < cells <= 4 * probes:
        masked = probes < cells
        asked = _asked_cells(index, units, probes) if masked else units
        return top_n(_search_blocks(index, asked, k, masked, without_self), ["query_id"], order, k)
    asked = durable(nearest_cells(index, units, probes))
    own = [r[0] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
    held = index[0].where(F.col("cell").isin(own)).join(broadcast_if_small(asked, 100_000), "cell")
    if without_self:
        held = held.where(F.col("id") != F.col("query_id"))
    scored = held.select("query_id", "id", dot(F.col("q"), F.col("embedding")).alias("score"))
    return top_n(scored, ["query_id"], order, k)


def semantic_search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 16, **encoder) -> DataFrame:
    """(query_id, rank, id, score) for queries(query_id, text), through the encoder of the vectors."""
    return search_vectors(index, embed_texts(queries, "query_id", "text", **encoder).select("query_id", "embedding"), k, probes)
