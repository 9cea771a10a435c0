"""Projections and clusters of many keys at once: each key has a space and clusters of its own.

No key above a fixed number of rows is gathered in one task and none is looped over on the driver, so the answer for
a key does not depend on which other keys are in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import broadcast_if_small, deal, durable, top_n

#: Bounds of the numbers of coarse and fine clusters, with the exponents of their growth.
COARSE, FINE = (3, 8, 0.33), (8, 30, 0.5)
#: Keys with at most as many rows are projected and clustered by one task each.
LOCAL_ROWS = 20_000


def _moments(key: str, embedding: str, held: int = 256):
    """Task: (key, n, sum, sum of products) of its rows; at most ``held`` keys at a time."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame(
                [(k, n, s.tolist(), p.ravel().tolist()) for k, (n, s, p) in sums.items()], columns=[key, "n", "s", "p"]
            )

        for batch in batches:
            for k, own in batch.groupby(key, sort=False):
                x = np.stack(own[embedding].to_numpy()).astype(np.float64)
                n, s, p = sums.get(k, (0, 0.0, 0.0))
                sums[k] = (n + len(x), s + x.sum(axis=0), p + x.T @ x)
                if len(sums) >= held:
                    yield rows()
                    sums.clear()
        if sums:
            yield rows()

    return task


def _axes(n: int, total: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and first two principal axes; zeros for fewer than five rows."""
    mean, d = total / n, len(total)
    if n < 5 or d < 2:
        return mean, np.zeros(d), np.zeros(d)
    cov = products.reshape(d, d) / n - np.outer(mean, mean)
    # rounding to a scale makes the axes the same however the sums were split
    values, columns = np.linalg.eigh(np.round(cov, 13))
    first, second = (columns[:, -i] * (np.sign(columns[np.abs(columns[:, -i]).argmax(), -i]) or 1.0) for i in (1, 2))
    return mean, first, second


def _project_of(columns: list[str]):
    """Task: the places of the rows of one key."""

    def task(own: pa.Table) -> pa.Table:
        v = _matrix(own["_v"])
        mean, first, second = _axes(len(v), v.sum(axis=0), v.T @ v)
        places = [pa.array((v - mean) @ axis, pa.float64()) for axis in (first, second)]
        return own.select(columns).append_column("x", places[0]).append_column("y", places[1])

    return task


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    return durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))


def _schema(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def project_2d_by(
    vectors: DataFrame, key: str, id: str, embedding: str = "embedding", local_rows: int = LOCAL_ROWS, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, id, keep, x, y): first two principal components of each key's vectors, centred.

    A key of at most ``local_rows`` rows is projected by one task. For larger ones tasks add up moments; a key's
    moments are one row a task, joined to one covariance of dim x dim. The largest loading of each axis is
    positive. Keys with fewer than five rows lie at (0, 0). The input is read twice, once for its keys alone; its
    vectors are not written, so they should come from stored tables. ``keep`` names columns to carry along.
    """
    columns = [key, id, *keep]
    rows = vectors.select(*columns, F.col(embedding).alias("_v"))
    sizes = _sizes(rows, [key])
    crowded = sizes.where(F.col("_n") > local_rows).select(key)
    large = not crowded.isEmpty()
    few = rows.join(F.broadcast(crowded), key, "left_anti") if large else rows
    n = sizes.where(F.col("_n") <= local_rows).agg(F.sum("_n")).first()[0] or 0
    own = deal(few, n, key).groupBy(key).applyInArrow(_project_of(columns), f"{_schema(rows, columns)}, x double, y double")
    return own.unionByName(_project_large(rows.join(F.broadcast(crowded), key, "left_semi"), key, columns)) if large else own


def _project_large(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    rows = durable(rows.withColumn("_v", F.col("_v").cast("array<double>")))
    kind = dict(rows.dtypes)[key]
    parts = rows.select(key, "_v").mapInPandas(_moments(key, "_v"), f"{key} {kind}, n bigint, s array<double>, p array<double>")

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = [np.sum(np.stack(pdf[c].to_numpy()), axis=0) for c in ("s", "p")]
        found = [x.tolist() for x in _axes(int(pdf["n"].sum()), *sums)]
        return pd.DataFrame([(pdf[key].iloc[0], *found)], columns=[key, "_m", "_a", "_b"])

    fitted = parts.groupBy(key).applyInPandas(axes, f"{key} {kind}, _m array<double>, _a array<double>, _b array<double>")
    centred = F.zip_with("_v", "_m", lambda v, m: v - m)
    dot = lambda axis: F.aggregate(F.zip_with("_c", axis, lambda v, a: v * a), F.lit(0.0), lambda s, x: s + x)
    joined = rows.join(durable(fitted), key).withColumn("_c", centred)
    return joined.select(*columns, dot("_a").alias("x"), dot("_b").alias("y"))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, ties to the smaller one."""
    norms = (centres**2).sum(axis=1)
    squares = norms - 2 * (v @ centres.T)
    best = squares.argmin(axis=1)
    # what rounding cannot tell apart is compared anew, by differences
    slack = 1e-9 * ((v**2).sum(axis=1) + norms.max() + 1e-300)
    close = squares <= (squares.min(axis=1) + slack)[:, None]
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        some = np.flatnonzero(close[i])
        best[i] = some[((centres[some] - v[i]) ** 2).sum(axis=1).argmin()]
    return best


def _clusters(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Cluster of each row; seeds are the first different rows."""
    seeds, seen = [], set()
    for i, place in enumerate(v + 0.0):
        if len(seeds) == k:
            break
        if place.tobytes() not in seen:
            seen.add(place.tobytes())
            seeds.append(i)
    centres = v[seeds]
    for _ in range(rounds):
        cluster = _nearest(v, centres)
        n = np.bincount(cluster, minlength=len(centres))
        sums = np.stack([np.bincount(cluster, v[:, d], len(centres)) for d in range(v.shape[1])], axis=1)
        moved = np.round(sums / np.maximum(n, 1)[:, None], 9)
        moved[n == 0] = centres[n == 0]
        if (moved == centres).all():
            break
        centres = moved
    return _nearest(v, centres)


def _kmeans_of(keys: list[str], id: str, rounds: int):
    """Task: the rows of one key with their clusters."""

    def task(own: pa.Table) -> pa.Table:
        own = own.sort_by([("_h", "ascending"), (id, "ascending")])
        found = _clusters(_matrix(own["_v"]), own["k"][0].as_py(), rounds)
        return own.select([*keys, id]).append_column("cluster_id", pa.array(found, pa.int32()))

    return task


def kmeans_by(
    points: DataFrame, keys: list[str], id: str, features: str, counts: DataFrame, most: int, rounds: int = 8,
    broadcast_bytes: int = 32 << 20, local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """(keys, id, cluster_id): k-means inside every key at once.

    counts(keys, k) names the number of clusters, at most ``most``. Seeds are the rows of a key with
    the smallest hash of their id and different positions. A round compares each row with the at most
    ``most`` centres of its key and averages anew. A key of at most ``local_rows`` rows has all its rounds in
    one task; rows of larger keys stay where they are, and their centres are stored after each round. Centres of at
    most ``broadcast_bytes`` are broadcast, beyond that they are joined by key. Ties go to the smaller
    cluster; a cluster without rows keeps its centre. Rows of small keys are not written again, so they should come
    from stored tables.
    """
    rows = points.select(*keys, id, F.col(features).alias("_v"))
    sized = durable(_sizes(rows, keys).join(counts, keys))
    few = broadcast_if_small(sized.where(F.col("_n") <= local_rows).select(*keys, F.least("k", F.lit(most)).alias("k")))
    own = rows.join(few, keys).withColumn("_h", F.xxhash64(id)).groupBy(*keys).applyInArrow(
        _kmeans_of(keys, id, rounds), f"{_schema(rows, [*keys, id])}, cluster_id int")
    crowded = sized.where(F.col("_n") > local_rows)
    if crowded.isEmpty():
        return own
    large = rows.withColumn("_v", F.col("_v").cast("array<double>"))
    held = durable(large.join(F.broadcast(crowded.select(*keys)), keys, "left_semi"))
    return own.unionByName(_kmeans_rounds(held, keys, id, crowded.select(*keys, "k"), most, rounds, broadcast_bytes))


def _kmeans_rounds(rows: DataFrame, keys: list[str], id: str, counts: DataFrame, most: int, rounds: int, broadcast_bytes: int) -> DataFrame:
    """The same for rows(keys, id, _v) of keys with any number of rows."""
    places = rows.groupBy(*keys, "_v").agg(F.min(F.struct(F.xxhash64(id).alias("h"), F.col(id).alias("i"))).alias("_o"))
    seeds = top_n(places, keys, [F.col("_o.h"), F.col("_o.i")], most, "_nth").join(counts, keys)
    centres = durable(seeds.where(F.col("_nth") <= F.col("k")).select(*keys, (F.col("_nth") - 1).alias("cluster_id"), F.col("_v").alias("_c")))

    def assigned() -> DataFrame:
        return _nearest_centres(rows, centres, keys, id, broadcast_bytes)

    for _ in range(rounds):
        means = assigned().groupBy(*keys, "cluster_id").agg(Summarizer.mean(array_to_vector(F.col("_v"))).alias("_m"))
        moved = means.select(*keys, "cluster_id", F.transform(vector_to_array("_m"), lambda v: F.round(v, 9)).alias("_new"))
        centres = durable(
            centres.join(moved, [*keys, "cluster_id"], "left").select(*keys, "cluster_id", F.coalesce("_new", "_c").alias("_c"))
        )
    return assigned().select(*keys, id, "cluster_id")


def _nearest_centres(rows: DataFrame, centres: DataFrame, keys: list[str], id: str, broadcast_bytes: int) -> DataFrame:
    """(keys, id, _v, cluster_id) with the nearest centre of the row's key."""
    size = centres.agg(F.sum(F.size("_c") * 8 + 32)).first()[0] or 0
    if size > broadcast_bytes:
        held = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cluster_id", "_c"))).alias("_all"))
        near = F.array_min(
            F.transform("_all", lambda c: F.struct(_distance(F.col("_v"), c["_c"]).alias("d"), c["cluster_id"].alias("cluster_id")))
        )
        return rows.join(held, keys).select(*keys, id, "_v", near["cluster_id"].alias("cluster_id"))
    table: dict = {}
    for r in centres.orderBy("cluster_id").collect():
        names, places = table.setdefault(tuple(r[k] for k in keys), ([], []))
        names.append(r["cluster_id"])
        places.append(r["_c"])
    shared = rows.sparkSession.sparkContext.broadcast({k: (np.array(n), np.array(c)) for k, (n, c) in table.items()})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = np.zeros(len(batch), np.int32)
            for key, at in batch.groupby(keys, sort=False).indices.items():
                names, places = known[key if isinstance(key, tuple) else (key,)]
                own = np.stack(batch["_v"].to_numpy()[at])
                for k in range(0, len(at), 256):
                    far = ((own[k : k + 256, None, :] - places[None]) ** 2).sum(axis=2)
                    out[at[k : k + 256]] = names[far.argmin(axis=1)]
            yield batch.assign(cluster_id=out)

    return rows.mapInPandas(task, f"{_schema(rows, rows.columns)}, cluster_id int")


def _count(n: Column, bounds: tuple[int, int, float], divide: int = 1) -> Column:
    low, high, power = bounds
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.pow(n, power) / divide).cast("int")))


def _same_ids(ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of rows with the same id, in order of the first row; null is no id."""
    codes = ids.combine_chunks().dictionary_encode().indices
    known = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    own = pd.DataFrame({"g": codes.drop_null().to_numpy(), "i": known})
    if len(known) == len(codes) and not own["g"].duplicated().any():
        return known, known
    pairs = own.merge(own, on="g", suffixes=("", "_b"))
    return pairs["i"].to_numpy(), pairs["i_b"].to_numpy()


def _hierarchy_of(key: str, id: str, rounds: int, places: list[str]):
    """Task: both levels of the rows of one key, each row as often as a join by id gives it."""

    def task(own: pa.Table) -> pa.Table:
        own = own.sort_by([("_h", "ascending"), (id, "ascending")])
        v = np.stack([own["x"].to_numpy(), own["y"].to_numpy()], axis=1)
        coarse = _clusters(v, own["_coarse"][0].as_py(), rounds)
        sizes = np.bincount(coarse)
        turns = sorted((j > 1, -n / j, c, j) for c, n in enumerate(sizes.tolist()) for j in range(1, min(n, FINE[1] + 2) + 1))
        shares = np.bincount([c for _, _, c, _ in turns[: own["_fine"][0].as_py()]], minlength=len(sizes))
        first = np.cumsum(shares) - shares
        left, right = _same_ids(own[id])
        fine, single = np.zeros(len(left), np.int32), np.zeros(len(left), bool)
        for c in np.unique(coarse[left]):
            at = np.flatnonzero(coarse[left] == c)
            fine[at] = first[c] + _clusters(v[right[at]], int(shares[c]), rounds)
            single[at] = len(np.unique(fine[at])) <= 1
        more = own.select(places)
        if places:
            row, other = _same_ids(own[id])
            if len(left) > len(np.unique(left)):
                joined = pd.DataFrame({"i": left, "at": np.arange(len(left))}).merge(pd.DataFrame({"i": row, "o": other}), on="i")
                at, other = joined["at"].to_numpy(), joined["o"].to_numpy()
                left, fine, single = left[at], fine[at], single[at]
            more = more.take(other)
        out = own.select([key, id]).take(left)
        for name, values in (("coarse_id", pa.array(coarse[left], pa.int32())), ("fine_id", pa.array(fine, pa.int32())), ("only_child", pa.array(single))):
            out = out.append_column(name, values)
        for c in places:
            out = out.append_column(c, more[c])
        return out

    return task


def hierarchy_by(
    points: DataFrame, key: str, id: str = "openalex_id", rounds: int = 8, local_rows: int = LOCAL_ROWS, places: Sequence[str] = ()
) -> DataFrame:
    """(key, id, coarse_id, fine_id, only_child): two nested levels on the map coordinates of each key.

    Each coarse cluster gets one fine cluster, the others go one by one to the cluster with most rows
    per fine cluster, until the key has its number of fine ones (or one for each row). A key with fewer
    than five rows is one cluster. A key of at most ``local_rows`` rows has both levels from one task. ``places``
    names columns of the points that are joined to the result by (key, id). The points should be stored.
    """
    rows = points.select(*dict.fromkeys([key, id, "x", "y", *places]))
    coarse_k = F.when(F.col("n") < 5, 1).otherwise(_count(F.col("n"), COARSE))
    fine_k = F.when(F.col("n") < 5, 1).otherwise(F.greatest(_count(F.col("n"), FINE, 2), coarse_k + 2))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = durable(sizes.select(key, "n", coarse_k.alias("_coarse"), fine_k.alias("_fine")))
    small = sizes.where(F.col("n") <= local_rows)
    n = small.agg(F.sum("n")).first()[0] or 0
    dealt = deal(rows, n, key).join(broadcast_if_small(small.drop("n")), key).withColumn("_h", F.xxhash64(id))
    columns = [key, id, "coarse_id", "fine_id", "only_child", *places]
    schema = f"{_schema(rows, [key, id])}, coarse_id int, fine_id int, only_child boolean"
    schema = ", ".join([schema, *([_schema(rows, list(places))] if places else [])])
    own = dealt.groupBy(key).applyInArrow(_hierarchy_of(key, id, rounds, list(places)), schema)
    crowded = sizes.where(F.col("n") > local_rows)
    if crowded.isEmpty():
        return own
    large = durable(rows.join(F.broadcast(crowded.select(key)), key, "left_semi"))
    found = _hierarchy_large(large.select(key, id, F.array("x", "y").alias("_xy")), crowded, key, id, rounds)
    if places:
        found = found.join(large.select(key, id, *places), [key, id])
    return own.unionByName(found.select(columns))


def _hierarchy_large(rows: DataFrame, sizes: DataFrame, key: str, id: str, rounds: int) -> DataFrame:
    """The same for stored rows(key, id, _xy) of keys with any number of rows and sizes(key, n, _coarse, _fine)."""
    coarse = durable(
        kmeans_by(rows, [key], id, "_xy", sizes.select(key, F.col("_coarse").alias("k")), COARSE[1], rounds).withColumnRenamed("cluster_id", "coarse_id")
    )
    parents = coarse.groupBy(key, "coarse_id").agg(F.count(F.lit(1)).alias("size"))
    turns = parents.join(sizes, key).withColumn("_j", F.explode(F.sequence(F.lit(1), F.least("size", F.lit(FINE[1] + 2)))))
    order = Window.partitionBy(key).orderBy((F.col("_j") > 1), F.desc(F.col("size") / F.col("_j")), "coarse_id", "_j")
    picked = turns.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= F.col("_fine"))
    shares = durable(picked.groupBy(key, "coarse_id").agg(F.count(F.lit(1)).cast("int").alias("k")))
    inside = durable(coarse.join(rows, [key, id]))
    fine = kmeans_by(inside, [key, "coarse_id"], id, "_xy", shares, FINE[1] + 2, rounds)
    before = Window.partitionBy(key).orderBy("coarse_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.select(key, "coarse_id", F.coalesce(F.sum("k").over(before), F.lit(0)).cast("int").alias("_first"))
    numbered = fine.join(offsets, [key, "coarse_id"]).select(key, id, "coarse_id", (F.col("_first") + F.col("cluster_id")).alias("fine_id"))
    numbered = durable(numbered)
    single = numbered.groupBy(key, "coarse_id").agg((F.countDistinct("fine_id") <= 1).alias("only_child"))
    return numbered.join(single, [key, "coarse_id"]).select(key, id, "coarse_id", "fine_id", "only_child")
