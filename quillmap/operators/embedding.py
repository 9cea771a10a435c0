"""Vectors of papers and authors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import STOP_WORDS, tokens
from quillmap.functions.vectors import l2_normalize
from quillmap.session import join_dealt

Encoder = Callable[[pd.Series], np.ndarray]


def text_hash(text) -> F.Column:
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def embed_texts(
    df: DataFrame,
    id: str,
    text: str,
    make_encoder: Callable[[], Encoder] | None = None,
    model: str = "hashing",
    dim: int = 64,
) -> DataFrame:
    """(id, embedding, model, dim, text_hash) for every row.

    ``make_encoder`` is called once per task and returns a function from a batch of texts to a
    matrix; use it for a language model. The built-in model hashes words into 2 * dim buckets, takes
    the upper half as negative and scales to unit length: no fitting, no shuffle, no Python.
    """
    rows = df.select(id, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if make_encoder is None:
        words = rows.withColumn("_words", F.filter(tokens(F.col("_text")), lambda t: ~t.isin(STOP_WORDS)))
        hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=2 * dim).transform(words)
        counts = hashed.withColumn("_c", vector_to_array("_tf"))
        signed = F.zip_with(F.slice("_c", 1, dim), F.slice("_c", dim + 1, dim), lambda p, m: p - m)
        # a column of its own: the norm and the scaling both read it
        vectors = counts.withColumn("_s", signed).select(
            id, l2_normalize("_s").cast("array<float>").alias("embedding"), text_hash("_text").alias("text_hash")
        )
    else:
        kind = rows.schema[id].dataType.simpleString()

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encoder = make_encoder()
            for batch in batches:
                matrix = np.asarray(encoder(batch["_text"]), dtype=np.float32)
                yield pd.DataFrame(
                    {id: batch[id], "embedding": list(matrix), "text_hash": batch["text_hash"]}
                )

        vectors = rows.withColumn("text_hash", text_hash("_text")).mapInPandas(
            encode, f"{id} {kind}, embedding array<float>, text_hash string"
        )
    return vectors.select(
        id, "embedding", F.lit(model).alias("model"), F.lit(dim).alias("dim"), "text_hash"
    )


def embed_incremental(
    df: DataFrame, id: str, text: str, existing: DataFrame, model: str = "hashing", **options
) -> DataFrame:
    """Vectors only for rows whose (id, model, text) has none yet."""
    have = existing.where(F.col("model") == model).select(id, "text_hash")
    todo = df.withColumn("text_hash", text_hash(text)).join(have, [id, "text_hash"], "left_anti")
    return embed_texts(todo, id, text, model=model, **options)


def author_vectors(
    links: DataFrame,
    vectors: DataFrame,
    papers: DataFrame,
    min_papers: int = 3,
    min_weight: float = 0.1,
) -> DataFrame:
    """(author_id, n_papers, embedding): citation-weighted mean of the paper vectors, unit length.

    vectors(openalex_id, embedding), papers(openalex_id, citation_count). The weighted mean is a plain
    sum for each component, combined before the shuffle: a prolific author ships one partial vector
    per task. Authors without any vector get zeros.
    """
    active = links.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_papers")).where(
        F.col("n_papers") >= min_papers
    )
    weight = F.greatest(F.log1p(F.col("citation_count").cast("double")), F.lit(min_weight))
    first = vectors.select(F.size("embedding").alias("d")).first()
    width = max(0, first["d"] or 0) if first else 0
    fits = F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(F.lit("vectors differ in length")))
    paper_rows = vectors.join(papers.select("openalex_id", "citation_count"), "openalex_id").select(
        F.col("openalex_id").alias("paper_id"),
        weight.alias("w"),
        fits.alias("v"),
    )
    sums = [F.sum(F.col("w") * F.col("v")[i].cast("double")).alias(f"s{i}") for i in range(width)]
    mean = F.array(*[F.col(f"s{i}") / F.col("_w") for i in range(width)]).cast("array<double>")
    means = (
        join_dealt(links.select("author_id", "paper_id"), paper_rows, ["paper_id"], links.count())
        .groupBy("author_id")
        .agg(F.sum("w").alias("_w"), *sums)
        .select("author_id", mean.alias("_m"))
        .select("author_id", l2_normalize("_m").alias("embedding"))
    )
    zeros = F.array_repeat(F.lit(0.0), width)
    return active.join(means, "author_id", "left").select(
        "author_id", "n_papers", F.coalesce("embedding", zeros).alias("embedding")
    )


def project_2d(vectors: DataFrame, id: str = "openalex_id", embedding: str = "embedding") -> DataFrame:
    """(id, x, y): first two principal components, centred.

    Signs are fixed so that the largest loading of each axis is positive. The fit keeps one
    dim x dim matrix on the driver, whatever the number of rows. Fewer than five rows give (0, 0).
    """
    rows = vectors.select(id, array_to_vector(F.col(embedding).cast("array<double>")).alias("_v"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("m")).first()
    if stats["n"] < 5:
        return rows.select(id, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    offset = stats["m"].toArray() @ axes
    out = model.transform(rows).withColumn("_p", vector_to_array("_p"))
    return out.select(
        id,
        ((F.col("_p")[0] - float(offset[0])) * float(signs[0])).alias("x"),
        ((F.col("_p")[1] - float(offset[1])) * float(signs[1])).alias("y"),
    )


def assign_nearest(
    vectors: DataFrame,
    centroids: DataFrame,
    id: str,
    cluster: str = "cluster_id",
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """(id, cluster, distance): nearest centroid by Euclidean distance; ties to the smaller cluster.

    Centroids go to the executors in blocks of at most block_bytes and are compared as matrix
    products, so there is no row per (point, centroid) and memory does not depend on their number.
    With more than one block each point keeps its best of every block, and the best of these wins.
    """
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    blocks = max(1, -(-size["n"] * (size["d"] or 0) * 8 // block_bytes))
    block = F.pmod(F.xxhash64(cluster), F.lit(blocks))
    parts = [
        _nearest_in(vectors, centroids.where(block == b).select(cluster, "embedding"), id, cluster)
        for b in range(blocks)
    ]
    if blocks == 1:
        return parts[0]
    every = reduce(DataFrame.unionByName, parts)
    best = F.min_by(F.struct(cluster, "distance"), F.struct("distance", cluster)).alias("b")
    return every.groupBy(id).agg(best).select(id, f"b.{cluster}", "b.distance")


def _nearest_in(vectors: DataFrame, centroids: DataFrame, id: str, cluster: str) -> DataFrame:
    rows = centroids.orderBy(cluster).collect()  # one block
    labels = np.array([r[0] for r in rows])
    matrix = np.array([r[1] for r in rows], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((labels, matrix))
    id_kind = vectors.schema[id].dataType.simpleString()
    label_kind = centroids.schema[cluster].dataType.simpleString()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centers = shared.value
        norms = (centers**2).sum(axis=1) if len(centers) else np.zeros(0)
        step = max(1, (1 << 22) // max(1, len(centers)))  # points at a time: 32 MB of distances
        for batch in batches:
            if batch.empty or not len(centers):
                continue
            points = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            best = np.empty(len(points), dtype=np.int64)
            for i in range(0, len(points), step):
                own = points[i : i + step]
                squares = norms - 2 * (own @ centers.T)
                best[i : i + step] = squares.argmin(axis=1)
                # what rounding cannot tell apart is compared anew, by differences
                slack = 1e-9 * ((own**2).sum(axis=1) + norms.max() + 1e-300)
                close = squares <= (squares.min(axis=1) + slack)[:, None]
                for k in np.flatnonzero(close.sum(axis=1) > 1):
                    some = np.flatnonzero(close[k])
                    best[i + k] = some[((centers[some] - own[k]) ** 2).sum(axis=1).argmin()]
            distance = np.sqrt(((points - centers[best]) ** 2).sum(axis=1))
            yield pd.DataFrame({id: batch[id], cluster: names[best], "distance": distance})

    return vectors.select(id, "embedding").mapInPandas(
        nearest, f"{id} {id_kind}, {cluster} {label_kind}, distance double"
    )
