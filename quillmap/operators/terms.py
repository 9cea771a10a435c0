"""Topic words of clusters."""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.text import STOP_WORDS, term_counts
from quillmap.session import broadcast_if_small, durable, store, top_n


def word_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of at least two word characters, without stop words."""
    stop = STOP_WORDS if stop_words is None else stop_words
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}_]+")
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(list(stop)))


def _document_terms(docs: DataFrame, cluster: str, text: str, id: str, stop_words) -> DataFrame:
    words = docs.select(id, cluster, word_tokens(F.col(text), stop_words).alias("_words"))
    return _each(words, [id, cluster], term_counts(F.col("_words")), "t").select(id, cluster, "t.token", "t.tf")


def _each(df: DataFrame, columns: list[str], values: Column, name: str) -> DataFrame:
    """A row for each value of an array. Before a plain ``explode`` Spark tests the array for emptiness, which computes it twice."""
    return df.select(*columns, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def tfidf_terms(
    docs: DataFrame,
    cluster: str = "cluster_id",
    text: str = "text",
    id: str = "openalex_id",
    top: int = 10,
    max_features: int = 10_000,
    stop_words: list[str] | None = None,
    per: str | None = None,
) -> DataFrame:
    """(cluster, rank, token, weight): terms with the largest mean TF-IDF in each cluster.

    The vocabulary is the max_features most frequent terms (a fixed bound, so it is broadcast);
    inverse document frequencies are smoothed, rows have unit length. Documents are counted against
    the vocabulary inside the row and stored as vectors; only sums of (cluster, term) are shuffled. Rows
    of one id are one document. With ``per`` each of its values has a vocabulary and frequencies of its
    own; clusters must not be shared between values.
    """
    if per:
        return _tfidf_by(docs, cluster, text, id, top, max_features, stop_words, per)
    words = docs.select(id, cluster, word_tokens(F.col(text), stop_words).alias("_words"))
    counts = _each(words, [], F.col("_words"), "token").groupBy("token").agg(F.count(F.lit(1)).alias("_count"))
    most = counts.orderBy(F.desc("_count"), "token").limit(max_features)
    vocabulary = [r["token"] for r in most.collect()]  # at most max_features words
    if not vocabulary:
        return docs.select(cluster, F.lit("").alias("token"), F.lit(0.0).alias("weight"), F.lit(0).alias("rank")).limit(0)
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_words", outputCol="_tf")
    rows = store(counter.transform(words).select(id, cluster, "_tf"), "vectors")
    n = rows.count()
    held = rows.select(F.explode(F.unwrap_udt("_tf")["indices"]).alias("_at")).groupBy("_at").agg(F.count(F.lit(1)).alias("_df"))
    df = {r["_at"]: r["_df"] for r in held.collect()}
    idf = [math.log((1 + n) / (1 + df[at])) + 1 for at in range(len(vocabulary))]
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_v").transform(rows)
    weighted = scaled.select(id, cluster, F.unwrap_udt("_v").alias("_v")).withColumn(
        "_own", F.aggregate("_v.values", F.lit(0.0), lambda acc, w: acc + w * w)
    )
    # rows with the same id have one length together; elsewhere it is known inside the row
    repeated = broadcast_if_small(
        weighted.groupBy(F.col(id).alias("_id")).agg(F.sum("_own").alias("_all"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1).drop("_n")
    )
    squares = weighted.join(repeated, F.col(id).eqNullSafe(F.col("_id")), "left").select(
        cluster, F.sqrt(F.coalesce("_all", "_own")).alias("_length"), F.explode(F.arrays_zip("_v.indices", "_v.values")).alias("_e")
    )
    sums = squares.groupBy(cluster, F.col("_e.indices").alias("_at")).agg(F.sum(F.col("_e.values") / F.col("_length")).alias("_sum"))
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    names = docs.sparkSession.createDataFrame(list(enumerate(vocabulary)), "_at int, token string")
    means = (
        sums.join(sizes, cluster).join(F.broadcast(names), "_at")
        .select(cluster, "token", (F.col("_sum") / F.col("_size")).alias("weight"))
    )
    return top_n(means, [cluster], [F.desc(F.round("weight", 9)), F.col("token")], top)


def _tfidf_by(docs, cluster, text, id, top, max_features, stop_words, per) -> DataFrame:
    """tfidf_terms inside every value of ``per``; a document may occur under several values."""
    doc = F.struct(F.col(per).alias("k"), F.col(id).alias("d"))
    keyed = docs.select(doc.alias("_doc"), cluster, text)
    rows = _document_terms(keyed, cluster, text, "_doc", stop_words).withColumn("_per", F.col("_doc.k"))
    sizes_of = docs.groupBy(F.col(per).alias("_per")).agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.groupBy("_per", "token").agg(F.sum("tf").alias("_count"), F.count(F.lit(1)).alias("_df"))
    kept = top_n(counts, ["_per"], [F.desc("_count"), F.col("token")], max_features).drop("rank").join(sizes_of, "_per")
    idf = kept.select("_per", "token", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    weighted = rows.join(idf, ["_per", "token"]).withColumn("_w", F.col("tf") * F.col("_idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_doc")))
    sums = weighted.withColumn("_w", F.col("_w") / length).groupBy(cluster, "token").agg(F.sum("_w").alias("_sum"))
    sizes = docs.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    means = sums.join(sizes, cluster).select(cluster, "token", (F.col("_sum") / F.col("_size")).alias("weight"))
    return top_n(means, [cluster], [F.desc(F.round("weight", 9)), F.col("token")], top)


def with_bigrams(words: Column) -> Column:
    """The words followed by all pairs of neighbours."""
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def ctfidf_weights(
    docs: DataFrame,
    cluster: str = "cluster_id",
    text: str = "text",
    bigrams: bool = True,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """(cluster, token, weight): class-based TF-IDF, tf * ln(1 + A / f).

    tf is the share of the term in its cluster, f its count over all clusters, A the mean number
    of terms per cluster. After the first aggregation only (cluster, term) counts are left.
    """
    counts, totals, mean_total = _class_counts(docs, cluster, text, bigrams, stop_words)
    overall = counts.groupBy("token").agg(F.sum("_n").alias("_f"))
    return (
        counts.join(overall, "token").join(totals, cluster)
        .select(cluster, "token", _class_weight(F.col("_f"), mean_total).alias("weight"))
    )


def _class_counts(docs, cluster, text, bigrams, stop_words) -> tuple[DataFrame, DataFrame, Column]:
    """(counts per cluster and term, terms per cluster, their mean); counts are shuffled once and stored."""
    words = word_tokens(F.col(text), stop_words)
    rows = docs.select(cluster, words.alias("_words"))
    terms = _each(rows, [cluster], with_bigrams(F.col("_words")) if bigrams else F.col("_words"), "token")
    counts = store(terms.groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("_n")), "counts")
    totals = broadcast_if_small(counts.groupBy(cluster).agg(F.sum("_n").alias("_total")))
    return counts, totals, F.lit(totals.agg(F.avg("_total")).first()[0])


def _class_weight(f: Column, mean_total: Column) -> Column:
    return F.col("_n") / F.col("_total") * F.log(1 + mean_total / f)


def ctfidf_terms(
    docs: DataFrame,
    cluster: str = "cluster_id",
    top: int = 10,
    text: str = "text",
    bigrams: bool = True,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """(cluster, rank, token, weight): strongest class-based terms of each cluster.

    A term occurs in all clusters at least as often as in its own, which bounds its weight from above. The most frequent
    terms of a cluster are weighed first; only terms whose bound reaches the last of the best of these are
    counted over all clusters. Nothing is lost by that, and few terms are left.
    """
    counts, totals, mean_total = _class_counts(docs, cluster, text, bigrams, stop_words)
    order = [F.desc(F.round("weight", 12)), F.col("token")]

    def weigh(some: DataFrame) -> DataFrame:
        tokens = broadcast_if_small(some.select("token").distinct())
        overall = counts.join(tokens, "token", "left_semi").groupBy("token").agg(F.sum("_n").alias("_f"))
        weighted = some.join(totals, cluster).join(overall, "token")
        return top_n(weighted.select(cluster, "token", _class_weight(F.col("_f"), mean_total).alias("weight")), [cluster], order, top)

    frequent = durable(top_n(counts, [cluster], [F.desc("_n"), F.col("token")], max(100, top)))
    reached = weigh(frequent.drop("rank")).where(F.col("rank") == top).select(cluster, F.round("weight", 12).alias("_least"))
    bound = F.round(_class_weight(F.col("_n"), mean_total), 12)
    left = counts.join(totals, cluster).join(broadcast_if_small(reached), cluster, "left")
    return weigh(store(left.where(F.col("_least").isNull() | (bound >= F.col("_least"))).select(cluster, "token", "_n"), "left"))


def topic_words(terms: DataFrame, cluster: str = "cluster_id", label_size: int = 3) -> DataFrame:
    """(cluster, topic_words, fallback_label): ``word(0.123); ...`` and the first words joined."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "token", "weight")))
    return terms.groupBy(cluster).agg(ordered.alias("t")).select(
        cluster,
        F.array_join(
            F.transform("t", lambda x: F.format_string("%s(%.3f)", x["token"], x["weight"])), "; "
        ).alias("topic_words"),
        F.array_join(F.transform(F.slice("t", 1, label_size), lambda x: x["token"]), ", ").alias("fallback_label"),
    )


def reduce_outliers(
    docs: DataFrame,
    cluster: str = "cluster_id",
    text: str = "text",
    id: str = "openalex_id",
    noise: int = -1,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """(id, cluster): noise documents move to the cluster of most similar class-based terms.

    Similarity is the cosine of the document's term counts and the cluster's weights; ties go to
    the smaller cluster. Documents without a common term stay noise.
    """
    core = docs.where(F.col(cluster) != noise)
    weights = ctfidf_weights(core, cluster, text, bigrams=False, stop_words=stop_words)
    lengths = weights.groupBy(cluster).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"))
    unit = weights.join(lengths, cluster).select(
        F.col(cluster).alias("_to"), "token", (F.col("weight") / F.col("_length")).alias("_w")
    )
    lost = docs.where(F.col(cluster) == noise)
    rows = _document_terms(lost, cluster, text, id, stop_words)
    # the document length is the same for all clusters and does not change the order
    close = rows.join(unit, "token").groupBy(id, "_to").agg(F.sum(F.col("tf") * F.col("_w")).alias("_s"))
    best = close.groupBy(id).agg(
        F.max_by("_to", F.struct(F.round("_s", 9).alias("s"), (-F.col("_to")).alias("t"))).alias("_to")
    )
    return docs.select(id, cluster).join(best, id, "left").select(
        id, F.coalesce("_to", cluster).alias(cluster)
    )
