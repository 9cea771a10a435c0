"""Labels and digests of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.scores import percent
from quillmap.functions.text import truncate_text
from quillmap.session import broadcast_if_small, durable, exact_rank, top_n


def cluster_summary(df: DataFrame, cluster: str = "cluster_id", warn_ratio: float = 0.4) -> DataFrame:
    """(cluster, n, total, n_clusters, n_outliers, outlier_pct, warn), one row per cluster; noise is -1."""
    sizes = durable(df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n").alias("v")).scalar()
    clusters = sizes.where(F.col(cluster) != -1).agg(F.count(F.lit(1)).alias("v")).scalar()
    outliers = F.coalesce(sizes.where(F.col(cluster) == -1).agg(F.sum("n").alias("v")).scalar(), F.lit(0))
    out = sizes.select(
        cluster, "n", total.alias("total"), clusters.alias("n_clusters"), outliers.alias("n_outliers")
    )
    out = out.withColumn("outlier_pct", percent(F.col("n_outliers"), F.col("total")))
    return out.withColumn("warn", F.col("outlier_pct") > warn_ratio * 100)


def majority_label(
    df: DataFrame, group: str, value: str, share: float = 0.5, sep: str = " / "
) -> DataFrame:
    """(group, label, top_share): the main value if it has more than the share, else the two main ones."""
    filled = df.where(F.coalesce(value, F.lit("")) != "")
    counts = filled.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(group).agg(F.sum("_n").alias("_total"))
    leaders = top_n(counts, [group], [F.desc("_n"), F.col(value)], 2)
    first = F.max(F.when(F.col("rank") == 1, F.col(value)))
    second = F.max(F.when(F.col("rank") == 2, F.col(value)))
    pairs = leaders.groupBy(group).agg(
        first.alias("_a"), second.alias("_b"), F.max("_n").alias("_top")
    ).join(totals, group)
    top_share = F.col("_top") / F.col("_total")
    label = F.when((top_share > share) | F.col("_b").isNull(), F.col("_a")).otherwise(
        F.concat("_a", F.lit(sep), "_b")
    )
    return pairs.select(group, label.alias("label"), top_share.alias("top_share"))


def label_clusters(
    df: DataFrame,
    cluster: str = "cluster_id",
    topic: str = "topic",
    fallback_terms: DataFrame | None = None,
    noise: int = -1,
    per: str | None = None,
) -> DataFrame:
    """(cluster, label, labelled): unique labels, handed out from the largest cluster down.

    Each cluster takes its most frequent topic that no larger cluster took; ties by topic and by
    cluster id. If all its topics are taken it gets the most frequent one with its first word from
    fallback_terms(cluster, fallback_label: words joined by ", "), else with its id. Without topics
    it gets the fallback label or ``Cluster <id>``. Of equal labels all but that of the largest
    cluster get their id. Noise is called Outlier. With ``per`` every value of that column is a set
    of clusters of its own, and the column is part of all rows, those of fallback_terms included.
    """
    keys = [per] if per else []
    own = [*keys, cluster]
    real = df.where(F.col(cluster) != noise)
    sizes = real.groupBy(*own).agg(F.count(F.lit(1)).alias("_size"))
    choices = durable(_topic_choices(real, sizes, keys, cluster, topic))
    given = _hand_out(choices, keys, cluster)
    base = choices.where(F.col("_rank") == 1).select(*own, F.col("_topic").alias("_base"))
    out = sizes.join(given, own, "left").join(base, own, "left")
    if fallback_terms is not None:
        out = out.join(fallback_terms.select(*own, F.col("fallback_label").alias("_words")), own, "left")
    else:
        out = out.withColumn("_words", F.lit(None).cast("string"))
    number = F.concat(F.lit("#"), F.col(cluster).cast("string"))
    word = F.split("_words", ", ")[0]
    spare = F.coalesce(
        F.when(word != "", F.concat("_base", F.lit(" ("), word, F.lit(")"))),
        F.concat("_base", F.lit(" "), number),
        F.when(F.col("_words") != "", F.col("_words")),
        F.concat(F.lit("Cluster "), F.col(cluster).cast("string")),
    )
    named = out.select(
        *own, "_size", F.coalesce("_label", spare).alias("label"), F.col("_label").isNotNull().alias("labelled")
    )
    # few rows share a label: one per cluster with the same topic and word
    same = Window.partitionBy(*keys, "label").orderBy(F.desc("labelled"), F.desc("_size"), cluster)
    labels = named.withColumn("_nth", F.row_number().over(same)).select(
        *own,
        F.when(F.col("_nth") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" "), number)).alias("label"),
        "labelled",
    )
    outlier = df.where(F.col(cluster) == noise).select(*own).distinct().select(
        *own, F.lit("Outlier").alias("label"), F.lit(False).alias("labelled")
    )
    return labels.unionByName(outlier)


def _topic_choices(real: DataFrame, sizes: DataFrame, keys: list[str], cluster: str, topic: str) -> DataFrame:
    """(keys, cluster, _topic, _rank, _turn): topics a cluster may get, best first.

    At the p-th turn at most p - 1 topics are taken, so only the first p topics of that cluster
    matter. They are ranked in salted parts first, then per cluster.
    """
    own = [*keys, cluster]
    turns = broadcast_if_small(exact_rank(sizes, keys, [F.desc("_size"), F.col(cluster)], "_turn").drop("_size"))
    rows = (
        real.where(F.coalesce(topic, F.lit("")) != "")
        .groupBy(*own, F.col(topic).alias("_topic"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(turns, own)
        .withColumn("_salt", F.pmod(F.xxhash64("_topic"), F.lit(64)))
    )
    for parts in ([*own, "_salt"], own):
        w = Window.partitionBy(*parts).orderBy(F.desc("_n"), "_topic")
        rows = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("_turn"))
    return rows.select(*own, "_topic", "_rank", "_turn")


def _hand_out(choices: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """(keys, cluster, _label): first free topic of each cluster in order of turns.

    Turn order is a sequence, served in rounds: every cluster asks for its best topic that no
    earlier turn holds, and a topic goes to the earliest turn asking. As all topics prefer the same
    order of clusters, the rounds end in the labels of the sequence.
    """
    held = None
    while True:
        open_ = choices
        if held is not None:
            before = held.select(*keys, "_topic", F.col("_turn").alias("_holder"))
            open_ = choices.join(before, [*keys, "_topic"], "left").where(
                F.col("_holder").isNull() | (F.col("_holder") >= F.col("_turn"))
            ).drop("_holder")
        asks = open_.groupBy(*keys, cluster, "_turn").agg(F.min_by("_topic", "_rank").alias("_topic"))
        now = durable(asks.groupBy(*keys, "_topic").agg(F.min("_turn").alias("_turn")))
        if held is not None and now.exceptAll(held).isEmpty() and held.exceptAll(now).isEmpty():
            owner = choices.select(*keys, cluster, "_turn").distinct()
            return held.join(owner, [*keys, "_turn"]).select(*keys, cluster, F.col("_topic").alias("_label"))
        held = now


def label_author_clusters(authors: DataFrame, cluster: str = "cluster_id", chars: int = 30) -> DataFrame:
    """(cluster, label): most cited author with the start of the institution."""
    best = F.min_by(
        F.struct("name", "institution"),
        F.struct((-F.col("total_citations")).alias("c"), "author_id"),
    )
    shown = F.when(
        F.coalesce("r.institution", F.lit("")) != "",
        F.concat(F.lit(" ("), F.substring("r.institution", 1, chars), F.lit(")")),
    ).otherwise("")
    return authors.groupBy(cluster).agg(best.alias("r")).select(
        cluster, F.concat("r.name", shown).alias("label")
    )


def cluster_digest(
    df: DataFrame, cluster: str = "cluster_id", label: str = "cluster_label", top: int = 3, noise: int = -1,
    title_chars: int | None = 60,
) -> DataFrame:
    """(cluster, label, n, year_min, year_max, citations, top_papers): one row per cluster, noise left out.

    top_papers is an array of (rank, title, year, citation_count); titles are cut unless title_chars is None.
    """
    real = df.where(F.col(cluster) != noise)
    sums = real.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.sum("citation_count").cast("long").alias("citations"),
    )
    best = top_n(real, [cluster], [F.desc("citation_count"), F.col("openalex_id")], top)
    shown = F.struct("rank", F.substring("title", 1, title_chars).alias("title") if title_chars else F.col("title"), "year", "citation_count")
    # the label is the same for all papers of a cluster: taken from the first one shown
    lines = best.groupBy(cluster).agg(
        F.max(F.when(F.col("rank") == 1, F.col(label))).alias("label"),
        F.array_sort(F.collect_list(shown)).alias("top_papers"),
    )
    return sums.join(lines, cluster).select(
        cluster, "label", "n", "year_min", "year_max", "citations", "top_papers"
    )


def cluster_dossier(df: DataFrame, cluster: str = "cluster_id", abstract_chars: int = 300) -> DataFrame:
    """Papers of each cluster for reading in order of (cluster, year, id), with the cluster's totals.

    One row per paper: a cluster of any size needs no collection.
    """
    totals = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.sum("citation_count").cast("long").alias("citations"),
    )
    return df.select(
        cluster, "year", "openalex_id", "title", "journal", "citation_count",
        truncate_text(F.col("abstract"), abstract_chars).alias("abstract"),
    ).join(broadcast_if_small(totals), cluster)
