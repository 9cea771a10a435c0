"""Ranked full-text search over an inverted index kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.scores import clamp
from quillmap.functions.text import term_counts, tokens, truncate_text
from quillmap.session import broadcast_if_small, durable, running_sum, top_n


#: (postings, doc_stats), or a stored index with (token_stats, corpus_stats) as well.
Index = tuple[DataFrame, ...]

#: Pairs of a posting and a query term that one task scores.
PAIRS = 1_000_000


def build_search_index(
    docs: DataFrame, columns: tuple[str, ...] = ("title", "abstract"), id: str = "openalex_id"
) -> Index:
    """(postings(token, doc_id, tf, dl), doc_stats(doc_id, dl)).

    Term counts are taken inside the row, so building needs no shuffle; a stored index is clustered
    by token when it is written.
    """
    words = F.concat(*[tokens(F.col(c)) for c in columns])
    per_doc = docs.select(F.col(id).alias("doc_id"), words.alias("_words"))
    per_doc = per_doc.withColumn("dl", F.size("_words"))
    postings = per_doc.select(
        "doc_id", "dl", F.explode(term_counts(F.col("_words"))).alias("t")
    ).select("t.token", "doc_id", "t.tf", "dl")
    return postings, per_doc.select("doc_id", "dl")


def store_search_index(index: Index, name: str, buckets: int = 200) -> Index:
    """Write the index as tables ``<name>_postings``, ``_docs``, ``_tokens`` and ``_corpus``.

    Postings are partitioned by a hash of the token, so a search reads the folders of its words only;
    inside they are sorted by token, so row groups are skipped, too. ``_tokens`` holds the document
    frequency of every token and ``_corpus`` the number and mean length of documents: neither is
    counted again by a search. The rebalance hint lets adaptive execution split very common tokens
    over several files.
    """
    postings, doc_stats = index[:2]
    spark = postings.sparkSession
    placed = postings.withColumn("bucket", _bucket(F.col("token"), buckets))
    placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token").write.mode(
        "overwrite"
    ).partitionBy("bucket").saveAsTable(f"{name}_postings")
    doc_stats.write.mode("overwrite").saveAsTable(f"{name}_docs")
    stored = spark.table(f"{name}_postings")
    frequency = stored.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    corpus = spark.table(f"{name}_docs").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean_dl"), F.lit(buckets).alias("buckets")
    )
    frequency.withColumn("bucket", _bucket(F.col("token"), buckets)).hint("rebalance", F.col("bucket")).sortWithinPartitions(
        "bucket", "token"
    ).write.mode("overwrite").partitionBy("bucket").saveAsTable(f"{name}_tokens")
    corpus.write.mode("overwrite").saveAsTable(f"{name}_corpus")
    return tuple(spark.table(f"{name}_{t}") for t in ("postings", "docs", "tokens", "corpus"))


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, group_id, token, times, n_tokens) from (query_id, group_id, keyword).

    Quotes vanish, the rest goes through the tokeniser of the text. Groups are alternatives, the
    words of one group must all occur.
    """
    bare = F.translate("keyword", "\"'", "")
    words = (
        queries.select("query_id", "group_id", F.explode(tokens(bare)).alias("token"))
        .groupBy("query_id", "group_id", "token")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    sizes = words.groupBy("query_id", "group_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    return words.join(sizes, ["query_id", "group_id"])


def _asked(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(postings of the asked tokens, query terms with their weights, how many pairs of both there are)."""
    postings, doc_stats = index[:2]
    terms = durable(parse_queries(queries))
    asked = broadcast_if_small(terms.select("token").distinct())
    if len(index) == 4:
        tokens_of, corpus = index[2], index[3].first()
        bucket = _bucket(F.col("token"), corpus["buckets"])
        # one small number per asked folder
        own = [r[0] for r in asked.select(bucket).distinct().collect()]
        postings, tokens_of = (df.where(F.col("bucket").isin(own)).drop("bucket") for df in (postings, tokens_of))
        spread = tokens_of.join(asked, "token", "left_semi")
        n_docs, mean_dl = F.lit(corpus["n"]), F.lit(corpus["mean_dl"])
    else:
        spread = postings.join(asked, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        n_docs = doc_stats.agg(F.count(F.lit(1)).alias("n")).scalar()
        mean_dl = doc_stats.agg(F.avg("dl").alias("a")).scalar()
    raw = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = broadcast_if_small(terms.join(spread, "token").select(
        "query_id", "group_id", "token", "times", "n_tokens", "df",
        F.when(raw > 0, raw).otherwise(F.lit(1e-6)).alias("idf"),
        mean_dl.alias("mean_dl"),
    ))
    return postings.join(asked, "token", "left_semi"), weighted, weighted.agg(F.sum("df")).first()[0] or 0


def _scores(postings: DataFrame, weighted: DataFrame, pairs: int, k1: float, b: float) -> DataFrame:
    """Scores per (query, document): postings are shuffled by document, pairs with query terms arise after that and stay there."""
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean_dl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    cores = postings.sparkSession.sparkContext.defaultParallelism
    tasks = max(pairs // PAIRS, min(cores, pairs * 10 // PAIRS)) + 1
    return (
        postings.repartition(tasks, "doc_id").join(weighted, "token")
        .select("query_id", "group_id", "doc_id", "n_tokens", part.alias("part"))
        .groupBy("query_id", "doc_id", "group_id", "n_tokens")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum("part").alias("score"))
        .where(F.col("hits") == F.col("n_tokens"))
        .groupBy("query_id", "doc_id")
        .agg(F.sum("score").alias("score"))
    )


def match_documents(
    index: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(query_id, doc_id, score) of every document that satisfies a group of the query.

    A stored index is read once: the folders of the asked tokens only, with their stored frequencies.
    An index that is not stored is read twice, as its frequencies are counted first. The query
    terms with their weights are counted and broadcast. The postings of asked tokens are shuffled by
    document, in tasks of about PAIRS pairs of a posting and a query term; scores add up there.
    """
    return _scores(*_asked(index, queries), k1, b)


def apply_search_filters(
    df: DataFrame, filters: DataFrame | None, query_id: str = "query_id"
) -> DataFrame:
    """Keep (query, paper) rows that pass the filters of their query; absent filters pass.

    filters(query_id, year_min, year_max, citation_min, journal_tiers, subfields), any of the last
    five may be missing or null; empty lists and a citation minimum of 0 mean no filter.
    """
    if filters is None:
        return df
    tests: dict[str, Column] = {
        "year_min": F.col("year") >= F.col("f.year_min"),
        "year_max": F.col("year") <= F.col("f.year_max"),
        "citation_min": F.when(F.col("f.citation_min") > 0, F.col("citation_count") >= F.col("f.citation_min")),
        "journal_tiers": F.when(F.size("f.journal_tiers") > 0, F.array_contains("f.journal_tiers", F.col("journal_tier"))),
        "subfields": F.when(F.size("f.subfields") > 0, F.array_contains("f.subfields", F.col("subfield"))),
    }
    joined = df.alias("d").join(
        filters.alias("f"), F.col(f"d.{query_id}") == F.col("f.query_id"), "left"
    )
    for name, test in tests.items():
        if name in filters.columns:
            joined = joined.where(F.coalesce(test, F.lit(True)))
    return joined.select("d.*")


def search(
    index: Index,
    docs: DataFrame,
    queries: DataFrame,
    filters: DataFrame | None = None,
    limit: int = 50,
    k1: float = 1.2,
    b: float = 0.75,
    max_limit: int = 200,
) -> DataFrame:
    """(query_id, rank, score, paper columns): best papers of every query.

    Order: score, citations, id. Scores are compared to nine digits, so that copies of a text tie
    whatever the order in which their parts were added. ``limit`` is clamped to 1..max_limit; a ``limit`` column in the filters
    sets it per query.
    """
    slim = ["year", "citation_count", "journal_tier", "subfield"]
    held = docs.select(F.col("openalex_id").alias("doc_id"), *[c for c in slim if c in docs.columns])
    postings, weighted, pairs = _asked(index, queries)
    found = _scores(postings, weighted, pairs, k1, b)
    # few matches are broadcast; many stay where their document's postings met, and papers come to them
    few = pairs <= 500_000
    scored = held.join(broadcast_if_small(found), "doc_id") if few else found.join(held.hint("shuffle_hash"), "doc_id")
    passed = apply_search_filters(scored, filters)
    order = [F.desc(F.round("score", 9)), F.desc("citation_count"), F.col("doc_id")]
    per_query = filters is not None and "limit" in filters.columns
    most = max_limit if per_query else min(max(limit, 1), max_limit)
    best = top_n(passed, ["query_id"], order, most)
    if per_query:
        own = filters.select("query_id", clamp(F.coalesce("limit", F.lit(limit)), 1, max_limit).alias("_most"))
        best = best.join(own, "query_id", "left").where(
            F.col("rank") <= F.coalesce("_most", F.lit(limit))
        )
    hits = best.select("query_id", "rank", "score", F.col("doc_id").alias("openalex_id"))
    return docs.join(broadcast_if_small(hits), "openalex_id")


def result_view(results: DataFrame, abstract_chars: int = 300) -> DataFrame:
    """Result columns with the abstract cut for display."""
    return results.withColumn("abstract", truncate_text(F.col("abstract"), abstract_chars))


def match_count(index: Index, queries: DataFrame) -> DataFrame:
    """Matching documents per query, 0 for queries without a match."""
    counts = match_documents(index, queries).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        queries.select("query_id").distinct().join(counts, "query_id", "left").fillna({"n": 0})
    )


def multi_search(results: DataFrame, queries: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, log) of several searches run in order of query_id.

    papers: each paper once, with the query that found it first. log: results, new papers and
    running total per query. With a cap, queries after the one that reaches it are left out. The
    log has one row per query.
    """
    results = durable(results)
    first = results.groupBy("openalex_id").agg(F.min("query_id").alias("query_id"))
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    new = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("new"))
    per_query = (
        queries.select("query_id").distinct()
        .join(counts, "query_id", "left")
        .join(new, "query_id", "left")
        .fillna({"results": 0, "new": 0})
    )
    log = running_sum(per_query, [], [F.col("query_id")], F.col("new"), "total")
    if cap is not None:
        log = log.where(F.col("total") - F.col("new") < cap)
    papers = (
        first.join(log.select("query_id"), "query_id", "left_semi")
        .join(results, ["openalex_id", "query_id"])
    )
    return papers, log
