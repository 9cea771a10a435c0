"""Looking up many pieces of names at once in a stored index of short strings.

A name is found by any text that it contains. The index has one row for each distinct string of one to three
characters of each name; a text is looked up by its rarest string of three alone, and the few names that hold that
are then compared with the whole text. So no look-up scans the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators.authors import active_authors, author_papers, top_paper_per_author
from quillmap.session import broadcast_if_small, durable, top_n

GRAM = 3

#: (grams(bucket, gram, author_id), counts(bucket, gram, n)), stored.
NameIndex = tuple[DataFrame, DataFrame]


def _folded(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _strings(text: Column, size: int) -> Column:
    """All strings of ``size`` characters in the text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.transform(starts, lambda k: F.substring(text, k, size))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def name_grams(authors: DataFrame) -> DataFrame:
    """(gram, author_id): every distinct string of one to three characters of every name, made inside the row."""
    name = F.lower(F.coalesce("name", F.lit("")))
    all_sizes = F.concat(*[_strings(name, k) for k in range(1, GRAM + 1)])
    return authors.select("author_id", F.explode(F.array_distinct(all_sizes)).alias("gram")).select("gram", "author_id")


def store_name_index(authors: DataFrame, path: str, buckets: int = 256) -> NameIndex:
    """Write the index below a folder, in buckets of a hash of the string and sorted by string inside them.

    A look-up reads the buckets of its strings and skips the row groups of others. The rebalance hint lets
    adaptive execution split the bucket of a very common string over several files.
    """
    placed = name_grams(authors).withColumn("bucket", _bucket(F.col("gram"), buckets))
    placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    spark = authors.sparkSession
    grams = spark.read.parquet(f"{path}/grams")
    counts = grams.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    return grams, spark.read.parquet(f"{path}/counts")


def rarest_grams(index: NameIndex, queries: DataFrame, buckets: int = 256) -> DataFrame:
    """(query_id, text, gram, bucket, n): the rarest string of every text; texts with a string that no name has are left out.

    A text of fewer than three characters is its own string.
    """
    asked = queries.select("query_id", _folded(F.col("text")).alias("text")).where(F.col("text") != "")
    strings = F.when(F.length("text") < GRAM, F.array("text")).otherwise(F.array_distinct(_strings(F.col("text"), GRAM)))
    wanted = durable(asked.select("query_id", "text", F.explode(strings).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets)))
    own = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    counts = index[1].where(F.col("bucket").isin(own)).join(broadcast_if_small(wanted.select("bucket", "gram").distinct()), ["bucket", "gram"], "left_semi")
    counted = wanted.join(counts, ["bucket", "gram"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "bucket")).alias("r")
    return counted.groupBy("query_id", "text").agg(rarest).select("query_id", "text", "r.gram", "r.bucket", "r.n").where(F.col("n") > 0)


def find_authors_batch(
    index: NameIndex,
    authors: DataFrame,
    queries: DataFrame,
    min_papers: int = 2,
    n: int = 10,
    links: DataFrame | None = None,
    papers: DataFrame | None = None,
    buckets: int = 256,
) -> DataFrame:
    """(query_id, rank, author columns): for every text the authors whose name contains it, most cited first.

    queries(query_id, text). Upper and lower case are alike, blanks round a text do not count, a blank text finds
    nothing. With links and papers, the top paper of each author found.
    """
    asked = durable(rarest_grams(index, queries, buckets))
    own = [r[0] for r in asked.select("bucket").distinct().collect()]
    postings = index[0].where(F.col("bucket").isin(own)).drop("bucket")
    candidates = postings.join(broadcast_if_small(asked.select("query_id", "text", "gram")), "gram").select("query_id", "text", "author_id")
    held = active_authors(authors, min_papers).join(broadcast_if_small(candidates), "author_id")
    matched = held.where(F.contains(F.lower("name"), F.col("text"))).drop("text")
    found = top_n(matched, ["query_id"], [F.desc("total_citations"), F.col("author_id")], n)
    if links is None or papers is None:
        return found
    found = durable(found)
    best = top_paper_per_author(author_papers(links, papers, found)).select(
        "author_id",
        F.col("openalex_id").alias("top_paper_id"),
        F.col("title").alias("top_paper_title"),
        F.col("citation_count").alias("top_paper_citations"),
    )
    return found.join(best, "author_id", "left")
