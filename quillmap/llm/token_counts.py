"""Token counts by a two-tier look-up on the map side.

Tier one is a broadcast table from frequent pieces of text (a white-space run and what follows it, the
unit that can be encoded alone) to their token counts. Tier two is a bounded cache in each worker that
encodes a missing piece with the library once. No piece is ever shuffled; only the short lists of
frequent pieces are, one list of at most ``1 / share`` rows per task.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import id_type, map_arrow, text_rows
from quillmap.llm.tokens import PieceCache, byte_level_encoder, pieces
from quillmap.session import durable


def encoder(path: str):
    """piece -> ids for a tokenizers file (.json), or text -> ids for a sentencepiece model (.model)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text, num_threads=1)
    return byte_level_encoder(path)


def _cut(path: str):
    return (lambda text: [text] if text else []) if path.endswith(".model") else pieces


def frequent_pieces(docs: DataFrame, path: str, share: float = 1 / 20_000, longest: int = 48) -> dict[str, int]:
    """Token counts of the pieces with at least ``share`` of all pieces, over all texts.

    A piece with that share of all pieces has it in at least one task, so each task names those alone.
    The named ones are added up and kept from half the share on: at most ``2 / share`` rows of at most
    ``longest`` characters come to the driver and are broadcast. The table only saves work; counts do
    not depend on it.
    """
    cut = _cut(path)

    def task(batches):
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = cut(text)
                n += len(found)
                seen.update(found)
            if len(seen) > 20 / share:  # rare pieces of a long task may be forgotten, frequent ones stay
                floor = n * share / 4
                seen = Counter({p: c for p, c in seen.items() if c >= floor})
        named = [(p, c) for p, c in seen.items() if c >= n * share and 0 < len(p) <= longest]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in named] + [None], pa.string()), "n": pa.array([c for _, c in named] + [n], pa.int64())}
        )

    named = durable(
        text_rows(docs).select("text").mapInArrow(task, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    )
    total = named.where(F.col("piece").isNull()).agg(F.sum("n")).first()[0] or 0

    def lengths():
        encode = encoder(path)
        return lambda batch: {
            "piece": batch.column("piece"),
            "n": pa.array([len(encode(p)) for p in batch.column("piece").to_pylist()], pa.int64()),
        }

    kept = named.where(F.col("piece").isNotNull() & (F.col("n") >= total * share / 2)).select("piece")
    return {r.piece: r.n for r in map_arrow(kept, lengths, "piece string, n bigint").collect()}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, share: float = 1 / 20_000) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every row.

    path: a vocabulary file that every executor has. A null text counts as empty: no bytes, no tokens.
    A null doc_id stays null; repeated rows are counted one by one; an empty table gives an empty
    result; extra columns are dropped.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, share))
    cut = _cut(path)

    def counter():
        encode = encoder(path)
        known = PieceCache(lambda p: len(encode(p)) if p else 0, table.value)
        look = known.__getitem__
        return lambda batch: {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "n_tokens": pa.array([sum(map(look, cut(t))) for t in batch.column("text").to_pylist()], pa.int64()),
        }

    rows = text_rows(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = map_arrow(rows, counter, f"doc_id {id_type(docs)}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
