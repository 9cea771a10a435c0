"""Best-fit packing of token sequences into bins with several capacities.

The plan needs only how many pieces there are of each length: pieces of one length are alike in every
dimension. Best-fit runs over that histogram (at most ``capacity`` rows) with groups of equal bins in
place of single bins, so the driver's work does not grow with the documents. Each piece then finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm.common import id_type, map_arrow, text_rows
from quillmap.llm.tokens import PieceCache, byte_level_encoder, pieces
from quillmap.session import durable


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    Each text is its ids followed by ``end_id``; a null or empty text is ``end_id`` alone. Longer ones are
    cut so that all pieces but the first are full. ``_part`` and ``_nth`` number the pieces of a length
    within a task; the caller must store the rows before it relies on them. With keep_ids the ids follow.
    """
    ids_field = ", ids array<int>" if keep_ids else ""

    def cutter():
        encode = byte_level_encoder(path)
        known = PieceCache(lambda p: array("I", encode(p)).tobytes() if p else b"")
        look, end = known.__getitem__, array("I", [end_id]).tobytes()
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}

        def step(batch):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").to_pylist()):
                ids = b"".join(map(look, pieces(text))) + end
                n, at, doc = len(ids) // 4, 0, doc_id.as_py()
                size = n % capacity or capacity
                number = 0
                while at < n:
                    own = ids[4 * at : 4 * (at + size)]
                    nth = seen.get(size, 0)
                    seen[size] = nth + 1
                    rows.append((doc, number, at, size, zlib.crc32(own), part, nth, own))
                    at, number, size = at + size, number + 1, capacity
            out = {
                name: pa.array([r[i] for r in rows], kind)
                for i, (name, kind) in enumerate(
                    [("doc_id", batch.schema.field("doc_id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_part", pa.int32()), ("_nth", pa.int64())]
                )
            }
            if keep_ids:
                out["ids"] = pa.array([np.frombuffer(r[7], "<i4") for r in rows], pa.list_(pa.int32()))
            return out

        return step

    return map_arrow(
        text_rows(docs),
        cutter,
        f"doc_id {id_type(docs)}, piece int, start bigint, length bigint, ids_crc32 bigint, _part int, _nth bigint{ids_field}",
    )


def plan_bins(
    histogram: dict[int, int],
    capacity: int = 2048,
    max_pieces: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> np.ndarray:
    """Where the pieces of each length go; rows (length, from_rank, to_rank, first bin, pieces a bin, offset).

    Lengths go from long to short. A bin has three residuals: tokens, pieces, and attention cost (the sum
    of squared lengths). Among the bins with room in all three, rule "norm" takes the one whose weighted
    residual after the placement is smallest, rule "dot" the one with the smallest weighted product of
    residual and demand, both in shares of the capacities. A chosen bin is the best one again until it is
    full for that length, so equal bins are filled as a group. A new bin is opened only if none has room.
    """
    caps = np.array([capacity, max_pieces or capacity, max_attention or capacity * capacity], float)
    w = np.array(weights, float)
    size = 1024
    room, first, count, used = np.zeros((size, 3)), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    groups, bins, out = 0, 0, []

    def add(residual, start, many, filled):
        nonlocal size, room, first, count, used, groups
        if many <= 0:
            return
        if groups == size:
            room, first, count, used = np.vstack([room, np.zeros_like(room)]), np.tile(first, 2), np.tile(count, 2), np.tile(used, 2)
            size *= 2
        room[groups], first[groups], count[groups], used[groups] = residual, start, many, filled
        groups += 1

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        if length > capacity or need[2] > caps[2]:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            fit = np.flatnonzero((room[:groups] >= need).all(axis=1))
            if len(fit):
                if rule == "norm":
                    cost = (w * ((room[fit] - need) / caps) ** 2).sum(axis=1)
                else:
                    cost = (w * room[fit] * need / caps**2).sum(axis=1)
                g = int(fit[np.argmin(cost)])
                residual, start, many, filled = room[g].copy(), first[g], count[g], used[g]
                groups -= 1  # the last group takes the place of the chosen one
                room[g], first[g], count[g], used[g] = room[groups], first[groups], count[groups], used[groups]
            else:
                residual, start, filled = caps.copy(), bins, 0
                many = -(-left // int((residual // need).min()))
                bins += many
            each = int((residual // need).min())
            placed = min(left, each * many)
            whole, rest = divmod(placed, each)
            out.append((length, rank, rank + placed, start, each, filled))
            add(residual - each * need, start, whole, filled + each * length)
            add(residual - rest * need, start + whole, int(rest > 0), filled + rest * length)
            add(residual, start + whole + (rest > 0), many - whole - (rest > 0), filled)
            left, rank = left - placed, rank + placed
    return np.array(out, np.int64).reshape(-1, 6)


def pack_pieces(rows: DataFrame, capacity: int = 2048, **limits) -> DataFrame:
    """Add sequence_id and offset to stored rows of token_pieces. limits: as in plan_bins."""
    spark = rows.sparkSession
    counts = rows.groupBy("_part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_bins(histogram, capacity, **limits))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranked = rows.join(before, ["_part", "length"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    kept = [c for c in rows.columns if c not in ("_part", "_nth")]
    kinds = dict(rows.dtypes)

    def placer():
        table = plan.value
        order = np.lexsort((table[:, 1], table[:, 0]))
        length, start, _, first, each, offset = table[order].T
        keys = length * (1 << 44) + start  # ranks stay below 2**44

        def step(batch):
            own, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, own * (1 << 44) + rank, side="right") - 1
            place = rank - start[at]
            out = {c: batch.column(c) for c in kept}
            out["sequence_id"] = pa.array(first[at] + place // each[at])
            out["offset"] = pa.array(offset[at] + place % each[at] * own)
            return out

        return step

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return map_arrow(ranked.select(*kept, "_rank"), placer, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, **limits) -> DataFrame:
    """Every piece of every row with its sequence and its place there, gapless from 0.

    Null and empty texts are one piece of one token. A null doc_id stays null; repeated rows are packed one
    by one; an empty table gives an empty result; extra columns are dropped. The limits on pieces and on
    attention bind only if given: without them any mix that fits in tokens fits.
    """
    return pack_pieces(durable(token_pieces(docs, path, capacity, end_id, keep_ids)), capacity, **limits)
