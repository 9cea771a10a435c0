"""Removing intervals from texts: parcels on their way to shards, and the final cut.

A parcel is one row for a shard from one Arrow batch: the rows it speaks of, how many entries each has,
where they start, and their contents in one binary. Shards are chosen by the hash of the content, after
equal contents of a batch are sent once only, so a shard has at most one entry a batch for each content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import id_type, map_arrow, text_key, text_rows
from quillmap.llm.windows import starts_of_runs

#: Names of columns of this module; no table is expected to have them.
KEY, CUTS = "__llm_key", "__llm_cuts"


def keyed(docs: DataFrame) -> DataFrame:
    return text_rows(docs).select("doc_id", text_key(F.col("text")).alias(KEY), "text")


def parcel_schema(docs: DataFrame) -> str:
    kind = id_type(docs)
    return f"shard int, sure boolean, doc_ids array<{kind}>, keys array<bigint>, counts binary, starts binary, lens binary, body binary, told binary"


class Parcels:
    """Collects the parcels of one batch."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.keys = batch.column("doc_id"), batch.column(KEY)
        self.rows: list[tuple] = []

    def add(self, shard: int, sure: bool, row: np.ndarray, starts: np.ndarray, lens: np.ndarray, body: bytes = b"", told: bytes = b"") -> None:
        """row: ascending row numbers of the entries in the batch."""
        runs = starts_of_runs(row)
        own = pa.array(row[runs])
        counts = np.diff(np.append(runs, len(row))).astype("<i4")
        self.rows.append(
            (int(shard), sure, self.ids.take(own).to_pylist(), self.keys.take(own).to_pylist(), counts.tobytes(), starts.astype("<i4").tobytes(), lens.astype("<i4").tobytes(), body, told)
        )

    def columns(self) -> dict:
        columns = list(zip(*self.rows)) if self.rows else [()] * 9
        kinds = [pa.int32(), pa.bool_(), pa.list_(self.ids.type), pa.list_(pa.int64()), *[pa.binary()] * 5]
        names = ["shard", "sure", "doc_ids", "keys", "counts", "starts", "lens", "body", "told"]
        return {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}


class Received:
    """The parcels of a shard, their entries in one line."""

    def __init__(self, parcels: list[dict]):
        join = lambda name: np.concatenate([np.frombuffer(p[name], "<i4") for p in parcels])
        self.ids = [d for p in parcels for d in p["doc_ids"]]
        self.keys = [k for p in parcels for k in p["keys"]]
        self.doc = np.repeat(np.arange(len(self.ids)), join("counts"))
        self.starts, self.lens = join("starts"), join("lens")
        self.body = b"".join([p["body"] for p in parcels])
        self.told = b"".join([p["told"] for p in parcels])


def cut_rows(received: Received, doc: np.ndarray, starts: np.ndarray, lens: np.ndarray, id_kind: pa.DataType) -> pa.RecordBatch:
    """One row for each document with its intervals; doc: places in received.ids, equal ones together."""
    runs = starts_of_runs(doc)
    ends = np.append(runs[1:], len(doc))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([received.ids[d] for d in doc[runs]], id_kind),
            KEY: pa.array([received.keys[d] for d in doc[runs]], pa.int64()),
            "starts": pa.array([starts[a:b].astype("<i4").tobytes() for a, b in zip(runs, ends)], pa.binary()),
            "lens": pa.array([lens[a:b].astype("<i4").tobytes() for a, b in zip(runs, ends)], pa.binary()),
        }
    )


def shard_count(text_bytes: int, least: int = 64) -> int:
    """One shard for 1 GB / least of text, and ``least`` at least: a document's entries spread alike on all smaller inputs."""
    return max(least, text_bytes * least >> 30)


def settle(parcels: DataFrame, shards: int, decide, id_sql: str) -> DataFrame:
    """Send parcels to their shards; ``decide(Received)`` gives (doc, starts, lens) of what is to be cut.

    A task holds the parcels of its shards. Their number grows with the input, so their size does not.
    """

    def reduce(batches):
        waiting: dict[int, list[dict]] = {}
        for batch in batches:
            id_kind = batch.schema.field("doc_ids").type.value_type
            for parcel in batch.to_pylist():
                if parcel["sure"]:
                    r = Received([parcel])
                    yield cut_rows(r, r.doc, r.starts, r.lens, id_kind)
                else:
                    waiting.setdefault(parcel["shard"], []).append(parcel)
        for shard in list(waiting):
            r = Received(waiting.pop(shard))
            doc, starts, lens = decide(r)
            if len(doc):
                yield cut_rows(r, doc, starts, lens, id_kind)

    return parcels.repartitionById(shards, F.col("shard")).mapInArrow(reduce, f"doc_id {id_sql}, {KEY} bigint, starts binary, lens binary")


def covered(n: int, cuts: list[dict] | None) -> np.ndarray:
    """Mask of the n units that lie in any interval."""
    marks = np.zeros(n + 1, np.int32)
    for cut in cuts or ():
        starts, lens = np.frombuffer(cut["starts"], "<i4"), np.frombuffer(cut["lens"], "<i4")
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + lens, -1)
    return np.cumsum(marks[:n]) > 0


def apply_cuts(docs: DataFrame, cuts: DataFrame, make, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Join every row with its intervals and map (batch, list of cuts per row) to columns; carry others along.

    Rows with equal doc_id and text bring equal cuts; each is kept once, or n rows would get n lists each.
    """
    gathered = cuts.groupBy("doc_id", KEY).agg(F.collect_set(F.struct("starts", "lens")).alias(CUTS))
    text = F.coalesce(F.col("text"), F.lit(""))
    left, right = docs.select("doc_id", text_key(text).alias(KEY), text.alias("text"), *[f"`{c}`" for c in carry]).alias("l"), gathered.alias("r")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col(f"l.{KEY}") == F.col(f"r.{KEY}"))
    joined = left.join(right, on, "left").select("l.doc_id", "l.text", f"r.{CUTS}", *[f"l.`{c}`" for c in carry])

    def cutter():
        step = make()
        return lambda batch: step(batch, batch.column(CUTS)) | {c: batch.column(c) for c in carry}

    kinds = dict(docs.dtypes)
    return map_arrow(joined, cutter, schema + "".join(f", `{c}` {kinds[c]}" for c in carry))
