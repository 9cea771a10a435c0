"""Removal of repeated word windows, with a count-min prefilter.

Pass one sketches the anchors of all windows (see windows.py: a repeated window has a repeated anchor, and
there is one anchor for about a dozen windows). Pass two sends only windows whose anchor may be repeated
to shards by their own hash, where they are grouped exactly. Windows that repeat within a batch are
settled there and sent once. Windows are compared by 128 bits: shard and group hash of 64, and a second
one of 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmap.llm.common import id_type, map_arrow, total_bytes
from quillmap.llm.cuts import Parcels, apply_cuts, covered, keyed, parcel_schema, settle, shard_count
from quillmap.llm.sketch import repeat_sketch, slice_bits, width_bits
from quillmap.llm.tokens import PieceCache
from quillmap.llm.windows import MULTIPLIERS, blocks, rolling

#: Words in a block of windows; about ten arrays of as many longs are held at a time.
SCAN_WORDS = 1 << 18
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8")])


def word_units():
    """text -> hashes of its words as uint64. Words are runs of anything but ASCII white space."""
    import xxhash

    cache = PieceCache(xxhash.xxh3_64_intdigest, limit=250_000)
    look = cache.__getitem__

    def units(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(look, words), np.uint64, len(words))

    return units


def window_cuts(docs: DataFrame, window: int = 35, gram: int = 12) -> DataFrame:
    """Intervals of words in repeated windows: doc_id, hash of the text, starts, lens."""
    rows = keyed(docs)
    size = total_bytes(rows)
    gram = min(gram, window)
    bits = width_bits(size // 60)
    sketch = repeat_sketch(rows.select("text"), _anchor_finder(window, gram), bits, 1 << slice_bits(size // 60, bits))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    shards = shard_count(size)

    def sender():
        known, units = shared.value, word_units()

        def step(batch):
            texts = batch.column("text").to_pylist()
            row, start, a, b = [], [], [], []
            for block in blocks(((i, units(t)) for i, t in enumerate(texts)), window, gram, SCAN_WORDS):
                flagged = known.may_repeat(block.grams[block.anchor[block.runs]])
                own = np.flatnonzero(np.repeat(flagged, np.diff(np.append(block.runs, len(block.anchor)))))
                if len(own):
                    at = block.place[own]
                    row.append(block.row[own])
                    start.append(at + block.shift[own])
                    a.append(rolling(block.units, window, MULTIPLIERS[1])[at])
                    b.append(rolling(block.units, window, MULTIPLIERS[2])[at])
            parcels = Parcels(batch)
            if row:
                _send(parcels, np.concatenate(row), np.concatenate(start), np.concatenate(a), np.concatenate(b))
            return parcels.columns()

        return step

    def _send(parcels, row, start, a, b):
        order = np.lexsort((b, a))
        first = np.ones(len(a), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.cumsum(first) - 1
        many = np.bincount(group)[group] > 1
        repeated = np.zeros(len(a), bool)
        repeated[order[many]] = True
        entry = np.empty(len(a), _ENTRY)
        entry["a"], entry["b"] = a, b
        shard = (a % np.uint64(shards)).astype(np.int64)
        if repeated.any():
            at = np.flatnonzero(repeated)
            new = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)])
            runs = np.flatnonzero(new)
            n = np.diff(np.append(runs, len(at)))
            parcels.add(shard[at[0]], True, row[at[runs]], start[at[runs]], n + window - 1)
        told = order[many & first]
        asks = np.flatnonzero(~repeated)
        asks = asks[np.argsort(shard[asks], kind="stable")]
        told = told[np.argsort(shard[told], kind="stable")]
        ask_shards, told_shards = shard[asks], shard[told]
        for s in np.union1d(ask_shards, told_shards):
            x = asks[np.searchsorted(ask_shards, s) : np.searchsorted(ask_shards, s, "right")]
            y = told[np.searchsorted(told_shards, s) : np.searchsorted(told_shards, s, "right")]
            parcels.add(s, False, row[x], start[x], np.zeros(0), entry[x].tobytes(), entry[y].tobytes())

    def decide(received):
        asks, told = np.frombuffer(received.body, _ENTRY), np.frombuffer(received.told, _ENTRY)
        a, b = np.concatenate([asks["a"], told["a"]]), np.concatenate([asks["b"], told["b"]])
        order = np.lexsort((b, a))
        first = np.ones(len(a), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.cumsum(first) - 1
        # a told window counts twice: its batch has it in two places or more
        hit = np.bincount(group, np.where(order < len(asks), 1, 2))[group] > 1
        at = np.sort(order[hit & (order < len(asks))])
        return received.doc[at], received.starts[at], np.full(len(at), window)

    return settle(map_arrow(rows, sender, parcel_schema(docs)), shards, decide, id_type(docs))


def _anchor_finder(window: int, gram: int):
    def make():
        units = word_units()

        def step(batch):
            texts = batch.column("text").to_pylist()
            for block in blocks(((i, units(t)) for i, t in enumerate(texts)), window, gram, SCAN_WORDS):
                yield block.grams[block.anchor[block.runs]]

        return step

    return make


def remove_repeated_windows(docs: DataFrame, window: int = 35, keep_text: bool = False) -> DataFrame:
    """Per row doc_id, n_words, n_removed, kept_sha256, and with keep_text the kept words joined by a blank.

    A word goes if a window that covers it has a word sequence that starts in another place too, in any row.
    Null and empty texts have no words; texts shorter than a window lose none. Repeated rows are rows of
    their own, so their windows repeat; a null doc_id stays null. An empty table gives an empty result and
    extra columns are dropped.
    """
    cuts = window_cuts(docs, window)

    def make():
        def step(batch, cuts):
            n, gone, digest, kept_text = [], [], [], []
            for text, own in zip(batch.column("text").to_pylist(), cuts.to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                if own:
                    mask = covered(len(words), own)
                    kept = [w for w, m in zip(words, mask.tolist()) if not m]
                else:
                    kept = words
                joined = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept_text.append(joined.decode("utf-8", "surrogatepass"))
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            return out | ({"text": pa.array(kept_text, pa.string())} if keep_text else {})

        return step

    schema = f"doc_id {id_type(docs)}, n_words bigint, n_removed bigint, kept_sha256 string" + (", text string" if keep_text else "")
    return apply_cuts(docs, cuts, make, schema)


