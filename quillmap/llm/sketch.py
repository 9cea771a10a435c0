"""Count-min sketch of anchor grams, merged from the tasks and broadcast as bits.

It answers "may this gram be an anchor in two places or more?": never no for one that is. Counters of at least
``hot`` are named one by one: a gram that is an anchor in so many places is always known as hot. The width grows
with the input up to a bound; beyond the bound more grams pass, and the exact stage after it has more to
do, but results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.windows import MULTIPLIERS, mix

#: Seeds of the rows. Anchors are the smallest hashes of their windows, so their own top bits are nearly all zero;
#: each row mixes them anew before it takes its bits, and slices and counters are used alike.
SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
ROWS = len(SEEDS)


def width_bits(units: int, least: int = 16, most: int = 28) -> int:
    """log2 of the counters of a row for about this many anchors; 2**28 is 64 MB of broadcast bits."""
    return min(most, max(least, int(np.ceil(np.log2(max(1, 4 * units))))))


def slice_bits(units: int, bits: int) -> int:
    """log2 of the slices of a row: about 2**20 anchors in each, so a merging task reads no more on larger inputs; from 64 to 8192."""
    return min(13, bits - 4, max(6, int(np.ceil(np.log2(max(1, units)))) - 20))


def _places(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mix((grams ^ seed) * MULTIPLIERS[1]) * MULTIPLIERS[2] >> np.uint64(64 - bits)).astype(np.int64) for seed in SEEDS]


def _rows(grams: np.ndarray, bits: int, slices: int) -> dict:
    """Places named once and more than once (with counts) by a task, as offsets inside slices."""
    inner = bits - slices.bit_length() + 1
    out: dict[str, list] = {"slice": [], "once": [], "more": [], "counts": []}
    for row, places in enumerate(_places(grams, bits)):
        values, counts = np.unique(places, return_counts=True)
        borders = np.searchsorted(values >> inner, np.arange(slices + 1))
        for k in range(slices):
            part = slice(borders[k], borders[k + 1])
            own, many = (values[part] & ((1 << inner) - 1)).astype("<u4"), counts[part] > 1
            if len(own):
                out["slice"].append(row * slices + k)
                out["once"].append(own[~many].tobytes())
                out["more"].append(own[many].tobytes())
                out["counts"].append(counts[part][many].astype("<u4").tobytes())
    return out


def repeat_sketch(rows: DataFrame, anchors_of, bits: int, slices: int = 64, flush: int = 4_000_000, hot: int = 0) -> Sketch:
    """Sketch of the arrays of gram hashes that ``anchors_of()(batch)`` gives for each Arrow batch of rows; slices: a power of two.

    hot: count from which a gram is hot, 0 for none. A row has at most (number of anchors / hot) hot counters.
    """
    inner = bits - slices.bit_length() + 1

    def emit(found):
        r = _rows(np.concatenate(found), bits, slices)
        return pa.RecordBatch.from_pydict(
            {"slice": pa.array(r["slice"], pa.int32())} | {c: pa.array(r[c], pa.binary()) for c in ("once", "more", "counts")}
        )

    def count(batches):
        step, found, n = anchors_of(), [], 0
        for batch in batches:
            for grams in step(batch):
                found.append(grams)
                n += len(grams)
                if n > flush:
                    yield emit(found)
                    found, n = [], 0
        if n:
            yield emit(found)

    def merge(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, once, more, counts in zip(*[batch.column(c).to_pylist() for c in ("slice", "once", "more", "counts")]):
                counters = seen.setdefault(k, np.zeros(1 << inner, np.int64))
                # a task names a place once, so no place is twice in either list
                counters[np.frombuffer(once, "<u4")] += 1
                counters[np.frombuffer(more, "<u4")] += np.frombuffer(counts, "<u4")
        for k, counters in seen.items():
            warm = np.flatnonzero(counters >= hot) if hot else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array([k], pa.int32()),
                    "bits": pa.array([np.packbits(counters > 1).tobytes()], pa.binary()),
                    "hot": pa.array([warm.astype("<u4").tobytes()], pa.binary()),
                }
            )

    parts = (
        rows.mapInArrow(count, "slice int, once binary, more binary, counts binary")
        .repartitionById(ROWS * slices, F.col("slice"))
        .mapInArrow(merge, "slice int, bits binary, hot binary")
        .collect()
    )  # ROWS * slices rows, together at most ROWS * 2**most / 8 bytes and the hot places
    packed = np.zeros((ROWS, slices, (1 << inner) // 8), np.uint8)
    warm: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(ROWS)]
    for part in sorted(parts, key=lambda part: part["slice"]):
        row, k = divmod(part["slice"], slices)
        packed[row, k] = np.frombuffer(part["bits"], np.uint8)
        warm[row].append(np.frombuffer(part["hot"], "<u4").astype(np.int64) + (k << inner))
    return Sketch(packed.reshape(ROWS, -1), bits, [np.concatenate(w) for w in warm])


class Sketch:
    def __init__(self, packed: np.ndarray, bits: int, hot: list[np.ndarray]):
        """hot: ascending hot places of each row."""
        self.packed, self.bits, self.hot = packed, bits, hot

    def may_repeat(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for row, places in enumerate(_places(grams, self.bits)):
            out &= (self.packed[row][places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
        return out

    def is_hot(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for warm, places in zip(self.hot, _places(grams, self.bits)):
            at = np.searchsorted(warm, places)
            out &= (at < len(warm)) & (np.append(warm, -1)[at] == places)
        return out
