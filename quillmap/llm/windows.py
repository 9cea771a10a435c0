"""Fixed-length windows over units (words or bytes): rolling hashes, and one anchor for each window.

The anchor of a window is the place of the smallest gram hash inside it, the leftmost of equals. It
depends on the window's content alone, so equal windows have equal anchors at equal offsets, and a gram
is the anchor of a repeated window only if it is itself an anchor in two places. Anchors are few: about
2 in (window - gram) units.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the rolling hashes.
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_PLACE_BITS = 26  # a block has fewer units than 2**26; fixed, so that ties fall alike in all blocks
MAX_UNITS = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def rolling(x: np.ndarray, length: int, multiplier: np.uint64) -> np.ndarray:
    """Hash of the ``length`` units from each place on, mixed. x: uint64 values of the units."""
    done, done_length = None, 0
    block, block_length, power = x, 1, multiplier
    with np.errstate(over="ignore"):
        while True:
            if length & block_length:
                if done is None:
                    done, done_length = block, block_length
                else:
                    n = len(x) - done_length - block_length + 1
                    done = done[:n] * power + block[done_length : done_length + n]
                    done_length += block_length
            if 2 * block_length > length:
                return mix(done)
            n = len(block) - block_length
            block = block[:n] * power + block[block_length : block_length + n]
            block_length, power = 2 * block_length, power * power


def anchors(x: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes of all places, and the anchor place of the window from each place on."""
    grams = rolling(x, gram, MULTIPLIERS[0])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, want = 1, window - gram + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        rest = want - span
        least = np.minimum(least[:-rest], least[rest:])
    return grams, (least & low).astype(np.int64)


def segments(length: int, window: int, most: int = MAX_UNITS) -> list[tuple[int, int]]:
    """(begin, end) parts of a long list of units; each window lies in exactly one part by its start."""
    if length < window:
        return []
    step = most - window + 1
    return [(at, min(length, at + most)) for at in range(0, max(1, length - window + 1), step)]


def starts_of_runs(values: np.ndarray) -> np.ndarray:
    """Places where a sorted or piecewise constant array takes a new value."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


class Block:
    """Units of several rows in one line, with the windows that lie inside one row."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.parts, self.rows, self.offsets, self.size = [], [], [], 0

    def add(self, row: int, offset: int, units: np.ndarray) -> None:
        self.parts.append(units)
        self.rows.append(row)
        self.offsets.append(offset)
        self.size += len(units)

    def close(self) -> None:
        """Set units, grams, and for every window: its place, row, start in the row, and anchor place."""
        self.units = np.concatenate(self.parts)
        lengths = np.array([len(p) for p in self.parts])
        begins = np.cumsum(lengths) - lengths
        self.grams, anchor = anchors(self.units, self.window, self.gram)
        counts = lengths - self.window + 1
        firsts = np.cumsum(counts) - counts
        self.place = np.arange(counts.sum()) + np.repeat(begins - firsts, counts)
        part = np.repeat(np.arange(len(lengths)), counts)
        self.row = np.array(self.rows)[part]
        self.shift = np.repeat(np.array(self.offsets) - begins, counts)  # place + shift = start in the row
        self.anchor = anchor[self.place]
        self.runs = starts_of_runs(self.anchor)


def blocks(rows, window: int, gram: int, most: int = MAX_UNITS):
    """Closed blocks of (row, units) pairs; rows too short for a window have none."""
    block = Block(window, gram)
    for row, units in rows:
        for begin, end in segments(len(units), window, most):
            if block.size and block.size + end - begin > most:
                block.close()
                yield block
                block = Block(window, gram)
            block.add(row, begin, units[begin:end])
    if block.size:
        block.close()
        yield block
