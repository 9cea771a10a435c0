"""Removal of byte strings that also start earlier, by suffix arrays.

Only stretches around anchors that may occur twice (sketch.py) can repeat. They go to shards by the hash
of their anchor, so equal strings meet in one shard and shards need no merging with each other; windows around
very common anchors are spread by their own fingerprints instead. A shard is
worked off in blocks in order of (doc_id, start): a suffix array by Larsson-Sadakane refinement, common
prefixes by Kasai's relation, classes of equal strings, and a binary search of each class among those of
the shard's earlier blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmap.llm.common import id_type, map_arrow, total_bytes
from quillmap.llm.cuts import KEY, Parcels, apply_cuts, covered, keyed, parcel_schema, settle, shard_count
from quillmap.llm.sketch import repeat_sketch, slice_bits, width_bits
from quillmap.llm.windows import MULTIPLIERS, blocks, rolling, starts_of_runs

#: Bytes in a block of windows while anchors are sought, and in a block of a shard's suffix array.
SCAN_BYTES, SORT_BYTES = 1 << 18, 1 << 20
#: Places from which an anchor's windows are settled one by one: below it an anchor brings a shard 11 MB at most.
HOT = 1 << 16
#: Fingerprint of a window on its way to the shard that settles it.
PRINT = np.dtype([("a", "<u8"), ("b", "<u8")])


def encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def byte_units(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)


def _words_of_eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the end."""
    out = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)].astype(np.uint64)
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the text from there on, exactly up to ``depth`` bytes at least.

    Larsson and Sadakane: after a sort by the first 8 bytes, only groups of equal rank are sorted again,
    by the rank of the place h bytes on, and h doubles.
    """
    n = len(data)
    key = _words_of_eight(data)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def set_ranks(places: np.ndarray, new: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Rank of a group is its first slot; gives the slots of groups that are still unsorted."""
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(places)))
        rank[places] = np.repeat(slots[starts], sizes)
        return slots[np.repeat(sizes > 1, sizes)]

    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    open_slots = set_ranks(order, new, np.arange(n)) if n else np.zeros(0, np.int64)
    h = 8
    while len(open_slots) and h < max(depth, 9):  # once at least: the padding at the end is no text
        places = order[open_slots]
        group = rank[places]
        ahead = places + h
        # of suffixes that end within h bytes the shorter goes first
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + h + 1, n - places)
        both = group * (n + h + 2) + second
        inner = np.argsort(both, kind="stable")
        places, both = places[inner], both[inner]
        order[open_slots] = places
        open_slots = set_ranks(places, np.concatenate([[True], both[1:] != both[:-1]]), open_slots)
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, enough: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, exact below ``enough``.

    Kasai: where a place and the one before it follow the neighbours of their neighbours, the length falls
    by one. Only heads of such runs are compared byte by byte; runs are begun anew after ``enough`` places.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (np.arange(1, n) % enough == 0)
    head[1:] |= data[:-1] != data[np.maximum(before[:-1], 0)]  # nothing in common there says nothing here
    heads = np.flatnonzero(head)
    key = _words_of_eight(data)
    length = np.zeros(len(heads), np.int64)
    active = np.flatnonzero(before[heads] >= 0)
    while len(active):
        a, b = heads[active] + length[active], before[heads[active]] + length[active]
        inside = np.minimum(n - a, n - b)
        differ = key[np.minimum(a, n - 1)] ^ key[np.minimum(b, n - 1)]
        lead = np.full(len(active), 8, np.int64)
        for k in range(8):
            lead = np.where((differ >> np.uint64(56 - 8 * k)) & np.uint64(0xFF) != 0, np.minimum(lead, k), lead)
        lead = np.clip(np.minimum(lead, inside), 0, 8)
        length[active] += lead
        active = active[(lead == 8) & (length[active] < 2 * enough)]
    at = np.cumsum(head) - 1
    by_place = length[at] - (np.arange(n) - heads[at])
    return np.maximum(by_place, 0)[order]


def first_of_class(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """For each valid place the earliest valid place with the same ``length`` bytes; -1 elsewhere."""
    order = suffix_array(data, length)
    own = np.cumsum(common_prefixes(data, order, length) < length)
    keep = valid[order]
    places, own = order[keep], own[keep]
    out = np.full(len(data), -1, np.int64)
    if len(places):
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[places] = np.repeat(np.minimum.reduceat(places, begin), np.diff(np.append(begin, len(places))))
    return out


class EarlierBlocks:
    """Windows of a shard's finished blocks as sorted fingerprints, in which later windows are sought."""

    def __init__(self):
        self.a = self.b = np.zeros(0, np.uint64)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.a):
            return np.zeros(len(a), bool)
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return (self.a[at] == a) & (self.b[at] == b)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge in windows that are not there yet; a stable sort merges two sorted runs in one pass."""
        order = np.argsort(a)
        a, b = np.concatenate([self.a, a[order]]), np.concatenate([self.b, b[order]])
        order = np.argsort(a, kind="stable")
        self.a, self.b = a[order], b[order]


def repeated_runs(pieces: list[bytes], length: int, block_bytes: int = SORT_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in order: (piece, start, n) of the runs of starts whose ``length`` bytes start earlier,
    in the same or a former piece. Pieces are no shorter than length; of equal pieces all but the first repeat whole.
    """
    seen: set[bytes] = set()
    earlier = EarlierBlocks()
    todo, equal = [], []
    for number, piece in enumerate(pieces):
        if piece in seen:
            equal.append(number)
        else:
            seen.add(piece)
            todo.append(number)
    seen.clear()
    found = [np.array([(k, 0, len(pieces[k]) - length + 1) for k in equal], np.int64).reshape(-1, 3)]
    at = 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and (end == at or size + len(pieces[todo[end]]) <= block_bytes):
            size += len(pieces[todo[end]])
            end += 1
        own = [pieces[k] for k in todo[at:end]]
        lengths = np.array([len(p) for p in own])
        begins = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(own), np.uint8)
        over = np.zeros(len(data) + 1, np.int32)  # places too near the end of their piece to begin a string
        np.add.at(over, begins + lengths - length + 1, 1)
        np.add.at(over, begins + lengths, -1)
        valid = np.cumsum(over[:-1]) == 0
        first = first_of_class(data, valid, length)
        place = np.arange(len(data))
        repeated = valid & (first != place)
        if len(earlier.a) or end < len(todo):
            heads = np.flatnonzero(valid & (first == place))
            units = data.astype(np.uint64) + np.uint64(1)
            a, b = rolling(units, length, MULTIPLIERS[1])[heads], rolling(units, length, MULTIPLIERS[2])[heads]
            known = earlier.has(a, b)
            old = np.zeros(len(data), bool)
            old[heads] = known
            repeated |= valid & old[np.maximum(first, 0)]
            if end < len(todo):
                earlier.add(a[~known], b[~known])
        hits = np.flatnonzero(repeated)
        if len(hits):
            # a run never goes on into the next piece: the last places of a piece are not valid
            runs = np.flatnonzero(np.concatenate([[True], hits[1:] != hits[:-1] + 1]))
            piece = np.searchsorted(begins, hits[runs], side="right") - 1
            n = np.diff(np.append(runs, len(hits)))
            found.append(np.stack([np.array(todo[at:end])[piece], hits[runs] - begins[piece], n], axis=1))
        at = end
    every = np.concatenate(found)
    return every[:, 0], every[:, 1], every[:, 2]


def first_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the entries whose fingerprint (a, b) has no earlier entry."""
    order = np.lexsort((np.arange(len(a)), b, a))
    out = np.ones(len(a), bool)
    out[order[1:]] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    return out


def repeat_cuts(docs: DataFrame, length: int = 100, gram: int = 28, hot: int = HOT) -> DataFrame:
    """Byte intervals that repeat something earlier: doc_id, hash of the text, starts, lens.

    Stretches around an anchor that repeats meet in the shard of the anchor, where suffix arrays settle them. An
    anchor in ``hot`` places or more, such as a footer amid differing text, would fill its shard: the windows around it
    go one by one, each as a fingerprint of 128 bits, to the shard of that fingerprint. Every equal window has the same
    anchor and so goes the same way, and an anchor brings a shard fewer than ``hot`` stretches.
    """
    rows = keyed(docs)
    size = total_bytes(rows)
    gram = min(gram, length)
    bits = width_bits(size // 30)
    # a full sketch has large counters everywhere: hot is what stands out from their mean
    hot = max(hot, 8 * (size // 30) >> bits)
    sketch = repeat_sketch(rows.select("text"), _anchor_finder(length, gram), bits, 1 << slice_bits(size // 30, bits), hot=hot)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    shards = shard_count(size, 128)

    def sender():
        known = shared.value

        def step(batch):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column(KEY).to_pylist()
            data = [encode(t) for t in batch.column("text").to_pylist()]
            # rows with equal id and text are one row, so the first of them speaks for all
            once = {(ids[i], keys[i]): i for i in reversed(range(len(ids)))}.values()
            ranks = sorted(once, key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, keys[i]))
            sent: dict[bytes, None] = {}
            row, start, n, content, shard = [], [], [], [], []
            sure: list[tuple[int, int, int]] = []
            single: list[tuple[np.ndarray, ...]] = []
            for block in blocks(((i, byte_units(data[i])) for i in ranks), length, gram, SCAN_BYTES):
                grams = block.grams[block.anchor[block.runs]]
                warm = known.is_hot(grams)
                alone: list[np.ndarray] = []
                # a run of equal anchors ends where the row does, too
                ends = np.append(block.runs[1:], len(block.anchor))
                for k in np.flatnonzero(known.may_repeat(grams)):
                    w, e = block.runs[k], ends[k]
                    r, s, windows = int(block.row[w]), int(block.place[w] + block.shift[w]), int(e - w)
                    piece = data[r][s : s + windows + length - 1]
                    if piece in sent:
                        sure.append((r, s, len(piece)))
                        continue
                    sent[piece] = None
                    if warm[k]:
                        alone.append(np.arange(w, e))
                        continue
                    row.append(r), start.append(s), n.append(len(piece)), content.append(piece), shard.append(int(grams[k] % np.uint64(shards)))
                if alone:
                    w = np.concatenate(alone)
                    at = block.place[w]
                    a, b = (rolling(block.units, length, m)[at] for m in MULTIPLIERS[1:])
                    single.append((block.row[w], at + block.shift[w], a, b))
            parcels = Parcels(batch)
            if single:
                r, s, a, b = (np.concatenate(x) for x in zip(*single))
                first = first_places(a, b)
                # windows found before in this batch, as runs of neighbours
                again_r, again_s = r[~first], s[~first]
                runs = starts_of_runs(again_s - np.arange(len(again_s)) + (again_r << 32))
                sure += zip(again_r[runs].tolist(), again_s[runs].tolist(), (np.diff(np.append(runs, len(again_s))) + length - 1).tolist())
                r, s, prints = r[first], s[first], np.rec.fromarrays([a[first], b[first]], dtype=PRINT)
                to = (prints["a"] % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((s, r, to))
                for x in np.split(order, starts_of_runs(to[order])[1:]):
                    parcels.add(to[x[0]], False, r[x], s[x], np.zeros(len(x), np.int64), told=prints[x].tobytes())
            if sure:
                r, s, z = (np.array(x) for x in zip(*sorted(sure)))
                parcels.add(int(r[0]) % shards, True, r, s, z)
            if row:
                row_a, start_a, n_a, shard_a = np.array(row), np.array(start), np.array(n), np.array(shard)
                order = np.lexsort((start_a, row_a, shard_a))
                borders = np.flatnonzero(np.concatenate([[True], shard_a[order][1:] != shard_a[order][:-1]]))
                for x in np.split(order, borders[1:]):
                    parcels.add(shard_a[x[0]], False, row_a[x], start_a[x], n_a[x], b"".join([content[k] for k in x]))
            sent.clear(), content.clear()  # the parcels hold a copy
            return parcels.columns()

        return step

    def decide(received):
        ends = np.cumsum(received.lens)
        ids, keys = received.ids, received.keys
        place = sorted(range(len(ids)), key=lambda d: (ids[d] is not None, ids[d] if ids[d] is not None else 0, keys[d]))
        # rows with equal id and text come from several batches with the same pieces; each piece is one find
        other = [True] + [ids[d] != ids[e] or keys[d] != keys[e] for d, e in zip(place, place[1:])]
        by_doc = np.empty(len(ids), np.int64)
        by_doc[place] = np.cumsum(other[: len(ids)])
        rank = by_doc[received.doc]
        order = np.lexsort((received.starts, rank))
        same = (rank[order][1:] == rank[order][:-1]) & (received.starts[order][1:] == received.starts[order][:-1])
        order = order[np.concatenate([[True], ~same])[: len(order)]]
        body = received.body
        alone = received.lens == 0  # hot windows, told by their fingerprints
        whole, single = order[~alone[order]], order[alone[order]]
        piece, start, n = repeated_runs([body[ends[k] - received.lens[k] : ends[k]] for k in whole], length)
        prints = np.frombuffer(received.told, PRINT)[(np.cumsum(alone) - 1)[single]]
        again = single[~first_places(prints["a"], prints["b"])]
        own = np.concatenate([whole[piece], again])
        start, n = np.append(start, np.zeros(len(again), np.int64)), np.append(n, np.ones(len(again), np.int64))
        by_doc = np.argsort(received.doc[own], kind="stable")
        own, start, n = own[by_doc], start[by_doc], n[by_doc]
        return received.doc[own], received.starts[own] + start, n + length - 1

    return settle(map_arrow(rows, sender, parcel_schema(docs)), shards, decide, id_type(docs))


def _anchor_finder(length: int, gram: int):
    def make():
        def step(batch):
            texts = batch.column("text").to_pylist()
            for block in blocks(((i, byte_units(encode(t))) for i, t in enumerate(texts)), length, gram, SCAN_BYTES):
                yield block.grams[block.anchor[block.runs]]

        return step

    return make


def _kept(text: str, cuts: list[dict] | None) -> tuple[bytes, bytes, int]:
    """All bytes of a text, those kept, and the number of runs removed."""
    data = encode(text)
    if not cuts:
        return data, data, 0
    mask = covered(len(data), cuts)
    spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
    return data, np.frombuffer(data, np.uint8)[~mask].tobytes(), spans


def remove_repeated_bytes(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row with a smaller
    doc_id (null before all), or earlier in the same row. Rows that share a doc_id but not the text go in the
    order of a hash of the text. Rows with equal doc_id and text count as one: what repeats inside them goes
    from each, the first find stays in each. Null and empty texts have no bytes; shorter texts lose none. An
    empty table gives an empty result, extra columns are dropped.
    """

    def make():
        def step(batch, cuts):
            rows = [_kept(t, own) for t, own in zip(batch.column("text").to_pylist(), cuts.to_pylist())]
            return {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(data) for data, _, _ in rows], pa.int64()),
                "n_removed": pa.array([len(data) - len(kept) for data, kept, _ in rows], pa.int64()),
                "n_spans": pa.array([spans for _, _, spans in rows], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(kept).hexdigest() for _, kept, _ in rows], pa.string()),
            }

        return step

    schema = f"doc_id {id_type(docs)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return apply_cuts(docs, repeat_cuts(docs, length, hot=hot), make, schema)


def cut_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """All rows with all their columns, the text without the bytes that remove_repeated_bytes removes.

    Of a character cut in two nothing is left. A null text becomes the empty one.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))

    def make():
        def step(batch, cuts):
            texts = batch.column("text").to_pylist()
            kept = [_kept(t, own)[1].decode("utf-8", "ignore") if own else t for t, own in zip(texts, cuts.to_pylist())]
            return {"doc_id": batch.column("doc_id"), "text": pa.array(kept, pa.string())}

        return step

    cut = apply_cuts(docs, repeat_cuts(docs, length), make, f"doc_id {id_type(docs)}, text string", carry)
    return cut.select(*docs.columns)
