"""Repeated windows, repeated strings and near-duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from tables import documents, odd_texts, rows_of, words

from quillmap.llm.cuts import covered
from quillmap.llm.simhash import allocate, components, keep_one, link_edges, linked_stars, near_duplicates
from quillmap.llm.sketch import SEEDS, Sketch, _places, repeat_sketch, slice_bits, width_bits
from quillmap.llm.substring_dedup import remove_repeated_windows
from quillmap.llm.suffix_dedup import common_prefixes, cut_repeated_bytes, remove_repeated_bytes, repeated_runs, suffix_array
from quillmap.llm.windows import MULTIPLIERS, anchors, blocks, rolling, segments


def test_rolling_hash_and_anchors():
    r = np.random.default_rng(1)
    x = r.integers(1, 3, 400).astype(np.uint64)
    for length in (1, 2, 7, 12, 35):
        h = rolling(x, length, MULTIPLIERS[0])
        same = {}
        for k in range(len(x) - length + 1):
            same.setdefault(tuple(x[k : k + length]), set()).add(int(h[k]))
        assert all(len(v) == 1 for v in same.values())
        assert len(set().union(*same.values())) == len(same)
    grams, at = anchors(x, 20, 6)
    for k in range(len(x) - 19):
        assert k <= at[k] <= k + 14
    offsets = {}
    for k in range(len(x) - 19):
        offsets.setdefault(tuple(x[k : k + 20]), set()).add(int(at[k] - k))
    assert all(len(v) == 1 for v in offsets.values())


def test_blocks_hold_every_window_once():
    r = random.Random(2)
    rows = [(k, np.arange(r.choice([0, 1, 4, 5, 6, 30, 200]), dtype=np.uint64) + np.uint64(1000 * k)) for k in range(30)]
    seen = Counter()
    for block in blocks(rows, 5, 2, 64):
        for place, row, shift in zip(block.place, block.row, block.shift):
            start = int(place + shift)
            assert block.units[place : place + 5].tolist() == dict(rows)[int(row)][start : start + 5].tolist()
            seen[int(row), start] += 1
    assert seen == Counter((k, s) for k, u in rows for s in range(len(u) - 4))
    assert segments(10**7, 100)[-1][1] == 10**7


def test_sketch_loses_no_repeat(spark):
    r = np.random.default_rng(3)
    once, twice = r.integers(1, 2**63, 3000).astype(np.uint64), r.integers(1, 2**63, 500).astype(np.uint64)
    values = np.concatenate([once, twice, twice]).view(np.int64).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(5)
    sketch = repeat_sketch(rows, lambda: lambda batch: iter([batch.column("v").to_numpy().view(np.uint64)]), 16, flush=100)
    assert isinstance(sketch, Sketch)
    assert sketch.may_repeat(twice).all()
    assert sketch.may_repeat(once).mean() < 0.2


def brute_windows(texts, window):
    lists = [words(t) for _, t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in lists for k in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(texts, lists):
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [3, 35])
def test_repeated_windows(spark, window):
    docs = documents(spark, odd_texts())
    assert rows_of(remove_repeated_windows(docs, window)) == brute_windows(odd_texts(), window)
    assert remove_repeated_windows(documents(spark, [])).count() == 0
    kept = remove_repeated_windows(docs, window, keep_text=True).collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in kept)


def brute_bytes(texts, length):
    """Rows with equal id and text count as one; null ids go first, then the key's order decides, so tests keep those texts apart."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            own = data[k : k + length]
            if own in seen:
                gone[k : k + length] = True
            seen.add(own)
        gone = gone[:-1]
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc_id, text] = (doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[row] for row in texts), key=repr)


@pytest.mark.parametrize("length", [40, 100])
def test_repeated_bytes(spark, length):
    docs = documents(spark, odd_texts())
    assert rows_of(remove_repeated_bytes(docs, length)) == brute_bytes(odd_texts(), length)
    assert remove_repeated_bytes(documents(spark, [])).count() == 0
    cut = cut_repeated_bytes(docs, length)
    assert cut.columns == docs.columns and cut.count() == len(odd_texts())


def test_suffix_arrays_common_prefixes_and_blocks():
    r = random.Random(3)
    for _ in range(120):
        alphabet, length = r.choice([b"ab", b"abc", b"\x00\x01", b"a"]), r.choice([3, 10, 20, 100])
        base = [bytes(r.choice(alphabet) for _ in range(r.randint(length, 3 * length))) for _ in range(4)]
        own = [p[r.randint(0, len(p) - length) :] for p in (r.choice(base) + r.choice([b"", *base]) for _ in range(r.randint(1, 10)))]
        seen, want = set(), []
        for p in own:
            want.append([k for k in range(len(p) - length + 1) if p[k : k + length] in seen or seen.add(p[k : k + length])])
        found = [[] for _ in own]
        for piece, start, n in zip(*repeated_runs(own, length, r.choice([50, 200, 10**6]))):
            found[piece] += range(start, start + n)
        assert [sorted(hits) for hits in found] == want
        text = b"".join(own)
        order = suffix_array(np.frombuffer(text, np.uint8), 10**9)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        common = common_prefixes(np.frombuffer(text, np.uint8), order, length)
        for k in range(1, len(order), 7):
            a, b = text[order[k] :], text[order[k - 1] :]
            n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(n, length) == min(common[k], length)


def test_covered():
    cuts = [{"starts": np.array([1, 3], "<i4").tobytes(), "lens": np.array([2, 4], "<i4").tobytes()}]
    assert covered(9, cuts).tolist() == [False, True, True, True, True, True, True, False, False]
    assert not covered(3, None).any()


def brute_fingerprint(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def test_near_duplicates(spark):
    texts = [(i, t) for i, t in odd_texts() if i != 4]
    prints = [brute_fingerprint(t) for _, t in texts]
    group = brute_components(prints)
    least = {g: min((texts[k][0] for k in range(len(texts)) if group[k] == g and texts[k][0] is not None), default=None) for g in group}
    want = sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(texts, prints, group)), key=repr)
    docs = documents(spark, texts)
    assert rows_of(near_duplicates(docs)) == want
    one = keep_one(docs)
    assert one.columns == docs.columns
    assert one.count() == len(set(group))
    assert near_duplicates(documents(spark, [])).count() == 0
    assert keep_one(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_links_between_fingerprints_are_complete(spark, monkeypatch, block):
    """Random values, chains one to three bits apart, and a crowd round one value, also in crowded buckets."""
    monkeypatch.setattr("quillmap.llm.simhash.BLOCK", block)
    r = random.Random(6)
    values = {0, 2**64 - 1} | {r.getrandbits(64) for _ in range(300)}
    for _ in range(20):
        v = r.getrandbits(64)
        for _ in range(8):
            values.add(v)
            for b in r.sample(range(64), r.randint(1, 4)):
                v ^= 1 << b
    crowd = r.getrandbits(64)
    values |= {crowd ^ 1 << a ^ 1 << b for a in range(10) for b in range(12, 20)}
    values = sorted(values)
    group = brute_components(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = link_edges(classes, 3)
    assert edges.count() < 20 * len(values)
    roots = {r.node: r.root for r in components(edges).collect()}
    found, want = {}, {}
    for v, g in zip(signed, group):
        found.setdefault(roots.get(v, v), set()).add(v)
        want.setdefault(g, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_allocation_and_stars():
    cost, chosen = allocate([[0, 1, 5, 20], [0, 2, 3, 9], [0, 8, 9, 10]], 1)
    assert sum(chosen) == 1 and cost == min(
        a + b + c
        for x, a in enumerate([0, 1, 5, 20])
        for y, b in enumerate([0, 2, 3, 9])
        for z, c in enumerate([0, 8, 9, 10])
        if x + y + z - 3 == 1
    )
    keys, values = np.array([1, 1, 1, 2, 2]), np.array([0, 7, 31 << 40, 0, 3])
    a, b = linked_stars(keys, values, 3)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 3), (0, 7)]


def test_components_of_a_long_chain_and_a_hub(spark):
    pairs = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert roots == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)}


def test_component_rounds_grow_with_the_logarithm(spark):
    """A chain of 10 000 rising ids, one of random ids, and one of ids that rise and fall in turn."""
    r = random.Random(3)
    ids = r.sample(range(20_000, 10**6), 3000)
    chain = [(k, k + 1) for k in range(10_000)] + list(zip(ids, ids[1:]))
    saw = [10**6 + (k // 2 if k % 2 else 5000 + k) for k in range(2000)]
    edges = spark.createDataFrame(chain + list(zip(saw, saw[1:])), "a bigint, b bigint").repartition(4)
    sizes = []
    roots = {x.node: x.root for x in components(edges, sizes).collect()}
    assert len(sizes) <= 15
    assert all(2 * b <= a + 2 for a, b in zip(sizes, sizes[1:]))
    want = {k: 0 for k in range(10_001)} | {k: min(ids) for k in ids} | {k: min(saw) for k in saw}
    assert roots == want


def test_sketch_uses_all_slices_and_both_rows():
    """Anchors are smallest hashes; their places are even all the same, and few that are seen once pass either row."""
    r = random.Random(9)
    text = np.frombuffer("".join(r.choice("abcdefghij ") for _ in range(400_000)).encode(), np.uint8)
    grams, at = anchors(text.astype(np.uint64) + np.uint64(1), 100, 28)
    own = np.unique(grams[np.unique(at)])
    bits = width_bits(len(own))
    for places in _places(own, bits):
        slices = np.bincount(places >> (bits - 6), minlength=64)
        assert slices.max() < 2 * slices.mean()
        _, back, times = np.unique(places, return_inverse=True, return_counts=True)
        assert (times[back] > 1).mean() < 0.3  # four to eight counters an anchor
    assert len(SEEDS) == 2 and [slice_bits(n, width_bits(n)) for n in (10, 10**7, 10**9, 10**12)] == [6, 6, 10, 13]


def test_sketch_with_more_slices(spark):
    values = [k * 2654435761 for k in range(5000)] + [k * 2654435761 for k in range(0, 5000, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(3)
    finder = lambda: lambda batch: iter([batch.column("v").to_numpy().view(np.uint64)])
    own = np.array(values[:5000], np.int64).view(np.uint64)
    found = [repeat_sketch(rows, finder, 16, slices).may_repeat(own) for slices in (64, 512)]
    assert (found[0] == found[1]).all() and found[0][::7].all() and found[0].mean() < 0.3
