"""Periodic runs against a plain search of every start and every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tables import documents, odd_texts, rows_of, words

from quillmap.llm.periodic_runs import batch_runs, collapse, find_runs, openings, periodic_runs


def brute_runs(w):
    """Every maximal stretch with period q by comparing words one by one; kept if no smaller period fits it."""
    n, out = len(w), []
    for q in range(1, n):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            long_enough = j > i and length >= max(6, 4 * q)
            if long_enough and not any(all(w[k] == w[k - p] for k in range(start + p, j)) for p in range(1, q)):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    s, m, q = best[0] if best else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    listed, kept = "".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(x for k, x in enumerate(w) if k not in gone)
    return doc_id, len(runs), s, m, q, 1000 * m // q if best else None, sha(listed), sha(kept)


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_all_short_strings_of_two_letters():
    for n in range(13):
        for code in range(1 << n):
            w = [code >> k & 1 for k in range(n)]
            assert periodic_runs(np.array(w, np.int64)) == brute_runs(w), w


@pytest.mark.parametrize("seed", range(6))
def test_random_nested_repeats(seed):
    r = random.Random(seed)
    for _ in range(60):
        w = []
        while len(w) < 150:
            root = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(1, 9))]
            if r.random() < 0.4:
                root = root * r.randint(2, 5) + [r.randrange(3)]
            w += root * r.randint(1, 7) + root[: r.randint(0, len(root))]
        assert periodic_runs(np.array(w, np.int64)) == brute_runs(w)


def test_openings_stay_few():
    """One word many times, a text without repeats, the Fibonacci word: time is no square of the length."""
    assert len(openings(np.zeros(100_000, np.int64))[0]) == 1
    assert len(openings(np.arange(100_000))[0]) == 0
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    assert len(openings(np.array(b))[0]) < len(b)
    assert periodic_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    with pytest.raises(ValueError):
        periodic_runs(np.zeros(9, np.int64), times=3)


def test_collapse_keeps_first_periods():
    assert collapse(8, [(1, 6, 1)]).tolist() == [True, True, False, False, False, False, False, True]


def test_rows_equal_brute_force(spark):
    r = random.Random(4)
    texts = [t for t in odd_texts() if t[0] != 4]
    for k in range(120):
        root = " ".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
        texts.append((100 + k, "  ".join([root] * r.randint(1, 8)) + "\n" + " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))))
    texts += [(20_000 + k, " ".join(f"w{j % 37}" for j in range(90))) for k in range(40)]
    want = sorted((brute_row(i, t) for i, t in texts), key=repr)
    found = find_runs(documents(spark, texts), plant=True)
    assert rows_of(found, *COLUMNS) == want
    assert sum(w[1] for w in want) > 50
    for row in found.collect():
        assert hashlib.sha256(row.collapsed.encode()).hexdigest() == row.collapsed_sha256
        assert len(row.runs) == row.n_runs
    assert rows_of(find_runs(documents(spark, texts, extra=False), plant=True, whole=False)) == rows_of(found.select(*COLUMNS))
    assert find_runs(documents(spark, [])).count() == 0


def test_groups_of_texts_do_not_mix(monkeypatch):
    rows = [(k, t or "") for k, t in odd_texts()] + [(1, "a a a"), (2, "a a a a"), (3, "")]
    whole = batch_runs(rows, False)
    monkeypatch.setattr("quillmap.llm.periodic_runs.GROUP", 1)
    assert batch_runs(rows, False) == whole
    assert [x["n_runs"] for x in whole[-3:]] == [0, 0, 0]


def test_long_text(spark):
    """A text of 200 000 words, half of it one word."""
    text = " ".join(f"x{k}" for k in range(100_000)) + " y" * 100_000
    row = find_runs(documents(spark, [(1, text)])).collect()[0]
    assert (row.start, row.length, row.period) == (100_000, 100_000, 1)
