"""Periodic runs of words by an online sparse dynamic program over diagonals.

Word i and an earlier occurrence of it at i - lag are a match on the diagonal ``lag``. While the words are read
from left to right, matches increment the lengths of the active diagonals; a diagonal that ends with
enough matches is a run and is emitted at once.

What makes it sparse: a diagonal is opened only where a run of its lag can begin. A run of smallest period q has at
least 3 q matches, so the g words that begin at its first match, g the power of two from q to 2 q - 1, stand q words
earlier too; and no smaller distance separates equal strings of g words there, as the run would have that smaller
period as well. So for each g only the nearest earlier occurrence of the g words has to be looked at, and only
if its distance is over g / 2 and at most g. Strings of g words that are not repeated within their text are
left out from then on, so plain text costs little more than finding its repeated words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmap.llm.common import id_type, map_arrow, text_rows

#: Words that are looked at together; a longer text is looked at by itself.
GROUP = 1 << 18


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the original words that the n words of a document are taken from, None if they stay as they are.

    For ids whose hash is a multiple of ten, the words from one place on repeat with a period given by the hash.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _grouped(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted places with ids: distance to the place before with the same id or 0, and dense ids, -1 if found once."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    back, dense = np.zeros(len(at), np.int64), np.empty(len(at), np.int64)
    back[order[1:]] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
    follows, goes_on = np.append(False, same), np.append(same, False)
    dense[order] = np.where(follows | goes_on, np.cumsum(~follows) - 1, -1)
    return back, dense


def openings(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of every diagonal that may become a run, by place; words: ids, one text or several with ids of their own."""
    n = len(words)
    at, ids = np.arange(n), words.astype(np.int64)
    places, lags, g = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    while len(at):
        back, dense = _grouped(ids, at)
        own = (2 * back > g) & (back <= g)
        first, lag = at[own], back[own]
        before = first - lag - 1
        begins = (before < 0) | (words[first - 1] != words[before])
        places.append(first[begins])
        lags.append(lag[begins])
        if 4 * g > n:  # a run of a period over g has more words than there are
            break
        # strings of 2 g words: both halves must be repeated
        full = np.full(n + 1, -1, np.int64)
        full[at] = dense
        second = full[np.minimum(at + g, n)]
        both = (dense >= 0) & (second >= 0)
        at, ids = at[both], dense[both] * (n + 1) + second[both]
        g *= 2
    places, lags = np.concatenate(places), np.concatenate(lags)
    order = np.argsort(places, kind="stable")
    return places[order], lags[order]


def periodic_runs(words: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch whose smallest period q fits max(least, times * q) words.

    words: ids of the words in a row; times is four at least. Sorted by start, then period.
    """
    if times < 4:
        raise ValueError("the openings are complete for four periods and more")
    places, lags = openings(words)
    runs: list[tuple[int, int, int]] = []
    opens = defaultdict(list)
    for place, lag in zip(places.tolist(), lags.tolist()):
        opens[place].append(lag)
    n, own = len(words), words.tolist()
    active: dict[int, int] = {}

    def end(lag: int, at: int) -> None:
        """The diagonal's last match is the word before ``at``."""
        length = active[lag] + lag
        if length >= max(least, times * lag) and not any(
            lag % other == 0 and matches >= length - other for other, matches in active.items() if other < lag
        ):
            runs.append((at - length, length, lag))

    order = sorted(opens)
    turn, i = 0, 0
    while active or turn < len(order):
        if not active:
            i = order[turn]
        if turn < len(order) and order[turn] == i:
            for lag in opens[i]:
                active.setdefault(lag, 0)
            turn += 1
        ended = [lag for lag in active if i >= n or own[i] != own[i - lag]]
        for lag in ended:
            end(lag, i)
        for lag in ended:
            del active[lag]
        for lag in active:
            active[lag] += 1
        i += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _digest(words: list[bytes], at: np.ndarray | None, runs: list[tuple[int, int, int]]) -> dict:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    if at is not None or runs:
        at = np.arange(len(words)) if at is None else at
        words = [words[k] for k in (at[collapse(len(at), runs)] if runs else at).tolist()]
    collapsed = b" ".join(words)
    return {
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(collapsed).hexdigest(),
        "runs": runs,
        "collapsed": collapsed,
    }


def batch_runs(rows: list[tuple[int | None, str]], plant: bool) -> list[dict]:
    """What find_runs returns for some rows; the texts are looked at in groups, each with word ids of its own."""
    out: list[dict] = []
    group: list[tuple[list[bytes], np.ndarray | None]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        codes, parts = 0, []
        for words, at in group:
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            parts.append((ids if at is None else ids[at]) + codes)
            codes += len(number)
        ends = np.cumsum([len(p) for p in parts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in group]
        # no match crosses from one text into the next, as they share no word id
        for start, length, period in periodic_runs(np.concatenate(parts)) if parts else ():
            k = int(np.searchsorted(ends, start, side="right"))
            found[k].append((start - (int(ends[k - 1]) if k else 0), length, period))
        out.extend(_digest(words, at, runs) for (words, at), runs in zip(group, found))
        group.clear()
        size = 0

    for doc_id, text in rows:
        words = text.encode("utf-8", "surrogatepass").split()
        if group and size + len(words) > GROUP:
            flush()
        group.append((words, planted(doc_id if plant else None, len(words))))
        size += len(words)
    flush()
    return out


DIGEST = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
WHOLE = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def find_runs(docs: DataFrame, plant: bool = False, whole: bool = True) -> DataFrame:
    """doc_id, the digest columns of every row's runs and, if whole, the runs and the collapsed text themselves.

    Words are parted by ASCII white space. ``plant`` makes periodic texts of a tenth of the documents, by the hash of
    their id; a null id is never planted. A null or empty text, or one of white space, has no words and no
    runs: zero, four nulls, digests of nothing. A null doc_id stays null; repeated rows give a row each; an
    empty table gives an empty result; extra columns are dropped. One text is looked at as a whole, in memory
    in proportion to its words; time grows with the words times their logarithm, also for one word many times over.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")] + (["runs", "collapsed"] if whole else [])
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = {"runs": run, "collapsed": pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def finder():
        def step(batch):
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            found = batch_runs(rows, plant)
            for f in found if whole else ():
                f["runs"] = [{"start": s, "length": m, "period": q} for s, m, q in f["runs"]]
                f["collapsed"] = f["collapsed"].decode("utf-8", "replace")
            return {"doc_id": batch.column("doc_id")} | {c: pa.array([f[c] for f in found], kinds.get(c, pa.int64())) for c in names}

        return step

    schema = f"doc_id {id_type(docs)}, {DIGEST}" + (f", {WHOLE}" if whole else "")
    return map_arrow(text_rows(docs), finder, schema)
