"""Quality by positive-unlabelled learning.

Trusted positives are the rows labelled 1; every document of the corpus is unlabelled text. No label 0 is used.
The model g(x) = w x minimises the non-negative unbiased risk

    prior * Rp(+1) + max(0, Ru(-1) - prior * Rp(-1)),

Rp and Ru the mean losses over positives and over all documents, and prior the estimated share of positives in the
corpus. With the squared loss each term is a quadratic form in w of the second moments of the features, so
one pass over the whole corpus gathers all that any number of steps needs, a matrix of fixed size, and the
minimum over all documents is found on the driver without a sample. The squared loss's minimum is g = 2 P(1 | x) - 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import id_type, map_arrow, text_rows
from quillmap.session import store

# Classes of bytes: 0 lower case, 1 capital, 2 digit, 3 mark of a sentence, 4 symbol, 5 beyond ASCII, 6 white space, 7 line end.
LOWER, CAPITAL, DIGIT, MARK, SYMBOL, BEYOND, WHITE, LINE_END = range(8)
_CLASS = np.full(256, SYMBOL, np.uint8)
for _bytes, _kind in (
    (range(97, 123), LOWER), (range(65, 91), CAPITAL), (range(48, 58), DIGIT), (b".,;:!?'\"()-", MARK),
    (range(128, 256), BEYOND), (b" \t\x0b\x0c\r", WHITE), (b"\n", LINE_END),
):
    _CLASS[list(_bytes)] = _kind

SHARES = np.array([0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6])
SIZES = np.array([1, 2, 3, 4, 5, 6, 8], float)
LENGTHS = np.array([3, 4, 5, 6, 7, 8, 10], float)
#: Measures of a text, each with the edges of its eight bins.
MEASURES = {
    "log_words": np.array([0, 3, 5, 6, 7, 8, 10], float),
    "log_words_a_line": SIZES,
    "word_bytes": LENGTHS,
    "word_bytes_spread": SIZES / 2,
} | {
    f"share_{name}": SHARES
    for name in (
        "capital digit mark symbol beyond line_end short_words long_words capitalised upper_words symbol_words digit_words "
        "symbols_alone mark_ends line_mark_ends repeated_lines repeated_triples distinct_words exclaimed"
    ).split()
}
BINS = 8
MASKS = 64
WIDTH = 1 + BINS * len(MEASURES) + MASKS
#: Bytes of text that are measured together; a longer text is measured by itself.
GROUP = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_POWERS = np.cumprod(np.full(4096, 0x5851F42D4C957F2D, np.uint64))


def _per(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)


def measure(texts: list[str]) -> np.ndarray:
    """Feature rows: 1, a one in the bin of each measure, and the root of the share of words of each mask of byte classes."""
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(r + b"\n" for r in raw), np.uint8)  # a line end behind each text keeps them apart
    kind = _CLASS[data]
    sizes = np.array([len(r) + 1 for r in raw])
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    bytes_in = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    bytes_in[:, LINE_END] -= 1
    total = np.maximum(bytes_in.sum(axis=1), 1)
    letters = np.maximum(bytes_in[:, LOWER] + bytes_in[:, CAPITAL], 1)

    inside = kind < WHITE
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    start = np.flatnonzero(edge == 1)
    stop = np.flatnonzero(edge == -1)  # the last byte is a line end, so every word stops
    length, word_doc = stop - start, doc[start]
    n_words = np.bincount(word_doc, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    if len(start):
        # words only: reduceat over the bytes inside words
        own = np.flatnonzero(inside)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        mask = np.bitwise_or.reduceat((1 << kind[own]).astype(np.uint8), begin)
        place = (np.arange(len(own)) - np.repeat(begin, length)) % len(_POWERS)
        word = _mixed(np.add.reduceat((data[own].astype(np.uint64) + np.uint64(1)) * _POWERS[place], begin) + length.astype(np.uint64))
    else:
        mask, word = np.zeros(0, np.uint8), np.zeros(0, np.uint64)
    first, last = kind[start], kind[stop - 1] if len(start) else np.zeros(0, np.uint8)
    share = lambda chosen: _per(chosen.astype(float), word_doc, n) / some
    mean = _per(length.astype(float), word_doc, n) / some
    spread = np.sqrt(np.maximum(_per(length.astype(float) ** 2, word_doc, n) / some - mean**2, 0))

    keyed = _mixed(word + word_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    distinct = _per(np.ones(len(u := np.unique(keyed, return_index=True)[1])), word_doc[u], n) / some
    triples = np.maximum(n_words - 2, 1)
    if len(word) > 2:
        whole = word_doc[:-2] == word_doc[2:]
        triple = _mixed(keyed[:-2] + np.uint64(3) * _mixed(keyed[1:-1] + np.uint64(1)) + np.uint64(7) * _mixed(keyed[2:] + np.uint64(2)))[whole]
        _, back, times = np.unique(triple, return_inverse=True, return_counts=True)
        repeated = _per((times[back] > 1).astype(float), word_doc[:-2][whole], n) / triples
    else:
        repeated = np.zeros(n)

    # lines: the words between two line ends
    line = np.cumsum(kind == LINE_END)[start]
    new = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    line_at = np.flatnonzero(new)
    line_doc = word_doc[line_at]
    n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    ends_at = np.append(line_at[1:], len(start))[: len(line_at)] - 1
    line_marks = _per((last[ends_at] == MARK).astype(float), line_doc, n) / n_lines
    if len(line_at):
        in_line = (np.arange(len(word)) - np.repeat(line_at, np.diff(np.append(line_at, len(word))))) % len(_POWERS)
        text_of = _mixed(np.add.reduceat(keyed * _POWERS[in_line], line_at))
        _, back, times = np.unique(text_of, return_inverse=True, return_counts=True)
        repeated_lines = _per((times[back] > 1).astype(float), line_doc, n) / n_lines
    else:
        repeated_lines = np.zeros(n)
    bangs = _per((data == 33).astype(float), doc, n) / total

    values = {
        "log_words": np.log2(n_words + 1),
        "log_words_a_line": np.log2(n_words / n_lines + 1),
        "word_bytes": mean,
        "word_bytes_spread": spread,
        "share_capital": bytes_in[:, CAPITAL] / letters,
        "share_digit": bytes_in[:, DIGIT] / total,
        "share_mark": bytes_in[:, MARK] / total,
        "share_symbol": bytes_in[:, SYMBOL] / total,
        "share_beyond": bytes_in[:, BEYOND] / total,
        "share_line_end": bytes_in[:, LINE_END] / total,
        "share_short_words": share(length <= 3),
        "share_long_words": share(length >= 13),
        "share_capitalised": share((first == CAPITAL) & (mask & 1 > 0)),
        "share_upper_words": share((mask & 0b11 == 0b10) & (length > 1)),
        "share_symbol_words": share(mask >> SYMBOL & 1 > 0),
        "share_digit_words": share(mask >> DIGIT & 1 > 0),
        "share_symbols_alone": share(mask == 1 << SYMBOL),
        "share_mark_ends": share(last == MARK),
        "share_line_mark_ends": line_marks,
        "share_repeated_lines": repeated_lines,
        "share_repeated_triples": repeated,
        "share_distinct_words": distinct,
        "share_exclaimed": bangs,
    }
    out = np.zeros((n, WIDTH), np.float32)
    out[:, 0] = 1
    rows = np.arange(n)
    for k, (name, edges) in enumerate(MEASURES.items()):
        out[rows, 1 + BINS * k + np.searchsorted(edges, values[name])] = 1
    shares = np.bincount(word_doc.astype(np.int64) * MASKS + mask, minlength=n * MASKS).reshape(n, MASKS) / some[:, None]
    out[:, -MASKS:] = np.sqrt(shares)
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """Feature rows as short byte strings: bins, then the roots in 255ths."""
    bins = x[:, 1:-MASKS].reshape(len(x), -1, BINS).argmax(axis=2).astype(np.uint8)
    roots = np.round(x[:, -MASKS:] * 255).astype(np.uint8)
    return [r.tobytes() for r in np.hstack([bins, roots])]


def unpack(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), len(MEASURES) + MASKS)
    out = np.zeros((len(packed), WIDTH))
    out[:, 0] = 1
    out[np.arange(len(x))[:, None], 1 + BINS * np.arange(len(MEASURES)) + x[:, : len(MEASURES)]] = 1
    out[:, -MASKS:] = x[:, len(MEASURES) :] / 255
    return out


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id and the packed features of every whole text."""

    def maker():
        def step(batch):
            texts, out, at = batch.column("text").to_pylist(), [], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= GROUP:
                    size += len(texts[end])
                    end += 1
                out += pack(measure(texts[at:end]))
                at = end
            return {"doc_id": batch.column("doc_id"), "x": pa.array(out, pa.binary())}

        return step

    return map_arrow(text_rows(docs), maker, f"doc_id {id_type(docs)}, x binary")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the rows that are labelled 1, never 0, and are not held out, once each."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("q")).where(F.col("q") == 1).select("doc_id")


def moments(rows: DataFrame) -> list[np.ndarray]:
    """Sums of x x' over all rows, and over the positives of either half; x[0] is 1, so sums hold counts and means too.

    rows: x and half, which is 0 or 1 for positives and -1 for all others. Each task adds up its rows; the entries are
    added up by a shuffle of at most 3 WIDTH^2 / 2 rows a task, and the driver gets three matrices of fixed size.
    """

    def task(batches):
        sums = np.zeros((3, WIDTH, WIDTH))
        for batch in batches:
            half = batch.column("half").to_numpy()
            for at in range(0, len(half), 2048):
                x, own = unpack(batch.column("x")[at : at + 2048].to_pylist()), half[at : at + 2048]
                for k, part in enumerate((x, x[own == 0], x[own == 1])):
                    sums[k] += part.T @ part
        k, i, j = np.nonzero(np.triu(sums))
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(sums[k, i, j])})

    out = np.zeros((3, WIDTH, WIDTH))
    summed = rows.select("x", "half").mapInArrow(task, "k int, i int, j int, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s"))
    for r in summed.collect():
        out[r.k, r.i, r.j] = out[r.k, r.j, r.i] = r.s
    return list(out)


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product on one thread; threaded algebra was seen to hang in a driver that had started its JVM."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive matrix by elimination, on one thread."""
    a = matrix.copy()
    for k in range(len(a)):
        pivot = a[k, k]
        row, column = a[k] / pivot, a[:, k].copy()
        a -= np.multiply.outer(column, row)
        a[k], a[:, k] = row, -column / pivot
        a[k, k] = 1 / pivot
    return a


@dataclass(frozen=True)
class Risk:
    """The risk as quadratic forms: mu, mp and mm, pp are first and second moments of all rows and of the positives."""

    prior: float
    mean_u: np.ndarray
    second_u: np.ndarray
    mean_p: np.ndarray
    second_p: np.ndarray
    ridge: float

    def _both(self, w: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[float, float]:
        """Both parts of the risk from w and its products with the second moments."""
        far, wide = w @ p, w @ u
        first = self.prior * (1 - 2 * w @ self.mean_p + far) / 4
        return first, (1 + 2 * w @ self.mean_u + wide) / 4 - self.prior * (1 + 2 * w @ self.mean_p + far) / 4

    def parts(self, w: np.ndarray) -> tuple[float, float]:
        """prior * Rp(+1), and the part that must not be negative: Ru(-1) - prior * Rp(-1). Losses are (1 - y g)^2 / 4."""
        return self._both(w, _times(self.second_p, w), _times(self.second_u, w))

    def value(self, w: np.ndarray) -> float:
        first, rest = self.parts(w)
        return first + max(rest, 0.0) + self.ridge * w @ w / 4

    def slopes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._slopes(_times(self.second_p, w), _times(self.second_u, w))

    def _slopes(self, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.prior * (p - self.mean_p) / 2, (self.mean_u + u) / 2 - self.prior * (self.mean_p + p) / 2

    def minimum(self, steps: int = 1000, rates: tuple[float, ...] = (0.2, 0.05, 0.0125)) -> np.ndarray:
        """w of the least risk.

        The unbiased risk has a closed minimum; where its second part is not negative that is the answer. Otherwise
        steps go down the whole risk while the second part is not negative and up the second part while it is, and the
        best w seen counts. A smaller rate is tried where the larger one finds nothing better than zero or the closed minimum.
        """
        scale = _inverse(self.second_u + self.ridge * np.eye(len(self.mean_u)))
        closed = _times(scale, 2 * self.prior * self.mean_p - self.mean_u)
        if self.parts(closed)[1] >= 0:
            return closed
        begin = best = min(np.zeros_like(closed), closed, key=self.value)
        least = self.value(begin)
        for rate in rates:
            w = np.zeros_like(closed)
            for step in range(steps):
                p, u = _times(self.second_p, w), _times(self.second_u, w)  # the only products of a step with whole matrices, but for the scale
                first, rest = self._both(w, p, u)
                value = first + max(rest, 0.0) + self.ridge * w @ w / 4
                if not value < 1e6:  # the rate is too large
                    break
                if value < least:
                    best, least = w, value
                up, down = self._slopes(p, u)
                w = w - rate * (1 - step / steps) * 2 * _times(scale, up + down + self.ridge * w / 2 if rest >= 0 else -down)
            if best is not begin:
                break
        return best


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray, slack: float = 1.0, sure: float = 0.1) -> float:
    """Share of positives in the corpus from counts of scores per bin, lowest score first.

    Any set of scores holds at least prior times the share of positives that it has, so the least quotient of the two
    shares over all upper tails bounds the prior; the tail is chosen with the whole uncertainty of both shares added.
    """
    n_u, n_p = unlabelled.sum(), positive.sum()
    tail_u, tail_p = (np.cumsum(c[::-1]) / c.sum() for c in (unlabelled, positive))
    own = tail_p > 0
    noise = np.sqrt(np.log(4 / sure) / 2) * (n_u**-0.5 + n_p**-0.5)
    bound = (tail_u[own] + slack * noise) / tail_p[own]
    at = int(np.argmin(bound))
    return float(np.clip(tail_u[own][at] / tail_p[own][at], 0.01, 0.99))


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray
    prior: float

    def scores(self, packed: list[bytes]) -> np.ndarray:
        """Share of label 1 that the squared loss's minimum stands for, row by row."""
        x = unpack(packed)
        return np.clip((1 + np.array([row @ self.weight for row in x])) / 2, 0.0, 1.0)


def score_counts(rows: DataFrame, weight: np.ndarray, bins: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Number of all rows and of the positives of half 1 per bin of clipped scores, over the whole corpus."""
    model = QualityModel(weight, 0.5)

    def task(batches):
        counts = np.zeros((2, bins), np.int64)
        for batch in batches:
            own = np.minimum(model.scores(batch.column("x").to_pylist()) * bins, bins - 1).astype(int)
            counts[0] += np.bincount(own, minlength=bins)
            counts[1] += np.bincount(own[batch.column("half").to_numpy() == 1], minlength=bins)
        k, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "bin": pa.array(at, pa.int32()), "n": pa.array(counts[k, at], pa.int64())})

    out = np.zeros((2, bins), np.int64)
    for r in rows.select("x", "half").mapInArrow(task, "k int, bin int, n bigint").groupBy("k", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.k, r.bin] = r.n
    return out[0], out[1]


def fit(features: DataFrame, labels: DataFrame, ridge: float = 0.3) -> QualityModel:
    """Two passes over the stored features: moments, then scores of a first model for the prior.

    The first model separates half of the positives from all documents, and the other half is held against its scores, as
    a model puts the rows it was fitted on too high. ``ridge`` is a number of rows. Without trusted positives
    nothing is learnt: every score is one half.
    """
    marked = trusted(labels).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    rows = store(features.join(marked, "doc_id", "left").select("x", F.coalesce("half", F.lit(-1)).alias("half")), "marked")
    sum_u, *halves = moments(rows)
    n_p = halves[0][0, 0] + halves[1][0, 0]
    if not n_p:
        return QualityModel(np.zeros(WIDTH), 0.5)
    u, p = sum_u / sum_u[0, 0], (halves[0] + halves[1]) / n_p
    prior = 0.5  # with positives in one half only
    if halves[0][0, 0] and halves[1][0, 0]:
        q = halves[0] / halves[0][0, 0]
        first = _times(_inverse(u + q + 2 * ridge / halves[0][0, 0] * np.eye(WIDTH)), q[0] - u[0])
        prior = estimated_prior(*score_counts(rows, first))
    return QualityModel(Risk(prior, u[0], u, p[0], p, ridge / n_p).minimum(), prior)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null text is the empty one; empty texts have a score like all others. A null doc_id stays null, is not held out and
    trains as unlabelled text only; repeated rows are scored one by one; documents labelled both 0 and 1 are
    not trusted; an empty table gives an empty result; extra columns are dropped. A text is measured as a
    whole, in memory in proportion to its bytes.
    """
    features = store(quality_features(docs), "features")
    shared = docs.sparkSession.sparkContext.broadcast(fit(features, labels))

    def scorer():
        model = shared.value
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": pa.array(model.scores(batch.column("x").to_pylist()))}

    scored = map_arrow(features, scorer, f"doc_id {id_type(docs)}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
