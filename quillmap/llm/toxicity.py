"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors): the
pairs let two terms mean together what neither means alone. The model is fitted on a bounded sample of
labelled rows; every text is scored, in its task, with the broadcast model.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import id_type, map_arrow, text_rows
from quillmap.llm.tokens import PieceCache

STEMS = (4, 5, 6)
_TERM = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class FmModel:
    """slots: log2 of the number of hashed terms; row: where a slot's parameters are, 0 for unused slots."""

    slots: int
    row: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def term_slots(slots: int):
    """text -> its distinct hashed terms as an int array.

    Terms are the words, case folded, and the stems of 4, 5 and 6 letters of longer words, so that forms of
    one word that were never seen still count. Digits and marks separate words.
    """
    import xxhash

    mask = (1 << slots) - 1

    def slot(term: str) -> int:
        return xxhash.xxh32_intdigest(term.encode("utf-8", "replace")) & mask

    cache = PieceCache(lambda w: (slot(w), *[slot(w[:n] + "*") for n in STEMS if len(w) > n]), limit=300_000)
    look = cache.__getitem__

    def find(text: str) -> np.ndarray:
        return np.fromiter(set(chain.from_iterable(map(look, set(_TERM.findall(text.lower()))))), np.int32)

    return find


def _margins(model: FmModel, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid; rows: parameter rows of all texts in line, ends: where each text ends.

    Each text is summed by itself, so equal texts have equal scores wherever they stand.
    """
    begins = np.concatenate([[0], ends[:-1]])
    empty = (begins == ends).reshape(-1, 1)

    def sums(values: np.ndarray) -> np.ndarray:
        padded = np.vstack([values, np.zeros((1, values.shape[1]))])
        return np.where(empty, 0.0, np.add.reduceat(padded, begins, axis=0))

    v = model.factor[rows]
    linear = sums(model.weight[rows].reshape(-1, 1))[:, 0]
    return model.bias + linear + 0.5 * (sums(v) ** 2 - sums(v * v)).sum(axis=1)


def fit_fm(
    texts: list[np.ndarray],
    labels: np.ndarray,
    slots: int = 20,
    factors: int = 4,
    least_texts: int = 5,
    least_chi2: float = 7.0,
    epochs: int = 10,
    rate: float = 0.1,
    decay: float = 1e-3,
    toxic_weight: float = 4.0,
    batch: int = 64,
    least_steps: int = 1500,
    seed: int = 7,
) -> FmModel:
    """Fit on slot arrays by AdaGrad on the logistic loss.

    Slots in fewer than least_texts texts, or as frequent with one label as with the other (chi-square
    below least_chi2), are unused: they would add noise, and the more the longer a text is. Label 1 counts
    toxic_weight times, as it is rare. Without rows, or with one class only, the score is the share of label 1 for every text.
    """
    row = np.zeros(1 << slots, np.int32)
    share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.0
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else -20.0
    if not len(labels) or labels.min() == labels.max():
        return FmModel(slots, row, bias, np.zeros(1), np.zeros((1, factors)))
    seen = np.bincount(np.concatenate(texts), minlength=1 << slots)
    toxic = np.bincount(np.concatenate(texts), np.repeat(labels, [len(t) for t in texts]), 1 << slots)
    total, positive = len(labels), labels.sum()
    expected = seen * positive / total
    spread = np.maximum(expected * (1 - positive / total) * (1 - seen / total), 1e-9)
    used = np.flatnonzero((seen >= least_texts) & ((toxic - expected) ** 2 / spread >= least_chi2))
    row[used] = np.arange(1, len(used) + 1)
    mapped = [r[r > 0] for r in (row[t] for t in texts)]
    random = np.random.default_rng(seed)
    n = len(used) + 1
    weight, factor = np.zeros(n), random.normal(0, 0.01, (n, factors))
    factor[0] = 0
    sum_b, sum_w, sum_f = 1e-6, np.full(n, 1e-2), np.full((n, factors), 1e-2)
    epochs = max(epochs, -(-least_steps * batch // len(mapped)))  # few rows are seen more often
    for epoch in range(epochs):
        step = rate / (1 + 3 * epoch / epochs)
        order = random.permutation(len(mapped))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            parts = [mapped[i] for i in own]
            size = np.array([len(p) for p in parts])
            flat = np.concatenate(parts) if size.sum() else np.zeros(0, np.int32)
            z = _margins(FmModel(slots, row, bias, weight, factor), flat, np.cumsum(size))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) * np.where(labels[own] > 0, toxic_weight, 1.0)
            g = float(error.mean())
            sum_b += g * g
            bias -= step * g / np.sqrt(sum_b)
            if not len(flat):
                continue
            doc = np.repeat(np.arange(len(own)), size)
            rows, inverse = np.unique(flat, return_inverse=True)
            e = error[doc] / len(own)
            grad_w = np.bincount(inverse, e, len(rows)) + decay * weight[rows]
            sum_w[rows] += grad_w**2
            weight[rows] -= step * grad_w / np.sqrt(sum_w[rows])
            v = factor[flat]
            sums = np.stack([np.bincount(doc, v[:, k], len(own)) for k in range(factors)], axis=1)
            pull = e[:, None] * (sums[doc] - v)
            grad_f = np.stack([np.bincount(inverse, pull[:, k], len(rows)) for k in range(factors)], axis=1) + decay * factor[rows]
            sum_f[rows] += grad_f**2
            factor[rows] -= step * grad_f / np.sqrt(sum_f[rows])
    weight[0], factor[0] = 0, 0
    return FmModel(slots, row, bias, weight, factor)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 10_000, slots: int = 20, **fit) -> FmModel:
    """Fit on at most ``sample`` labelled rows, those with the smallest hash of their id.

    Rows held out, with a null id or without a label do not take part. The terms are found in the tasks;
    the driver gets one short array a row. A document with several labels counts once for each.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.select("doc_id", F.col("toxic").cast("int").alias("_label"), F.xxhash64("doc_id").alias("_order"))
    chosen = ids.orderBy("_order", "doc_id", "_label").limit(sample)
    rows = text_rows(docs).join(F.broadcast(chosen), "doc_id").select("_order", "_label", "text")

    def finder():
        find = term_slots(slots)
        return lambda batch: {
            "_order": batch.column("_order"),
            "_label": batch.column("_label"),
            "terms": pa.array([find(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary()),
        }

    found = map_arrow(rows, finder, "_order bigint, _label int, terms binary").orderBy("_order", "_label", "terms").limit(2 * sample).collect()
    return fit_fm([np.frombuffer(r.terms, np.int32) for r in found], np.array([float(r._label != 0) for r in found]), slots, **fit)


def _scorer(shared):
    """texts of a batch -> scores, with the broadcast model."""
    fitted = shared.value
    find = term_slots(fitted.slots)

    def scores(texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            own = [fitted.row[find(t or "")] for t in texts[at : at + 256].to_pylist()]
            own = [np.sort(r[r > 0]) for r in own]
            z = _margins(fitted, np.concatenate(own), np.cumsum([len(r) for r in own]))
            out[at : at + len(own)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out

    return scores


def score_toxicity(docs: DataFrame, model: FmModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null text is the empty one, and texts without terms get the model's base rate. A null doc_id stays
    null and is not held out; repeated rows are scored one by one; an empty table gives an empty result;
    extra columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        scores = _scorer(shared)
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": pa.array(scores(batch.column("text")))}

    scored = map_arrow(text_rows(docs), scorer, f"doc_id {id_type(docs)}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: FmModel, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that score below the threshold. Nulls as in score_toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        scores = _scorer(shared)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text")) < threshold))

    return docs.mapInArrow(task, docs.schema)
