"""Positive-unlabelled quality: measures and risk by plain loops, the prior on made mixtures, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import documents, odd_texts, passage, words

from quillmap.llm.common import read_table
from quillmap.llm.pu_quality import _inverse, BINS, MASKS, MEASURES, WIDTH, Risk, estimated_prior, fit, measure, moments, pack, quality_features, score_quality, trusted, unpack

MARKS = ".,;:!?'\"()-"


def kind(b):
    c = chr(b)
    if b > 127:
        return 5
    if c.islower() or c.isupper():
        return 0 if c.islower() else 1
    if c.isdigit():
        return 2
    return 3 if c in MARKS else 4


def plain_measures(text):
    raw = text.encode()
    own = [w.encode() for w in words(text)]
    lines = [x for x in ([w.encode() for w in words(line)] for line in text.split("\n")) if x]
    n, total, many_lines = max(len(own), 1), max(len(raw), 1), max(len(lines), 1)
    kinds = Counter(kind(b) for b in raw if b not in b" \t\n\x0b\x0c\r")
    masks = [{kind(b) for b in w} for w in own]
    triples = Counter(zip(own, own[1:], own[2:]))
    repeated = sum(c for c in triples.values() if c > 1)
    line_count = Counter(tuple(x) for x in lines)
    mean = sum(map(len, own)) / n
    spread = math.sqrt(max(sum(len(w) ** 2 for w in own) / n - mean**2, 0))
    share = lambda test: sum(map(test, own)) / n
    values = {
        "log_words": math.log2(len(own) + 1), "log_words_a_line": math.log2(len(own) / many_lines + 1), "word_bytes": mean, "word_bytes_spread": spread,
        "share_capital": kinds[1] / max(kinds[0] + kinds[1], 1), "share_digit": kinds[2] / total, "share_mark": kinds[3] / total, "share_symbol": kinds[4] / total,
        "share_beyond": kinds[5] / total, "share_line_end": raw.count(b"\n") / total, "share_short_words": share(lambda w: len(w) <= 3),
        "share_long_words": share(lambda w: len(w) >= 13), "share_capitalised": share(lambda w: kind(w[0]) == 1 and any(kind(b) == 0 for b in w)),
        "share_upper_words": share(lambda w: len(w) > 1 and any(kind(b) == 1 for b in w) and not any(kind(b) == 0 for b in w)),
        "share_symbol_words": sum(4 in m for m in masks) / n, "share_digit_words": sum(2 in m for m in masks) / n, "share_symbols_alone": sum(m == {4} for m in masks) / n,
        "share_mark_ends": share(lambda w: kind(w[-1]) == 3), "share_line_mark_ends": sum(kind(x[-1][-1]) == 3 for x in lines) / many_lines,
        "share_repeated_lines": sum(c for c in line_count.values() if c > 1) / many_lines, "share_repeated_triples": repeated / max(len(own) - 2, 1),
        "share_distinct_words": len(set(own)) / n, "share_exclaimed": raw.count(b"!") / total,
    }
    shares = Counter(sum(1 << k for k in m) for m in masks)
    return values, [math.sqrt(shares[k] / n) for k in range(MASKS)]


def test_measures_equal_plain_loops():
    texts = [t or "" for _, t in odd_texts()] + ["A B!! c\nA B!! c\nx9 | | |\n", "!", " \n ", "NO no No nO 1a a1 é É éA"]
    got = measure(texts)
    for text, row in zip(texts, got):
        values, shares = plain_measures(text)
        assert list(values) == list(MEASURES)
        for k, (name, edges) in enumerate(MEASURES.items()):
            at = int(row[1 + BINS * k : 1 + BINS * k + BINS].argmax())
            assert at == int(np.searchsorted(edges, values[name])) or min(abs(edges - values[name])) < 1e-9, (name, text[:50])
        assert np.allclose(row[-MASKS:], shares, atol=1e-6)
    alone = np.vstack([measure([t]) for t in texts])
    assert (alone == got).all()
    assert np.allclose(unpack(pack(got)), got, atol=0.5 / 255 + 1e-6) and got.shape[1] == WIDTH


def test_risk_is_that_of_the_rows():
    r = np.random.default_rng(3)
    u, p, w = np.c_[np.ones(300), r.normal(size=(300, 5))], np.c_[np.ones(80), r.normal(1, 1, (80, 5))], r.normal(size=6)
    risk = Risk(0.4, u.mean(0), u.T @ u / 300, p.mean(0), p.T @ p / 80, 0.0)
    loss = lambda x, y: sum((1 - y * float(row @ w)) ** 2 / 4 for row in x) / len(x)
    first, rest = risk.parts(w)
    assert first == pytest.approx(0.4 * loss(p, 1)) and rest == pytest.approx(loss(u, -1) - 0.4 * loss(p, -1))
    for slope, part in zip(risk.slopes(w), (0, 1)):
        for k in range(6):
            step = np.eye(6)[k] * 1e-6
            assert slope[k] == pytest.approx((risk.parts(w + step)[part] - risk.parts(w - step)[part]) / 2e-6, abs=1e-6)
    least = risk.minimum()
    assert all(risk.value(least) <= risk.value(least + d) + 1e-9 for d in 0.3 * r.normal(size=(50, 6)))


def test_inverse():
    x = np.random.default_rng(2).normal(size=(90, 60))
    a = x.T @ x / 90 + 1e-3 * np.eye(60)
    assert np.allclose(_inverse(a) @ a, np.eye(60), atol=1e-8)


def test_second_part_never_rewards_negative_risk():
    """Few rows, many features: the unbiased risk falls below zero, the non-negative one does not."""
    r = np.random.default_rng(4)
    u, p = r.normal(size=(40, 30)), r.normal(size=(15, 30))
    risk = Risk(0.5, u.mean(0), u.T @ u / 40, p.mean(0), p.T @ p / 15, 1e-3)
    closed = np.linalg.solve(risk.second_u + 1e-3 * np.eye(30), 2 * 0.5 * risk.mean_p - risk.mean_u)
    assert risk.parts(closed)[1] < 0
    assert risk.value(risk.minimum()) < min(0.01, risk.value(np.zeros(30)), risk.value(closed))


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_prior_of_mixtures(prior):
    r = np.random.default_rng(5)
    n = 4000
    good, bad = r.normal(0.75, 0.1, n), r.normal(0.35, 0.1, n)
    unlabelled = np.where(r.random(n) < prior, r.permutation(good), bad)
    count = lambda x: np.histogram(np.clip(x, 0, 1), 500, (0, 1))[0]
    assert estimated_prior(count(unlabelled), count(r.normal(0.75, 0.1, 1500))) == pytest.approx(prior, abs=0.06)


def junk(k):
    r = random.Random(k)
    return " | ".join(passage(r.randint(0, 999), 2) + "###" for _ in range(40))


def test_rows_and_special_cases(spark):
    texts = odd_texts() + [(100 + k, passage(k, 80).capitalize() + ".") for k in range(120)] + [(300 + k, junk(k)) for k in range(40)]
    labels = spark.createDataFrame(
        [(100 + k, 1, 0) for k in range(60)] + [(300, 0, 0), (100, 0, 1), (None, 1, 0), (101, None, 0), (101, 1, 0), (101, 1, 0), (9999, 1, 0)], "doc_id bigint, quality int, toxic int"
    )
    docs = documents(spark, texts)
    assert {r.doc_id for r in trusted(labels).collect()} == {100 + k for k in range(1, 60) if zlib.crc32(str(100 + k).encode()) % 5} | ({9999} if zlib.crc32(b"9999") % 5 else set())
    found = score_quality(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in texts)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    score = {r.doc_id: r.score for r in found}
    assert np.mean([score[300 + k] for k in range(40)]) < 0.3 < 0.7 < np.mean([score[100 + k] for k in range(120)])
    same = {r.score for r in found if r.doc_id == 7}
    assert len(same) == 1 and score[1] == score[2]
    # held-out labels and labels 0 of documents without another label change nothing
    more = labels.union(spark.createDataFrame([(300 + k, 0, 0) for k in range(40)] + [(300 + k, 1, 0) for k in range(40) if zlib.crc32(str(300 + k).encode()) % 5 == 0], labels.schema))
    again = {r.doc_id: r.score for r in score_quality(docs, more).collect()}
    assert all(again[i] == pytest.approx(s, abs=1e-9) for i, s in score.items())
    none = score_quality(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert score_quality(documents(spark, []), labels).count() == 0


def test_moments_equal_plain_sums(spark):
    texts = odd_texts()
    rows = quality_features(documents(spark, texts)).withColumn("half", F.when(F.col("doc_id") % 3 < 2, (F.col("doc_id") % 3).cast("int")).otherwise(-1))
    x = unpack(pack(measure([t or "" for _, t in texts])))
    half = np.array([i % 3 if i is not None and i % 3 < 2 else -1 for i, _ in texts])
    for got, own in zip(moments(rows), (half > -2, half == 0, half == 1)):
        assert np.allclose(got, x[own].T @ x[own])


def test_held_out_accuracy(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scored = score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    bad, good = ([r.predicted for r in scored if r.quality == q] for q in (0, 1))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    prior = fit(quality_features(docs), labels).prior
    assert prior == pytest.approx(labels.agg(F.avg("quality")).first()[0], abs=0.04)
