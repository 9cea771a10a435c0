"""Toxicity, licenses, quality rules, neighbours: rules, models and searches against brute force."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import documents, odd_texts, passage, rows_of, words

from quillmap.llm.ann import nearest
from quillmap.llm.licenses import BASE_PHRASES, GATE, scan_licenses, scan_sql, signature_rules
from quillmap.llm.oracles import quality_sql
from quillmap.llm.quality_rules import clean_lines, quality_rules
from quillmap.llm.toxicity import drop_toxic, fit_fm, score_toxicity, train_toxicity


def in_duckdb(spark_rows, sql):
    """Run SQL over a documents table with the given rows."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in spark_rows])
    cur = con.execute(sql)
    return [d[0] for d in cur.description], sorted(cur.fetchall(), key=repr)


def license_words(text):
    out, word = [], ""
    for c in (text or "").translate({c: c + 32 for c in range(65, 91)}) + " ":
        if c.isascii() and not (c.isdigit() or c.islower()):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def test_license_base_columns(spark):
    lines = "Under the MIT License,", "apache-license VERSION 2", "CC BY NC", "under the mit", "license", "K"
    r = random.Random(8)
    texts = odd_texts() + [(100 + k, " ".join(r.choice(lines) for _ in range(r.randint(0, 9)))) for k in range(40)]
    want = []
    for doc_id, text in texts:
        w = license_words(text)
        places = [(k, label) for p, label in BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        want.append((doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    found = scan_licenses(documents(spark, texts))
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    for row in found.collect():
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1
    assert scan_licenses(documents(spark, [])).count() == 0


def test_license_rules_against_sql(spark):
    r = random.Random(9)
    parts = ["Licensed under the", "Apache License, Version 2.0", "GNU General Public License, version 3", "GPL-2.0-only", "MIT", "license", "CC BY-NC-SA 4.0",
             "BSD 3-Clause", "see the", "SPDX-License-Identifier:", "released into the public domain", "All rights reserved.", "LGPL v2.1", "word"]
    texts = odd_texts() + [(100 + k, " ".join(r.choice(parts) for _ in range(r.randint(1, 7)))) for k in range(60)]
    columns, want = in_duckdb(texts, scan_sql())
    assert rows_of(scan_licenses(documents(spark, texts)), *columns) == want
    assert len(signature_rules()) > 200


def test_every_rule_can_pass_the_gate():
    for rule in signature_rules():
        assert any(g.strip() in rule.body or g in rule.body for g in GATE) or "licen" in rule.body, rule


def test_suppression_by_containment(spark):
    rows = [(1, "licensed under the gnu general public license version 3"), (2, "creative commons attribution noncommercial license"), (3, "the mit license")]
    found = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert found[1].labels == "gpl-3" and len(found[1].detections) == 1
    assert found[2].labels == "cc-by-nc"
    assert found[3].labels == "mit" and found[3].score == pytest.approx(0.8)


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    repeated = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_quality_measures(spark):
    texts = odd_texts() + [(200, "a a a a"), (201, "a b a b a"), (202, "x\r\nx\r\nx\n\n \n y"), (203, "\U0001f600 \U0001f600|<é>")]
    found = quality_rules(documents(spark, texts))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(found, *names) == sorted(((i, *brute_quality(t)) for i, t in texts), key=repr)
    columns, want = in_duckdb(texts, quality_sql())
    assert rows_of(found, *columns) == want
    assert quality_rules(documents(spark, [])).count() == 0


def test_lines_are_removed_and_clean_documents_kept(spark):
    good = ". ".join(passage(k, 12) for k in range(10)) + "."
    menu = "\n".join(["Home | About | News | Contact | Login | Help | More"] * 12)
    rows = [(1, good), (2, good + "\nRead more\n\nAll rights reserved."), (3, good + "\n" + menu * 3), (4, good.upper())]
    docs = documents(spark, rows)
    cleaned = clean_lines(docs, max_loss=0.3)
    found = {r.doc_id: (r.kept, r.text) for r in cleaned.collect()}
    assert found[1] == (True, good)
    assert found[2] == (True, good + "\n")
    assert not found[3][0] and not found[4][0]
    assert set(docs.columns) <= set(cleaned.columns)


def test_quality_plan_has_no_python_and_no_shuffle(spark):
    for df in (quality_rules(documents(spark, odd_texts(), extra=False)), scan_licenses(documents(spark, odd_texts(), extra=False))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert plan.count("Exchange") <= 1  # that of the fixture


def toxic_rows(n=600):
    r = random.Random(10)
    plain, bad, group = [f"w{k}x".replace("0", "o").translate({48 + d: 97 + d for d in range(10)}) for k in range(80)], ["zounds", "fiend"], ["tribe", "clan"]
    rows, labels = [], []
    for k in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        kind = r.random()
        if kind < 0.3:
            w += [r.choice(bad), r.choice(group)]
        elif kind < 0.45:
            w.append(r.choice(bad))
        elif kind < 0.6:
            w.append(r.choice(group))
        r.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(kind < 0.3)))
    return rows, labels


def test_factors_learn_pairs():
    """Neither term alone is toxic, both together are: linear weights cannot tell."""
    r = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(3000):
        a, b = r.random(2) < 0.5
        own = [1] * int(a) + [2] * int(b) + list(r.choice(np.arange(10, 40), 5, replace=False))
        texts.append(np.array(own, np.int32))
        labels.append(float(a and b))
    model = fit_fm(texts, np.array(labels), slots=6, epochs=30, least_chi2=0)
    first, second = model.factor[model.row[1]], model.factor[model.row[2]]
    assert first @ second > 0.5


def test_toxicity_rows(spark):
    rows, labels = toxic_rows()
    extra = [(9001, None), (9002, ""), (None, "zounds tribe"), (5, rows[5][1])]
    docs = documents(spark, rows + extra)
    given = spark.createDataFrame(labels + [(None, 1), (7, None), (99999, 1)], "doc_id bigint, toxic int")
    model = train_toxicity(docs, given, slots=16)
    found = score_toxicity(docs, model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    by_id = {}
    for r in found.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[9001][0].score == by_id[9002][0].score
    assert len({r.score for r in by_id[5]}) == 1
    truth = dict(labels)
    held = [r for k, own in by_id.items() if k in truth for r in own if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.93 * len(held)
    # labels of held-out rows change nothing
    flipped = given.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = train_toxicity(docs, flipped, slots=16)
    assert np.array_equal(again.weight, model.weight) and np.array_equal(again.factor, model.factor)
    left = drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert left.count() == sum(r.predicted == 0 for own in by_id.values() for r in own)
    assert score_toxicity(documents(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = documents(spark, odd_texts())
    model = train_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.predicted for r in score_toxicity(docs, model).collect()} == {0}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, qkey string, ids int").repartition(4)


def brute_nearest(rows, k):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            good[i, tuple(np.float32(v))] = np.array(v, np.float32).astype(float)
    out = []
    for (q, _), a in good.items():
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for (i, _), b in good.items() if i != q and len(b) == len(a))
            out += [(q, n + 1, i, round(d, 6)) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def test_nearest_is_exact_when_all_are_candidates(spark):
    r = random.Random(11)
    rows = [(k, [r.gauss(0, 1) for _ in range(8)], None, None) for k in range(150)]
    rows += [(k, [1.0] * 8, "x", 1) for k in range(200, 260)]  # one vector many times
    rows += [(300, None, None, None), (310, [], None, None), (320, [0.0] * 8, None, None), (330, [1.0, None] * 4, None, None), (340, [float("nan")] * 8, None, None), (None, [1.0] * 8, None, None)]
    rows += [rows[10], (400, [1.0, 2.0, 3.0], None, None), (401, [1.0, 2.0, 4.0], None, None)]
    table = vectors(spark, rows)
    for sizes in ({}, {"shard_rows": 40, "block_rows": 5}):
        found = nearest(table, F.col("vec_id") % 10 == 0, k=10, enough=100.0, **sizes)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted((a, b, c, round(d, 6)) for a, b, c, d in found.collect()) == brute_nearest(rows, 10)
    assert nearest(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_nearest_recall(spark):
    r = np.random.default_rng(12)
    centers = r.normal(size=(8, 32))
    rows = [(k, (centers[k % 8] + r.normal(0, 0.4, 32)).astype(np.float32).tolist(), None, None) for k in range(2000)]
    found = Counter()
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, 10)}
    for row in nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=10, shard_rows=1000).collect():
        found[(row.query_id, row.vec_id) in want] += 1
    assert found[True] >= 0.9 * len(want)
