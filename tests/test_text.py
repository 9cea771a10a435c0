import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmap.functions import text as tx
from quillmap.functions import vectors as vx


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_tokens_fold_and_split(spark):
    got = values(spark, [("Café-ÑANDÚ 3x, éte",), ("",), (None,)], "t string", tx.tokens(F.col("t")))
    assert got == [(["cafe", "nandu", "3x", "ete"],), ([],), ([],)]


def test_term_counts(spark):
    got = values(spark, [("b a b",), ("",), ("x",)], "t string", tx.term_counts(tx.tokens(F.col("t"))))
    assert [[tuple(e) for e in r[0]] for r in got] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


def test_rebuild_abstract(spark):
    rows = [({"b": [1, 7], "a": [0], "c": [3]},), ({},), (None,), ({"y": [0], "x": [0]},)]
    got = values(spark, rows, "m map<string,array<int>>", tx.rebuild_abstract(F.col("m")))
    assert [r[0] for r in got] == ["a b c b", "", "", "x y"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "d"]), max_size=12))
def test_rebuild_inverts_positions(spark, words):
    index = {}
    for i, w in enumerate(words):
        index.setdefault(w, []).append(i)
    got = values(spark, [(index,)], "m map<string,array<int>>", tx.rebuild_abstract(F.col("m")))
    assert got == [(" ".join(words),)]


@pytest.mark.parametrize(
    "raw, clean",
    [("(deep AND learning) or nets", "deep learning nets"), ("order band", "order band"), ("  a  ", "a"), ("AND", "")],
)
def test_clean_keyword(spark, raw, clean):
    assert values(spark, [(raw,)], "k string", tx.clean_keyword(F.col("k"))) == [(clean,)]


def test_truncate_compose_doi_key(spark):
    got = values(
        spark, [("t", "abc", "10.1/x"), ("t", None, None), ("t", "ab", "https://d")], "a string, b string, d string",
        tx.truncate_text(F.col("b"), 2), tx.compose_text(F.col("a"), F.col("b")), tx.doi_url(F.col("d")),
    )
    assert got == [("ab...", "t. abc", "https://doi.org/10.1/x"), ("", "t", ""), ("ab", "t. ab", "https://d")]
    import hashlib

    key = values(spark, [("s", "k", None)], "a string, b string, c string", tx.cache_key(F.col("a"), F.col("b"), F.col("c")))
    assert key == [(hashlib.md5(b"s|k|").hexdigest()[:12],)]


def test_author_list_keeps_ten(spark):
    got = values(spark, [([f"n{i}" for i in range(12)],)], "a array<string>", tx.author_list(F.col("a")))
    assert got[0][0].split("; ") == [f"n{i}" for i in range(10)]


def test_vectors(spark):
    got = values(
        spark, [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>",
        vx.l2_norm(F.col("a")), vx.l2_normalize(F.col("a")), vx.dot(F.col("a"), F.col("b")), vx.cosine(F.col("a"), F.col("b")),
    )
    assert got[0] == (5.0, [0.6, 0.8], 24.0, 0.96)
    assert got[1] == (0.0, [0.0, 0.0], 0.0, None)
