"""Rows with equal doc_id and text: suffix dedup keeps their first find, and their cuts do not multiply."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tables import passage, rows_of
from test_dedup import brute_bytes

from quillmap.llm.cuts import KEY, apply_cuts, keyed
from quillmap.llm.suffix_dedup import remove_repeated_bytes


def signed_key(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - 2**64 if value >> 63 else value


def spread_rows(spark, rows, parts):
    """Row k stands in partition k % parts, so equal rows reach different batches."""
    numbered = spark.createDataFrame([(k % parts, i, t) for k, (i, t) in enumerate(rows)], "k int, doc_id bigint, text string")
    return numbered.repartitionById(parts, "k").drop("k")


@pytest.mark.parametrize("parts", [1, 4])
def test_equal_rows_keep_their_first_find(spark, parts):
    """Text that stands nowhere else, text that repeats inside, null ids, two texts of one id, and a later copy."""
    alone, inside, no_id, shared = passage(20, 80), passage(21, 60) + " " + passage(21, 60), passage(22, 80), passage(30, 40)
    pair = sorted([passage(31, 30) + " " + shared, shared + " " + passage(32, 30)], key=signed_key)
    texts = [(20, alone)] * 4 + [(21, inside)] * 4 + [(None, no_id)] * 4 + [(23, pair[1]), (23, pair[0])] * 2 + [(23, pair[0])] + [(24, alone)]
    want = {}
    for doc_id, text, before in [(20, alone, ""), (21, inside, ""), (None, no_id, ""), (23, pair[0], ""), (23, pair[1], pair[0]), (24, alone, alone)]:
        want[doc_id, text] = (doc_id, *brute_bytes([(0, before), (1, text)], 100)[1][1:])
    assert want[20, alone][2] == 0 and want[24, alone][2] == len(alone)
    assert rows_of(remove_repeated_bytes(spread_rows(spark, texts, parts), 100)) == sorted((want[row] for row in texts), key=repr)


def test_equal_cuts_are_gathered_once(spark):
    """Four rows with equal id and text bring four equal cut rows; each row is handed one."""
    docs = spark.createDataFrame([(1, "some text")] * 4, "doc_id bigint, text string")
    row = keyed(docs).first()
    four = np.array([4], "<i4").tobytes()
    cuts = spark.createDataFrame([(1, row[KEY], four, four)] * 4 + [(1, row[KEY], four, bytes(4))], f"doc_id bigint, {KEY} bigint, starts binary, lens binary")
    make = lambda: lambda batch, own: {"n": pa.array([len(x) for x in own.to_pylist()], pa.int64())}
    assert rows_of(apply_cuts(docs, cuts.repartition(3), make, "n bigint")) == [(2,)] * 4
