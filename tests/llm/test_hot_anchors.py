"""Anchors in very many places: windows around them are settled one by one, with the same result."""

import numpy as np
import pytest
from tables import documents, passage, rows_of
from test_dedup import brute_bytes

from quillmap.llm import suffix_dedup
from quillmap.llm.sketch import repeat_sketch
from quillmap.llm.suffix_dedup import first_places, remove_repeated_bytes


def footers() -> list[tuple[int | None, str | None]]:
    """A footer of 28 to 99 bytes in most texts, amid differing words and amid copies, and a longer passage."""
    footer, long = passage(70, 12)[:60], passage(71, 80)
    texts: list[tuple[int | None, str | None]] = [(k, passage(100 + k, 25) + footer + passage(300 + k, 25)) for k in range(60)]
    texts += [(100 + k, passage(400 + k, 10) + long + passage(500 + k % 3, 30)) for k in range(30)]
    texts += [(200, texts[3][1]), (201, texts[3][1]), (201, texts[3][1]), (None, texts[5][1]), (202, (footer + " ") * 40), (203, footer), (204, None), (205, "")]
    return texts


@pytest.mark.parametrize("hot", [1, 8, 40, 1 << 16])
def test_hot_windows_give_the_same_result(spark, hot):
    docs = documents(spark, footers())
    assert rows_of(remove_repeated_bytes(docs, 100, hot=hot)) == brute_bytes(footers(), 100)
    assert rows_of(remove_repeated_bytes(docs.repartition(1), 100, hot=hot)) == brute_bytes(footers(), 100)


def test_a_footer_fills_no_shard(spark, monkeypatch):
    """What a footer sends is dealt over the shards."""
    footer = passage(70, 12)[:60]
    docs = documents(spark, [(k, passage(1000 + k, 25) + footer + passage(9000 + k, 25)) for k in range(800)])
    largest = {}
    for hot in (100, 1 << 16):
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "settle", lambda parcels, *_: parcels)
            sent = suffix_dedup.repeat_cuts(docs, hot=hot).where("not sure")
        largest[hot] = sent.groupBy("shard").agg({"*": "count"}).count(), sent.selectExpr("shard", "length(body) + length(told) n").groupBy("shard").sum("n").toPandas()["sum(n)"].agg(["max", "sum"])
    assert largest[100][0] == 128 and largest[100][1]["max"] < 0.03 * largest[100][1]["sum"]
    assert largest[1 << 16][1]["max"] > 0.1 * largest[1 << 16][1]["sum"]


def test_hot_places(spark):
    """Whatever is an anchor often enough is known as hot; what is rare is hot by chance only."""
    r = np.random.default_rng(4)
    often, rare = r.integers(0, 1 << 63, 20), r.integers(0, 1 << 63, 3000)
    values = np.concatenate([np.repeat(often, 50), rare])
    r.shuffle(values)
    rows = spark.createDataFrame([(int(v),) for v in values], "v bigint").repartition(5)
    finder = lambda: lambda batch: iter([batch.column("v").to_numpy().view(np.uint64)])
    for flush in (40, 4_000_000):
        sketch = repeat_sketch(rows, finder, 16, flush=flush, hot=50)
        assert sketch.is_hot(often.view(np.uint64)).all() and sketch.is_hot(rare.view(np.uint64)).mean() < 0.01
        assert all((np.diff(w) > 0).all() for w in sketch.hot)
    assert not repeat_sketch(rows, finder, 16).is_hot(often.view(np.uint64)).any()


def test_first_places():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 4, 200).astype(np.uint64), r.integers(0, 4, 200).astype(np.uint64)
    seen: set = set()
    assert first_places(a, b).tolist() == [not ((x, y) in seen or seen.add((x, y))) for x, y in zip(a.tolist(), b.tolist())]
    assert first_places(a[:0], b[:0]).tolist() == []
