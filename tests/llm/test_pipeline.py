"""The pipeline stage by stage against the operators' brute force, and the registered SQL checks."""

import os

import duckdb
import pytest
from tables import rows_of
from test_tokens import check_packing

import corpus_pipeline
from quillmap.llm.quality_rules import quality_rules
from quillmap.llm.queries import ORACLES, QUERIES
from quillmap.llm.toxicity import score_toxicity, train_toxicity
from test_dedup import brute_bytes, brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((docs, result))
        docs = result
    return out


def test_columns_stay(stages):
    first = stages[0][0].columns
    for _, result in stages[:-1]:
        assert result.columns == first


def test_toxicity_stage(spark, stages):
    docs, result = stages[0]
    model = train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    low = score_toxicity(docs, model).where("predicted = 0").select("doc_id")
    assert rows_of(result) == rows_of(docs.join(low, "doc_id", "left_semi").select(*docs.columns))


def test_quality_stage(stages):
    docs, result = stages[1]
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in result.collect()} == kept
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in result.collect():
        lines = iter(before[r.doc_id].split("\n"))
        assert all(line in lines for line in r.text.split("\n")) or r.text == ""
        assert r.n_chars == len(r.text)


def test_near_duplicate_stage(stages):
    docs, result = stages[2]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    group = brute_components([brute_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in result.collect()) == [rows[k][0] for k in range(len(rows)) if group[k] == k]


def test_suffix_stage(stages):
    docs, result = stages[3]
    want = {r[0]: r[1] - r[2] for r in brute_bytes([(r.doc_id, r.text) for r in docs.collect()], 100)}
    rows = result.collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        assert want[r.doc_id] - 6 * 1000 <= len(r.text.encode()) <= want[r.doc_id]
        assert r.n_chars == len(r.text)


def test_packing_stage(stages):
    docs, result = stages[4]
    bins, tokens = check_packing(result.collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert bins <= -(-tokens // 2048) + 1


def test_run_equals_the_stages(spark, stages):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(corpus_pipeline.run(spark, SF), *names) == rows_of(stages[-1][1], *names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{os.path.join(SF, table)}.parquet')")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found, *columns) == sorted(cur.fetchall(), key=repr)


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
