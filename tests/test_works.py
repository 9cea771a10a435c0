"""Nested records, malformed lines, incremental ingest, CSV and BibTeX."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillmap.operators import works as wk
from quillmap.operators.tiers import add_journal_tier
from quillmap.sources import files, lakehouse, snapshot
from quillmap.sources.alt_source import resolve_sources
from quillmap.streaming.ingest import ingest_stream, progress


def work(i, **more):
    return {"id": f"W{i}", "title": f"T{i}", "publication_year": 2010, "type": "article", **more}


def write(folder, name, records):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt", encoding="utf-8") as f:
        for r in records:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")


LONG = {f"word{i:02d}": [i] for i in range(10)}  # 69 characters


def test_snapshot_skips_bad_lines_and_years(spark, tmp_path):
    write(tmp_path / "a", "p.gz", [
        work(1), "{broken", "", work(2, publication_year=None), work(3, publication_year=0),
        work(4, primary_topic=None, primary_location={"source": None}, authorships=[
            {"author": {"id": None, "display_name": "x"}, "institutions": []},
            {"author": {"id": "A1", "display_name": "Ann"}, "institutions": [], "author_position": "last"},
            {"author": {"id": "A2"}, "is_corresponding": True, "institutions": [{"display_name": "I"}, {"display_name": "J"}]},
        ], corresponding_author_ids=["A1"]),
        work(5, cited_by_count="many"),
    ])
    works, bad = snapshot.read_snapshot(spark, str(tmp_path))
    flat = {r["openalex_id"]: r for r in wk.project_works(works).collect()}
    assert sorted(flat) == ["W1", "W4", "W5"]
    assert flat["W4"]["field"] == "" and flat["W4"]["source_name"] == "" and flat["W4"]["journal_tier"] == "Other"
    assert flat["W5"]["cited_by_count"] == 0 and flat["W5"]["title"] == "T5"
    assert sorted(r["value"] for r in bad.collect()) == ["", "{broken"]
    rows = {r["author_id"]: r for r in wk.explode_authorships(works).collect()}
    assert sorted(rows) == ["A1", "A2"]
    assert rows["A1"]["is_corresponding"] and rows["A2"]["is_corresponding"]
    assert rows["A1"]["institution"] == "" and rows["A2"]["institution"] == "I"
    assert rows["A1"]["ordinal"] == 1


def test_max_files(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"d{i}", "part.gz", [work(i)])
    works, _ = snapshot.read_snapshot(spark, str(tmp_path), max_files=2)
    assert sorted(r["id"] for r in works.collect()) == ["W0", "W1"]


def test_subject_filter(spark, tmp_path):
    topic = lambda s: {"display_name": "t", "subfield": {"display_name": s}, "field": {"display_name": "f"}}
    short = {"x" * 49: [0]}
    exact = {"x" * 50: [0]}
    further = [{"subfield": {"display_name": "Other"}}, {"subfield": {"display_name": "Information SYSTEMS"}}]
    write(tmp_path, "p.gz", [
        work(1, primary_topic=topic("Information Systems"), abstract_inverted_index=LONG),
        work(2, primary_topic=topic("Physics"), topics=further, abstract_inverted_index=LONG),
        work(3, primary_topic=topic("Physics"), abstract_inverted_index=LONG),
        work(4, primary_topic=topic("information systems"), abstract_inverted_index=short),
        work(5, primary_topic=topic("information systems"), abstract_inverted_index=exact),
        work(6, primary_topic=topic("information systems"), abstract_inverted_index=LONG, type="book"),
        work(7, primary_topic=topic("information systems"), abstract_inverted_index=LONG, publication_year=1990),
    ])
    works, _ = snapshot.read_snapshot(spark, str(tmp_path))
    got = {r["openalex_id"]: r for r in wk.filter_subject(works, ["Information Systems"]).collect()}
    assert sorted(got) == ["W1", "W2", "W5"]
    assert got["W2"]["subfield"] == "Physics" and got["W2"]["matched_subfield"] == "Information SYSTEMS"


def test_project_papers_keeps_title_only(spark, tmp_path):
    write(tmp_path, "p.gz", [work(1), work(2, title=None), work(3, title=None, abstract="given")])
    works, _ = snapshot.read_snapshot(spark, str(tmp_path))
    got = {r["openalex_id"]: r["abstract"] for r in wk.project_papers(works).collect()}
    assert got == {"W1": "", "W3": "given"}


def test_journal_tiers(spark):
    df = spark.createDataFrame([("  MIS Quarterly ",), ("Information Systems Journal",), ("Electronic Markets",), ("X",), (None,)], "source_name string")
    got = [r["journal_tier"] for r in add_journal_tier(df).collect()]
    assert sorted(got) == sorted(["Tier1-FT/UTD", "Tier2-Basket8", "Tier3-Strong", "Other", "Other"])


@pytest.mark.parametrize("key", [None, "openalex_id"])
def test_ingest_twice_and_new_file(spark, tmp_path, key):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: ingest_stream(spark, source, target, state, 1, key)
    write(tmp_path / "in" / "d1", "part.gz", [work(1), work(2)])
    q = run()
    q.awaitTermination()
    assert sum(n for _, n in progress(q)) == 2
    assert spark.read.parquet(target).count() == 2
    run().awaitTermination()
    assert spark.read.parquet(target).count() == 2
    write(tmp_path / "in" / "d2", "part.gz", [work(3), work(1)])
    run().awaitTermination()
    assert spark.read.parquet(target).count() == (3 if key else 4)
    assert "publication_year" in spark.read.parquet(target).columns


def test_lakehouse_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, 2000 + i % 3) for i in range(30)], "id int, publication_year int")
    path = str(tmp_path / "works")
    lakehouse.write_lakehouse(df, path)
    lakehouse.write_lakehouse(df, path)
    back = lakehouse.load_works(spark, path)
    assert back.count() == 30 and back.where("publication_year = 2001").count() == 10
    assert sum(r["n_rows"] for r in snapshot.rows_per_file(back).collect()) == 30
    lakehouse.register_views(spark, {"v_works": back, "v_files": path})
    assert spark.sql("SELECT count(*) FROM v_works JOIN v_files USING (id)").first()[0] == 30
    lakehouse.write_lakehouse(df.where("publication_year = 2002").limit(4), path)
    assert {r[0]: r[1] for r in lakehouse.load_works(spark, path).groupBy("publication_year").count().collect()} == {2000: 10, 2001: 10, 2002: 4}


def test_ingest_after_a_batch_without_rows(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write(tmp_path / "in", "a.gz", ["no json"])
    ingest_stream(spark, source, target, state, 1, "openalex_id").awaitTermination()
    write(tmp_path / "in", "b.gz", [work(1), work(1, title="other"), work(2)])
    ingest_stream(spark, source, target, state, 1, "openalex_id").awaitTermination()
    first = sorted((r["openalex_id"], r["title"]) for r in spark.read.parquet(target).collect())
    assert [i for i, _ in first] == ["W1", "W2"]
    again = str(tmp_path / "again")
    ingest_stream(spark, source, again, str(tmp_path / "state2"), None, "openalex_id").awaitTermination()
    assert sorted((r["openalex_id"], r["title"]) for r in spark.read.parquet(again).collect()) == first


def test_files_of_one_name_and_unreadable_files(spark, tmp_path):
    write(tmp_path / "a", "part.gz", [work(1), work(2)])
    write(tmp_path / "b", "part.gz", [work(3)])
    counts = {r["file"].split("/")[-2]: r["n_rows"] for r in snapshot.rows_per_file(snapshot_lines(spark, tmp_path)).collect()}
    assert counts == {"a": 2, "b": 1}
    whole = (tmp_path / "a" / "part.gz").read_bytes()
    (tmp_path / "b" / "cut.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "b" / "none.gz").write_bytes(b"plain text")
    bad = {r["file"].split("/")[-1] for r in snapshot.unreadable_files(spark, str(tmp_path)).collect()}
    assert bad == {"cut.gz", "none.gz"}


def snapshot_lines(spark, path):
    return spark.read.option("recursiveFileLookup", True).text(str(path))


def test_journal_names_without_letters_match_nothing(spark):
    names = spark.createDataFrame([("--",), ("Nature",)], "name string")
    sources = spark.createDataFrame([(1, "!!", 5), (2, "nature", 3)], "source_id int, source_name string, works_count int")
    assert [(r["name"], r["source_id"]) for r in resolve_sources(names, sources).collect()] == [("Nature", 2)]


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("W1", 'a "b"\nc', "x", 3.5), ("W2", None, "y", None)], "openalex_id string, title string, extra string, x double")
    path = str(tmp_path / "set")
    files.write_dataset(df, path)
    back = files.read_dataset(spark, path)
    rows = {r["openalex_id"]: r for r in back.collect()}
    assert rows["W1"]["title"] == 'a "b"\nc' and rows["W1"]["x"] == 3.5 and rows["W1"]["extra"] == "x"
    assert rows["W2"]["cluster_label"] == "Unknown" and rows["W2"]["cluster_id"] == -1 and rows["W2"]["abstract"] == ""
    raw = files.read_dataset(spark, path, columns=["extra", "openalex_id", "absent"])
    assert raw.columns == ["extra", "openalex_id"]
    assert files.ordered_columns(df).columns[:2] == ["openalex_id", "title"]
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "set").glob("part*"))
    assert text.startswith("\ufeff")


def test_bibtex(spark, tmp_path):
    df = spark.createDataFrame([("W1", "T", "Ann Lee; Bo", "J", 2001, "d"), ("W2", "U", "", "K", None, None)], "openalex_id string, title string, authors string, journal string, year int, doi string")
    entries = [r["entry"] for r in files.bibtex_lines(df, [F.col("openalex_id")]).orderBy("position").collect()]
    assert entries[0].splitlines()[0] == "@article{Lee2001_0," and entries[0].endswith("}")
    assert entries[1].splitlines()[0] == "@article{Unknown0_1,"
    files.export_bibtex(df, str(tmp_path / "bib"), [F.col("openalex_id")])


def test_vectors_round_trip_and_dataset_list(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.5], "m", 2), (2, [0.1, 0.2], "n", 2)], "id int, embedding array<float>, model string, dim int")
    files.write_vectors(df, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v"), "m").count() == 1
    for name in ("b_map_clustered", "worldmap_clustered", "papers_clustered", "other"):
        df.createOrReplaceTempView(name)
    got = [r["label"] for r in lakehouse.list_datasets(spark).orderBy("position").collect()]
    assert got == ["Worldmap", "B Map", "Papers"]
    got = [r["label"] for r in lakehouse.list_datasets(spark, titles={"papers": "All"}).orderBy("position").collect()]
    assert got == ["Worldmap", "B Map", "All"]
