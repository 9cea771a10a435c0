"""Look-ups of names, citations, sketches, whole abstracts and names: cases beside the registered queries."""

import pytest
from pyspark.sql import functions as F

from quillmap.operators import authors as au
from quillmap.operators import citations as ct
from quillmap.operators import density, lookup, network, quality, similar, vector_index
from quillmap.operators.embedding import embed_texts


def test_names_by_parts(spark, tmp_path):
    rows = [(1, "Ann Lee", 5, 10), (2, "ANNA  O'Lee", 5, 30), (3, None, 9, 99), (4, "", 9, 99), (5, "Lee", 1, 500), (6, "Bo", 2, 30), (7, "Jo%n_", 3, 1), (8, "éLEe", 3, 30), (9, "aaaa", 2, 0)]
    authors = spark.createDataFrame(rows, "author_id int, name string, paper_count int, total_citations int")
    index = lookup.store_name_index(authors, str(tmp_path), 4)
    texts = {"a": " lee ", "b": "ANN", "c": "bo", "d": "o", "e": "zzz", "f": "", "g": None, "h": "  ", "i": "%n", "j": "lee o", "k": "'lee", "l": "é", "m": "aaa", "n": "nna  o'"}
    queries = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    found = {}
    for r in lookup.find_authors_batch(index, authors, queries, 2, 10, buckets=4).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["author_id"])
    assert found == {"a": [2, 8, 1], "b": [2, 1], "c": [6], "d": [2, 6, 7], "i": [7], "k": [2], "l": [8], "m": [9], "n": [2]}
    top = lookup.find_authors_batch(index, authors, queries.where("query_id = 'a'"), 2, 1, buckets=4).collect()
    assert [(r["author_id"], r["rank"]) for r in top] == [(2, 1)]
    assert lookup.find_authors_batch(index, authors, queries.where("false"), buckets=4).count() == 0


def test_a_look_up_reads_its_buckets(spark, tmp_path):
    authors = spark.range(300).select(F.col("id").alias("author_id"), F.concat(F.lit("name "), F.col("id") * 7919).alias("name"), F.lit(3).alias("paper_count"), F.col("id").alias("total_citations"))
    index = lookup.store_name_index(authors, str(tmp_path), 32)
    queries = spark.createDataFrame([("q", str(7919 * 123))], "query_id string, text string")
    rarest = lookup.rarest_grams(index, queries, 32).first()
    assert rarest["n"] == index[0].where(F.col("gram") == rarest["gram"]).count() < 30
    assert [r["author_id"] for r in lookup.find_authors_batch(index, authors, queries, buckets=32).collect()] == [123]


def brute_rank(nodes, edges, rounds, damping=0.85):
    edges = {(a, b) for a, b in edges if a in nodes and b in nodes}
    out = {v: sum(a == v for a, _ in edges) for v in nodes}
    rank = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        lost = sum(r for v, r in rank.items() if not out[v])
        rank = {v: 1 - damping + damping * (sum(rank[a] / out[a] for a, b in edges if b == v) + lost / len(nodes)) for v in nodes}
    return rank


def test_citations(spark):
    raw = spark.createDataFrame(
        [("A", ["B", "C", "B", None, "", "A"]), ("B", ["C"]), ("C", []), ("D", None), ("E", ["X", "C"]), (None, ["A"]), ("", ["A"])], "id string, referenced_works array<string>"
    )
    edges = ct.citation_edges(raw)
    assert {tuple(r) for r in edges.collect()} == {("A", "B"), ("A", "C"), ("B", "C"), ("E", "X"), ("E", "C")}
    works = spark.createDataFrame([(x,) for x in "ABCDEE"], "openalex_id string")
    degrees = {r["openalex_id"]: (r["n_cited"], r["n_citing"]) for r in ct.citation_degrees(works, edges).collect()}
    assert degrees == {"A": (2, 0), "B": (1, 1), "C": (0, 3), "D": (0, 0), "E": (2, 0)}
    own = [tuple(r) for r in edges.collect()]
    ranks = {r["openalex_id"]: r["rank"] for r in ct.citation_rank(works, edges, rounds=4, tolerance=0.0).collect()}
    assert ranks == pytest.approx(brute_rank(set("ABCDE"), own, 4))
    assert sum(ranks.values()) == pytest.approx(5)
    settled = {r["openalex_id"]: r["rank"] for r in ct.citation_rank(works, edges, rounds=40, tolerance=1e-3).collect()}
    assert settled == pytest.approx(brute_rank(set("ABCDE"), own, 200), abs=0.02)
    assert ct.citation_rank(works.where("false"), edges).count() == 0


def test_sketches_merge(spark):
    links = spark.range(20_000).select((F.col("id") % 7000).alias("author_id"), (2000 + F.col("id") % 3).alias("publication_year"))
    whole = quality.author_sketches(links)
    parts = quality.merge_sketches(*(quality.author_sketches(links.where(F.col("author_id") % 3 == k)) for k in range(3)))
    for table in (whole, parts):
        row = quality.distinct_authors_by_sketch(table).first()
        assert row["n_links"] == 20_000 and abs(row["n_authors"] - 7000) < 140
    assert quality.distinct_authors_by_sketch(parts, "publication_year").count() == 3


def test_shared_papers_and_whole_texts(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (2, 11), (3, 11), (1, 12), (2, 12), (2, 12)], "author_id int, paper_id int")
    papers = spark.createDataFrame([(10, "T", "x" * 400, 5), (11, "U", None, 9), (12, "V", "y", 5)], "openalex_id int, title string, abstract string, citation_count int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 9)], "focal_id int, author_id int")
    got = [(r["focal_id"], r["author_id"], r["openalex_id"], r["rank"]) for r in network.shared_papers_of(pairs, links, papers).collect()]
    assert sorted(got) == [(1, 2, 10, 2), (1, 2, 11, 1), (1, 2, 12, 3), (1, 3, 11, 1)]
    text = lambda n: {r["author_id"]: r["text"] for r in au.author_texts(links, papers, n).collect()}
    assert text(None)[1] == "U.  T. " + "x" * 400 + " V. y"
    assert text(300)[1] == "U.  T. " + "x" * 300 + " V. y"


def test_vector_index(spark, tmp_path):
    import random

    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [c + r.gauss(0, 0.2) for c in centres[k % 6]]) for k in range(240)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, rows[5][1]), (904, [float("inf")] + [1.0] * 7)]
    vectors = spark.createDataFrame(rows, "openalex_id int, embedding array<float>")
    index = vector_index.store_vector_index(vectors, str(tmp_path / "a"), cells=6)
    assert index[0].count() == 241 and index[1].count() == 6
    queries = vectors.where("openalex_id in (5, 17, 900, 902)").withColumnRenamed("openalex_id", "query_id")
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in rows if v and k not in (901, 902, 904)}
    want = {}
    for q in (5, 17):
        scored = sorted((-round(sum(a * b for a, b in zip(unit[q], u)), 6), k) for k, u in unit.items() if k != q)
        want[q] = [k for _, k in scored[:7]]
    for probes in (6, 2):  # the clusters are far apart: two cells hold all neighbours
        got = {}
        for x in vector_index.search_vectors(index, queries, 7, probes, True).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["id"])
        assert got == want
    read = vector_index.nearest_cells(index, queries.where("query_id = 5").selectExpr("query_id", "cast(embedding as array<double>) q"), 1)
    assert read.count() == 1
    none = vector_index.store_vector_index(vectors.where("false"), str(tmp_path / "b"))
    assert vector_index.search_vectors(none, queries).count() == 0
    texts = spark.createDataFrame([(1, "red apple pie"), (2, "blue steel bridge"), (3, "apple pie with cream")], "openalex_id int, text string")
    held = vector_index.store_vector_index(embed_texts(texts, "openalex_id", "text"), str(tmp_path / "c"), cells=2)
    asked = spark.createDataFrame([(7, "apple pie"), (8, "steel")], "query_id int, text string")
    first = {x["query_id"]: x["id"] for x in vector_index.semantic_search(held, asked, 1, 2).collect()}
    assert first == {7: 1, 8: 2}


def test_neighbour_graph(spark):
    """Groups of near vectors, a hub that many have as neighbour, copies, and vectors that take no part."""
    import random

    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(k, [c + r.gauss(0, 0.3) for c in centres[k % 12]]) for k in range(240)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (900, None), (901, [0.0] * 6)]
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in rows if v and k != 901}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {q: [k for _, k in sorted((-round(dot(u, w), 9), k) for k, w in unit.items() if k != q)[:5]] for q, u in unit.items()}
    vectors = spark.createDataFrame(rows, "openalex_id int, embedding array<double>")
    got = {}
    for x in similar.similar_items(vectors, k=5, width=10).orderBy("openalex_id", "rank").collect():
        got.setdefault(x["openalex_id"], []).append(x["similar_id"])
        assert x["score"] == pytest.approx(dot(unit[x["openalex_id"]], unit[x["similar_id"]]), abs=1e-9)
    assert set(got) == set(unit) and all(len(v) == 5 and len(set(v)) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    few = similar.similar_items(vectors.where("openalex_id < 3"), k=5, width=5)
    assert few.count() == 6
    assert similar.similar_items(vectors.where("openalex_id > 800"), k=5).count() == 0


@pytest.mark.parametrize("dim, block", [(1, 2000), (2, 7), (4, 2000), (5, 11)])
def test_density_clusters_equal_plain_search(spark, monkeypatch, dim, block):
    import math
    import random

    monkeypatch.setattr(density, "BLOCK", block)
    r = random.Random(dim)
    rows = []
    for c in range(4):
        centre = [r.uniform(-3, 3) for _ in range(dim)]
        rows += [[x + r.gauss(0, 0.15) for x in centre] for _ in range(25)]
    rows += [[r.uniform(-4, 4) for _ in range(dim)] for _ in range(30)] + [rows[0]] * 5
    eps = 0.1 + 0.06 * dim
    near = [[k for k, b in enumerate(rows) if math.dist(a, b) <= eps] for a in rows]
    core = {k for k, n in enumerate(near) if len(n) >= 5}
    group = {}
    for k in sorted(core):
        if k not in group:
            group[k], todo = k, [k]
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in group:
                        group[j] = k
                        todo.append(j)
    size = {g: sum(x == g for x in group.values()) for g in group.values()}
    number = {g: n for n, g in enumerate(sorted((g for g in size if size[g] >= 10), key=lambda g: (-size[g], g)))}
    want = {k: number.get(group.get(k), -1) for k in range(len(rows))} | {1000: -1, 1001: -1}
    data = [(k, v) for k, v in enumerate(rows)] + [(1000, None), (1001, [float("nan")] * dim)]
    vectors = spark.createDataFrame(data, "openalex_id int, embedding array<double>").repartition(4)
    assert {x["openalex_id"]: x["cluster_id"] for x in density.density_cluster_nd(vectors, eps).collect()} == want
    assert max(want.values()) >= 0
