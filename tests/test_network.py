import re

import pytest
from pyspark.sql import functions as F

from quillmap import session
from quillmap.operators import network as nw
from quillmap.operators import trajectory as tr


def circle_of(spark, scores):
    rows = [(0, i + 1, 2, s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "focal_id int, author_id int, shared_papers int, score double")
    return sorted(r["author_id"] for r in nw.inner_circle(df).collect())


@pytest.mark.parametrize(
    "scores, size",
    [
        ([], 0), ([1.0], 1), ([3.0, 1.0], 2), ([5.0, 4.9, 4.8, 1.0, 0.9], 3),
        ([9.0, 1.0, 0.9], 2),  # the cut leaves at least two
        ([3.0, 2.0, 1.0], 2),  # first of equal gaps, at least two
        ([20.0 - 0.1 * i for i in range(18)] + [1.0, 0.9], 15),
    ],
)
def test_inner_circle_size(spark, scores, size):
    assert circle_of(spark, scores) == list(range(1, size + 1))


def test_scores_and_density(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 3), (4, 2), (4, 4)], "paper_id int, author_id int")
    papers = spark.createDataFrame([(1, 2024), (2, None), (3, 2000), (4, 0)], "openalex_id int, year int")
    authors = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 0)], "author_id int, paper_count int")
    focal = spark.createDataFrame([(1,)], "author_id int")
    edges = {r["author_id"]: r for r in nw.coauthor_edges(focal, links, papers).collect()}
    assert edges[2]["shared_papers"] == 2 and abs(edges[2]["recency"] - 0.85**2) < 1e-12
    assert edges[3]["recency"] is None
    import math

    scored = {r["author_id"]: r["score"] for r in nw.collaboration_scores(nw.coauthor_edges(focal, links, papers), authors).collect()}
    assert abs(scored[2] - (0.4 * math.log(3) + 0.35 * 0.85**2 + 0.25 * 2 / 3)) < 1e-12
    assert abs(scored[3] - (0.4 * math.log(2) + 0.25 * 1 / 3)) < 1e-12
    members = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (9, 4)], "focal_id int, author_id int")
    got = {r["focal_id"]: r for r in nw.circle_density(members, links).collect()}
    assert got[1]["n_edges"] == 2 and abs(got[1]["density"] - 2 / 3) < 1e-12 and got[1]["band"] == "medium"
    assert got[9]["density"] == 0.0 and got[9]["band"] == "low"


def test_layer2(spark):
    # 1 works with 2 and 3; both work twice with 4; 2 works twice with 5
    pairs = [(1, 2), (1, 3)] + [(2, 4)] * 2 + [(3, 4)] * 2 + [(2, 5)] * 2 + [(2, 3)] * 2
    links = spark.createDataFrame([(p, a) for p, pair in enumerate(pairs) for a in pair], "paper_id int, author_id int")
    authors = spark.createDataFrame([(i, 10 * i) for i in range(1, 6)], "author_id int, total_citations int")
    focal = spark.createDataFrame([(1,)], "author_id int")
    layer1 = nw.ego_layer1(nw.coauthor_edges(focal, links), authors)
    hops = nw.layer2_links(layer1, links)
    assert sorted((r["layer1_id"], r["author_id"]) for r in hops.collect()) == [(2, 4), (2, 5), (3, 4)]
    assert [r["author_id"] for r in nw.ego_layer2(hops, authors).collect()] == [4]


def test_fork_origin_is_least_cited_of_latest_earlier_year(spark):
    rows = [(0, 1, "a", 2000, 9), (0, 2, "a", 2002, 5), (0, 3, "a", 2002, 7), (0, 4, "b", 2003, 1), (0, 5, "b", 2003, 2)]
    papers = spark.createDataFrame(rows, "focal_id int, paper_id int, cluster_id string, year int, citations int")
    got = {r["cluster_id"]: r["origin_id"] for r in tr.fork_origins(papers).collect()}
    assert got == {"a": None, "b": 2}
    edges = {(r["edge_kind"], r["from_id"], r["to_id"]) for r in tr.trajectory_edges(papers).collect()}
    assert edges == {("spine", 1, 3), ("spoke", 3, 2), ("fork", 2, 5), ("spoke", 5, 4)}


def test_landscape_modes(spark):
    df = spark.createDataFrame([(2000,), (2001,), (2001,), (2003,)], "year int")
    assert tr.landscape_until(df, 2001).count() == 3
    assert tr.landscape_until(df, 2001, "slice").count() == 2
    with pytest.raises(ValueError):
        tr.landscape_until(df, 2001, "other")


def _tasks(df, *keys) -> int:
    """Largest number of tasks to which the plan deals rows by these keys."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    own = ", ".join(rf"{k}#\d+L?" for k in keys)
    return max((int(n) for n in re.findall(rf"hashpartitioning\({own}, (\d+)\), REPARTITION_BY_NUM", plan)), default=0)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    rows = sorted({(p, (7 * p + 11 * k * (p % 5)) % 30) for p in range(90) for k in range(4)})
    links = spark.createDataFrame(rows, "paper_id int, author_id int")
    authors = spark.createDataFrame([(a, a % 4) for a in range(30)], "author_id int, total_citations int")
    focals = authors.where("author_id % 3 = 0").select("author_id")
    written = {a: {p for p, b in rows if b == a} for a in range(30)}
    shared = {(a, b): len(written[a] & written[b]) for a in range(30) for b in range(30) if a != b and written[a] & written[b]}
    edges = nw.coauthor_edges(focals, links)
    assert _tasks(edges, "focal_id", "author_id") > len(rows) / 3 / 20
    assert {(r["focal_id"], r["author_id"]): r["shared_papers"] for r in edges.collect()} == {k: n for k, n in shared.items() if k[0] % 3 == 0}
    layer1 = nw.ego_layer1(edges, authors)
    hops = nw.layer2_links(layer1, links)
    near = {k for k in shared if k[0] % 3 == 0}
    want = {(f, a, b) for f, a in near for x, b in shared if x == a and shared[x, b] >= 2 and b != f and (f, b) not in near}
    assert {(r["focal_id"], r["layer1_id"], r["author_id"]) for r in hops.collect()} == want
    assert _tasks(hops, "layer1_id") > len(near) / 20 and _tasks(hops, "focal_id", "author_id") > len(near) / 20
    # the selection of authors is dealt, too, where it is too large to be broadcast
    some = session.join_selected(links, focals, ["author_id"], links.count(), "left_semi", max_rows=0)
    assert _tasks(some, "author_id") >= len(rows) / 20 and some.count() == sum(a % 3 == 0 for _, a in rows)
    papers = spark.createDataFrame([(p, p) for p in range(90)], "openalex_id int, year int")
    owned = nw.territory_papers(focals, layer1, links, papers, 2)
    best = {f: [a for _, a in sorted((-n, b) for (x, b), n in shared.items() if x == f)[:2]] for f in range(0, 30, 3)}
    owners = {(f, p): a for f in best for a in reversed([f, *best[f]]) for p in written[a]}
    assert {(r["focal_id"], r["openalex_id"]): r["owner_id"] for r in owned.collect()} == owners
