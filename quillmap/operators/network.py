"""Co-author networks around focal authors.

All functions take a table of focal authors and work from their papers outwards. Nothing builds
the pairs of every author with every other: rows arise only for the asked authors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.scores import clamp, collaboration_score
from quillmap.session import broadcast_if_small, deal, durable, exact_rank, join_dealt, join_selected, top_n


def _papers_of(focals: DataFrame, links: DataFrame) -> DataFrame:
    asked = focals.select("author_id").distinct()
    return join_selected(links, asked, ["author_id"], links.count(), "left_semi").select(
        F.col("author_id").alias("focal_id"), "paper_id"
    )


def _mean_rows(table: DataFrame, key: str) -> float:
    """Rows for a value of the key, on average; it only sets numbers of tasks."""
    size = table.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key).alias("k")).first()
    return size["n"] / max(1, size["k"])


def coauthor_edges(
    focals: DataFrame,
    links: DataFrame,
    papers: DataFrame | None = None,
    current_year: int = 2026,
    decay: float = 0.85,
) -> DataFrame:
    """(focal_id, author_id, shared_papers[, recency]): co-authors of each focal author.

    With papers(openalex_id, year), ``recency`` is the mean of decay^(current_year - year) over the
    shared papers that have a year. Years are averaged, not collected.
    """
    mine = _papers_of(focals, links)
    aggregates = [F.count(F.lit(1)).alias("shared_papers")]
    if papers is not None:
        years = papers.select(F.col("openalex_id").alias("paper_id"), "year")
        wanted = broadcast_if_small(mine.select("paper_id").distinct())
        mine = mine.join(years.join(wanted, "paper_id", "left_semi"), "paper_id", "left")
        fade = F.when(F.col("year") != 0, F.pow(F.lit(decay), current_year - F.col("year")))
        aggregates.append(F.avg(fade).alias("recency"))
    mine = durable(mine)
    pairs = join_selected(links.select("paper_id", "author_id"), mine, ["paper_id"], links.count()).where(
        F.col("author_id") != F.col("focal_id")
    )
    # few pairs share many papers, so combining before the shuffle saves little
    rows = mine.count() * _mean_rows(links, "paper_id")
    return deal(pairs, rows, "focal_id", "author_id").groupBy("focal_id", "author_id").agg(*aggregates)


def ego_layer1(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """Co-authors with their author record, in order of shared papers (rank by that, then id)."""
    return edges.join(authors, "author_id")


def top_coauthors(layer1: DataFrame, n: int = 15) -> DataFrame:
    return top_n(layer1, ["focal_id"], [F.desc("shared_papers"), F.col("author_id")], n)


def pair_edges(members: DataFrame, links: DataFrame, group: str = "focal_id") -> DataFrame:
    """(group, author_a, author_b): distinct pairs a < b of a group's members with a common paper.

    Links are cut to members first, so a paper contributes pairs of members of one group only.
    """
    held = durable(join_selected(links.select("author_id", "paper_id"), members.select(group, "author_id"), ["author_id"], links.count()))
    a = held.select(group, "paper_id", F.col("author_id").alias("author_a"))
    b = held.select(group, "paper_id", F.col("author_id").alias("author_b"))
    return (
        join_dealt(a, b, [group, "paper_id"], held.count())
        .where(F.col("author_a") < F.col("author_b"))
        .select(group, "author_a", "author_b")
        .distinct()
    )


def edge_coordinates(edges: DataFrame, coords: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges whose two ends are on the map, with their positions."""
    start = coords.select(F.col("author_id").alias(src), F.col("x").alias("x0"), F.col("y").alias("y0"))
    end = coords.select(F.col("author_id").alias(dst), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.join(start, src).join(end, dst)


def collaboration_scores(
    edges: DataFrame,
    authors: DataFrame,
    weights: tuple[float, float, float] = (0.4, 0.35, 0.25),
) -> DataFrame:
    """Adds ``score`` to co-author edges that carry ``recency``; a paper count of 0 counts as 1."""
    count = F.greatest(F.coalesce("paper_count", F.lit(0)), F.lit(1))
    own = authors.select(F.col("author_id").alias("focal_id"), count.alias("_total_a"))
    other = authors.select("author_id", count.alias("_total_b"))
    score = collaboration_score(
        F.col("shared_papers"), F.col("recency"), F.col("_total_a"), F.col("_total_b"), weights
    )
    return (
        edges.join(own, "focal_id").join(other, "author_id")
        .withColumn("score", score).drop("_total_a", "_total_b")
    )


def inner_circle(
    scores: DataFrame, min_shared: int = 2, min_size: int = 2, max_size: int = 15
) -> DataFrame:
    """(focal_id, author_id, score, rank): co-authors above the largest gap of the sorted scores.

    The cut leaves between min_size and max_size people; the first of equal gaps counts. Scores are
    compared to twelve digits, so that equal records tie whatever the order of summation. Ranks are
    exact however many co-authors a focal author has, and the next score comes by a join on rank.
    """
    eligible = scores.where(F.col("shared_papers") >= min_shared).select(
        "focal_id", "author_id", "shared_papers", F.round("score", 12).alias("score")
    )
    ranked = exact_rank(eligible, ["focal_id"], [F.desc("score"), F.col("author_id")])
    following = ranked.select(
        "focal_id", (F.col("rank") - 1).alias("rank"), F.col("score").alias("_next")
    )
    gaps = ranked.join(following, ["focal_id", "rank"])
    widest = F.max_by("rank", F.struct((F.col("score") - F.col("_next")).alias("gap"), (-F.col("rank")).alias("r")))
    cut = gaps.groupBy("focal_id").agg(clamp(widest, min_size, max_size).alias("_size"))
    return (
        ranked.join(cut, "focal_id", "left")
        .where(F.col("rank") <= F.coalesce("_size", F.lit(1)))
        .drop("_size")
    )


def circle_density(
    circle: DataFrame, links: DataFrame, high: float = 0.7, medium: float = 0.4
) -> DataFrame:
    """(focal_id, n_members, n_edges, density, band): linked share of the possible member pairs."""
    sizes = circle.groupBy("focal_id").agg(F.count(F.lit(1)).alias("n_members"))
    edges = pair_edges(circle, links).groupBy("focal_id").agg(F.count(F.lit(1)).alias("n_edges"))
    possible = F.col("n_members") * (F.col("n_members") - 1) / 2
    density = F.when(possible > 0, F.col("n_edges") / possible).otherwise(F.lit(0.0))
    return (
        sizes.join(edges, "focal_id", "left").fillna({"n_edges": 0})
        .withColumn("density", density)
        .withColumn(
            "band",
            F.when(F.col("density") >= high, "high").when(F.col("density") >= medium, "medium").otherwise("low"),
        )
    )


def circle_topics(
    circle: DataFrame, links: DataFrame, papers: DataFrame, top: int = 5, distinct_papers: bool = False
) -> DataFrame:
    """(focal_id, topic, n, rank): main topics of a circle's papers, counted per member and paper."""
    topics = papers.where(F.coalesce("topic", F.lit("")) != "").select(
        F.col("openalex_id").alias("paper_id"), "topic"
    )
    people = broadcast_if_small(circle.select("focal_id", "author_id"))
    written = links.select("author_id", "paper_id").join(people, "author_id")
    rows = topics.join(broadcast_if_small(written), "paper_id")
    n = F.countDistinct("paper_id") if distinct_papers else F.count(F.lit(1))
    counts = rows.groupBy("focal_id", "topic").agg(n.alias("n"))
    return top_n(counts, ["focal_id"], [F.desc("n"), F.col("topic")], top)


def layer2_links(layer1: DataFrame, links: DataFrame, min_shared: int = 2) -> DataFrame:
    """(focal_id, layer1_id, author_id): co-authors of co-authors with enough shared papers.

    The focal author and its direct co-authors are left out.
    """
    near = layer1.select("focal_id", F.col("author_id").alias("layer1_id"))
    hop = coauthor_edges(layer1.select("author_id"), links).where(F.col("shared_papers") >= min_shared)
    hop = hop.select(F.col("focal_id").alias("layer1_id"), "author_id")
    hop = durable(hop)
    known = layer1.select("focal_id", "author_id")
    found = join_dealt(near, hop, ["layer1_id"], near.count() + hop.count()).where(F.col("author_id") != F.col("focal_id"))
    rows = near.count() * (1 + _mean_rows(hop, "layer1_id"))
    return join_dealt(found, known, ["focal_id", "author_id"], rows, "left_anti")


def ego_layer2(
    hops: DataFrame, authors: DataFrame, min_links: int = 2, cap: int = 100
) -> DataFrame:
    """(focal_id, author_id, n_links, author columns, rank): layer 2, most cited first up to the cap."""
    counts = deal(hops, hops.count(), "focal_id", "author_id").groupBy("focal_id", "author_id").agg(F.count(F.lit(1)).alias("n_links"))
    linked = counts.where(F.col("n_links") >= min_links).join(authors, "author_id")
    return top_n(linked, ["focal_id"], [F.desc("total_citations"), F.col("author_id")], cap)


def ego_edges(
    layer1: DataFrame, circle: DataFrame, layer2: DataFrame, hops: DataFrame, links: DataFrame
) -> DataFrame:
    """(focal_id, kind, src, dst, weight): all edges of the networks.

    focal to layer 1 (shared papers up to 8, at least 3 inside the circle), circle to circle,
    layer 2 to layer 1.
    """
    inside = circle.select("focal_id", "author_id", F.lit(True).alias("_in"))
    weight = F.least("shared_papers", F.lit(8))
    own = layer1.select("focal_id", "author_id", "shared_papers")
    first = join_dealt(own, inside, ["focal_id", "author_id"], layer1.count(), "left").select(
        "focal_id", F.lit("layer1").alias("kind"), F.col("focal_id").alias("src"),
        F.col("author_id").alias("dst"),
        F.when(F.col("_in"), F.greatest(weight, F.lit(3))).otherwise(weight).cast("long").alias("weight"),
    )
    mutual = pair_edges(circle, links).select(
        "focal_id", F.lit("circle").alias("kind"), F.col("author_a").alias("src"),
        F.col("author_b").alias("dst"), F.lit(3).cast("long").alias("weight"),
    )
    second = join_dealt(hops, layer2.select("focal_id", "author_id"), ["focal_id", "author_id"], hops.count(), "left_semi").select(
        "focal_id", F.lit("layer2").alias("kind"), F.col("author_id").alias("src"),
        F.col("layer1_id").alias("dst"), F.lit(1).cast("long").alias("weight"),
    )
    return first.unionByName(mutual).unionByName(second)


def territory_papers(
    focals: DataFrame, layer1: DataFrame, links: DataFrame, papers: DataFrame, top_coauthors_n: int = 15
) -> DataFrame:
    """(focal_id, openalex_id, owner_id, paper columns): papers of a focal author and its main co-authors.

    Each paper once per focal author; the focal author owns it first, then the co-authors by rank.
    """
    ranked = top_coauthors(layer1, top_coauthors_n)
    people = focals.select(
        F.col("author_id").alias("focal_id"), "author_id", F.lit(0).alias("rank")
    ).distinct().unionByName(ranked.select("focal_id", "author_id", "rank"))
    people = durable(people)
    owned = join_selected(links.select("author_id", "paper_id"), people, ["author_id"], links.count())
    rows = people.count() * _mean_rows(links, "author_id")
    owner = deal(owned, rows, "focal_id", "paper_id").groupBy("focal_id", "paper_id").agg(F.min_by("author_id", "rank").alias("owner_id"))
    return join_selected(papers, owner.withColumnRenamed("paper_id", "openalex_id"), ["openalex_id"], links.count())


def author_profile(
    focals: DataFrame, papers_of_authors: DataFrame, layer1: DataFrame, top: int = 15
) -> DataFrame:
    """(author_id, part, rank_value, ref_id): papers by citations and main co-authors in one table."""
    own = papers_of_authors.join(focals.select("author_id").distinct(), "author_id", "left_semi").select(
        "author_id", F.lit("paper").alias("part"), F.col("citation_count").cast("long").alias("rank_value"),
        F.col("openalex_id").alias("ref_id"),
    )
    co = top_coauthors(layer1, top).select(
        F.col("focal_id").alias("author_id"), F.lit("coauthor").alias("part"),
        F.col("shared_papers").alias("rank_value"), F.col("author_id").alias("ref_id"),
    )
    return own.unionByName(co)


# --- comparison of selected authors ------------------------------------------------------------


def _group_papers(groups: DataFrame, links: DataFrame) -> DataFrame:
    return links.select("author_id", "paper_id").join(broadcast_if_small(groups), "author_id")


def shared_papers(groups: DataFrame, links: DataFrame, min_owners: int = 2) -> DataFrame:
    """(group_id, paper_id, owners): papers of at least two selected authors of a group.

    A group has a handful of selected authors, so the owner list is short.
    """
    return (
        _group_papers(groups, links)
        .groupBy("group_id", "paper_id")
        .agg(F.array_sort(F.collect_set("author_id")).alias("owners"))
        .where(F.size("owners") >= min_owners)
    )


def shared_papers_of(pairs: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    """(focal_id, author_id, paper columns, rank): the papers that both authors of each pair wrote, most cited first.

    Walks from the pairs: papers of the focal author, then those that the other one wrote, too.
    """
    asked = durable(pairs.select("focal_id", "author_id").distinct())
    own = links.select(F.col("author_id").alias("focal_id"), "paper_id").join(broadcast_if_small(asked), "focal_id")
    both = links.select("author_id", "paper_id").join(broadcast_if_small(own), ["author_id", "paper_id"]).distinct()
    held = papers.join(broadcast_if_small(both.withColumnRenamed("paper_id", "openalex_id")), "openalex_id")
    return exact_rank(held, ["focal_id", "author_id"], [F.desc("citation_count"), F.col("openalex_id")])


def solo_papers(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(group_id, author_id, paper_id): papers of one selected author only."""
    both = shared_papers(groups, links).select("group_id", "paper_id")
    return (
        _group_papers(groups, links)
        .select("group_id", "author_id", "paper_id")
        .join(both, ["group_id", "paper_id"], "left_anti")
    )


def compare_points(groups: DataFrame, links: DataFrame, min_papers: int = 5) -> DataFrame:
    """(group_id, paper_id, owner_id, n_owners, shared): papers of a group, owned by the first author.

    groups(group_id, author_id, seq). Groups with too few papers are left out.
    """
    points = _group_papers(groups, links).groupBy("group_id", "paper_id").agg(
        F.min_by("author_id", "seq").alias("owner_id"),
        F.countDistinct("author_id").alias("n_owners"),
    )
    sizes = points.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_papers)
    return points.withColumn("shared", F.col("n_owners") >= 2).join(
        sizes.select("group_id"), "group_id", "left_semi"
    )
