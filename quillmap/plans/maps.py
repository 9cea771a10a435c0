"""Whole jobs: world map, landscape, author map, comparison of authors, ego map."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import compose_text, truncate_text
from quillmap.functions.vectors import l2_normalize
from quillmap.operators import authors as au
from quillmap.operators import clustering, keyed, labels, network, terms
from quillmap.operators.embedding import author_vectors, embed_texts, project_2d
from quillmap.operators.quality import alignment_check
from quillmap.operators.sampling import sqrt_quotas, stratified_sample
from quillmap.operators.territory import cluster_ellipses
from quillmap.operators.trajectory import trajectory_edges
from quillmap.operators.works import filter_high_impact
from quillmap.session import broadcast_if_small, deal, durable, join_dealt, store

ID = "openalex_id"


def _with_text(papers: DataFrame) -> DataFrame:
    abstract = F.col("abstract") if "abstract" in papers.columns else F.lit("")
    return papers.withColumn("_text", compose_text(F.col("title"), abstract))


def describe_clusters(papers: DataFrame, placed: DataFrame, label_size: int = 3, per: str | None = None) -> DataFrame:
    """Papers with x, y, cluster_id, cluster_label and topic_words.

    placed(id, x, y, cluster_id). Labels are the clusters' topics, handed out without repeats, or
    their strongest words. With ``per`` placed has that column, too, and each of its values is a map by itself.
    """
    keys = [per] if per else []
    mapped = (papers if "_text" in papers.columns else _with_text(papers)).join(placed, ID)
    if "topic" not in mapped.columns:
        mapped = mapped.withColumn("topic", F.lit(""))
    own = F.struct(*keys, "cluster_id")
    mapped = store(mapped.withColumn("_own", own) if per else mapped, "mapped")
    column = "_own" if per else "cluster_id"
    words = terms.topic_words(terms.tfidf_terms(mapped, column, "_text", ID, per=per), column, label_size)
    strongest = durable(words.select("_own.*", "topic_words", "fallback_label") if per else words)
    named = labels.label_clusters(mapped, fallback_terms=strongest, per=per)
    return (
        mapped.join(broadcast_if_small(named.select(*keys, "cluster_id", F.col("label").alias("cluster_label"))), [*keys, "cluster_id"])
        .join(broadcast_if_small(strongest.select(*keys, "cluster_id", "topic_words")), [*keys, "cluster_id"], "left")
        .withColumn("topic_words", F.coalesce("topic_words", F.lit("")))
        .drop("_text", "_own")
    )


def build_landscape(
    papers: DataFrame,
    vectors: DataFrame | None = None,
    method: str = "kmeans",
    k: int | None = None,
    eps: float = 0.05,
    min_samples: int = 5,
    min_cluster_size: int = 10,
    move_outliers: bool = True,
    seed: int = 42,
    **encoder,
) -> DataFrame:
    """Papers on a map with clusters and labels.

    Vectors(id, embedding) may be given; they must fit the papers one to one. ``kmeans`` works on
    the vectors, ``density`` on the projection, with noise optionally moved to the closest topic.
    """
    papers = store(_with_text(papers), "papers")  # texts are composed once, each step reads the columns it needs
    if vectors is None:
        vectors = embed_texts(papers, ID, "_text", **encoder).select(ID, "embedding")
    elif not alignment_check(papers, vectors, ID, ID).isEmpty():
        raise ValueError("papers and vectors do not match")
    vectors = durable(vectors)
    if method == "kmeans":
        placed = clustering.cluster_papers(vectors, k, seed)
    elif method == "density":
        points = durable(project_2d(vectors))
        found = clustering.density_cluster(points, eps, min_samples, min_cluster_size)
        if move_outliers:
            text = papers.select(ID, F.col("_text").alias("text"))
            found = terms.reduce_outliers(durable(text.join(found, ID)))
        placed = points.join(found, ID)
    else:
        raise ValueError(f"unknown method: {method}")
    return describe_clusters(papers, placed)


def build_worldmap(
    works: DataFrame,
    min_citations: int = 500,
    target: int = 50_000,
    floor: int = 100,
    stratum: str = "field",
    seed: int = 42,
    **encoder,
) -> DataFrame:
    """Map of a square-root-proportional sample of the high-impact articles of all fields."""
    renamed = {"cited_by_count": "citation_count", "publication_year": "year", "source_name": "journal"}
    high = filter_high_impact(works, min_citations).withColumnsRenamed(renamed)
    quotas = sqrt_quotas(high, stratum, target, floor)
    # the sample has at most target + floor * strata rows and is read by every later step
    sample = durable(stratified_sample(high, stratum, quotas, seed=seed))
    return build_landscape(sample, seed=seed, **encoder)


def build_author_map(
    links: DataFrame,
    papers: DataFrame,
    vectors: DataFrame,
    authors: DataFrame,
    min_papers: int = 3,
    k: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Authors with enough papers on a map: vectors from their papers, clusters named after the most cited."""
    own = durable(author_vectors(links, vectors, papers, min_papers))
    placed = clustering.cluster_authors(own.select("author_id", "embedding"), k, seed)
    mapped = durable(authors.join(placed, "author_id"))
    named = labels.label_author_clusters(mapped).withColumnRenamed("label", "cluster_label")
    return mapped.join(broadcast_if_small(named), "cluster_id")


def compare_authors(
    groups: DataFrame,
    links: DataFrame,
    papers: DataFrame,
    vectors: DataFrame | None = None,
    min_papers: int = 5,
    abstract_chars: int | None = 300,
) -> tuple[DataFrame, DataFrame]:
    """(points, centroids) of groups of selected authors; every group has a space and clusters of its own.

    points: (group_id, paper, owner_id, shared, x, y, cluster_id, cluster_label). centroids: label
    places of clusters with at least three papers of the group. Nothing of a group depends on others.
    """
    points = store(network.compare_points(groups, links, min_papers).withColumnRenamed("paper_id", ID), "points")
    held = store(papers.join(points.select(ID).distinct(), ID, "left_semi"), "papers")
    if vectors is None:
        abstract = F.coalesce(F.col("abstract"), F.lit("")) if "abstract" in papers.columns else F.lit("")
        short = truncate_text(abstract, abstract_chars, "") if abstract_chars else abstract
        text = held.withColumn("_text", F.concat(F.col("title"), F.lit(". "), short))
        vectors = store(embed_texts(text, ID, "_text").select(ID, "embedding"), "vectors")
    # vectors go to the task of their group once; both steps below find them there
    rows = points.count()
    own = durable(deal(join_dealt(points, vectors, [ID], rows), rows, "group_id"))
    n = F.count(F.lit(1))
    counts = own.groupBy("group_id").agg(F.when(n < 5, 1).otherwise(_paper_clusters(n)).alias("k"))
    found = keyed.kmeans_by(own, ["group_id"], ID, "embedding", counts, PAPER_CLUSTERS[1])
    # what is known of a point goes with it, as a group has a paper once
    about = [c for c in points.columns if c not in ("group_id", ID)]
    places = keyed.project_2d_by(own, "group_id", ID, keep=about)
    mapped = describe_clusters(held, join_dealt(places, found, ["group_id", ID], rows), per="group_id")
    placed = mapped.select("group_id", ID, *about, *[c for c in mapped.columns if c not in ("group_id", ID, *about)])
    centroids = placed.groupBy("group_id", "cluster_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")
    ).where(F.col("n") >= 3)
    return placed, centroids


#: Least and most clusters of papers.
PAPER_CLUSTERS = (3, 200)


def _paper_clusters(n: Column) -> Column:
    return F.greatest(F.lit(PAPER_CLUSTERS[0]), F.least(F.lit(PAPER_CLUSTERS[1]), F.floor(F.sqrt(n / 2)).cast("int")))


def author_text_vectors(links: DataFrame, papers: DataFrame, abstract_chars: int | None = 300, **encoder) -> DataFrame:
    """(author_id, embedding) from the running text of all papers of an author; abstract_chars None: whole abstracts.

    Long texts come in chunks; their vectors are averaged with the number of papers as weight.
    """
    chunks = store(au.author_texts(links, papers, abstract_chars), "chunks").withColumn(
        "_key", F.concat_ws("/", F.col("author_id").cast("string"), F.col("chunk").cast("string"))
    )
    embedded = embed_texts(chunks, "_key", "text", **encoder).select(
        "_key", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    return (
        chunks.select("_key", "author_id", "n_papers").join(embedded, "_key")
        .groupBy("author_id")
        .agg(Summarizer.mean(F.col("v"), F.col("n_papers").cast("double")).alias("m"))
        .select("author_id", l2_normalize(vector_to_array("m")).alias("embedding"))
    )


def build_ego_map(
    focals: DataFrame, links: DataFrame, papers: DataFrame, authors: DataFrame, abstract_chars: int | None = 300, **encoder
) -> tuple[DataFrame, DataFrame]:
    """(people, edges) of the focal authors' networks with positions in a space of each focal author's own.

    people: (focal_id, author_id, layer, x, y) for the focal author, co-authors and their
    co-authors; edges: network edges with the positions of both ends.
    """
    scored = store(network.collaboration_scores(network.coauthor_edges(focals, links, papers), authors), "scored")
    circle = network.inner_circle(scored)
    layer1 = store(scored.select("focal_id", "author_id", "shared_papers").join(authors, "author_id"), "layer1")
    hops = store(network.layer2_links(layer1, links), "hops")
    layer2 = store(network.ego_layer2(hops, authors), "layer2")
    people = (
        focals.select(F.col("author_id").alias("focal_id"), "author_id", F.lit(0).alias("layer"))
        .unionByName(layer1.select("focal_id", "author_id", F.lit(1).alias("layer")))
        .unionByName(layer2.select("focal_id", "author_id", F.lit(2).alias("layer")))
    )
    known = people.select("author_id").distinct()
    vectors = store(author_text_vectors(links.join(known, "author_id", "left_semi"), papers, abstract_chars, **encoder), "vectors")
    spread = people.select("focal_id", "author_id").distinct().join(vectors, "author_id")
    coords = store(keyed.project_2d_by(spread, "focal_id", "author_id"), "coords")
    edges = store(network.ego_edges(layer1, circle, layer2, hops, links), "edges")
    ends = edges
    for end, x, y in (("src", "x0", "y0"), ("dst", "x1", "y1")):
        place = coords.select("focal_id", F.col("author_id").alias(end), F.col("x").alias(x), F.col("y").alias(y))
        ends = ends.join(place, ["focal_id", end])
    return people.join(coords, ["focal_id", "author_id"]), ends.select(*edges.columns, "x0", "y0", "x1", "y1")


def describe_hierarchy(papers: DataFrame, levels: DataFrame | None = None, points: DataFrame | None = None, per: str | None = None) -> DataFrame:
    """(per, level, cluster_id, parent_id, label, n, x, y, half_major, half_minor, angle, only_child).

    levels(id, coarse_id, fine_id, only_child), points(id, x, y). Coarse clusters are named by
    subfield and fine ones by topic, by majority; without such values by their strongest words. With
    ``per`` both have that column, too, and each of its values is described by itself. Without levels and points
    the papers are a stored table that has their columns already.
    """
    keys = [per] if per else []
    rows = _with_text(papers)
    if levels is not None:
        rows = durable(rows.join(levels, ID).join(points.select(*keys, ID, "x", "y"), [*keys, ID]))
    if per:
        # clusters of different keys are different clusters
        rows = rows.withColumns({c: F.struct(F.col(per).alias("k"), F.col(c).alias("c")) for c in ("coarse_id", "fine_id")})

    def level(name: str, column: str, value: str, words: int, scale: float) -> DataFrame:
        outlines = cluster_ellipses(rows, column, scale, min_points=1)
        few = F.col("n") < 3  # too few points for an outline, the centre stays
        for axis in ("half_major", "half_minor", "angle"):
            outlines = outlines.withColumn(axis, F.when(~few, F.col(axis)))
        strongest = terms.topic_words(terms.tfidf_terms(rows, column, "_text", ID, per=per), column, words)
        out = outlines.join(strongest.select(column, "fallback_label"), column, "left")
        named = F.lit(None).cast("string")
        if value in rows.columns:
            out = out.join(labels.majority_label(rows, column, value).select(column, "label"), column, "left")
            named = F.col("label")
        parents = rows.groupBy(column).agg(
            F.min("coarse_id").alias("parent_id"), F.first("only_child").alias("only_child")
        )
        return out.join(parents, column).select(
            F.lit(name).alias("level"), F.col(column).alias("cluster_id"),
            F.when(F.lit(name == "fine"), F.col("parent_id")).alias("parent_id"),
            F.coalesce(named, "fallback_label", F.lit("Unknown")).alias("label"),
            "n", "x", "y", "half_major", "half_minor", "angle",
            F.when(F.lit(name == "fine"), F.col("only_child")).alias("only_child"),
        )

    both = level("coarse", "coarse_id", "subfield", 3, 2.0).unionByName(
        level("fine", "fine_id", "topic", 4, 1.5)
    )
    if not per:
        return both
    rest = [c for c in both.columns if c not in ("cluster_id", "parent_id")]
    return both.select(F.col("cluster_id.k").alias(per), F.col("cluster_id.c").alias("cluster_id"), F.col("parent_id.c").alias("parent_id"), *rest)


def build_trajectories(
    focals: DataFrame,
    links: DataFrame,
    papers: DataFrame,
    authors: DataFrame,
    vectors: DataFrame | None = None,
    top_coauthors_n: int = 15,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(territory, clusters, edges) of focal authors.

    territory: papers of each focal author and its main co-authors with owner, x, y and clusters;
    clusters: the two levels described; edges: the trajectory tree of the focal author's own papers
    over the coarse clusters. Every focal author has a space and clusters of its own.
    """
    layer1 = network.ego_layer1(network.coauthor_edges(focals, links), authors)
    # ids alone until places and clusters are known: a paper is in many territories, its columns are joined once, at the end
    territory = store(network.territory_papers(focals, layer1, links, papers.select(ID).distinct(), top_coauthors_n), "territory")
    held = store(papers.join(territory.select(ID).distinct(), ID, "left_semi"), "papers")
    if vectors is None:
        vectors = store(embed_texts(_with_text(held), ID, "_text").select(ID, "embedding"), "vectors")
    rows = territory.count()
    points = keyed.project_2d_by(join_dealt(territory, vectors, [ID], rows), "focal_id", ID, keep=["owner_id"])
    levels = keyed.hierarchy_by(store(points, "points"), "focal_id", ID, places=["owner_id", "x", "y"])
    about = [c for c in papers.columns if c != ID]
    placed = store(join_dealt(held, levels, [ID], rows).select(
        "focal_id", ID, *about, "owner_id", "x", "y", "coarse_id", "fine_id", "only_child"), "placed")
    own = placed.where(F.col("owner_id") == F.col("focal_id")).select(
        "focal_id", F.col(ID).alias("paper_id"), F.col("coarse_id").alias("cluster_id"), "year",
        F.col("citation_count").alias("citations"),
    )
    return placed, describe_hierarchy(placed, per="focal_id"), trajectory_edges(own)
