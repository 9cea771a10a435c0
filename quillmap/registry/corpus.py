"""Queries on works, authors, sources and data quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

from quillmap import schemas
from quillmap.functions import text as tx
from quillmap.functions.scores import citation_size
from quillmap.operators import authors as au
from quillmap.operators import dedupe, quality, tiers
from quillmap.operators import works as wk
from quillmap.operators.embedding import embed_incremental, embed_texts
from quillmap.registry.base import Tables, query, r6
from quillmap.session import exact_rank, scratch_path, store
from quillmap.sources import alt_source, files, lakehouse, query_cache, snapshot
from quillmap.sources.gzip_lines import bad_files, open_folder, snapshot_lines, write_gzip
from quillmap.streaming.ingest import ingest_progress, ingest_stream, ingest_tables, ingested

WORK_COLUMNS = ["openalex_id", "field", "source_name", "type"]


@query("works_by_year", "fx_works", """
    SELECT publication_year, count(*) AS n FROM fx_works GROUP BY 1 ORDER BY 1 DESC LIMIT 10""")
def works_by_year(t: Tables) -> DataFrame:
    return quality.works_by_year(t.works)


@query("top_fields", "fx_works", """
    SELECT field, count(*) AS n FROM fx_works WHERE field <> '' GROUP BY 1 ORDER BY n DESC, field LIMIT 10""")
def top_fields(t: Tables) -> DataFrame:
    return quality.top_fields(t.works)


@query("works_by_type", "fx_works", """
    SELECT type, count(*) AS n FROM fx_works WHERE type <> '' GROUP BY 1 ORDER BY n DESC, type LIMIT 8""")
def works_by_type(t: Tables) -> DataFrame:
    return quality.works_by_type(t.works)


@query("distinct_authors", "fx_links", """
    SELECT count(*) AS n_links, count(DISTINCT author_id) AS n_authors FROM fx_links""")
def distinct_authors(t: Tables) -> DataFrame:
    return quality.distinct_authors(t.links)


@query("completeness", "fx_authorships", """
    SELECT column_name, filled, round(filled * 100.0 / total, 6) AS pct FROM (
        SELECT count(*) AS total, count(*) FILTER (WHERE author_name <> '') AS author_name,
               count(*) FILTER (WHERE orcid <> '') AS orcid,
               count(*) FILTER (WHERE institution <> '') AS institution FROM fx_authorships)
    UNPIVOT (filled FOR column_name IN (author_name, orcid, institution))""")
def completeness(t: Tables) -> DataFrame:
    return quality.completeness(t.authorships, ["author_name", "orcid", "institution"]).select(
        "column_name", "filled", *r6("pct"))


@query("verify_lakehouse", "fx_works fx_links", """
    SELECT 'year' AS metric, CAST(publication_year AS VARCHAR) AS key, CAST(n AS DOUBLE) AS value FROM (
        SELECT publication_year, count(*) AS n FROM fx_works GROUP BY 1 ORDER BY 1 DESC LIMIT 10)
    UNION ALL SELECT 'field', field, CAST(n AS DOUBLE) FROM (
        SELECT field, count(*) AS n FROM fx_works WHERE field <> '' GROUP BY 1 ORDER BY n DESC, field LIMIT 10)
    UNION ALL SELECT 'type', type, CAST(n AS DOUBLE) FROM (
        SELECT type, count(*) AS n FROM fx_works WHERE type <> '' GROUP BY 1 ORDER BY n DESC, type LIMIT 8)
    UNION ALL SELECT 'total', 'works', CAST(count(*) AS DOUBLE) FROM fx_works
    UNION ALL SELECT 'filled', 'title', CAST(count(*) FILTER (WHERE title <> '') AS DOUBLE) FROM fx_works
    UNION ALL SELECT 'filled', 'topic', CAST(count(*) FILTER (WHERE topic <> '') AS DOUBLE) FROM fx_works
    UNION ALL SELECT 'total', 'authorships', CAST(count(*) AS DOUBLE) FROM fx_links
    UNION ALL SELECT 'total', 'authors', CAST(count(DISTINCT author_id) AS DOUBLE) FROM fx_links
    UNION ALL SELECT 'spot', CAST(openalex_id AS VARCHAR), CAST(cited_by_count AS DOUBLE) FROM (
        SELECT openalex_id, cited_by_count FROM fx_works WHERE title <> '' AND cited_by_count > 400
        ORDER BY md5(CAST(openalex_id AS VARCHAR)), openalex_id LIMIT 3)""")
def verify_lakehouse(t: Tables) -> DataFrame:
    return quality.verify_lakehouse(t.works, t.links, ["title", "topic"], spot_citations=400)


@query("spot_check", "fx_works", """
    SELECT openalex_id, title, publication_year, cited_by_count, source_name, field FROM fx_works
    WHERE title <> '' AND cited_by_count > 400 ORDER BY md5(CAST(openalex_id AS VARCHAR)), openalex_id LIMIT 3""")
def spot_check(t: Tables) -> DataFrame:
    return wk.spot_check(t.works, 3, 400).select(
        "openalex_id", "title", "publication_year", "cited_by_count", "source_name", "field")


@query("rows_per_file", "", "SELECT 'orders.parquet' AS file, count(*) AS n_rows FROM orders")
def rows_per_file(t: Tables) -> DataFrame:
    name = F.regexp_extract("file", "([^/]+)$", 1)  # the folder differs from run to run
    return snapshot.rows_per_file(t.raw("orders")).select(name.alias("file"), "n_rows")


@query("db_stats", "fx_papers", """
    SELECT 'tier' AS metric, journal_tier AS key, count(*) AS n FROM fx_papers GROUP BY 2
    UNION ALL SELECT 'subfield', subfield, n FROM (
        SELECT subfield, count(*) AS n FROM fx_papers GROUP BY 1 ORDER BY n DESC, subfield LIMIT 20)
    UNION ALL SELECT 'total', 'papers', count(*) FROM fx_papers
    UNION ALL SELECT 'total', 'journals', count(DISTINCT journal) FROM fx_papers
    UNION ALL SELECT 'total', 'year_min', min(year) FROM fx_papers
    UNION ALL SELECT 'total', 'year_max', max(year) FROM fx_papers""")
def db_stats(t: Tables) -> DataFrame:
    return quality.db_stats(t.papers)


@query("top_journals", "fx_papers", """
    SELECT journal, journal_tier, count(*) AS n FROM fx_papers GROUP BY 1, 2 ORDER BY n DESC, journal LIMIT 20""")
def top_journals(t: Tables) -> DataFrame:
    return quality.top_journals(t.papers)


@query("journal_tier", "fx_papers", """
    SELECT journal_tier, journal, count(*) AS n, sum(CAST(citation_count AS BIGINT))::BIGINT AS citations
    FROM fx_papers GROUP BY 1, 2""")
def journal_tier(t: Tables) -> DataFrame:
    tiered = tiers.add_journal_tier(t.works, t.tiers)
    return tiered.groupBy("journal_tier", F.col("source_name").alias("journal")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cited_by_count").alias("citations"))


@query("build_search_table", "fx_papers", """
    SELECT openalex_id, title, '' AS abstract, year, citation_count, journal, '' AS doi, subfield, field,
           journal_tier FROM fx_papers WHERE type = 'article'""")
def build_search_table(t: Tables) -> DataFrame:
    return lakehouse.search_table(tiers.add_journal_tier(t.works, t.tiers))


@query("filter_high_impact", "fx_works", """
    SELECT openalex_id, title, field, cited_by_count FROM fx_works
    WHERE type = 'article' AND cited_by_count >= 400 AND field <> '' AND title <> ''""")
def filter_high_impact(t: Tables) -> DataFrame:
    return wk.filter_high_impact(t.works, 400).select("openalex_id", "title", "field", "cited_by_count")


@query("filter_landscape", "fx_papers", """
    SELECT openalex_id, year, citation_count, field FROM fx_papers
    WHERE year BETWEEN 1996 AND 1999 AND citation_count >= 250 AND field IN ('ASIA', 'EUROPE')""")
def filter_landscape(t: Tables) -> DataFrame:
    return wk.filter_landscape(t.papers, (1996, 1999), 250, ["ASIA", "EUROPE"], label="field").select(
        "openalex_id", "year", "citation_count", "field")


@query("export_subset", "fx_papers", """
    SELECT openalex_id, year, citation_count, journal_tier, subfield, subfield AS streams FROM fx_papers
    WHERE journal_tier IN ('Tier1', 'Tier2') AND citation_count > 300""")
def export_subset(t: Tables) -> DataFrame:
    return wk.export_subset(t.papers, ["Tier1", "Tier2"], 300).select(
        "openalex_id", "year", "citation_count", "journal_tier", "subfield", "streams")


@query("find_authors", "fx_authors fx_links fx_papers", """
    SELECT a.author_id, a.name, a.institution, a.paper_count, a.total_citations,
           b.top_paper_id, b.top_paper_title, b.top_paper_citations
    FROM (SELECT * FROM fx_authors WHERE lower(name) LIKE '%ring%' AND paper_count >= 2
          ORDER BY total_citations DESC, author_id LIMIT 10) a
    LEFT JOIN (SELECT * FROM (
        SELECT l.author_id, p.openalex_id AS top_paper_id, p.title AS top_paper_title,
               p.citation_count AS top_paper_citations,
               row_number() OVER (PARTITION BY l.author_id ORDER BY p.citation_count DESC, p.openalex_id) AS rk
        FROM fx_links l JOIN fx_papers p ON p.openalex_id = l.paper_id) WHERE rk = 1) b
    ON a.author_id = b.author_id""")
def find_authors(t: Tables) -> DataFrame:
    return au.find_authors(t.authors, " Ring ", t.links, t.papers).select(
        "author_id", "name", "institution", "paper_count", "total_citations",
        "top_paper_id", "top_paper_title", "top_paper_citations")


@query("conform", "fx_docs", """
    SELECT CAST(openalex_id AS VARCHAR) AS openalex_id, title, 0.0::DOUBLE AS x, -1 AS cluster_id,
           'Unknown' AS cluster_label, '' AS doi, cited_by_count AS citation_count, publication_year AS year
    FROM fx_docs""")
def conform(t: Tables) -> DataFrame:
    held = t.docs.select("openalex_id", "title", F.col("cited_by_count").alias("citation_count"),
                         F.col("publication_year").alias("year"))
    out = schemas.conform(held, schemas.DATASET_DEFAULTS, schemas.DATASET_TEXT)
    return out.select("openalex_id", "title", "x", "cluster_id", "cluster_label", "doi", "citation_count", "year")


@query("text_scalars", "fx_docs", r"""
    SELECT openalex_id,
           CASE WHEN abstract <> '' THEN title || '. ' || abstract ELSE title END AS composed,
           CASE WHEN length(abstract) > 300 THEN substring(abstract, 1, 300) || '...' ELSE abstract END AS short,
           trim(regexp_replace(regexp_replace(regexp_replace(
               '(' || title || ') AND (' || source_name || ' or b)', '[()]', '', 'g'),
               '\b(and|or)\b', ' ', 'gi'), '\s+', ' ', 'g')) AS cleaned,
           'https://doi.org/' || '10.5/' || CAST(openalex_id AS VARCHAR) AS doi,
           substring(md5(language || '|' || title || '|' || source_name), 1, 12) AS key
    FROM fx_docs""")
def text_scalars(t: Tables) -> DataFrame:
    raw_keyword = F.concat(F.lit("("), F.col("title"), F.lit(") AND ("), F.col("source_name"), F.lit(" or b)"))
    return t.docs.select(
        "openalex_id",
        tx.compose_text(F.col("title"), F.col("abstract")).alias("composed"),
        tx.truncate_text(F.col("abstract")).alias("short"),
        tx.clean_keyword(raw_keyword).alias("cleaned"),
        tx.doi_url(F.concat(F.lit("10.5/"), F.col("openalex_id").cast("string"))).alias("doi"),
        tx.cache_key(F.col("language"), F.col("title"), F.col("source_name")).alias("key"),
    )


@query("author_names_and_tags", "fx_authorships", """
    SELECT paper_id, array_to_string((list(author_name ORDER BY position))[1:10], '; ') AS authors
    FROM fx_authorships GROUP BY paper_id""")
def author_names_and_tags(t: Tables) -> DataFrame:
    # the list of one paper's names is an input column of the operator; a record holds it whole
    names = t.authorships.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "author_name"))).alias("a"))
    joined = names.select("paper_id", tx.author_list(F.transform("a", lambda x: x["author_name"])).alias("authors"))
    return joined.select("paper_id", F.array_join(tx.split_tags(F.col("authors")), "; ").alias("authors"))


@query("citation_size", "fx_works", """
    SELECT openalex_id, round(ln(1 + cited_by_count) / greatest(1.0, ln(1 + (SELECT max(cited_by_count) FROM fx_works))) * 25 + 4, 6) AS size
    FROM fx_works""")
def citation_sizes(t: Tables) -> DataFrame:
    top = t.works.agg(F.max("cited_by_count").alias("m")).scalar()
    return t.works.select("openalex_id", F.round(citation_size(F.col("cited_by_count"), top, 25.0, 4.0), 6).alias("size"))


# --- nested records ---------------------------------------------------------------------------

RAW_FROM = """
    SELECT w.openalex_id, w.title, w.publication_year, w.type, w.cited_by_count, w.source_name, w.field,
           w.subfield, w.topic, d.abstract
    FROM fx_works w LEFT JOIN fx_docs d ON w.openalex_id = d.openalex_id"""


def _index_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: id and words to id and the map of each word to its positions, sorted by word; null without words."""
    for batch in batches:
        words = batch.column(1)
        starts = words.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        row = np.repeat(np.arange(len(words)), np.diff(starts))
        found = words.flatten().dictionary_encode()
        place = np.empty(len(found.dictionary), np.int64)
        place[pc.sort_indices(found.dictionary).to_numpy()] = np.arange(len(place))
        key = row * max(len(place), 1) + place[found.indices.to_numpy()]
        order = np.argsort(key, kind="stable")  # equal words of a row stay in order of position
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        at = (np.arange(len(row)) - starts[row])[order]
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(at, pa.int32()))
        tokens = found.dictionary.take(found.indices.take(pa.array(order[first])))
        ends = np.searchsorted(row[order][first], np.arange(len(words) + 1))
        offsets = pa.array(ends, pa.int32(), mask=np.append(np.diff(starts) == 0, False))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.MapArray.from_arrays(offsets, tokens, lists)], names=["openalex_id", "index"])


def inverted_indexes(docs: DataFrame) -> DataFrame:
    """(openalex_id, index): token -> positions of each abstract."""
    words = docs.select("openalex_id", tx.tokens(F.col("abstract")).alias("words"))
    return words.mapInArrow(_index_words, "openalex_id bigint, index map<string, array<int>>")


def _index_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for whole rows: their column ``words`` becomes ``index``."""
    for batch in batches:
        found = next(_index_words(iter([batch.select(["openalex_id", "words"])])))
        rest = [c for c in batch.schema.names if c != "words"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found.column(1)], names=[*rest, "index"])


def raw_lines(t: Tables) -> DataFrame:
    """(openalex_id, value): works, documents and authorships nested into one JSON line per work."""
    people = t.authorships.groupBy(F.col("paper_id").alias("openalex_id")).agg(
        F.sort_array(F.collect_list(F.struct("position", "author_id", "author_name", "orcid", "institution"))).alias("people"))
    name = lambda c: F.struct(c.alias("display_name"))
    person = lambda a: F.struct(
        F.when(a["position"] == 0, "first").otherwise("middle").alias("author_position"),
        (a["position"] == 0).alias("is_corresponding"),
        F.struct(
            F.when(a["author_id"] > 0, F.concat(F.lit("A"), a["author_id"].cast("string"))).alias("id"),
            a["author_name"].alias("display_name"),
            F.when(a["orcid"] != "", a["orcid"]).alias("orcid")).alias("author"),
        F.when(a["institution"] != "", F.array(name(a["institution"]))).otherwise(
            F.array().cast("array<struct<display_name:string>>")).alias("institutions"))
    work = F.struct(
        F.concat(F.lit("W"), F.col("openalex_id").cast("string")).alias("id"),
        "title", "publication_year", "type", "cited_by_count",
        F.col("index").alias("abstract_inverted_index"),
        F.transform(F.slice("people", -1, 1), lambda a: F.concat(F.lit("A"), a["author_id"].cast("string"))).alias("corresponding_author_ids"),
        F.struct(F.struct(F.col("source_name").alias("display_name")).alias("source")).alias("primary_location"),
        F.struct(F.col("topic").alias("display_name"), name(F.col("subfield")).alias("subfield"), name(F.col("field")).alias("field")).alias("primary_topic"),
        F.array(F.struct(name(F.col("subfield")).alias("subfield")), F.struct(name(F.col("field")).alias("subfield"))).alias("topics"),
        F.transform("people", person).alias("authorships"),
    )
    # texts are shuffled as they are; indexes are larger, and arise where the rows are
    rows = t.works.join(t.docs.select("openalex_id", "abstract"), "openalex_id", "left").join(people, "openalex_id", "left")
    rows = rows.withColumn("words", tx.tokens(F.col("abstract"))).drop("abstract")
    kind = StructType([f for f in rows.schema.fields if f.name != "words"]).add("index", MapType(StringType(), ArrayType(IntegerType())))
    return rows.mapInArrow(_index_column, kind).select("openalex_id", F.to_json(work).alias("value"))


def raw_works(t: Tables) -> DataFrame:
    return snapshot.parse_works(raw_lines(t).select("value"))


REBUILT = r"array_to_string(regexp_extract_all(lower(strip_accents(d.abstract)), '[\p{L}\p{N}]+'), ' ')"
FLAT = f"""
    SELECT 'W' || CAST(w.openalex_id AS VARCHAR) AS openalex_id, w.title, coalesce({REBUILT}, '') AS abstract,
           w.publication_year, w.type, w.cited_by_count, w.source_name, w.field, w.subfield, w.topic,
           coalesce(t.tier, 'Other') AS journal_tier, false AS is_retracted, '' AS doi
    FROM fx_works w LEFT JOIN fx_docs d ON w.openalex_id = d.openalex_id
    LEFT JOIN fx_tiers t ON lower(trim(w.source_name)) = t.name"""
FLAT_COLUMNS = ["openalex_id", "title", "abstract", "publication_year", "type", "cited_by_count", "source_name",
                "field", "subfield", "topic", "journal_tier", "is_retracted", "doi"]


@query("project_works", "fx_works fx_docs fx_tiers", FLAT)
def project_works(t: Tables) -> DataFrame:
    return wk.project_works(raw_works(t), t.tiers).select(*FLAT_COLUMNS)


@query("project_papers", "fx_works fx_docs fx_authorships", f"""
    SELECT 'W' || CAST(w.openalex_id AS VARCHAR) AS openalex_id, w.title, coalesce({REBUILT}, '') AS abstract,
           w.cited_by_count AS citation_count, w.publication_year AS year, w.source_name AS journal,
           coalesce(a.authors, '') AS authors, 'all' AS streams
    FROM fx_works w LEFT JOIN fx_docs d ON w.openalex_id = d.openalex_id
    LEFT JOIN (SELECT paper_id, array_to_string((list(author_name ORDER BY position))[1:10], '; ') AS authors
               FROM fx_authorships GROUP BY 1) a ON a.paper_id = w.openalex_id""")
def project_papers(t: Tables) -> DataFrame:
    return wk.project_papers(raw_works(t), "all").drop("doi", "openalex_url")


@query("explode_authorships", "fx_authorships", """
    SELECT 'W' || CAST(paper_id AS VARCHAR) AS paper_id, 'A' || CAST(author_id AS VARCHAR) AS author_id, author_name,
           orcid, CASE WHEN position = 0 THEN 'first' ELSE 'middle' END AS position,
           position = 0 OR position = max(position) OVER (PARTITION BY paper_id) AS is_corresponding,
           institution, position AS ordinal
    FROM fx_authorships QUALIFY author_id > 0""")
def explode_authorships(t: Tables) -> DataFrame:
    return wk.explode_authorships(raw_works(t)).drop("publication_year")


@query("paper_author_links", "fx_authorships", """
    SELECT 'W' || CAST(paper_id AS VARCHAR) AS paper_id, 'A' || CAST(author_id AS VARCHAR) AS author_id,
           position FROM fx_authorships WHERE author_id > 0""")
def paper_author_links(t: Tables) -> DataFrame:
    return wk.paper_author_links(wk.explode_authorships(raw_works(t)))


@query("match_subfield", "fx_works", """
    SELECT 'W' || CAST(openalex_id AS VARCHAR) AS id,
           CASE WHEN subfield IN ('NATION_3', 'NATION_7') THEN subfield WHEN field = 'ASIA' THEN field ELSE '' END AS matched_subfield
    FROM fx_works""")
def match_subfield(t: Tables) -> DataFrame:
    return wk.match_subfield(raw_works(t), ["nation_3", "Nation_7", "asia"]).select("id", "matched_subfield")


@query("filter_subject", "fx_works fx_docs", f"""
    SELECT * FROM (
        SELECT 'W' || CAST(w.openalex_id AS VARCHAR) AS openalex_id, coalesce({REBUILT}, '') AS abstract,
               w.cited_by_count AS citation_count, w.publication_year AS year, w.subfield,
               CASE WHEN subfield IN ('NATION_3', 'NATION_7') THEN subfield WHEN field = 'ASIA' THEN field ELSE '' END AS matched_subfield
        FROM fx_works w LEFT JOIN fx_docs d ON w.openalex_id = d.openalex_id
        WHERE w.type = 'article' AND w.publication_year BETWEEN 1996 AND 2000)
    WHERE matched_subfield <> '' AND length(abstract) >= 50""")
def filter_subject(t: Tables) -> DataFrame:
    found = wk.filter_subject(raw_works(t), ["nation_3", "Nation_7", "asia"], 1996, 2000)
    return found.select("openalex_id", "abstract", "citation_count", "year", "subfield", "matched_subfield")


@query("rebuild_abstract", "fx_docs", r"""
    SELECT openalex_id, array_to_string(regexp_extract_all(lower(strip_accents(abstract)), '[\p{L}\p{N}]+'), ' ') AS abstract
    FROM fx_docs""")
def rebuild_abstract(t: Tables) -> DataFrame:
    index = inverted_indexes(t.docs)
    return index.select("openalex_id", tx.rebuild_abstract(F.col("index")).alias("abstract"))


@query("bad_records", "fx_works", """
    SELECT '{"id": "W' || CAST(openalex_id AS VARCHAR) || '", "title": ' AS value FROM fx_works""")
def bad_records(t: Tables) -> DataFrame:
    # every line twice: whole, and cut in the middle of the object
    cut = t.works.select(F.concat(F.lit('{"id": "W'), F.col("openalex_id").cast("string"), F.lit('", "title": ')).alias("value"))
    whole = t.works.select(F.concat(F.lit('{"id": "W'), F.col("openalex_id").cast("string"), F.lit('"}')).alias("value"))
    return snapshot.bad_lines(cut.unionByName(whole))


@query("ingest_stream", "fx_works fx_docs fx_tiers", FLAT)
def ingest(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "ingest")
    raw_lines(t).select("value").write.option("compression", "gzip").text(f"{base}/in/first")
    project = lambda raw: wk.project_works(raw, t.tiers)
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(t.spark, f"{base}/in", f"{base}/out", f"{base}/state", 4, "openalex_id", project).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select(*FLAT_COLUMNS)


# six files of records, every tenth followed by half a record; the last file breaks off after half of its lines
PLACED = """placed AS (
        SELECT *, id % 6 AS f, row_number() OVER (PARTITION BY id % 6 ORDER BY id, seq) AS line_no, count(*) OVER (PARTITION BY id % 6) AS n
        FROM (SELECT openalex_id AS id, 0 AS seq FROM fx_works UNION ALL SELECT openalex_id, 1 FROM fx_works WHERE openalex_id % 10 = 3)),
    held AS (SELECT * FROM placed WHERE f < 5 OR line_no <= n // 2)"""
WHOLE_IDS = "SELECT 'W' || CAST(id AS VARCHAR) FROM held WHERE seq = 0"


def snapshot_folder(t: Tables) -> str:
    """The records as a folder of compressed files, with malformed lines and a file that breaks off."""
    whole = raw_lines(t).select(F.col("openalex_id").cast("long").alias("id"), F.lit(0).alias("seq"), "value")
    half = t.works.where("openalex_id % 10 = 3").select(
        F.col("openalex_id").alias("id"), F.lit(1).alias("seq"),
        F.concat(F.lit('{"id": "W'), F.col("openalex_id").cast("string"), F.lit('", "title": ')).alias("value"))
    placed = whole.unionByName(half).withColumn("f", (F.col("id") % 6).cast("int")).where(F.col("f").isNotNull())
    # the lines are made once; counting and cutting read their keys alone
    path = scratch_path(t.spark, "lines")
    placed.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = t.spark.read.parquet(path)
    order = ["id", "seq", "_row"]
    last = rows.where("f = 5")
    ranked = exact_rank(last.select(*order), [], [F.col(c) for c in order], "line_no")
    end = ranked.where(F.col("line_no") == last.count() // 2).select(*order).first()
    kinds = dict(rows.dtypes)
    before = F.struct(*order) <= F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, end)]) if end else F.lit(False)
    folder = scratch_path(t.spark, "snapshot")
    write_gzip(rows.where((F.col("f") != 5) | before), folder, [5], order)
    system, own, _ = open_folder(path)
    system.delete_dir(own)  # every line is in the files now
    return folder


def ingest_all(t: Tables) -> str:
    """All tables of one snapshot folder, in batches of four files, run twice."""
    source, base = snapshot_folder(t), scratch_path(t.spark, "tables")
    for _ in range(2):  # the second run finds nothing new
        ingest_tables(t.spark, source, f"{base}/out", f"{base}/state", 4, True, t.tiers).awaitTermination()
    return f"{base}/out"


@query("read_snapshot", "fx_works fx_docs fx_tiers", f"""
    SELECT * FROM (WITH {PLACED} SELECT * FROM ({FLAT}) WHERE openalex_id IN ({WHOLE_IDS}))""")
def read_snapshot(t: Tables) -> DataFrame:
    works = snapshot.parse_works(snapshot_lines(t.spark, snapshot_folder(t)).where(F.col("error").isNull()))
    return wk.project_works(works, t.tiers).select(*FLAT_COLUMNS)


@query("bad_files", "fx_works", f"""
    SELECT * FROM (WITH {PLACED} SELECT 'part5.gz' AS file, count(*) AS n_lines, 'EOFError' AS error FROM held WHERE f = 5)""")
def broken_files(t: Tables) -> DataFrame:
    return bad_files(snapshot_lines(t.spark, snapshot_folder(t))).select(
        F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "n_lines", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


@query("ingest_works", "fx_works fx_docs fx_tiers", f"""
    SELECT * FROM (WITH {PLACED} SELECT * FROM ({FLAT}) WHERE openalex_id IN ({WHOLE_IDS}))""")
def ingest_works(t: Tables) -> DataFrame:
    return ingested(t.spark, ingest_all(t), "works").select(*FLAT_COLUMNS)


@query("ingest_authorships", "fx_works fx_authorships", f"""
    SELECT * FROM (WITH {PLACED} SELECT * FROM (
        SELECT 'W' || CAST(paper_id AS VARCHAR) AS paper_id, 'A' || CAST(author_id AS VARCHAR) AS author_id, author_name,
               orcid, CASE WHEN position = 0 THEN 'first' ELSE 'middle' END AS position,
               position = 0 OR position = max(position) OVER (PARTITION BY paper_id) AS is_corresponding,
               institution, position AS ordinal
        FROM fx_authorships QUALIFY author_id > 0) WHERE paper_id IN ({WHOLE_IDS}))""")
def ingest_authorships(t: Tables) -> DataFrame:
    return ingested(t.spark, ingest_all(t), "authorships").drop("publication_year", "batch")


@query("ingest_bad_lines", "fx_works", f"""
    SELECT * FROM (WITH {PLACED}
        SELECT 'part' || CAST(f AS VARCHAR) || '.gz' AS file, line_no, '{{"id": "W' || CAST(id AS VARCHAR) || '", "title": ' AS value,
               CAST(NULL AS VARCHAR) AS error FROM held WHERE seq = 1
        UNION ALL SELECT 'part5.gz', count(*), NULL, 'EOFError' FROM held WHERE f = 5)""")
def ingest_bad_lines(t: Tables) -> DataFrame:
    rows = ingested(t.spark, ingest_all(t), "bad_lines")
    return rows.select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "line_no", "value", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


@query("ingest_progress", "fx_works fx_authorships", f"""
    SELECT * FROM (WITH {PLACED}
        SELECT 'lines' AS metric, '' AS key, count(*) AS value FROM held
        UNION ALL SELECT 'bad_lines', '', count(*) FROM held WHERE seq = 1
        UNION ALL SELECT 'bad_files', '', 1
        UNION ALL SELECT 'works', '', count(*) FROM held WHERE seq = 0
        UNION ALL SELECT 'authorships', '', count(*) FROM fx_authorships a JOIN held h ON h.id = a.paper_id AND h.seq = 0 WHERE a.author_id > 0
        UNION ALL SELECT 'year', CAST(w.publication_year AS VARCHAR), count(*) FROM fx_works w JOIN held h ON h.id = w.openalex_id AND h.seq = 0 GROUP BY 2)""")
def progress_of_ingest(t: Tables) -> DataFrame:
    return ingest_progress(t.spark, ingest_all(t))


# --- duplicates, totals, caches ---------------------------------------------------------------


@query("dedupe_papers", "fx_docs", """
    SELECT openalex_id, language || '; ' || source_name AS streams, cited_by_count + 1 AS citation_count,
           title, publication_year AS year FROM fx_docs""")
def dedupe_papers(t: Tables) -> DataFrame:
    first = t.docs.select("openalex_id", "title", F.col("publication_year").alias("year"),
                          F.col("source_name").alias("streams"), F.col("cited_by_count").alias("citation_count"), F.lit(0).alias("seq"))
    second = t.docs.select("openalex_id", F.lit("later").alias("title"), F.lit(0).alias("year"),
                           F.col("language").alias("streams"), (F.col("cited_by_count") + 1).alias("citation_count"), F.lit(1).alias("seq"))
    return dedupe.dedupe_papers(second.unionByName(first), [F.col("seq")]).drop("seq")


@query("dedupe_authors", "fx_authorships fx_works", """
    SELECT a.author_id, arg_min(a.author_name, {'y': w.publication_year, 'p': a.paper_id}) AS name,
           arg_min(a.orcid, {'y': w.publication_year, 'p': a.paper_id}) FILTER (WHERE a.orcid <> '') AS orcid
    FROM fx_authorships a JOIN fx_works w ON a.paper_id = w.openalex_id GROUP BY 1""")
def dedupe_authors(t: Tables) -> DataFrame:
    years = t.works.select(F.col("openalex_id").alias("paper_id"), "publication_year")
    return dedupe.dedupe_authors(t.authorships.join(years, "paper_id"), [F.col("publication_year"), F.col("paper_id")])


@query("author_profiles", "fx_authorships", """
    SELECT author_id, arg_min(author_name, {'b': CAST(institution = '' AS INT), 'p': paper_id}) AS name,
           arg_min(institution, {'b': CAST(institution = '' AS INT), 'p': paper_id}) AS institution
    FROM fx_authorships GROUP BY 1""")
def author_profiles(t: Tables) -> DataFrame:
    return dedupe.author_profiles(t.authorships, [F.col("paper_id")])


@query("dedupe_by_priority", "fx_authorships", """
    SELECT paper_id, author_id, position FROM fx_authorships
    QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY position DESC) = 1""")
def dedupe_by_priority(t: Tables) -> DataFrame:
    return dedupe.dedupe_by_priority(t.authorships, ["paper_id"], [F.desc("position")]).select("paper_id", "author_id", "position")


@query("author_totals", "fx_authors", "SELECT author_id, paper_count, total_citations FROM fx_authors")
def author_totals(t: Tables) -> DataFrame:
    people = t.raw("part").select(F.col("p_partkey").alias("author_id"))
    return au.author_totals(t.papers, t.links, people)


@query("top_authors", "fx_authors", """
    SELECT author_id, paper_count, total_citations FROM fx_authors ORDER BY total_citations DESC, author_id LIMIT 10""")
def top_authors(t: Tables) -> DataFrame:
    return au.top_authors(au.author_totals(t.papers, t.links))


@query("active_authors", "fx_authors", "SELECT author_id, paper_count FROM fx_authors WHERE paper_count >= 30")
def active_authors(t: Tables) -> DataFrame:
    return au.active_authors(au.author_totals(t.papers, t.links), 30).select("author_id", "paper_count")


@query("restrict_to_papers", "fx_works fx_docs", """
    SELECT openalex_id, title FROM fx_works WHERE openalex_id IN (SELECT openalex_id FROM fx_docs)""")
def restrict_to_papers(t: Tables) -> DataFrame:
    return wk.restrict_to_papers(t.works, t.docs).select("openalex_id", "title")


@query("incremental_queries", "", """
    SELECT 'hit' AS part, d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'miss', d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def incremental_queries(t: Tables) -> DataFrame:
    asked = t.raw("documents").select("doc_id", F.lit("2000").alias("year_min"))
    cache = t.raw("labels").select("doc_id", F.lit(2000).alias("year_min"))
    hits, misses = query_cache.incremental_queries(asked, cache, ["doc_id"], ["year_min"])
    return query_cache.merge_results(
        hits.select(F.lit("hit").alias("part"), "doc_id"), misses.select(F.lit("miss").alias("part"), "doc_id"))


@query("embed_incremental", "", """
    SELECT d.doc_id, 'hashing' AS model, 64 AS dim, md5(d.text) AS text_hash FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def embed_new(t: Tables) -> DataFrame:
    docs = t.raw("documents").select("doc_id", "text")
    done = docs.join(t.raw("labels"), "doc_id", "left_semi")
    existing = embed_texts(done, "doc_id", "text").select("doc_id", "model", "text_hash")
    return embed_incremental(docs, "doc_id", "text", existing).select("doc_id", "model", "dim", "text_hash")


@query("normalize_alt_source", "fx_docs", """
    SELECT 's2:' || CAST(openalex_id AS VARCHAR) AS openalex_id, title, abstract, cited_by_count AS citation_count,
           publication_year AS year, source_name AS journal, 'https://doi.org/10.1/' || CAST(openalex_id AS VARCHAR) AS doi,
           'first ' || language || '; second ' || language AS authors, 'alt' AS streams
    FROM fx_docs WHERE abstract <> '' AND source_name IN (SELECT source_name FROM fx_docs WHERE language = 'de')""")
def normalize_alt_source(t: Tables) -> DataFrame:
    record = F.struct(
        F.col("openalex_id").cast("string").alias("paperId"), "title", "abstract",
        F.col("cited_by_count").alias("citationCount"), F.col("publication_year").alias("year"),
        F.struct(F.col("source_name").alias("name")).alias("journal"),
        F.array(*[F.struct(F.concat(F.lit(f"{w} "), F.col("language")).alias("name")) for w in ("first", "second")]).alias("authors"),
        F.struct(F.concat(F.lit("10.1/"), F.col("openalex_id").cast("string")).alias("DOI")).alias("externalIds"))
    lines = t.docs.select(F.to_json(record).alias("value"))
    parsed = lines.select(F.from_json("value", schemas.RAW_ALT).alias("r")).select("r.*")
    common = t.docs.where(F.col("language") == "de").select(F.upper("source_name").alias("name"))
    return alt_source.normalize_alt_source(parsed, "alt", common)


@query("resolve_sources", "fx_works", """
    SELECT DISTINCT p_brand AS name, arg_min(p_partkey, {'e': CAST(p_brand <> shown AS INT), 's': -p_size, 'k': p_partkey}) AS source_id
    FROM (SELECT b.p_brand, p.p_partkey, p.p_size, CASE WHEN p.p_size > 25 THEN upper(p.p_brand) ELSE p.p_brand END AS shown
          FROM (SELECT DISTINCT p_brand FROM part) b JOIN part p ON p.p_brand = b.p_brand) GROUP BY p_brand""")
def resolve_sources(t: Tables) -> DataFrame:
    part = t.raw("part")
    shown = F.when(F.col("p_size") > 25, F.upper("p_brand")).otherwise(F.col("p_brand"))
    sources = part.select(F.col("p_partkey").alias("source_id"), shown.alias("source_name"), F.col("p_size").alias("works_count"))
    return alt_source.resolve_sources(part.select(F.col("p_brand").alias("name")), sources).select("name", "source_id")


@query("mark_user_papers", "fx_docs", """
    SELECT d.openalex_id, (d.openalex_id IN (SELECT doc_id FROM labels WHERE quality = 1)
        OR lower(d.title) IN (SELECT lower(x.title) FROM fx_docs x JOIN labels l ON l.doc_id = x.openalex_id
                              WHERE l.toxic = 1 AND x.title <> '')) AS is_mine
    FROM fx_docs d""")
def mark_user_papers(t: Tables) -> DataFrame:
    doi = lambda c: F.concat(F.lit("10.1/X"), c.cast("string"))
    papers = t.docs.withColumn("doi", doi(F.col("openalex_id")))
    mine = papers.join(t.raw("labels").withColumnRenamed("doc_id", "openalex_id"), "openalex_id").select(
        F.when(F.col("quality") == 1, F.lower("doi")).alias("doi"),
        F.when(F.col("toxic") == 1, F.upper("title")).alias("title"))
    return alt_source.mark_user_papers(papers, mine).select("openalex_id", "is_mine")


@query("bibtex_lines", "fx_papers", """
    SELECT CAST(position AS BIGINT) AS position, '@article{' || k || CAST(year AS VARCHAR) || '_' || CAST(position AS VARCHAR) || ',' || chr(10)
        || '  title = {' || title || '},' || chr(10) || '  author = {' || a || '},' || chr(10)
        || '  journal = {' || journal || '},' || chr(10) || '  year = {' || CAST(year AS VARCHAR) || '},' || chr(10)
        || '  doi = {},' || chr(10) || '}' AS entry
    FROM (SELECT *, 'Ann ' || topic || '; Bo Li' AS a, split_part(topic, ' ', -1) AS k,
                 row_number() OVER (ORDER BY citation_count DESC, openalex_id) - 1 AS position FROM fx_papers)""")
def bibtex_lines(t: Tables) -> DataFrame:
    papers = t.papers.withColumn("authors", F.concat(F.lit("Ann "), F.col("topic"), F.lit("; Bo Li"))).withColumn("doi", F.lit(""))
    return files.bibtex_lines(papers, [F.desc("citation_count"), F.col("openalex_id")])


@query("author_papers", "fx_links fx_papers fx_focals", """
    SELECT l.author_id, p.openalex_id, p.title, p.citation_count FROM fx_links l
    JOIN fx_papers p ON p.openalex_id = l.paper_id""")
def author_papers(t: Tables) -> DataFrame:
    return au.author_papers(t.links, t.papers).select("author_id", "openalex_id", "title", "citation_count")


@query("top_paper_per_author", "fx_links fx_papers", """
    SELECT l.author_id, p.openalex_id, p.citation_count FROM fx_links l JOIN fx_papers p ON p.openalex_id = l.paper_id
    QUALIFY row_number() OVER (PARTITION BY l.author_id ORDER BY p.citation_count DESC, p.openalex_id) = 1""")
def top_paper_per_author(t: Tables) -> DataFrame:
    return au.top_paper_per_author(au.author_papers(t.links, t.papers)).select("author_id", "openalex_id", "citation_count")


@query("author_texts", "fx_links fx_works fx_docs", """
    SELECT author_id, CAST(floor((rk - 1) / 5) AS INT) AS chunk, count(*) AS n_papers, string_agg(part, ' ' ORDER BY rk) AS text FROM (
        SELECT l.author_id, w.title || '. ' || substring(coalesce(d.abstract, ''), 1, 300) AS part,
               row_number() OVER (PARTITION BY l.author_id ORDER BY w.cited_by_count DESC, w.openalex_id) AS rk
        FROM fx_links l JOIN fx_works w ON w.openalex_id = l.paper_id LEFT JOIN fx_docs d ON d.openalex_id = w.openalex_id)
    GROUP BY 1, 2""")
def author_texts(t: Tables) -> DataFrame:
    texts = t.papers.join(t.docs.select("openalex_id", "abstract"), "openalex_id", "left")
    return au.author_texts(t.links, texts, chunk_papers=5)
