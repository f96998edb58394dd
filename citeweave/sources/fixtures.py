"""Bind the driver's TPC-H-style tables to the roles the analytics work on.

Roles (see FIXTURES.md part B): papers come from ``orders``, citations from a
``lineitem`` self join on (partkey, suppkey), subject codes from
``lineitem`` x ``part``, vectors from ``embeddings``, abstracts from
``documents``, titles from the ``<title>`` of ``pages``.  Every role is a lazy
DataFrame, so Catalyst prunes the columns and pushes the filters of the query
that uses it down to the Parquet scan.

Each builder has a twin SQL view in :mod:`citeweave.plans.fixture_sql` so the
DuckDB oracle sees the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.session import fits_broadcast

# Fixed binding parameters (the reference's journal set, removed article types and
# cut-off year, translated to the values present in the driver's tables).
FOCUS_JOURNALS = ["HIGH", "LOW", "URGENT"]
REMOVED_TYPES = ["P"]
MAX_YEAR = 1999
DOI_PREFIX = "10.1103/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def among(df: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """The rows of ``df`` whose ``key`` is an ``id`` of ``ids`` (all of them without ``ids``).  The ids are broadcast
    if their counted size is small."""
    if ids is None:
        return df
    few = ids.select(F.col("id").alias("_among"))
    few = F.broadcast(few) if fits_broadcast(few.count(), 16) else few
    return df.join(few, F.col(key) == F.col("_among"), "left_semi")


def vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` of every row that has a vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))


def journal_of_priority(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]", "")


def papers(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Paper metadata: id, doi, date, year, journal, article_type; with ``ids`` of these papers only."""
    o = among(table(spark, sf_dir, "orders"), "o_orderkey", ids)
    journal = journal_of_priority(F.col("o_orderpriority"))
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit(DOI_PREFIX), journal, F.lit("."), year.cast("string"), F.lit("."),
                 F.col("o_orderkey").cast("string")).alias("doi"),
        F.col("o_orderdate").alias("date"),
        year.cast("bigint").alias("year"),
        journal.alias("journal"),
        F.col("o_orderstatus").alias("article_type"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges by paper id: order A cites order B when both bought the same
    (part, supplier) and A is later.  Duplicates are kept (raw edge list)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    a = li.alias("a").join(o.alias("oa"), F.col("a.l_orderkey") == F.col("oa.o_orderkey"))
    b = li.alias("b").join(o.alias("ob"), F.col("b.l_orderkey") == F.col("ob.o_orderkey"))
    return (
        a.join(b, (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("a.l_suppkey") == F.col("b.l_suppkey")))
        .where(F.col("oa.o_orderdate") > F.col("ob.o_orderdate"))
        .select(F.col("a.l_orderkey").alias("citing"), F.col("b.l_orderkey").alias("cited"))
    )


def raw_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's raw edge list: ``citing_doi, cited_doi`` strings."""
    p = papers(spark, sf_dir).select("id", "doi")
    c = citations(spark, sf_dir)
    return (
        c.join(p.alias("pc"), F.col("citing") == F.col("pc.id"))
        .join(p.alias("pd"), F.col("cited") == F.col("pd.id"))
        .select(F.col("pc.doi").alias("citing_doi"), F.col("pd.doi").alias("cited_doi"))
    )


def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger graph for walks/spectral work: customer -> part, prefixed string ids."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
    )


def _part_code() -> Column:
    return F.concat(
        F.lpad(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), 2, "0"),
        F.lpad(F.col("p_size").cast("string"), 2, "0"),
        F.substring("p_type", 1, 1),
    )


def code_lines(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    pt = table(spark, sf_dir, "part").select("p_partkey", _part_code().alias("_part"))
    return among(li, "l_orderkey", ids).join(pt, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat("_part", "l_returnflag").alias("code")
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean 6-character subject codes: ``id, code`` (several rows per id, duplicates kept)."""
    return code_lines(spark, sf_dir).select("id", "code")


def dirty_codes(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The same codes disturbed the ways real subject-code fields are dirty."""
    c = F.col("code")
    dotted = F.concat(F.substring(c, 1, 2), F.lit("."), F.substring(c, 3, 2), F.lit("."), F.substring(c, 5, 2))
    m = F.col("line") % 7
    pacs = (
        F.when(m == 0, dotted)
        .when(m == 1, F.concat(F.lit("  "), c, F.lit(" ")))
        .when(m == 2, F.concat(c, F.lit(";"), c))
        .when(m == 3, F.concat(dotted, dotted))
        .when(m == 4, F.concat(F.lit("n"), c))
        .when(m == 5, F.concat(F.lit("1977PACS:"), c, F.lit(" and "), c))
        .otherwise(F.lit("bad"))
    )
    return code_lines(spark, sf_dir, ids).select("id", "line", pacs.alias("pacs"))


def dirty_codes_wide(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Raw wide code table ``doi, pacs1..pacs5`` (lines 1-5 of an order; smallest
    string when a (id, line) pair repeats); with ``ids`` of these papers only."""
    d = dirty_codes(spark, sf_dir, ids)
    wide = d.groupBy("id").agg(
        *[F.min(F.when(F.col("line") == i, F.col("pacs"))).alias(f"pacs{i}") for i in range(1, 6)]
    )
    p = papers(spark, sf_dir, ids).select("id", "doi")
    return wide.join(p, "id").select("doi", *[f"pacs{i}" for i in range(1, 6)])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper vectors ``doi, vec array<float>, label`` (paper = order with the same id)."""
    e = table(spark, sf_dir, "embeddings")
    p = papers(spark, sf_dir, vector_ids(spark, sf_dir)).select("id", "doi")
    return e.join(p, F.col("vec_id") == F.col("id")).select("doi", F.col("embedding").alias("vec"), "label")


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors keyed by their numeric id: ``id, vec, label``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between vectors of the same label: each id to its 1st..3rd previous id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    w = Window.partitionBy("label").orderBy("id")
    lagged = e.select("id", *[F.lag("id", s).over(w).alias(f"l{s}") for s in (1, 2, 3)])
    stacked = lagged.select(
        "id", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"l{s}").alias("cited")) for s in (1, 2, 3)])).alias("x")
    )
    return stacked.where(F.col("x.cited").isNotNull()).select(
        F.col("id").alias("citing"), F.col("x.cited").alias("cited"), F.col("x.s").cast("int").alias("s")
    )


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts ``doi, abstract`` from ``documents`` (document id = paper id)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = papers(spark, sf_dir, d.select(F.col("doc_id").alias("id"))).select("id", "doi")
    return d.join(p, F.col("doc_id") == F.col("id")).select("doi", F.col("text").alias("abstract"))


def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTML titles ``doi, title`` cut from the ``<title>`` element of ``pages``."""
    pg = table(spark, sf_dir, "pages").select("page_id", "html")
    p = papers(spark, sf_dir).select("id", "doi")
    return pg.join(p, F.col("page_id") == F.col("id")).select(
        "doi", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title")
    )
