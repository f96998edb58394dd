"""Sources/sinks, text, profiles, set operations and simple graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions.columns import cantor_pair, cantor_unpair, hash_sql, non_blank, safe_log, uniform_sql
from citeweave.operators import clean, graph as G, relate
from citeweave.operators.sample import sample_fraction, sample_n, with_hash_rank
from citeweave.plans.fixture_sql import with_views
from citeweave.plans.q_core import network, pacs
from citeweave.plans.registry import register
from citeweave.plans.sqlparts import clean_codes_views, network_views, strip_ws
from citeweave.session import scratch_table_path
from citeweave.sources import fixtures as fx
from citeweave.sources import io as sio


def R6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- text
@register("text_nonblank", "J2 P8 P10", with_views(
    "SELECT p.doi, a.abstract FROM papers p LEFT JOIN abstracts a ON p.doi = a.doi WHERE a.abstract IS NOT NULL AND a.abstract <> ''",
    "papers", "abstracts"))
def q_text_nonblank(spark, d):
    texts = {"abstract": fx.abstracts(spark, d), "title": fx.raw_titles(spark, d)}
    return clean.choose_text(fx.papers(spark, d).select("doi"), texts, "ABSTRACT")


# The references that the driver's pages hold, for SQL; the operator knows all of HTML 5.
FIXTURE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", chr(160)), ("&copy;", chr(169)),
                    ("&middot;", chr(183)), ("&amp;", "&")]


def _html_sql(c: str) -> str:
    s = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    s = f"regexp_replace({s}, '<![^>]*>', '', 'g')"
    s = (f"regexp_replace({s}, '(?s)<script[^>]*>(.*?)</script\\s*>|<style[^>]*>(.*?)</style\\s*>|<[^>]*>', "
         f"'\\1\\2', 'g')")
    for ent, ch in FIXTURE_ENTITIES:
        s = f"replace({s}, '{ent}', '{ch}')"
    s = f"replace({s}, '/emph>', '')"
    return strip_ws(s)


@register("html_clean", "P9 P8", f"SELECT page_id, {_html_sql('html')} AS text FROM pages WHERE html IS NOT NULL AND html <> ''")
def q_html_clean(spark, d):
    pg = fx.table(spark, d, "pages").select("page_id", "html")
    return clean.clean_text(pg, "html", "text", mode="sql").select("page_id", "text")


@register("html_parse", "P9", f"SELECT page_id, {_html_sql('html')} AS text FROM pages WHERE html IS NOT NULL AND html <> ''")
def q_html_parse(spark, d):
    """The same by a real HTML tokenizer, for markup that regular expressions cannot follow."""
    pg = fx.table(spark, d, "pages").select("page_id", "html")
    return clean.clean_text(pg, "html", "text", mode="parser").select("page_id", "text")


@register("title_clean", "P9 P10 J17", with_views(
    f"SELECT doi, {_html_sql('title')} AS title FROM raw_titles WHERE title IS NOT NULL AND title <> ''", "raw_titles"))
def q_title_clean(spark, d):
    return clean.clean_text(fx.raw_titles(spark, d), "title", mode="sql").select("doi", "title")


# ---------------------------------------------------------------- sources
@register("json_metadata", "S5", with_views("""
    SELECT id, journal AS folder, strftime(date, '%Y-%m-%d') AS date_text, article_type,
           CASE WHEN id % 5 = 0 OR id % 11 = 0 THEN NULL ELSE 'Paper ' || id END AS title,
           CASE WHEN id % 7 = 0 THEN NULL ELSE journal END AS journal_id,
           CASE WHEN id % 7 = 0 OR id % 3 = 0 THEN NULL ELSE 'Journal ' || journal END AS journal_name
    FROM papers""", "papers"))
def q_json_metadata(spark, d):
    """Nested metadata documents, some with missing fields and objects, in one folder per journal, read back by one scan."""
    i = F.col("id")
    title = F.when(i % 5 == 0, F.lit(None)).otherwise(F.struct(F.when(i % 11 != 0, F.concat(F.lit("Paper "), i.cast("string"))).alias("value")))
    journal = F.when(i % 7 != 0, F.struct(F.col("journal").alias("id"), F.when(i % 3 != 0, F.concat(F.lit("Journal "), "journal")).alias("name")))
    docs = fx.papers(spark, d).select(F.col("journal").alias("folder"), F.to_json(F.struct(
        i.cast("string").alias("id"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("article_type").alias("articleType"),
        title.alias("title"), journal.alias("journal"))).alias("value"))
    path = scratch_table_path(spark, "metadata")
    docs.write.partitionBy("folder").text(path)
    back = sio.read_metadata_dir(spark, path, key_from_path=r"folder=([^/]+)/", fields="id string")
    return back.select(F.col("id").cast("bigint").alias("id"), F.col("paper").alias("folder"), "date_text", "article_type", "title", "journal_id", "journal_name")


# Fixture binding: folders of the driver's journal tokens (NOTSPECIFIED has none -> null key).
FIXTURE_FOLDERS = [("HIGH", "H"), ("LOW", "L"), ("MEDIUM", "M"), ("URGENT", "U")]


@register("doi_file_key", "S6 D24", with_views(
    """SELECT p.doi, CASE WHEN f.folder IS NULL THEN NULL ELSE
              '/meta/' || f.folder || '/' || split_part(split_part(p.doi, '/', 2), '.', 2) || '/' || split_part(p.doi, '/', 2) || '.json' END AS meta_filename
       FROM papers p LEFT JOIN (VALUES ('HIGH','H'),('LOW','L'),('MEDIUM','M'),('URGENT','U')) f(journal, folder)
         ON split_part(split_part(p.doi, '/', 2), '.', 1) = f.journal""", "papers"))
def q_doi_file_key(spark, d):
    folders = spark.createDataFrame(FIXTURE_FOLDERS + sio.JOURNAL_FOLDERS, "journal string, folder string")
    return sio.doi_file_key(fx.papers(spark, d).select("doi"), folders, "/meta/").select("doi", "meta_filename")


@register("src_csv_roundtrip", "S1 S2 S3 S7", with_views("SELECT citing_doi, cited_doi, 'gz' AS fmt FROM raw_citations "
                                                         "UNION ALL SELECT citing_doi, cited_doi, 'tsv' FROM raw_citations "
                                                         "UNION ALL SELECT citing_doi, cited_doi, 'bz2' FROM raw_citations",
                                                         "raw_citations"))
def q_src_csv_roundtrip(spark, d):
    raw = fx.raw_citations(spark, d)
    p1 = sio.write_csv_table(raw, scratch_table_path(spark, "cit_gz"), compression="gzip")
    p2 = sio.write_csv_table(raw, scratch_table_path(spark, "cit_tsv"), header=False, sep="\t")
    schema = "citing_doi string, cited_doi string"
    p3 = sio.write_csv_table(raw, scratch_table_path(spark, "cit_bz2"), compression="bzip2")
    spread = spark.sparkContext.defaultParallelism
    a = sio.read_compressed_csv(spark, p1, schema, columns=["citing_doi", "cited_doi"], partitions=spread)
    b = sio.read_csv_table(spark, p2, schema, header=False, sep="\t")
    c = sio.read_compressed_csv(spark, p3, schema, columns=["citing_doi", "cited_doi"])
    return a.withColumn("fmt", F.lit("gz")).unionByName(b.withColumn("fmt", F.lit("tsv"))).unionByName(c.withColumn("fmt", F.lit("bz2")))


@register("embedding_table", "S8", with_views(
    """SELECT id, CAST(len(vec) AS BIGINT) AS dim, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm, label
       FROM raw_vectors""", "raw_vectors"))
def q_embedding_table(spark, d):
    v = fx.raw_vectors(spark, d)
    path = sio.write_table(v, scratch_table_path(spark, "emb"))
    back = sio.read_table(spark, path)
    from citeweave.functions.columns import norm2

    return back.select("id", F.size("vec").cast("bigint").alias("dim"), R6(norm2("vec")).alias("norm"), "label")


@register("run_params", "S10 P26", with_views(
    "SELECT journal, CAST(year AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n_papers FROM papers GROUP BY journal, year",
    "papers"))
def q_run_params(spark, d):
    p = fx.papers(spark, d).select("doi", "journal", "year")
    path = sio.write_table(p, scratch_table_path(spark, "runs"), partition_by=["journal", "year"])
    back = spark.read.parquet(path).select("doi")
    back = sio.with_run_params(back)
    return back.groupBy(F.col("params")["journal"].alias("journal"),
                        F.col("params")["year"].cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n_papers"))


GRID = {"method": ["given", "citation"], "k": [2, 4, 8, 16, 32, 64, 128], "trial": [1, 2, 3], "property": ["micro", "macro"]}


@register("run_names", "S10 P26", with_views(
    """SELECT 'given' AS embedding, CAST(k AS INTEGER) AS k, t.trial, CAST(count(*) AS BIGINT) AS n_rows
       FROM raw_vectors v CROSS JOIN (VALUES (1), (2), (3)) t(trial) CROSS JOIN (VALUES (4), (8)) g(k) GROUP BY ALL""", "raw_vectors"))
def q_run_names(spark, d):
    """Result folders named ``Embedding-given_K-8_trial-2``: parameters from names, case folded, filtered by name."""
    grid = F.broadcast(sio.param_grid(spark, k=[2, 4, 8], trial=[1, 2, 3]))  # nine rows
    name = F.concat(F.lit("Embedding-given_K-"), F.col("k").cast("string"), F.lit("_trial-"), F.col("trial").cast("string"))
    rows = fx.raw_vectors(spark, d).select("id", F.explode(F.array(*[F.lit(k) for k in (2, 4, 8)])).alias("k")).join(grid, "k")
    path = sio.write_table(rows.select("id", name.alias("run")), scratch_table_path(spark, "named-runs"), partition_by=["run"])
    back = spark.read.parquet(path).select(F.regexp_extract("_metadata.file_path", r"/run=([^/]+)/", 1).alias("name"))
    p = back.withColumn("p", sio.params_from_name("name")).where(F.col("p")["k"].isin("4", "8"))
    return p.groupBy(F.col("p")["embedding"].alias("embedding"), F.col("p")["k"].cast("int").alias("k"),
                     F.col("p")["trial"].cast("int").alias("trial")).agg(F.count(F.lit(1)).alias("n_rows"))


def _axis_sql(name: str) -> str:
    return "(VALUES " + ", ".join(f"({v!r})" for v in GRID[name]) + f") {name}_({name})"


@register("param_grid", "S12 M6 M8", with_views(
    f"""SELECT method, k, trial, property, {uniform_sql('trial', 'v.id')} < 0.2 AS is_test, CAST(count(*) AS BIGINT) AS n_rows
        FROM raw_vectors v CROSS JOIN {_axis_sql('trial')} CROSS JOIN {_axis_sql('k')} CROSS JOIN {_axis_sql('method')} CROSS JOIN {_axis_sql('property')}
        GROUP BY ALL""", "raw_vectors"))
def q_param_grid(spark, d):
    from citeweave.operators.sample import trial_split

    split = trial_split(fx.raw_vectors(spark, d).select("id"), "id", GRID["trial"])
    counts = split.groupBy("trial", "is_test").agg(F.count(F.lit(1)).alias("n_rows"))
    grid = sio.param_grid(spark, **GRID)  # every setting of the sweep: parameters, not data
    return counts.join(F.broadcast(grid), "trial").select("method", F.col("k").cast("int").alias("k"), F.col("trial").cast("int").alias("trial"),
                                                          "property", "is_test", "n_rows")


# ---------------------------------------------------------------- counts and profiles
@register("citation_counts", "A2 J12 P19", with_views(
    """SELECT p.doi, CAST(coalesce(c.n, 0) AS BIGINT) AS n_citations
       FROM net_meta p LEFT JOIN (SELECT cited_doi, count(DISTINCT citing_doi) AS n FROM net GROUP BY cited_doi) c
       ON p.doi = c.cited_doi""", "papers", "raw_citations", extra=network_views()))
def q_citation_counts(spark, d):
    n = network(spark, d)
    cnt = n.groupBy(F.col("cited_doi").alias("doi")).agg(F.countDistinct("citing_doi").alias("n"))
    papers = clean.reviewed_papers(fx.papers(spark, d), fx.REMOVED_TYPES).select("doi")
    return papers.join(cnt, "doi", "left").select("doi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_citations"))


@register("dedup_keep_first", "W3", """
    SELECT conv_id, turn, role, text FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations)
    WHERE rn = 1""")
def q_dedup_keep_first(spark, d):
    c = fx.table(spark, d, "conversations")
    return relate.keep_first(c, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", "text")


@register("dup_profile", "A9 A10 A11 A21 W5", """
    WITH t AS (SELECT text, count(*) AS c FROM documents GROUP BY text)
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS n_rows,
           (SELECT CAST(count(DISTINCT doc_id) AS BIGINT) FROM documents) AS n_ids,
           (SELECT CAST(count(*) AS BIGINT) FROM t) AS n_distinct_text,
           (SELECT CAST(count(*) AS BIGINT) FROM t WHERE c > 1) AS n_repeated_text,
           (SELECT CAST(max(c) AS BIGINT) FROM t) AS max_copies,
           (SELECT CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM documents) AS n_null_text,
           (SELECT CAST(sum(CASE WHEN text = '' THEN 1 ELSE 0 END) AS BIGINT) FROM documents) AS n_empty_text,
           round((SELECT count(*) FROM t) / (SELECT count(*) FROM documents), 6) AS share_kept""")
def q_dup_profile(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    vc = docs.groupBy("text").agg(F.count(F.lit(1)).alias("c"))  # value_counts
    a = docs.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"),
                 F.sum(F.col("text").isNull().cast("long")).alias("n_null_text"),
                 F.sum((F.col("text") == "").cast("long")).alias("n_empty_text"))
    b = vc.agg(F.count(F.lit(1)).alias("n_distinct_text"), F.sum((F.col("c") > 1).cast("long")).alias("n_repeated_text"),
               F.max("c").alias("max_copies"))
    bs = b.first()  # three scalars
    a = a.select("*", *[F.lit(bs[c]).alias(c) for c in ["n_distinct_text", "n_repeated_text", "max_copies"]])
    return a.select("n_rows", "n_ids", "n_distinct_text", "n_repeated_text", "max_copies", "n_null_text",
                                 "n_empty_text", R6(F.col("n_distinct_text") / F.col("n_rows")).alias("share_kept"))


@register("filter_profile", "A21 A11", with_views(
    f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM raw_citations) AS n_raw,
               (SELECT CAST(count(*) AS BIGINT) FROM net) AS n_kept,
               round((SELECT count(*) FROM net) / (SELECT count(*) FROM raw_citations), 6) AS share_kept,
               (SELECT CAST(count(DISTINCT citing_doi) AS BIGINT) FROM net) AS n_citing_papers""",
    "papers", "raw_citations", extra=network_views()))
def q_filter_profile(spark, d):
    n_raw = fx.raw_citations(spark, d).count()  # a scalar
    kept = network(spark, d).agg(F.count(F.lit(1)).alias("n_kept"), F.countDistinct("citing_doi").alias("n_citing_papers"))
    return kept.select(F.lit(n_raw).cast("bigint").alias("n_raw"), "n_kept", R6(F.col("n_kept") / F.lit(n_raw)).alias("share_kept"), "n_citing_papers")


FAR_ID = 1 << 30  # ids up to here on both sides are paired and taken apart


@register("cantor_pair", "P24", with_views(
    f"""SELECT DISTINCT citing, cited,
               CAST((citing + cited) * (citing + cited + 1) // 2 + cited AS BIGINT) AS z,
               CAST((greatest(citing, cited) + least(citing, cited)) * (greatest(citing, cited) + least(citing, cited) + 1) // 2
                    + least(citing, cited) AS BIGINT) AS zu,
               CAST(citing AS BIGINT) AS back_citing, CAST(cited AS BIGINT) AS back_cited,
               CAST((CAST({2 * FAR_ID} - citing - cited AS HUGEINT) * ({2 * FAR_ID} - citing - cited + 1)) // 2 + {FAR_ID} - cited AS BIGINT) AS far_z,
               CAST({FAR_ID} - citing AS BIGINT) AS far_citing, CAST({FAR_ID} - cited AS BIGINT) AS far_cited
        FROM citations""", "citations"))
def q_cantor_pair(spark, d):
    """Pairing and its inverse, for the ids and for ids near ``FAR_ID`` on both sides."""
    c = fx.citations(spark, d).distinct()
    z = c.withColumn("z", cantor_pair("citing", "cited")).withColumn("zu", cantor_pair("citing", "cited", unordered=True)) \
        .withColumn("far_z", cantor_pair(F.lit(FAR_ID) - F.col("citing"), F.lit(FAR_ID) - F.col("cited")))
    (k1, k2), (f1, f2) = cantor_unpair("z"), cantor_unpair("far_z")
    return z.select("citing", "cited", "z", "zu", k1.alias("back_citing"), k2.alias("back_cited"), "far_z", f1.alias("far_citing"), f2.alias("far_cited"))


# ---------------------------------------------------------------- joins and sets
@register("edges_with_text", "J4 W3", with_views(
    """SELECT n.citing_doi, n.cited_doi, CAST(length(a.abstract) AS BIGINT) AS citing_len, CAST(length(b.abstract) AS BIGINT) AS cited_len
       FROM net n JOIN ab a ON n.citing_doi = a.doi JOIN ab b ON n.cited_doi = b.doi""",
    "papers", "raw_citations", "abstracts", extra=network_views() + [
        ("ab", """SELECT doi, abstract FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY abstract) rn
                  FROM abstracts WHERE abstract IS NOT NULL AND abstract <> '') WHERE rn = 1""")]))
def q_edges_with_text(spark, d):
    ab = fx.abstracts(spark, d).where(non_blank("abstract"))
    ab = relate.keep_first_agg(ab, ["doi"], "abstract")
    n = network(spark, d).select("citing_doi", "cited_doi")
    a = ab.select(F.col("doi").alias("citing_doi"), F.length("abstract").cast("bigint").alias("citing_len"))
    b = ab.select(F.col("doi").alias("cited_doi"), F.length("abstract").cast("bigint").alias("cited_len"))
    return n.join(a, "citing_doi").join(b, "cited_doi").select("citing_doi", "cited_doi", "citing_len", "cited_len")


def _holdout_sql():
    h = hash_sql("0", "citing_id", "cited_id")
    return [
        ("e", """SELECT DISTINCT n.citing_doi, n.cited_doi, n.citing_year,
                        CAST(string_split(n.citing_doi, '.')[-1] AS BIGINT) AS citing_id,
                        CAST(string_split(n.cited_doi, '.')[-1] AS BIGINT) AS cited_id FROM net n"""),
        ("cand", f"SELECT *, {h} AS h FROM e WHERE citing_year = {fx.MAX_YEAR}"),
        ("held", """SELECT citing_doi, cited_doi FROM (
                      SELECT *, row_number() OVER (ORDER BY h, citing_id, cited_id) - 1 AS rk FROM cand)
                    WHERE rk < (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM cand)"""),
    ]


def holdout(spark, d):
    e = network(spark, d).select("citing_doi", "cited_doi", "citing_year").distinct()
    e = e.withColumn("citing_id", F.element_at(F.split("citing_doi", r"\."), -1).cast("long")) \
         .withColumn("cited_id", F.element_at(F.split("cited_doi", r"\."), -1).cast("long"))
    cand = e.where(F.col("citing_year") == fx.MAX_YEAR)
    n = int(cand.count() * 0.5)  # a scalar
    held = sample_n(cand, ["citing_id", "cited_id"], n, seed=0).select("citing_doi", "cited_doi")
    return e.select("citing_doi", "cited_doi"), held


@register("holdout_edges", "M4 M3", with_views("SELECT citing_doi, cited_doi FROM held", "papers", "raw_citations",
                                                extra=network_views() + _holdout_sql()))
def q_holdout_edges(spark, d):
    return holdout(spark, d)[1]


@register("edge_attributes", "J11", with_views(
    """SELECT h.citing_doi, h.cited_doi, min(n.citing_year) AS citing_year, min(n.cited_year) AS cited_year, CAST(count(*) AS BIGINT) AS n
       FROM held h JOIN net n ON h.citing_doi = n.citing_doi AND h.cited_doi = n.cited_doi GROUP BY ALL""",
    "papers", "raw_citations", extra=network_views() + _holdout_sql()))
def q_edge_attributes(spark, d):
    """Edges joined to edge attributes on both ends."""
    held = holdout(spark, d)[1]
    attributes = network(spark, d).groupBy("citing_doi", "cited_doi").agg(
        F.min("citing_year").alias("citing_year"), F.min("cited_year").alias("cited_year"), F.count(F.lit(1)).alias("n"))
    return held.join(attributes, ["citing_doi", "cited_doi"])


@register("edge_set_ops", "U1 U4 U5 U6 J15", with_views(
    """SELECT 'kept' AS tag, citing_doi, cited_doi FROM (SELECT citing_doi, cited_doi FROM e EXCEPT SELECT citing_doi, cited_doi FROM held)
       UNION ALL SELECT 'held_out', citing_doi, cited_doi FROM held
       UNION ALL SELECT 'overlap', citing_doi, cited_doi FROM (
            SELECT citing_doi, cited_doi FROM (SELECT citing_doi, cited_doi FROM e EXCEPT SELECT citing_doi, cited_doi FROM held)
            INTERSECT SELECT citing_doi, cited_doi FROM held)""",
    "papers", "raw_citations", extra=network_views() + _holdout_sql()))
def q_edge_set_ops(spark, d):
    e, held = holdout(spark, d)
    reduced = e.join(held, ["citing_doi", "cited_doi"], "left_anti")  # remove_edges_from: nodes stay
    overlap = reduced.intersect(held)  # must be empty
    return (reduced.withColumn("tag", F.lit("kept"))
            .unionByName(held.withColumn("tag", F.lit("held_out")))
            .unionByName(overlap.withColumn("tag", F.lit("overlap")))
            .select("tag", "citing_doi", "cited_doi"))


@register("node_list", "U3", with_views(
    "SELECT citing_doi AS node FROM net UNION SELECT cited_doi FROM net", "papers", "raw_citations", extra=network_views()))
def q_node_list(spark, d):
    return G.nodes_of(network(spark, d), "citing_doi", "cited_doi")


# ---------------------------------------------------------------- graph tables
_BIP_UNDIRECTED = ("g", "SELECT src, dst, 1.0 AS w FROM (SELECT src, dst FROM bipartite_edges UNION SELECT dst, src FROM bipartite_edges)")


@register("graph_build", "G1 G3 S9", with_views(
    "SELECT src, dst, w FROM g", "bipartite_edges", extra=[_BIP_UNDIRECTED]))
def q_graph_build(spark, d):
    g = G.build_graph(fx.bipartite_edges(spark, d), mode="undirected")
    path = sio.write_table(g, scratch_table_path(spark, "graph_edges"))
    return sio.read_table(spark, path).select("src", "dst", "w")


@register("degrees", "A12", with_views(
    """SELECT coalesce(o.node, i.node) AS node, coalesce(o.d, 0.0) AS out_deg, coalesce(i.d, 0.0) AS in_deg FROM
       (SELECT src AS node, sum(w) AS d FROM g GROUP BY src) o FULL JOIN (SELECT dst AS node, sum(w) AS d FROM g GROUP BY dst) i
       ON o.node = i.node""", "bipartite_edges", extra=[("g", "SELECT DISTINCT src, dst, 1.0 AS w FROM bipartite_edges")]))
def q_degrees(spark, d):
    return G.degrees(G.build_graph(fx.bipartite_edges(spark, d), mode="to_cited"))


@register("core_periphery", "A13", with_views(
    """SELECT node, deg, CASE WHEN deg >= (SELECT quantile_cont(deg, 0.9) FROM dg) THEN 'Core' ELSE 'Periphery' END AS is_hub FROM dg""",
    "bipartite_edges", extra=[_BIP_UNDIRECTED, ("dg", "SELECT src AS node, sum(w) AS deg FROM g GROUP BY src")]))
def q_core_periphery(spark, d):
    g = G.build_graph(fx.bipartite_edges(spark, d), mode="undirected")
    deg = g.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    return G.quantile_flag(deg, "deg", 0.9).select("node", "deg", "is_hub")


@register("sparse_from_triples", "A15", """
    SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS w FROM lineitem
    GROUP BY l_partkey, l_suppkey HAVING sum(l_quantity) >= 50""")
def q_sparse_from_triples(spark, d):
    li = fx.table(spark, d, "lineitem")
    return G.sum_duplicates(li, "l_partkey", "l_suppkey", "l_quantity", min_value=50.0)


@register("transition_matrix", "G6", with_views(
    "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM g", "bipartite_edges", extra=[_BIP_UNDIRECTED]))
def q_transition_matrix(spark, d):
    t = G.transition_matrix(G.build_graph(fx.bipartite_edges(spark, d)))
    return t.select("src", "dst", R6(F.col("p")).alias("p"))


@register("transition_cumprob", "W9 G7", with_views(
    """SELECT src, dst, round(sum(w) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                        / sum(w) OVER (PARTITION BY src), 6) AS cum FROM g""", "bipartite_edges", extra=[_BIP_UNDIRECTED]))
def q_transition_cumprob(spark, d):
    t = G.transition_cumprob(G.build_graph(fx.bipartite_edges(spark, d)))
    return t.select("src", "dst", R6(F.col("cum")).alias("cum"))


@register("normalized_adjacency", "G18", with_views(
    """SELECT g.src, g.dst, round(g.w / sqrt(greatest(a.d, 1e-12) * greatest(b.d, 1e-12)), 6) AS w
       FROM g JOIN (SELECT src, sum(w) d FROM g GROUP BY src) a ON g.src = a.src
       JOIN (SELECT src, sum(w) d FROM g GROUP BY src) b ON g.dst = b.src""", "bipartite_edges", extra=[_BIP_UNDIRECTED]))
def q_normalized_adjacency(spark, d):
    a = G.normalized_adjacency(G.build_graph(fx.bipartite_edges(spark, d)))
    return a.select("src", "dst", R6(F.col("w")).alias("w"))


@register("safe_log", "P25", with_views(
    "SELECT src, dst, round(ln(greatest(w / sum(w) OVER (PARTITION BY src), 1e-12)), 6) AS log_p FROM g",
    "bipartite_edges", extra=[_BIP_UNDIRECTED]))
def q_safe_log(spark, d):
    t = G.transition_matrix(G.build_graph(fx.bipartite_edges(spark, d))).select("src", "dst", F.col("p").alias("w"))
    return G.elementwise_log(t).select("src", "dst", R6(F.col("w")).alias("log_p"))


@register("node_index", "G2", with_views(
    "SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS idx FROM (SELECT src AS node FROM g UNION SELECT dst FROM g)",
    "bipartite_edges", extra=[_BIP_UNDIRECTED]))
def q_node_index(spark, d):
    from citeweave.operators.walks import index_graph

    nodes, _ = index_graph(G.build_graph(fx.bipartite_edges(spark, d)))
    return nodes.select("node", "idx")


@register("sample_fraction", "M1", with_views(
    f"SELECT doi FROM papers WHERE {uniform_sql('7', 'id')} < 0.2", "papers"))
def q_sample_fraction(spark, d):
    return sample_fraction(fx.papers(spark, d), "id", 0.2, seed=7).select("doi")


@register("sample_n", "M3 M9", with_views(
    f"""SELECT doi, pacs_code FROM (
          SELECT doi, pacs_code, row_number() OVER (ORDER BY {hash_sql('3', 'rid')}, rid) - 1 AS rk FROM (
            SELECT doi, pacs_code, CAST(string_split(doi, '.')[-1] AS BIGINT) * 16 + row_number() OVER (PARTITION BY doi ORDER BY pacs_code) AS rid
            FROM pacs))
        WHERE rk < 25000""", "dirty_codes_wide", extra=clean_codes_views()))
def q_sample_n(spark, d):
    from pyspark.sql.window import Window

    p = pacs(spark, d).select("doi", "pacs_code")
    # row key: paper id * 16 + position of the code within the paper (a paper has <= 5 lines x 2 codes)
    rid = F.element_at(F.split("doi", r"\."), -1).cast("long") * 16 + F.row_number().over(
        Window.partitionBy("doi").orderBy("pacs_code"))
    return sample_n(p.withColumn("rid", rid), ["rid"], 25000, seed=3).select("doi", "pacs_code")
