"""Spectral and skip-gram embeddings, text encoders, projections (§2.9 V1-V7, V13, V17, V18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions.columns import hash_sql, l2_normalize, uniform_sql
from citeweave.operators import clean, embed, linalg, relate
from citeweave.operators import graph as G
from citeweave.operators import walks as W
from citeweave.operators.sample import sample_fraction, sample_n
from citeweave.plans.fixture_sql import with_views
from citeweave.plans.q_core import network, pacs
from citeweave.plans.q_graph import (
    BIP_VIEWS, CIT_UND, DIM, NUM_WALKS, WALK_LENGTH, WINDOW, bip_graph, cit_graph, cum_view, walk_sql)
from citeweave.plans.q_text_sets import _html_sql
from citeweave.plans.registry import register
from citeweave.plans.sqlparts import clean_codes_views, modal_view, network_views
from citeweave.session import materialize, scratch_table_path
from citeweave.sources import fixtures as fx


def R6(c):
    return F.round(c, 6)


def _walk_pairs(gi):
    """Centre/context counts of the walk corpus, stored: several aggregates read them."""
    return materialize(W.piece_pairs(W.walk_pieces(gi, NUM_WALKS, WALK_LENGTH, seed=1, undirected=True), WINDOW, WALK_LENGTH), "walk-pairs")


def _ids(g):
    return G.nodes_of(g).select(F.col("node").alias("id"))


@register("truncated_svd", "V1 W8")
def q_truncated_svd(spark, d):
    g = cit_graph(spark, d)
    L = G.normalized_adjacency(g)
    _, s = linalg.randomized_svd(L, _ids(g), DIM, seed=1)
    return spark.createDataFrame([(i, float(round(v, 6))) for i, v in enumerate(s)], "component int, singular_value double")


@register("svd_invariants", "V1 V3 W8", with_views(
    f"""SELECT 'largest value' AS what, 0 AS i, 1.0 AS value
        UNION ALL SELECT 'column length', c.i, 1.0 FROM range({DIM}) c(i)
        UNION ALL SELECT 'values out of order', 0, 0.0
        UNION ALL SELECT 'residuals over 0.001', 0, 0.0""", "citations"))
def q_svd_invariants(spark, d):
    """A symmetric normalised adjacency has the largest singular value 1 (to six digits here), and singular vectors have length 1;
    every triple's residual |X X^T u - s^2 u| is at most 0.001."""
    g = cit_graph(spark, d)
    svd = linalg.truncated_svd(G.normalized_adjacency(g), _ids(g), DIM, seed=1, tol=1e-3)
    U, s = svd.U, svd.s
    of_col = U.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(R6(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("value"))
    scalars = [("largest value", 0, float(round(s[0], 6))), ("values out of order", 0, float((s[1:] > s[:-1] + 1e-12).sum())),
               ("residuals over 0.001", 0, float((svd.residuals > 1e-3).sum()))]
    return of_col.select(F.lit("column length").alias("what"), F.col("i").cast("int").alias("i"), "value").unionByName(
        spark.createDataFrame(scalars, "what string, i int, value double"))


@register("svd_of_sum", "V2 V1")
def q_svd_of_sum(spark, d):
    """Singular values of P + P^2, the products applied in turn and never formed."""
    g = cit_graph(spark, d)
    P = G.transition_matrix(g).select("src", "dst", F.col("p").alias("w"))
    _, s = linalg.randomized_svd([[P], [P, P]], _ids(g), DIM, seed=4)
    return spark.createDataFrame([(i, float(round(v, 6))) for i, v in enumerate(s)], "component int, singular_value double")


def _gauss_sql(col: str, c: int, seed: int = 5) -> str:
    u1 = f"greatest({uniform_sql(str(seed), col, str(2 * c))}, 1e-300)"
    u2 = uniform_sql(str(seed), col, str(2 * c + 1))
    return f"sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2})"


@register("matrix_chain", "V2 G16", with_views(
    """SELECT y.id, round(y.c0, 6) AS c0, round(y.c1, 6) AS c1 FROM (
         SELECT p.src AS id, sum(p.w * y1.c0) AS c0, sum(p.w * y1.c1) AS c1 FROM P1 p JOIN (
           SELECT p.src AS id, sum(p.w * o.c0) AS c0, sum(p.w * o.c1) AS c1 FROM P1 p JOIN omega o ON p.dst = o.id GROUP BY p.src) y1
         ON p.dst = y1.id GROUP BY p.src) y""",
    "citations", extra=[CIT_UND, ("P1", "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM gi"),
                        ("omega", f"""SELECT id, {_gauss_sql('id', 0)} AS c0, {_gauss_sql('id', 1)} AS c1 FROM (
                                         SELECT src AS id FROM gi UNION SELECT dst FROM gi)""")]))
def q_matrix_chain(spark, d):
    g = cit_graph(spark, d)
    P = G.transition_matrix(g).select("src", "dst", F.col("p").alias("w"))
    omega = linalg.gaussian_rows(_ids(g), 2, seed=5)
    y = linalg.spmm(P, linalg.spmm(P, omega))  # factors applied in turn, product never formed
    return y.select("id", R6(F.col("vec")[0]).alias("c0"), R6(F.col("vec")[1]).alias("c1"))


@register("laplacian_eigenmap", "V3 G18 V1 W8 D11")
def q_laplacian_eigenmap(spark, d):
    g = cit_graph(spark, d)
    emb, _ = linalg.laplacian_eigenmap(g, _ids(g), DIM, seed=1)
    return emb.select(F.col("id").alias("node"), "vec")


@register("residual2vec", "V5 G14 P25", with_views(
    """SELECT c.center AS src, c.context AS dst,
              round(ln(greatest(c.freq / t.tot, 1e-12)) - ln(greatest(d.deg / m.two_m, 1e-12)), 6) AS w
       FROM cp c JOIN (SELECT center, sum(freq) AS tot FROM cp GROUP BY center) t ON c.center = t.center
       JOIN (SELECT src, sum(w) AS deg FROM gi GROUP BY src) d ON c.context = d.src
       CROSS JOIN (SELECT sum(w) AS two_m FROM gi) m""",
    "bipartite_edges", extra=BIP_VIEWS + [cum_view(), ("walks", walk_sql(NUM_WALKS, WALK_LENGTH, 1)),
                                          ("cp", """SELECT a.cur AS center, b.cur AS context, CAST(count(*) AS DOUBLE) AS freq
                                                    FROM walks a JOIN walks b ON a.walk_id = b.walk_id AND b.t BETWEEN a.t + 1 AND a.t + """ + f"""{WINDOW}
                                                    WHERE a.t < {WALK_LENGTH} - {WINDOW} GROUP BY a.cur, b.cur""")]))
def q_residual2vec(spark, d):
    _, gi = bip_graph(spark, d)
    pairs = _walk_pairs(gi)
    R = linalg.residual_matrix(pairs, gi)
    return R.select("src", "dst", R6(F.col("w")).alias("w"))


@register("residual2vec_embedding", "V5 V1")
def q_residual2vec_embedding(spark, d):
    _, gi = bip_graph(spark, d)
    pairs = _walk_pairs(gi)
    U, s = linalg.randomized_svd(linalg.residual_operand(pairs, gi), _ids(gi), DIM, seed=2)
    return linalg.factor_embedding(U, s).select(F.col("id").alias("node"), "vec")


@register("pca_2d", "V13")
def q_pca_2d(spark, d):
    return linalg.pca_2d(fx.raw_vectors(spark, d), "vec", "id")


def _node2vec(spark, d):
    nodes, gi = bip_graph(spark, d)
    nodes = materialize(nodes.select(F.col("idx").alias("id"), F.col("node").alias("name")), "node-names")
    emb = embed.node2vec_embedding(_walk_pairs(gi), nodes.select("id"), DIM, seed=1)
    return embed.load_vectors(spark, embed.save_vectors(emb, nodes, scratch_table_path(spark, "node2vec")))


@register("node2vec", "V4 S11 G8 G13")
def q_node2vec(spark, d):
    return _node2vec(spark, d).select("name", "vec")


def _shape(vectors, key):
    """What SQL can tell of vectors: every key once, the dimension, and whether all numbers are finite."""
    bad = F.exists("vec", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return vectors.select(key, F.size("vec").alias("dim"), (~bad).alias("finite"))


@register("node2vec_rows", "V4 S11", with_views(
    f"SELECT node AS name, CAST({DIM} AS INTEGER) AS dim, true AS finite FROM nidx", "bipartite_edges", extra=BIP_VIEWS[:2]))
def q_node2vec_rows(spark, d):
    return _shape(_node2vec(spark, d), "name")


def _doc_vectors(spark, d):
    return embed.document_vectors(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", DIM, seed=1)


@register("doc_vectors", "V6 D4")
def q_doc_vectors(spark, d):
    return _doc_vectors(spark, d)


@register("doc_vector_rows", "V6", f"SELECT doc_id, CAST(least({DIM}, (SELECT count(*) FROM documents)) AS INTEGER) AS dim, true AS finite FROM documents")
def q_doc_vector_rows(spark, d):
    return _shape(_doc_vectors(spark, d), "doc_id")


@register("text_embed", "V7", f"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents WHERE text <> ''),
    c AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % {DIM} AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY ALL)
    SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""")
def q_text_embed(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    v = embed.embed_texts(docs, "doc_id", "text", embed.hashing_encoder(DIM))
    return v.select("doc_id", F.posexplode("vec").alias("bucket", "weight")).where("weight > 0").select("doc_id", "bucket", R6(F.col("weight")).alias("weight"))


@register("embedding_enrich", "V17 M1 J7 J17 J12 W1", with_views(
    f"""SELECT v.doi, m.pacs_code_1, t.title, CAST(coalesce(c.n, 0) AS BIGINT) AS cit_ct
        FROM vectors v JOIN modal m ON v.doi = m.doi
        JOIN (SELECT doi, {_html_sql('title')} AS title FROM raw_titles WHERE title IS NOT NULL AND title <> '') t ON v.doi = t.doi
        LEFT JOIN (SELECT cited_doi, count(DISTINCT citing_doi) AS n FROM net GROUP BY cited_doi) c ON v.doi = c.cited_doi
        WHERE {uniform_sql('13', "CAST(string_split(v.doi, '.')[-1] AS BIGINT)")} < 0.2""",
    "vectors", "raw_titles", "dirty_codes_wide", "papers", "raw_citations",
    extra=network_views() + clean_codes_views() + [modal_view()]))
def q_embedding_enrich(spark, d):
    v = fx.vectors(spark, d).withColumn("id", F.element_at(F.split("doi", r"\."), -1).cast("long"))
    samp = sample_fraction(v, "id", 0.2, seed=13)
    modal = relate.modal_code(pacs(spark, d))
    titles = clean.clean_text(fx.raw_titles(spark, d), "title")
    cit = network(spark, d).groupBy(F.col("cited_doi").alias("doi")).agg(F.countDistinct("citing_doi").alias("n"))
    out = samp.join(modal, "doi").join(titles, "doi").join(cit, "doi", "left")
    return out.select("doi", "pacs_code_1", "title", F.coalesce("n", F.lit(0)).cast("bigint").alias("cit_ct"))


@register("multi_embedding_wide", "V18 J10 M9 M3", with_views(
    f"""SELECT doi, round(max(CASE WHEN method = 'given' THEN x END), 6) AS given_x,
               round(max(CASE WHEN method = 'normed' THEN x END), 6) AS normed_x,
               round(max(CASE WHEN method = 'centred' THEN x END), 6) AS centred_x
        FROM (SELECT s.doi, 'given' AS method, v.vec[1] AS x FROM samp s JOIN vectors v ON s.doi = v.doi
              UNION ALL SELECT s.doi, 'normed', v.vec[1] / sqrt(list_inner_product(v.vec, v.vec)) FROM samp s JOIN vectors v ON s.doi = v.doi
              UNION ALL SELECT s.doi, 'centred', v.vec[1] - (SELECT avg(vec[1]) FROM vectors) FROM samp s JOIN vectors v ON s.doi = v.doi)
        GROUP BY doi""",
    "vectors", extra=[("samp", f"""SELECT doi FROM (SELECT doi, row_number() OVER (
                                       ORDER BY {hash_sql('17', "CAST(string_split(doi, '.')[-1] AS BIGINT)")},
                                                CAST(string_split(doi, '.')[-1] AS BIGINT)) - 1 AS rk FROM vectors) WHERE rk < 25000""")]))
def q_multi_embedding_wide(spark, d):
    v = fx.vectors(spark, d).withColumn("id", F.element_at(F.split("doi", r"\."), -1).cast("long"))
    ids = sample_n(v.select("doi", "id"), ["id"], 25000, seed=17).select("doi")  # one id sample shared by all methods
    mean0 = v.agg(F.avg(F.col("vec")[0].cast("double")).alias("m0")).first()["m0"]  # a scalar
    methods = (v.select("doi", F.lit("given").alias("method"), F.col("vec")[0].cast("double").alias("x"))
               .unionByName(v.select("doi", F.lit("normed").alias("method"), l2_normalize("vec")[0].alias("x")))
               .unionByName(v.select(
                   "doi", F.lit("centred").alias("method"), (F.col("vec")[0].cast("double") - F.lit(mean0)).alias("x"))))
    wide = methods.join(ids, "doi", "left_semi").groupBy("doi").pivot("method", ["given", "normed", "centred"]).agg(F.first("x"))
    return wide.select("doi", R6(F.col("given")).alias("given_x"), R6(F.col("normed")).alias("normed_x"),
                       R6(F.col("centred")).alias("centred_x"))


def _projections(spark, d):
    """``doi, method, x, y``: principal components of three forms of the vectors, for one id sample shared by all (M9)."""
    v = fx.vectors(spark, d).withColumn("id", F.element_at(F.split("doi", r"\."), -1).cast("long"))
    v = materialize(sample_n(v, ["id"], 25000, seed=17).select("doi", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "projected-sample")
    forms = {"given": v, "normed": v.select("doi", l2_normalize("vec").alias("vec")),
             "sign": v.select("doi", F.transform("vec", lambda x: F.signum(x)).alias("vec"))}
    out = None
    for name, vectors in forms.items():
        p = linalg.pca_2d(vectors, "vec", "doi").select("doi", F.lit(name).alias("method"), F.col("proj")[0].alias("x"), F.col("proj")[1].alias("y"))
        out = p if out is None else out.unionByName(p)
    return out


@register("projections_wide", "V18 J10 M9 V13")
def q_projections_wide(spark, d):
    wide = _projections(spark, d).groupBy("doi").pivot("method", ["given", "normed", "sign"]).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    return wide


@register("projection_enrich", "V17 V13 J7 J17 J12")
def q_projection_enrich(spark, d):
    p = _projections(spark, d).where("method = 'normed'").select("doi", "x", "y")
    modal = relate.modal_code(pacs(spark, d))
    cit = network(spark, d).groupBy(F.col("cited_doi").alias("doi")).agg(F.countDistinct("citing_doi").alias("n"))
    return p.join(modal, "doi").join(cit, "doi", "left").select("doi", "x", "y", "pacs_code_1", F.coalesce("n", F.lit(0)).cast("bigint").alias("cit_ct"))


@register("projection_checks", "V13 V17 V18", with_views(
    """SELECT m.method, CAST((SELECT least(count(*), 25000) FROM vectors) AS BIGINT) AS n, 0.0 AS mean_x, 0.0 AS mean_y, 0.0 AS corr, true AS first_is_wider
       FROM (VALUES ('given'), ('normed'), ('sign')) m(method)""", "vectors"))
def q_projection_checks(spark, d):
    """Principal components have mean 0, no correlation, and the first the larger variance."""
    p = _projections(spark, d)
    return p.groupBy("method").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("x"), 4) + 0.0).alias("mean_x"), (F.round(F.avg("y"), 4) + 0.0).alias("mean_y"),
                                   (F.round(F.corr("x", "y"), 4) + 0.0).alias("corr"), (F.variance("x") >= F.variance("y")).alias("first_is_wider"))
