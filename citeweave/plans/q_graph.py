"""Link prediction, random walks, transition powers and components (§2.8, E3-E5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeweave.functions.columns import cantor_pair, hash_sql, hash_uniform, uniform_sql
from citeweave.operators import components as C
from citeweave.operators import evaluate
from citeweave.operators import graph as G
from citeweave.operators import walks as W
from citeweave.operators import vectors as V
from citeweave.operators.sample import sample_n, with_hash_rank
from citeweave.plans.fixture_sql import with_views
from citeweave.plans.registry import register
from citeweave.session import fits_broadcast, materialize
from citeweave.sources import fixtures as fx

# the walk corpus of the reference: walks a node, steps a walk, window, dimensions
NUM_WALKS, WALK_LENGTH, WINDOW, DIM = 10, 80, 10, 128
MAX_TURNS = 20  # passes of the negative-edge draw before it gives up with an error


def R6(c):
    return F.round(c, 6)


# ================================================================== link prediction
def link_sets(spark, d):
    le = fx.link_edges(spark, d).select("citing", "cited")
    yrs = fx.papers(spark, d).select("id", "year")
    e = (le.join(yrs.select(F.col("id").alias("citing"), F.col("year").alias("citing_year")), "citing")
         .join(yrs.select(F.col("id").alias("cited"), F.col("year").alias("cited_year")), "cited").distinct())
    cand = e.where(F.col("citing_year") == fx.MAX_YEAR)
    n = int(cand.count() * 0.5)  # scalar
    pos = sample_n(cand, ["citing", "cited"], n, seed=21).select("citing", "cited")
    net = e.select("citing", "cited").join(pos, ["citing", "cited"], "left_anti")
    # both ends are permuted on their own and zipped; one pass over all edges usually gives
    # enough pairs, else further passes with new permutations add more
    size, found = net.count(), None
    for turn in range(MAX_TURNS):
        ci = with_hash_rank(net, ["citing", "cited"], 22 + 10 * turn).select(F.col("_rank").alias("r"), "citing")
        cd = with_hash_rank(net, ["citing", "cited"], 23 + 10 * turn).select(F.col("_rank").alias("r"), "cited")
        more = (ci.join(cd, "r")
                .join(e.select("citing", "citing_year").distinct(), "citing")
                .join(e.select("cited", "cited_year").distinct(), "cited")
                .where(F.col("citing_year") >= F.col("cited_year"))
                .join(net, ["citing", "cited"], "left_anti")
                .select((F.col("r") + turn * size).alias("r"), "citing", "cited"))
        found = materialize(more if found is None else found.unionByName(more), "negative-edges")
        if found.count() >= n:
            break
    else:
        raise ValueError(f"no {n} negative edges in {MAX_TURNS} passes: the graph is too dense")
    neg = sample_n(found, ["r"], n, seed=24).select("citing", "cited")
    return pos, neg


def scored_links(spark, d):
    pos, neg = link_sets(spark, d)
    test = pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
    s = V.pair_cosine(test, fx.raw_vectors(spark, d), "citing", "cited", key="id", how="left")
    given = s.where(F.col("cos_sim").isNotNull()).select(F.lit("given").alias("method"), "citing", "cited", "label",
                                                          F.round("cos_sim", 12).alias("score"))
    base = test.select(F.lit("hash_baseline").alias("method"), "citing", "cited", "label",
                       F.round(hash_uniform(F.lit(99), F.col("citing"), F.col("cited")), 12).alias("score"))
    return given.unionByName(base)


LINK_VIEWS = [
    ("le", """SELECT DISTINCT l.citing, l.cited, a.year AS citing_year, b.year AS cited_year
              FROM link_edges l JOIN papers a ON l.citing = a.id JOIN papers b ON l.cited = b.id"""),
    ("cand", f"SELECT * FROM le WHERE citing_year = {fx.MAX_YEAR}"),
    ("pos", f"""SELECT citing, cited FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('21', 'citing', 'cited')}, citing, cited) - 1 AS rk
                FROM cand) WHERE rk < (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM cand)"""),
    ("lnet", "SELECT citing, cited FROM le EXCEPT SELECT citing, cited FROM pos"),
    ("ci", f"""SELECT rk AS r, citing FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('22', 'citing', 'cited')}, citing, cited) - 1 AS rk
               FROM lnet)"""),
    ("cd", f"""SELECT rk AS r, cited FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('23', 'citing', 'cited')}, citing, cited) - 1 AS rk
               FROM lnet)"""),
    ("neg0", """SELECT ci.r, ci.citing, cd.cited FROM ci JOIN cd ON ci.r = cd.r
                JOIN (SELECT DISTINCT citing, citing_year FROM le) y1 ON ci.citing = y1.citing
                JOIN (SELECT DISTINCT cited, cited_year FROM le) y2 ON cd.cited = y2.cited
                WHERE y1.citing_year >= y2.cited_year
                  AND NOT EXISTS (SELECT 1 FROM lnet n WHERE n.citing = ci.citing AND n.cited = cd.cited)"""),
    ("neg", f"""SELECT citing, cited FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('24', 'r')}, r) - 1 AS rk FROM neg0)
                WHERE rk < (SELECT count(*) FROM pos)"""),
    ("test", "SELECT citing, cited, 1 AS label FROM pos UNION ALL SELECT citing, cited, 0 FROM neg"),
    ("scored", f"""SELECT 'given' AS method, t.citing, t.cited, t.label, round(
                      list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))), 12) AS score
                   FROM test t JOIN raw_vectors a ON t.citing = a.id JOIN raw_vectors b ON t.cited = b.id
                   UNION ALL
                   SELECT 'hash_baseline', citing, cited, label, round({uniform_sql('99', 'citing', 'cited')}, 12) FROM test"""),
    ("sg", """SELECT method, score, pos, neg,
                     sum(pos) OVER (PARTITION BY method ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
                     sum(neg) OVER (PARTITION BY method ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
              FROM (SELECT method, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
                    FROM scored GROUP BY method, score)"""),
    ("auc", """SELECT method, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(neg * (cum_pos - pos + pos / 2)) / (sum(pos) * sum(neg)) END AS auc,
                      CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM sg GROUP BY method"""),
]
LINK_NAMES = ("papers", "link_edges", "raw_vectors")


@register("negative_edges", "M7 J13 J14 J6 D17 M3", with_views("SELECT citing, cited FROM neg", *LINK_NAMES, extra=LINK_VIEWS))
def q_negative_edges(spark, d):
    return link_sets(spark, d)[1]


@register("link_prediction", "E5 U1 J9 V9 E4", with_views(
    "SELECT method, round(auc, 6) AS auc, n_pos, n_neg FROM auc", *LINK_NAMES, extra=LINK_VIEWS))
def q_link_prediction(spark, d):
    a = evaluate.roc_auc(scored_links(spark, d), "method")
    return a.select("method", R6(F.col("auc")).alias("auc"), "n_pos", "n_neg")


@register("link_prediction_embeddings", "E5 V1 V3 V5 J9 V9 E4")
def q_link_prediction_embeddings(spark, d):
    """AUC of every embedding built here on the graph without the held-out edges, beside the given vectors."""
    from citeweave.operators import linalg

    pos, neg = link_sets(spark, d)
    test = materialize(pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0))), "link-test")
    held = test.where("label = 1").select("citing", "cited")
    net = fx.link_edges(spark, d).select("citing", "cited").distinct().join(held, ["citing", "cited"], "left_anti")
    g = materialize(G.build_graph(net, "citing", "cited"), "link-graph")
    ids = G.nodes_of(g).select(F.col("node").alias("id"))
    U, s = linalg.randomized_svd(G.normalized_adjacency(g), ids, DIM, seed=1)
    eigenmap, _ = linalg.laplacian_eigenmap(g, ids, DIM, seed=2)
    pairs = materialize(W.piece_pairs(W.walk_pieces(g, NUM_WALKS, WALK_LENGTH, seed=3, undirected=True), WINDOW, WALK_LENGTH), "link-pairs")
    R, r = linalg.randomized_svd(linalg.residual_matrix(pairs, g), ids, DIM, seed=3)
    methods = {"given": fx.raw_vectors(spark, d).select("id", "vec"), "svd": linalg.factor_embedding(U, s), "eigenmap": eigenmap,
               "residual2vec": linalg.factor_embedding(R, r)}
    scored = None
    for name, vectors in methods.items():
        one = V.pair_cosine(test, vectors, "citing", "cited", key="id", how="left").select(F.lit(name).alias("method"), "label", F.col("cos_sim").alias("score"))
        scored = one if scored is None else scored.unionByName(one)
    a = evaluate.roc_auc(materialize(scored, "link-scores"), "method")
    return a.select("method", R6(F.col("auc")).alias("auc"), "n_pos", "n_neg")


@register("roc_auc", "E4 W7", with_views(
    "SELECT method, round(auc, 6) AS auc, CAST(row_number() OVER (ORDER BY auc DESC, method) AS INTEGER) AS auc_rank FROM auc",
    *LINK_NAMES, extra=LINK_VIEWS))
def q_roc_auc(spark, d):
    a = evaluate.roc_auc(scored_links(spark, d), "method")
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("auc"), "method"))  # one row per method
    return a.select("method", R6(F.col("auc")).alias("auc"), rank.cast("int").alias("auc_rank"))


@register("roc_curve", "E3 W13", with_views(
    """SELECT method, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM (
         SELECT p.method, p.threshold, p.fps / t.N AS fpr, p.tps / t.P AS tpr FROM (
           SELECT method, score AS threshold, cum_pos AS tps, cum_neg AS fps,
                  lag(cum_neg) OVER w AS pf, lead(cum_neg) OVER w AS nf, lag(cum_pos) OVER w AS pt, lead(cum_pos) OVER w AS nt
           FROM sg WINDOW w AS (PARTITION BY method ORDER BY score DESC)) p
         JOIN (SELECT method, max(cum_pos) AS P, max(cum_neg) AS N FROM sg GROUP BY method) t ON p.method = t.method
         WHERE pf IS NULL OR nf IS NULL OR (nf - 2 * fps + pf) <> 0 OR (nt - 2 * tps + pt) <> 0
         UNION ALL SELECT DISTINCT method, NULL, 0.0, 0.0 FROM sg)""",
    *LINK_NAMES, extra=LINK_VIEWS))
def q_roc_curve(spark, d):
    r = evaluate.roc_curve(scored_links(spark, d), "method")
    return r.select("method", "threshold", R6(F.col("fpr")).alias("fpr"), R6(F.col("tpr")).alias("tpr"))


# ================================================================== graph SQL helpers
BIP_VIEWS = [
    ("g", "SELECT src, dst, 1.0 AS w FROM (SELECT src, dst FROM bipartite_edges UNION SELECT dst, src FROM bipartite_edges)"),
    ("nidx", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM g UNION SELECT dst FROM g)"),
    ("gi", "SELECT a.idx AS src, b.idx AS dst, g.w FROM g JOIN nidx a ON g.src = a.node JOIN nidx b ON g.dst = b.node"),
]
CIT_UND = ("gi", "SELECT src, dst, 1.0 AS w FROM (SELECT citing AS src, cited AS dst FROM citations UNION SELECT cited, citing FROM citations)")
CIT_DIR = ("gi", "SELECT DISTINCT citing AS src, cited AS dst, 1.0 AS w FROM citations")


def cum_view(src: str = "gi", name: str = "ce", order: str = "dst") -> tuple[str, str]:
    run = f"sum(w) OVER (PARTITION BY src ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    tot = "sum(w) OVER (PARTITION BY src)"
    return (name, f"SELECT src, dst, w, ({run} - w) / {tot} AS lo, {run} / {tot} AS hi FROM {src}")


def walk_sql(W_: int, L: int, seed: int, restart: float | None = None, nodes: str = "(SELECT src AS n FROM gi UNION SELECT dst FROM gi)") -> str:
    u = uniform_sql(str(seed), "w.walk_id", "w.t + 1", "1")
    r = uniform_sql(str(seed), "w.walk_id", "w.t + 1", "0")
    cond = f" AND NOT ({r} <= {restart})" if restart else ""
    return f"""
        SELECT walk_id, t, cur FROM (
          WITH RECURSIVE walk(walk_id, start, t, cur) AS (
            SELECT s.n * {W_} + r.r, s.n, 0, s.n FROM {nodes} s CROSS JOIN range({W_}) r(r)
            UNION ALL
            SELECT w.walk_id, w.start, w.t + 1, e.dst FROM walk w JOIN ce e ON e.src = w.cur
            WHERE w.t + 1 < {L}{cond} AND e.lo <= {u} AND {u} < e.hi)
          SELECT walk_id, t, cur FROM walk
          UNION ALL
          SELECT s.n * {W_} + r.r, 1, s.n FROM {nodes} s CROSS JOIN range({W_}) r(r)
          WHERE {L} > 1 AND s.n NOT IN (SELECT src FROM gi))"""


def bip_graph(spark, d):
    nodes, gi = W.index_graph(G.build_graph(fx.bipartite_edges(spark, d)))
    return nodes, materialize(gi, "indexed-graph")  # read several times


def cit_graph(spark, d, mode="undirected"):
    return G.build_graph(fx.citations(spark, d), "citing", "cited", mode)


# ================================================================== walks
@register("random_walks", "G8 G2 G10", with_views(
    "SELECT w.walk_id, CAST(w.t AS INTEGER) AS t, n.node FROM walks w JOIN nidx n ON w.cur = n.idx",
    "bipartite_edges", extra=BIP_VIEWS + [cum_view(), ("walks", walk_sql(NUM_WALKS, WALK_LENGTH, 1))]))
def q_random_walks(spark, d):
    nodes, gi = bip_graph(spark, d)
    w = W.random_walks(gi, NUM_WALKS, WALK_LENGTH, seed=1, undirected=True).withColumnRenamed("node", "node_i")
    names = nodes.select(F.col("idx").alias("node_i"), "node")
    if fits_broadcast(names.count(), W.NODE_ROW_BYTES):  # the positions, which are many, stay where they are
        names = F.broadcast(names)
    return w.join(names, "node_i").select("walk_id", F.col("t").cast("int"), "node")


@register("random_walks_restart", "G9", with_views(
    "SELECT walk_id, CAST(t AS INTEGER) AS t, cur AS node FROM walks", "citations",
    extra=[CIT_DIR, cum_view(), ("walks", walk_sql(NUM_WALKS, WALK_LENGTH, 2, restart=0.01))]))
def q_random_walks_restart(spark, d):
    w = W.random_walks(cit_graph(spark, d, "to_cited"), NUM_WALKS, WALK_LENGTH, seed=2, restart_prob=0.01)
    return w.select("walk_id", F.col("t").cast("int"), "node")


def dangling_sql(W_: int, L: int, seed: int, nodes: str = "(SELECT src AS n FROM gi UNION SELECT dst FROM gi)") -> str:
    """Walks that jump back to their start from a node without out-edges."""
    u = uniform_sql(str(seed), "w.walk_id", "w.t + 1", "1")
    return f"""
        WITH RECURSIVE walk(walk_id, start, t, cur) AS (
          SELECT s.n * {W_} + r.r, s.n, 0, s.n FROM {nodes} s CROSS JOIN range({W_}) r(r)
          UNION ALL
          SELECT w.walk_id, w.start, w.t + 1, CASE WHEN e.dst IS NULL THEN w.start ELSE e.dst END
          FROM walk w LEFT JOIN ce e ON e.src = w.cur AND e.lo <= {u} AND {u} < e.hi WHERE w.t + 1 < {L})
        SELECT walk_id, t, cur FROM walk"""


@register("random_walks_dangling", "G9", with_views(
    "SELECT walk_id, CAST(t AS INTEGER) AS t, cur AS node FROM walks", "citations",
    extra=[CIT_DIR, cum_view(), ("walks", dangling_sql(NUM_WALKS, WALK_LENGTH, 6))]))
def q_random_walks_dangling(spark, d):
    w = W.random_walks(cit_graph(spark, d, "to_cited"), NUM_WALKS, WALK_LENGTH, seed=6, restart_at_dangling=True)
    return w.select("walk_id", F.col("t").cast("int"), "node")


def _so_views(p: float, q: float) -> list[tuple[str, str]]:
    cz = lambda a, b: f"(({a} + {b}) * ({a} + {b} + 1) // 2 + {b})"
    return [CIT_UND, ("so", f"""
        SELECT e1.src AS prev, e1.dst AS cur, e2.dst AS nxt,
               CASE WHEN e2.dst = e1.src THEN e2.w / {p} WHEN a.src IS NOT NULL THEN e2.w ELSE e2.w / {q} END AS w
        FROM gi e1 JOIN gi e2 ON e1.dst = e2.src LEFT JOIN gi a ON a.src = e1.src AND a.dst = e2.dst
        UNION ALL SELECT src, src, dst, w FROM gi"""),
            ("sg2", f"SELECT {cz('prev', 'cur')} AS src, {cz('cur', 'nxt')} AS dst, w, nxt FROM so"),
            ("ce", f"""SELECT src, dst, nxt, w, (sum(w) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w)
                          / sum(w) OVER (PARTITION BY src) AS lo,
                          sum(w) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                          / sum(w) OVER (PARTITION BY src) AS hi FROM sg2"""),
            ("starts", f"SELECT DISTINCT {cz('src', 'src')} AS n, src AS node FROM gi")]


@register("node2vec_edges", "G11", with_views(
    "SELECT prev, cur, nxt, round(w, 6) AS w FROM so", "citations", extra=_so_views(0.5, 2.0)[:2]))
def q_node2vec_edges(spark, d):
    so = G.second_order_edges(cit_graph(spark, d), 0.5, 2.0)
    return so.select("prev", "cur", "nxt", R6(F.col("w")).alias("w"))


@register("random_walks_biased", "G12 G11", with_views(
    f"""SELECT walk_id, CAST(t AS INTEGER) AS t, node FROM (
          WITH RECURSIVE walk(walk_id, t, cur, node) AS (
            SELECT s.n * {NUM_WALKS} + r.r, 0, s.n, s.node FROM starts s CROSS JOIN range({NUM_WALKS}) r(r)
            UNION ALL
            SELECT w.walk_id, w.t + 1, e.dst, e.nxt FROM walk w JOIN ce e ON e.src = w.cur
            WHERE w.t + 1 < {WALK_LENGTH} AND e.lo <= {uniform_sql('3', 'w.walk_id', 'w.t + 1', '1')}
              AND {uniform_sql('3', 'w.walk_id', 'w.t + 1', '1')} < e.hi)
          SELECT * FROM walk)""", "citations", extra=_so_views(0.5, 2.0)))
def q_random_walks_biased(spark, d):
    w = W.second_order_walks(cit_graph(spark, d), NUM_WALKS, WALK_LENGTH, 0.5, 2.0, seed=3)
    return w.select("walk_id", F.col("t").cast("int"), "node")


P, Q = 0.5, 2.0
REJECTION_LENGTH = 6  # every pass over the walkers is a join of all of them: few steps, from all nodes
_TOP = max(1 / P, 1.0, 1 / Q)


def _draw_sql(t: str, k: str, purpose: int) -> str:
    return uniform_sql("3", "walk_id", t, k, str(purpose))


@register("random_walks_rejection", "G12 G11", with_views(
    f"""SELECT walk_id, CAST(t - 1 AS INTEGER) AS t, cur AS node FROM (
          WITH RECURSIVE walk(walk_id, t, k, prev, cur, u) AS (
            SELECT walk_id, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), n, {_draw_sql('1', '0', 1)}
            FROM (SELECT n * {NUM_WALKS} + r AS walk_id, n FROM (SELECT src AS n FROM gi UNION SELECT dst FROM gi), range({NUM_WALKS}) t(r))
            UNION ALL
            SELECT walk_id, t1, k1, prev1, cur1, {_draw_sql('t1', 'k1', 1)} FROM (
              SELECT walk_id, CASE WHEN ok THEN t + 1 ELSE t END AS t1, CASE WHEN ok THEN 0 ELSE k + 1 END AS k1,
                     CASE WHEN ok THEN cur ELSE prev END AS prev1, CASE WHEN ok THEN dst ELSE cur END AS cur1 FROM (
                SELECT w.*, e.dst, {_draw_sql('t', 'k', 2)} * {_TOP} <
                         CASE WHEN w.prev IS NULL THEN {_TOP} WHEN e.dst = w.prev THEN {1 / P} WHEN a.src IS NOT NULL THEN 1.0 ELSE {1 / Q} END AS ok
                FROM walk w JOIN ce e ON e.src = w.cur AND e.lo <= w.u AND w.u < e.hi
                     LEFT JOIN gi a ON a.src = w.prev AND a.dst = e.dst WHERE w.t < {REJECTION_LENGTH})))
          SELECT * FROM walk) WHERE k = 0""", "citations", extra=[CIT_UND, cum_view()]))
def q_random_walks_rejection(spark, d):
    w = W.rejection_walks(cit_graph(spark, d), NUM_WALKS, REJECTION_LENGTH, P, Q, seed=3)
    return w.select("walk_id", F.col("t").cast("int"), "node")


@register("context_pairs", "W11 G13 G14 A16 P24", with_views(
    """SELECT a.cur AS center, b.cur AS context, CAST(count(*) AS DOUBLE) AS freq
       FROM walks a JOIN walks b ON a.walk_id = b.walk_id AND b.t BETWEEN a.t + 1 AND a.t + """ + f"""{WINDOW}
       WHERE a.t < {WALK_LENGTH} - {WINDOW} GROUP BY a.cur, b.cur""",
    "bipartite_edges", extra=BIP_VIEWS + [cum_view(), ("walks", walk_sql(NUM_WALKS, WALK_LENGTH, 1))]))
def q_context_pairs(spark, d):
    _, gi = bip_graph(spark, d)
    return W.piece_pairs(W.walk_pieces(gi, NUM_WALKS, WALK_LENGTH, seed=1, undirected=True), WINDOW, WALK_LENGTH)


@register("rolling_windows", "W10 G13", with_views(
    """SELECT walk_id, CAST(t AS INTEGER) AS pos, win FROM (
         SELECT walk_id, t, string_agg(CAST(cur AS VARCHAR), ',' ORDER BY t) OVER (PARTITION BY walk_id ORDER BY t
                ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS win,
                count(*) OVER (PARTITION BY walk_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c
         FROM walks) WHERE c = 3""",
    "bipartite_edges", extra=BIP_VIEWS + [cum_view(), ("walks", walk_sql(NUM_WALKS, WALK_LENGTH, 1))]))
def q_rolling_windows(spark, d):
    _, gi = bip_graph(spark, d)
    arr = W.whole_walks(W.walk_pieces(gi, NUM_WALKS, WALK_LENGTH, seed=1, undirected=True))
    ex = arr.select("walk_id", F.posexplode(W.rolling_windows("nodes", 3)).alias("pos", "win"))
    return ex.select("walk_id", F.col("pos").cast("int"), F.concat_ws(",", F.transform("win", lambda x: x.cast("string"))).alias("win"))


@register("sample_neighbor", "G10", with_views(
    f"""SELECT a.node, b.node AS neighbor FROM nidx n JOIN ce e ON e.src = n.idx
        JOIN nidx a ON a.idx = n.idx JOIN nidx b ON b.idx = e.dst
        WHERE e.lo <= {uniform_sql('31', 'n.idx')} AND {uniform_sql('31', 'n.idx')} < e.hi""",
    "bipartite_edges", extra=BIP_VIEWS + [cum_view()]))
def q_sample_neighbor(spark, d):
    nodes, gi = bip_graph(spark, d)
    f = nodes.withColumn("u", hash_uniform(F.lit(31), F.col("idx")))
    r = W.roulette(f, gi, "idx", "u", "nb")
    names = nodes.select(F.col("idx").alias("nb"), F.col("node").alias("neighbor"))
    return r.join(names, "nb").select("node", "neighbor")


@register("config_context", "G15 D12", with_views(
    f"""SELECT d.center, c2.dst AS context, CAST(count(*) AS DOUBLE) AS freq FROM (
          SELECT n.node AS center, n.gid AS g0, n.node * 3 + r.r AS draw FROM grp n CROSS JOIN range(3) r(r)) d
        JOIN gce g1 ON g1.src = d.g0 AND g1.lo <= {uniform_sql('41', 'd.draw', '0')} AND {uniform_sql('41', 'd.draw', '0')} < g1.hi
        JOIN cce c2 ON c2.src = g1.dst AND c2.lo <= {uniform_sql('41', 'd.draw', '1')} AND {uniform_sql('41', 'd.draw', '1')} < c2.hi
        GROUP BY d.center, c2.dst""",
    "citations", "papers", extra=[CIT_UND,
        ("grp", "SELECT n.node, p.journal AS gid FROM (SELECT src AS node FROM gi UNION SELECT dst FROM gi) n JOIN papers p ON n.node = p.id"),
        ("gg", """SELECT a.gid AS src, b.gid AS dst, sum(gi.w) AS w FROM gi JOIN grp a ON gi.src = a.node JOIN grp b ON gi.dst = b.node
                  GROUP BY a.gid, b.gid"""),
        cum_view("gg", "gce"),
        ("c2n", "SELECT g.gid AS src, i.node AS dst, i.w FROM (SELECT dst AS node, sum(w) AS w FROM gi GROUP BY dst) i JOIN grp g ON i.node = g.node"),
        cum_view("c2n", "cce")]))
def q_config_context(spark, d):
    g = cit_graph(spark, d)
    groups = G.nodes_of(g).join(fx.papers(spark, d).select(F.col("id").alias("node"), F.col("journal").alias("gid")), "node")
    return W.config_context_pairs(g, groups, 3, seed=41)


# ================================================================== matrix powers
def _pt_views(restart: float, steps: int, offset: int):
    w = [(1 - restart) ** i for i in range(steps)]
    tot = sum(w)
    views = [CIT_UND, ("P1", "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM gi")]
    for i in range(2, steps + 1):
        views.append((f"P{i}", f"""SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM P{i - 1} a JOIN P1 b ON a.dst = b.src GROUP BY a.src, b.dst"""))
    terms = " UNION ALL ".join(f"SELECT src, dst, w * {w[i] / tot!r} AS w FROM P{i + 1}" for i in range(offset, steps))
    views.append(("rwr", f"SELECT src, dst, sum(w) AS w FROM ({terms}) GROUP BY src, dst"))
    return views


@register("rwr_matrix", "G16 V2", with_views("SELECT src, dst, round(w, 6) AS w FROM rwr", "citations", extra=_pt_views(0.2, 3, 1)))
def q_rwr_matrix(spark, d):
    P = G.transition_matrix(cit_graph(spark, d)).select("src", "dst", F.col("p").alias("w"))
    r = G.rwr_matrix(P, 0.2, 3, offset=1)
    return r.select("src", "dst", R6(F.col("w")).alias("w"))


def _stationary_views(steps: int):
    views = [CIT_UND, ("P1", "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM gi"),
             ("nodes", "SELECT src AS node FROM gi UNION SELECT dst FROM gi"),
             ("x0", "SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS x FROM nodes")]
    for i in range(1, steps + 1):
        views.append((f"x{i}", f"SELECT P1.dst AS node, sum(v.x * P1.p) AS x FROM x{i - 1} v JOIN P1 ON v.node = P1.src GROUP BY P1.dst"))
    every = " UNION ALL ".join(f"SELECT node, x FROM x{i}" for i in range(steps + 1))
    views.append(("total", f"SELECT node, sum(x) AS x FROM ({every}) GROUP BY node"))
    return views


@register("stationary_dist", "G17", with_views(
    "SELECT node, round(x / (SELECT sum(x) FROM total) * 1e3, 6) AS pi_milli FROM total", "citations", extra=_stationary_views(30)))
def q_stationary_dist(spark, d):
    P = G.transition_matrix(cit_graph(spark, d))
    nodes = G.nodes_of(P)
    pi = G.stationary_distribution(P, nodes, 30)
    return pi.select("node", R6(F.col("pi") * 1e3).alias("pi_milli"))


# ================================================================== components
COMP_VIEWS = [
    ("und", "SELECT citing AS a, cited AS b FROM citations UNION SELECT cited, citing FROM citations"),
    ("comp", """SELECT node, min(lab) AS component FROM (
                  WITH RECURSIVE reach(node, lab) AS (
                    SELECT a, a FROM und UNION SELECT r.node, u.b FROM reach r JOIN und u ON r.lab = u.a)
                  SELECT * FROM reach) GROUP BY node"""),
]


@register("connected_components", "G4", with_views("SELECT node, component FROM comp", "citations", extra=COMP_VIEWS))
def q_connected_components(spark, d):
    return C.connected_components(fx.citations(spark, d), "citing", "cited")


@register("largest_component", "G5 W14", with_views(
    """SELECT DISTINCT c.citing, c.cited FROM citations c JOIN comp a ON c.citing = a.node JOIN comp b ON c.cited = b.node
       WHERE a.component = (SELECT component FROM (SELECT component, count(*) AS s FROM comp GROUP BY component)
                            ORDER BY s DESC, component LIMIT 1)
         AND b.component = a.component""", "citations", extra=COMP_VIEWS))
def q_largest_component(spark, d):
    e = fx.citations(spark, d).distinct()
    comp = C.connected_components(e, "citing", "cited")
    return C.largest_component(e, comp, "citing", "cited")
