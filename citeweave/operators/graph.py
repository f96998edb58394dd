"""Graphs as edge tables ``src, dst, w`` (COO form) and node tables.

Sparse-matrix work of the reference (degrees, transition matrices, normalised
adjacency, multi-step walk matrices, stationary distributions) becomes joins and
aggregates over the edge table; nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.functions.columns import safe_log
from citeweave.operators.prefix import prefix_sums
from citeweave.session import materialize


def build_graph(edges: DataFrame, src: str = "src", dst: str = "dst", mode: str = "undirected") -> DataFrame:
    """Edge table from an edge list (G1, G3): duplicates collapse, weight 1.

    ``mode``: ``undirected`` (both directions), ``to_cited`` (src -> dst as given),
    ``to_citing`` (reversed).
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if mode == "to_cited":
        g = e
    elif mode == "to_citing":
        g = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif mode == "undirected":
        # each pair is made single once, in one order of its ends, before it is turned round
        lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
        one, turned = F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"))
        both = F.explode(F.when(F.col("lo") == F.col("hi"), F.array(one)).otherwise(F.array(one, turned))).alias("e")
        return e.select(lo.alias("lo"), hi.alias("hi")).distinct().select(both).select("e.src", "e.dst").withColumn("w", F.lit(1.0))
    else:
        raise ValueError(mode)
    return g.distinct().withColumn("w", F.lit(1.0))


def nodes_of(edges: DataFrame, src: str = "src", dst: str = "dst", out: str = "node") -> DataFrame:
    """Node list = distinct ids over both edge ends."""
    return edges.select(F.col(src).alias(out)).union(edges.select(F.col(dst).alias(out))).distinct()


def degrees(g: DataFrame, w: str = "w") -> DataFrame:
    """Weighted out- and in-degree per node (A12); zero when a node has none."""
    out_d = g.groupBy(F.col("src").alias("node")).agg(F.sum(w).alias("out_deg"))
    in_d = g.groupBy(F.col("dst").alias("node")).agg(F.sum(w).alias("in_deg"))
    return out_d.join(in_d, "node", "full").fillna(0.0, ["out_deg", "in_deg"])


def quantile_flag(nodes: DataFrame, value: str, q: float, out: str = "is_hub",
                  hi: str = "Core", lo: str = "Periphery") -> DataFrame:
    """Flag ``value >= quantile(value, q)`` (A13): the exact, linearly interpolated
    quantile, read off the running counts of the histogram of distinct values, which stay
    distributed; only the two values around the position reach the driver."""
    hist = nodes.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_f"))
    cum = prefix_sums(hist, ["_v"], ["_f"])
    total = cum.agg(F.max("cum__f").alias("n")).first()["n"]
    if not total:
        return nodes.withColumn(out, F.lit(lo))
    at = q * (total - 1)
    two = cum.agg(F.min(F.when(F.col("cum__f") > math.floor(at), F.col("_v"))).alias("a"), F.min(F.when(F.col("cum__f") > math.ceil(at), F.col("_v"))).alias("b")).first()
    thr = two["a"] + (at - math.floor(at)) * (two["b"] - two["a"])
    return nodes.withColumn(out, F.when(F.col(value) >= F.lit(thr), hi).otherwise(lo))


def sum_duplicates(triples: DataFrame, r: str = "src", c: str = "dst", v: str = "w",
                   min_value: float | None = None) -> DataFrame:
    """Merge duplicate (row, col) entries by summing; drop entries below a threshold."""
    s = triples.groupBy(F.col(r).alias("src"), F.col(c).alias("dst")).agg(F.sum(v).alias("w"))
    return s if min_value is None else s.where(F.col("w") >= min_value)


def transition_matrix(g: DataFrame) -> DataFrame:
    """Row-normalised transition probabilities ``p = w / sum_src(w)`` (G6).  A node
    without out-edges simply has no rows (its row stays zero)."""
    tot = g.groupBy("src").agg(F.sum("w").alias("_tot"))
    return g.join(tot, "src").withColumn("p", F.col("w") / F.col("_tot")).drop("_tot")


def _running(g: DataFrame) -> DataFrame:
    """Edges with ``_run`` (weight up to and with the edge, neighbours in ``dst`` order), ``_tot``
    and ``deg`` of the source.

    Edges are range-partitioned by (src, dst), so a hub's edges lie in many partitions.
    Sums run inside each (src, partition) part; a source's parts, at most as many as there are
    partitions, give each part's offset.  No task holds a whole hub."""
    parts = max(1, int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = materialize(g.repartitionByRange(parts, "src", "dst").withColumn("_part", F.spark_partition_id()), "edge-ranges")
    sums = laid.groupBy("src", "_part").agg(F.sum("w").alias("_s"), F.count(F.lit(1)).alias("_n"))
    of_src = Window.partitionBy("src")
    before = F.sum("_s").over(of_src.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_s")
    offsets = sums.select("src", "_part", before.alias("_before"), F.sum("_s").over(of_src).alias("_tot"), F.sum("_n").over(of_src).alias("deg"))
    inside = Window.partitionBy("src", "_part").orderBy("dst").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return laid.withColumn("_in", F.sum("w").over(inside)).join(offsets, ["src", "_part"]) \
        .withColumn("_run", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def transition_cumprob(g: DataFrame) -> DataFrame:
    """Cumulative transition probability per row, neighbours in ``dst`` order."""
    return _running(g).withColumn("cum", F.col("_run") / F.col("_tot")).drop("_run", "_tot", "deg")


def cum_edges(g: DataFrame) -> DataFrame:
    """Edges with their roulette interval ``[lo, hi)`` inside the source row
    (neighbours in ``dst`` order) and the source degree (number of neighbours)."""
    return _running(g).select("src", "dst", "w", ((F.col("_run") - F.col("w")) / F.col("_tot")).alias("lo"),
                              (F.col("_run") / F.col("_tot")).alias("hi"), "deg")


def normalized_adjacency(g: DataFrame, floor: float = 1e-12) -> DataFrame:
    """D^-1/2 A D^-1/2 with degree floor (G18); degree = weighted row sum."""
    deg = g.groupBy("src").agg(F.sum("w").alias("_d"))
    ds = deg.select(F.col("src"), F.greatest(F.col("_d"), F.lit(floor)).alias("_ds"))
    dt = deg.select(F.col("src").alias("dst"), F.greatest(F.col("_d"), F.lit(floor)).alias("_dt"))
    return (g.join(ds, "src").join(dt, "dst", "left").fillna(floor, ["_dt"])
            .withColumn("w", F.col("w") / F.sqrt(F.col("_ds") * F.col("_dt"))).select("src", "dst", "w"))


def matmul_sparse(a: DataFrame, b: DataFrame, min_value: float | None = None) -> DataFrame:
    """COO sparse product: join on the inner index, sum per (i, j)."""
    prod = a.select(F.col("src").alias("i"), F.col("dst").alias("k"), F.col("w").alias("wa")).join(
        b.select(F.col("src").alias("k"), F.col("dst").alias("j"), F.col("w").alias("wb")), "k")
    s = prod.groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
    return s if min_value is None else s.where(F.col("w") >= min_value)


def rwr_matrix(P: DataFrame, restart: float, max_step: int, offset: int = 0, min_value: float | None = None) -> DataFrame:
    """Multi-step walk matrix ``sum_{i>=offset} w_i P^(i+1)`` with
    ``w_i = (1-r)^i / sum_k (1-r)^k`` over all ``max_step`` steps (G16).  Each
    power is one join and one aggregate; ``min_value`` prunes fill-in."""
    weights = [(1 - restart) ** i for i in range(max_step)]
    kept = list(range(offset, max_step))
    tot = sum(weights)
    acc = None
    power = P = materialize(P.select("src", "dst", "w"), "walk-matrix")
    for i in range(max_step):
        if i > 0:  # stored, so that each power is computed once
            power = materialize(matmul_sparse(power, P, min_value), f"power{i + 1}")
        if i in kept:
            term = power.select("src", "dst", (F.col("w") * (weights[i] / tot)).alias("w"))
            acc = term if acc is None else acc.unionByName(term)
    return acc.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def stationary_distribution(P: DataFrame, nodes: DataFrame, iterations: int = 30) -> DataFrame:
    """Normalised ``x0 + x0 P + ... + x0 P^iterations`` from the uniform vector
    ``x0`` (G17).  The vector is one row per node; lineage is cut by a
    checkpoint every few steps."""
    P = materialize(P.select("src", "dst", "p"), "transitions")
    nodes = materialize(nodes, "nodes")
    x = nodes.select(F.col("node"), F.lit(1.0 / nodes.count()).alias("x"))
    acc = x
    for it in range(iterations):
        nx = (x.join(P.select(F.col("src").alias("node"), "dst", "p"), "node")
               .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("x")))
        x = materialize(nx, "vector")
        acc = acc.unionByName(x)
        if it % 10 == 9:
            acc = materialize(acc.groupBy("node").agg(F.sum("x").alias("x")), "sum")
    acc = materialize(acc.groupBy("node").agg(F.sum("x").alias("x")), "sum")
    total = acc.agg(F.sum("x").alias("t")).first()["t"]  # a scalar
    return acc.select("node", (F.col("x") / F.lit(total)).alias("pi"))


def elementwise_log(g: DataFrame, minval: float = 1e-12) -> DataFrame:
    """``log(max(w, minval))`` on stored entries of a sparse matrix (P25)."""
    return g.withColumn("w", safe_log("w", minval))


def second_order_edges(g: DataFrame, p: float, q: float, add_source: bool = True) -> DataFrame:
    """node2vec second-order transition network.

    States are directed edges (prev, cur).  From (prev, cur) to (cur, nxt) the
    weight is w/p when ``nxt == prev``, w when ``nxt`` is a neighbour of
    ``prev``, else w/q.  With ``add_source`` each node also gets a start state
    (i, i) whose moves carry the plain edge weights.  The common-neighbour test
    is a hash join on (prev, nxt) against the edge table, not a scan.
    """
    e1 = g.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    e2 = g.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), F.col("w"))
    pairs = e1.join(e2, "cur")
    adj = g.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"), F.lit(True).alias("_nb"))
    t = pairs.join(adj, ["prev", "nxt"], "left")
    w = (F.when(F.col("nxt") == F.col("prev"), F.col("w") / p)
         .when(F.col("_nb"), F.col("w")).otherwise(F.col("w") / q))
    out = t.select("prev", "cur", "nxt", w.alias("w"))
    if add_source:
        start = g.select(F.col("src").alias("prev"), F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w")
        out = out.unionByName(start)
    return out
