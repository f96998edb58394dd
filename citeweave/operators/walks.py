"""Random-walk corpora as distributed jobs.

Walkers are rows ``(walk_id, start, cur, deg)``; one step is one equi-join of
the frontier with a *bucketed* edge table.  Each edge owns the interval
``[lo, hi)`` of its source's roulette wheel and is listed under every bucket
``floor(x * deg)`` its interval touches, so a walker with uniform number ``u``
joins on ``(cur, floor(u * deg))`` and keeps the one edge with
``lo <= u < hi``.  Hubs are never gathered into one array or task: their edges
spread over ``deg`` join keys.  The uniform numbers are a portable hash of
``(seed, walk_id, step, purpose)``, so the corpus does not depend on
partitioning or retries, and a lost executor recomputes exactly the same walk.

Walk steps are stored as rows ``(walk_id, t, node)`` - no padding (D10).

Plain walks over undirected graphs without weights (``packed_walks``) need no search: edges lie in shards by their position
in the order of (source, end), a walker draws the position of its next edge, and rows of many walkers go to the shards of
their edges, where each step is array operations (``operators.packed``).  The draws are the same.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.columns import cantor_pair, cantor_unpair, hash_uniform
from citeweave.operators import graph as G
from citeweave.operators import packed
from citeweave.operators.prefix import dense_index
from citeweave.session import fits_broadcast, fixed_plans, keep_layout, materialize, tasks_for

# bytes per bucketed edge row (src, bucket, dst, lo, hi, dst_deg) used for the broadcast size check
EDGE_ROW_BYTES = 64
NODE_ROW_BYTES = 24  # a node's number and name


def index_graph(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense integer ids for the nodes of an edge table (G2): returns
    ``(nodes(node, idx), edges(src, dst, w))`` with integer ``src``/``dst``; the nodes are stored."""
    g = materialize(g, "named-graph")
    nodes = materialize(dense_index(G.nodes_of(g), ["node"], out="idx"), "node-index")
    # the edges, which are many, stay where they are
    known = F.broadcast(nodes) if fits_broadcast(nodes.count(), NODE_ROW_BYTES) else nodes
    ns = known.select(F.col("node").alias("src"), F.col("idx").alias("_s"))
    nd = known.select(F.col("node").alias("dst"), F.col("idx").alias("_d"))
    e = g.join(ns, "src").join(nd, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")
    return nodes, e


def bucketed_edges(g: DataFrame, with_dst_deg: bool = True) -> DataFrame:
    """``src, bucket, dst, lo, hi[, dst_deg]`` (see module doc)."""
    ce = G.cum_edges(g)
    deg = g.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("dst_deg"))
    first = F.floor(F.col("lo") * F.col("deg")).cast("long")
    last = F.least(F.floor(F.col("hi") * F.col("deg")).cast("long"), (F.col("deg") - 1).cast("long"))
    b = ce.select("src", "dst", "lo", "hi", F.explode(F.sequence(first, last)).alias("bucket"))
    if not with_dst_deg:
        return b
    return b.join(deg, "dst", "left").fillna(0, ["dst_deg"])


STEPS_PER_STORE = 10
DRAWS_PER_STORE = 2  # of rejection walks, whose plan for one draw is large
NODES_PER_TASK = 4_000_000  # walk positions of a task that puts walks together
PAIRS_PER_TASK = 2_000_000  # pairs of a task that counts them, so that its table stays in memory


def laid_out(be: DataFrame) -> DataFrame:
    """Bucketed edges for the steps of walks: to broadcast if their counted size is small, else checkpointed in the
    partitions and order of the join, so no step moves or sorts them again, and cached in columns, which a step reads
    faster than the checkpoint.  Callers unpersist them after the last step."""
    be = materialize(be, "walk-edges")
    if fits_broadcast(be.count(), EDGE_ROW_BYTES):
        return F.broadcast(be)
    n = int(be.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep_layout(be.repartition(n, "src", "bucket").sortWithinPartitions("src", "bucket")).persist()


def _bucket(u: str, deg: str) -> F.Column:
    return F.least(F.floor(F.col(u) * F.col(deg)).cast("long"), (F.col(deg) - 1).cast("long"))


def _draw(f: DataFrame, be: DataFrame, move: F.Column) -> DataFrame:
    """``f`` with ``dst, dst_deg``: the edge of ``cur`` that the draw ``_u`` falls on, for rows where ``move`` holds."""
    # walkers that do not move get keys of their own, which match nothing and spread evenly
    f = f.withColumn("_key", F.when(move, F.col("cur")).otherwise(-1 - F.col("walk_id"))).withColumn(
        "_bucket", F.when(move, _bucket("_u", "deg")).otherwise(F.lit(-1)))
    on = (f["_key"] == be["src"]) & (f["_bucket"] == be["bucket"]) & (be["lo"] <= f["_u"]) & (f["_u"] < be["hi"])
    return f.join(be, on, "left")


def _step(front: DataFrame, be: DataFrame, t: int, seed: int, restart_prob: float,
          restart_at_dangling: bool) -> DataFrame:
    """Advance every walker by one step (``walk_id, cur, deg, path``, and ``start, start_deg`` if it may jump back;
    ``cur`` is null once a walk has ended).  The path grows by the node reached."""
    live = F.col("cur").isNotNull()
    f = front.withColumn("_u", hash_uniform(F.lit(seed), F.col("walk_id"), F.lit(t), F.lit(1)))
    jump = live & (F.col("deg") == 0)
    if restart_prob > 0:
        jump = live & ((F.col("deg") == 0) | (hash_uniform(F.lit(seed), F.col("walk_id"), F.lit(t), F.lit(0)) <= F.lit(restart_prob)))
    f = f.withColumn("_jump", jump)
    j = _draw(f, be, live & ~F.col("_jump"))
    cur, deg = F.col("dst"), F.col("dst_deg")
    if restart_at_dangling:
        cur = F.when(F.col("_jump"), F.col("start")).otherwise(cur)
        deg = F.when(F.col("_jump"), F.col("start_deg")).otherwise(deg)
    fixed = [c for c in front.columns if c not in ("cur", "deg", "path")]
    return j.select(*fixed, cur.alias("cur"), deg.alias("deg"),
                    F.when(cur.isNull(), F.col("path")).otherwise(F.concat("path", F.array(cur))).alias("path"))


def _starts(g: DataFrame, num_walks: int, start_nodes: DataFrame | None) -> DataFrame:
    """``walk_id, start, deg``: ``num_walks`` walkers at every node or at ``start_nodes(node)``."""
    deg = g.groupBy(F.col("src").alias("start")).agg(F.count(F.lit(1)).alias("deg"))
    nodes = G.nodes_of(g) if start_nodes is None else start_nodes
    starts = nodes.select(F.col("node").cast("long").alias("start")).distinct().join(deg, "start", "left").fillna(0, ["deg"])
    return starts.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_walks - 1).cast("long")))).select(
        (F.col("start") * num_walks + F.col("rep")).alias("walk_id"), "start", "deg")


def walk_pieces(g: DataFrame, num_walks: int, walk_length: int, *, seed: int = 0, restart_prob: float = 0.0,
                restart_at_dangling: bool = False, start_nodes: DataFrame | None = None, undirected: bool = False) -> DataFrame | PackedWalks:
    """The corpus of ``random_walks`` as it is stored: ``walk_id, start, t, path`` with up to ``STEPS_PER_STORE`` nodes in
    ``path``, the first at position ``t``; or packed, where the caller knows that ``g`` is ``undirected`` and its edges weigh 1.

    The bucketed edge table is stored once (``laid_out``).  The walkers carry the nodes of
    ``STEPS_PER_STORE`` steps before they are written, so lineage stays that deep, and nothing else that a step does not
    need: every step may shuffle them."""
    g = materialize(g.select("src", "dst", "w"), "walk-graph")
    if undirected and not restart_prob and not restart_at_dangling and start_nodes is None:
        found = packed_walks(g, num_walks, walk_length, seed)
        if found is not None:
            return found
    be = laid_out(bucketed_edges(g))
    state = ["walk_id", "start", "start_deg"] if restart_at_dangling else ["walk_id"]
    front = _starts(g, num_walks, start_nodes).select(
        "walk_id", "start", F.col("deg").alias("start_deg"), F.col("start").alias("cur"), "deg", F.array("start").alias("path"))
    if not restart_at_dangling and walk_length > 1:
        # a walker that starts at a sink records itself once more (t = 1)
        front = front.withColumn("path", F.when(F.col("deg") == 0, F.array("start", "start")).otherwise(F.col("path")))
    front = materialize(front.select(*state, "cur", "deg", "path"), "walkers0")
    # walk ids are start * num_walks + number of the walk
    start = F.expr(f"(walk_id - pmod(walk_id, {num_walks}L)) div {num_walks}L").alias("start")
    parts = [front.select("walk_id", start, F.lit(0).alias("t"), "path")]
    for first in range(1, walk_length, STEPS_PER_STORE):
        front = front.where(F.col("cur").isNotNull()).withColumn("path", F.array().cast("array<bigint>"))
        for t in range(first, min(first + STEPS_PER_STORE, walk_length)):
            front = _step(front, be, t, seed, restart_prob, restart_at_dangling)
        front = materialize(front, f"walkers{first}")
        parts.append(front.select("walk_id", start, F.lit(first).alias("t"), "path"))
    be.unpersist()
    return _union(parts)


EDGES_PER_SHARD, EDGES_AT_LEAST = 1 << 20, 1 << 14  # of packed walks
WALKS_PER_BUCKET = 1 << 14
PACKED_STEPS = 5  # between writes of packed walkers


class PackedWalks(NamedTuple):
    """Walks of ``length`` nodes each, stored as rows ``bucket, t, ids, path`` of many walkers: ``path`` has their nodes from position ``t`` on."""

    rows: DataFrame
    num_walks: int
    length: int
    kind: str  # of a node's number
    ids: int  # nodes are below it
    walks: int


def edge_positions(g: DataFrame, n: int) -> DataFrame:
    """``src, dst, pos``: the place of each of the ``n`` edges in the order of (src, dst).  Edges are range-partitioned, so a hub's lie
    in many partitions, whose sizes (a number each) give each partition's offset."""
    spark = g.sparkSession
    laid = g.select("src", "dst").repartitionByRange(tasks_for(spark, n, EDGES_PER_SHARD), "src", "dst").withColumn("_part", F.spark_partition_id())
    laid, run, offsets = materialize(laid, "edge-ranges"), 0, []
    for r in sorted(laid.groupBy("_part").count().collect()):
        offsets.append((r["_part"], run))
        run += r["count"]
    place = F.row_number().over(Window.partitionBy("_part").orderBy("src", "dst"))
    before = spark.createDataFrame(offsets, "_part int, _before long")
    return materialize(laid.withColumn("_n", place).join(F.broadcast(before), "_part").select("src", "dst", (F.col("_before") + F.col("_n") - 1).alias("pos")), "edge-positions")


def packed_walks(g: DataFrame, num_walks: int, walk_length: int, seed: int) -> PackedWalks | None:
    """The corpus of ``random_walks`` over a stored graph that has every edge in both directions, or None where edges have weights or ids
    are not whole numbers from 0.

    A walker is expected on an edge no more than ``num_walks`` times, so a shard's walkers are bounded as its edges are."""
    spark = g.sparkSession
    if walk_length < 2 or not {dict(g.dtypes)[c] for c in ("src", "dst")} <= {"bigint", "int"}:
        return None
    lo, hi, light, heavy, n = g.agg(F.min("src"), F.max("src"), F.min("w"), F.max("w"), F.count(F.lit(1))).first()
    if not n or lo < 0 or (hi + 1) * num_walks >= 10**17 or light != 1 or heavy != 1 or len(str(seed)) > 20:
        return None
    kind = "<i4" if max(hi, n) < 1 << 31 else "<i8"
    shards = max(1, -(-n // EDGES_PER_SHARD), min(-(-n // EDGES_AT_LEAST), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    size = -(-n // shards)
    idx = edge_positions(g, n)
    nodes = materialize(idx.groupBy("src").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("deg")), "walk-nodes")
    walks = nodes.count() * num_walks
    ends = nodes.select(F.col("src").cast("long").alias("dst"), "first", "deg")
    edges = idx.select(F.col("dst").cast("long").alias("dst"), "pos").join(ends, "dst", "left").fillna(0, ["first", "deg"])
    edges = edges.withColumn("shard", F.expr(f"cast(pos div {size}L AS int)")).groupBy("shard").applyInArrow(packed.edges_fn(kind), "shard int, edges binary")
    edges = keep_layout(edges.repartition(shards, "shard").sortWithinPartitions("shard"))
    steps = packed.Steps(seed, size, -(-walks // WALKS_PER_BUCKET), kind)
    moving, stored = "shard int, ids binary, at binary, path binary", "bucket int, t int, ids binary, path binary, at binary"
    parts, front = [], nodes.select(F.col("src").cast("long").alias("src"), "first", "deg").mapInArrow(steps.started(num_walks), moving)
    with fixed_plans(spark):  # the edges keep their layout
        for first in range(1, walk_length, PACKED_STEPS):
            last = min(first + PACKED_STEPS, walk_length) - 1
            for t in range(first, last + 1):
                step = steps.taken(t, t - first, t == last, t == walk_length - 1)
                front = edges.groupBy("shard").cogroup(front.repartition(shards, "shard").groupBy("shard")).applyInArrow(step, stored if t == last else moving)
            front = materialize(front, f"walkers{first}")
            parts.append(front.select("bucket", "t", "ids", "path"))
            front = front.select("ids", "at").mapInArrow(steps.resumed(), moving)
    return PackedWalks(_union(parts), num_walks, walk_length, kind, hi + 1, walks)


def _by_bucket(p: PackedWalks, run, schema: str) -> DataFrame:
    n = tasks_for(p.rows.sparkSession, p.walks, WALKS_PER_BUCKET)
    return p.rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(run, schema)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def walk_rows(pieces: DataFrame) -> DataFrame:
    """``walk_id, start, t, node`` of stored pieces."""
    if isinstance(pieces, PackedWalks):
        return pieces.rows.select("t", "ids", "path").mapInArrow(packed.rows_fn(pieces.num_walks, pieces.kind), "walk_id long, start long, t int, node long")
    return pieces.select("walk_id", "start", F.col("t").alias("_t"), F.posexplode("path").alias("_p", "node")).select(
        "walk_id", "start", (F.col("_t") + F.col("_p")).alias("t"), "node")


def random_walks(g: DataFrame, num_walks: int, walk_length: int, *, seed: int = 0, restart_prob: float = 0.0,
                 restart_at_dangling: bool = False, start_nodes: DataFrame | None = None, undirected: bool = False) -> DataFrame:
    """Walk corpus over an integer-id edge table ``src, dst, w``.

    ``num_walks`` walkers start at every node (or at ``start_nodes(node)``),
    each visits up to ``walk_length`` positions.  A walker at a node without
    out-edges stops (a walker *starting* at a sink writes itself once more), or
    jumps back to its start with ``restart_at_dangling``; with probability
    ``restart_prob`` a step restarts (jump to start) or ends the walk.
    Returns ``walk_id, start, t, node``.
    """
    return walk_rows(walk_pieces(g, num_walks, walk_length, seed=seed, restart_prob=restart_prob,
                                 restart_at_dangling=restart_at_dangling, start_nodes=start_nodes, undirected=undirected))


def walk_arrays(walks: DataFrame) -> DataFrame:
    """One array per walk (bounded by ``walk_length``): ``walk_id, nodes``."""
    return walks.groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("t", "node"))).alias("_s")).select(
        "walk_id", F.transform("_s", lambda x: x["node"]).alias("nodes"))


def whole_walks(pieces: DataFrame) -> DataFrame:
    """:func:`walk_arrays` of stored pieces, which are put together without taking them apart.  As many tasks share the
    work as the number of nodes asks for."""
    if isinstance(pieces, PackedWalks):
        return _by_bucket(pieces, packed.lists_fn(pieces.num_walks, pieces.kind), "walk_id long, nodes array<long>")
    some = pieces.where(F.size("path") > 0)
    nodes = some.agg(F.sum(F.size("path")).alias("n")).first()["n"] or 0  # a scalar
    laid = some.select("walk_id", "t", "path").repartition(tasks_for(pieces.sparkSession, nodes, NODES_PER_TASK), "walk_id")
    return laid.groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("t", "path"))).alias("_s")).select(
        "walk_id", F.flatten(F.transform("_s", lambda x: x["path"])).alias("nodes"))


def _pairs_of(whole: DataFrame, nodes: int, window: int, walk_length: int) -> DataFrame:
    """Pair counts of walks ``nodes``.  The walk corpus of a large graph repeats few pairs, so they are dealt by their key
    before they are counted once, to so many tasks (from the number of ``nodes``) that none need spill."""
    n = tasks_for(whole.sparkSession, nodes * window, PAIRS_PER_TASK)
    centres = F.sequence(F.lit(1), F.least(F.size("nodes") - 1, F.lit(walk_length - window)))
    at = whole.where(F.lit(walk_length > window) & (F.size("nodes") > 1)).select("nodes", F.explode(centres).alias("_a"))
    pairs = at.select(F.element_at("nodes", F.col("_a")).alias("center"), F.explode(F.slice("nodes", F.col("_a") + 1, F.lit(window))).alias("context"))
    return pairs.repartition(n, "center", "context").groupBy("center", "context").agg(F.count(F.lit(1)).cast("double").alias("freq"))


def piece_pairs(pieces: DataFrame, window: int, walk_length: int) -> DataFrame:
    """Centre/context pair counts ``center, context, freq`` from stored pieces (W11, G13, G14, A16): each node of a walk
    is the context of up to ``window`` nodes before it.  Centres are positions ``0 .. walk_length-window-1``."""
    if isinstance(pieces, PackedWalks):
        many = pieces.walks * max(0, min(walk_length, pieces.length) - window) * window
        tasks = tasks_for(pieces.rows.sparkSession, many, PAIRS_PER_TASK)
        if walk_length != pieces.length or not packed.Pairs.fits(pieces.ids, tasks):
            return _pairs_of(whole_walks(pieces), pieces.walks * pieces.length, window, walk_length)
        pairs = packed.Pairs(pieces.ids, tasks, window, pieces.num_walks, pieces.kind)
        counts = _by_bucket(pieces, pairs.counted(), "task int, wide boolean, once binary, often binary, n binary")
        return counts.repartition(tasks, "task").groupBy("task").applyInArrow(pairs.summed(), "center long, context long, freq double")
    nodes = pieces.agg(F.sum(F.size("path")).alias("n")).first()["n"] or 0  # a scalar
    return _pairs_of(whole_walks(pieces), nodes, window, walk_length)


def context_pairs(walks: DataFrame, window: int, walk_length: int) -> DataFrame:
    """:func:`piece_pairs` of walks given as rows ``walk_id, t, node``, which are first gathered to one array a walk."""
    return _pairs_of(walk_arrays(walks), walks.count(), window, walk_length)


def rolling_windows(arr_col: str, window: int) -> F.Column:
    """All contiguous sub-arrays of length ``window``."""
    n = F.size(F.col(arr_col)) - window + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(F.col(arr_col), i, window)))


def second_order_walks(g: DataFrame, num_walks: int, walk_length: int, p: float, q: float, *, seed: int = 0) -> DataFrame:
    """node2vec walks (G12): first-order walks on the second-order network
    (G11), states mapped back to their current node.  With ``p == q == 1`` the
    line graph is skipped (plain walks).  The network has a row for each path of two edges: for graphs
    with hubs, or ids over a billion, use :func:`rejection_walks`."""
    if p == 1 and q == 1:
        return random_walks(g, num_walks, walk_length, seed=seed)
    so = G.second_order_edges(g, p, q, add_source=True)
    # state ids: Cantor pairing of (prev, cur) keeps them integers and unique
    st = so.select(cantor_pair("prev", "cur").alias("src"), cantor_pair("cur", "nxt").alias("dst"), "w",
                   F.col("nxt").alias("_nxt"), F.col("cur").alias("_cur"))
    state_edges = st.select("src", "dst", "w")
    starts = G.nodes_of(g).select(cantor_pair("node", "node").alias("node"))
    w = random_walks(state_edges, num_walks, walk_length, seed=seed, start_nodes=starts)
    # map state back: the current node of (prev, cur)
    k1, k2 = cantor_unpair("node")
    s1, s2 = cantor_unpair("start")
    return w.select(F.col("walk_id"), s2.alias("start"), "t", k2.alias("node"))


def rejection_walks(g: DataFrame, num_walks: int, walk_length: int, p: float, q: float, *, seed: int = 0) -> DataFrame:
    """node2vec walks (G12) ``walk_id, start, t, node`` by rejection, without the second-order network.

    A walker at ``cur`` that came from ``prev`` draws a neighbour as a plain walk does, and takes it with probability
    ``bias / max(1/p, 1, 1/q)``, where the bias is 1/p for ``prev`` itself, 1 for a neighbour of ``prev`` and 1/q for any
    other; else it stays and draws again.  What it takes has the law of the second-order network.  The state is
    the columns ``prev, cur``, and the neighbour test an equi-join of (prev, drawn) with the edges, so nothing grows with
    squared degrees.  Every pass gives each unfinished walker one draw, whatever its position; a draw is a hash of (walk,
    position, attempt), so a retried task repeats it."""
    g = materialize(g.select("src", "dst", "w"), "walk-graph")
    be = laid_out(bucketed_edges(g))
    adjacent = materialize(g.select(F.col("src").alias("prev"), F.col("dst").alias("dst"), F.lit(True).alias("_near")).distinct(), "walk-adjacency")
    if fits_broadcast(adjacent.count(), 32):
        adjacent = F.broadcast(adjacent)
    top, none = max(1 / p, 1.0, 1 / q), F.array().cast("array<bigint>")
    front = _starts(g, num_walks, None).select(
        "walk_id", "start", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("attempt"), F.lit(None).cast("long").alias("prev"),
        F.col("start").alias("cur"), "deg", none.alias("path"))
    front = materialize(front, "walkers0")
    # as in a plain walk, one that starts at a sink records itself once more
    first = F.when((F.col("deg") == 0) & F.lit(walk_length > 1), F.array("start", "start")).otherwise(F.array("start"))
    parts = [front.select("walk_id", "start", F.lit(0).cast("long").alias("t"), first.alias("path"))]
    turn = 0
    while True:
        live = (F.col("t") < walk_length) & (F.col("deg") > 0)
        front = front.where(live)
        if front.isEmpty():
            break
        for _ in range(DRAWS_PER_STORE):
            front = _attempt(front, be, adjacent, live, seed, 1 / p, 1 / q, top)
        turn += 1
        front = materialize(front, f"walkers{turn}")
        parts.append(front.where(F.size("path") > 0).select("walk_id", "start", (F.col("t") - F.size("path")).alias("t"), "path"))
        front = front.withColumn("path", none)
    be.unpersist()
    return walk_rows(_union(parts))


def _attempt(front: DataFrame, be: DataFrame, adjacent: DataFrame, live, seed: int, back: float, far: float, top: float) -> DataFrame:
    """One draw of every live walker (``walk_id, start, t, attempt, prev, cur, deg, path``), and a step where it is taken."""
    def draw(purpose: int):
        return hash_uniform(F.lit(seed), F.col("walk_id"), F.col("t"), F.col("attempt"), F.lit(purpose))

    f = front.withColumn("_u", draw(1)).withColumn("_v", draw(2)).withColumn("_live", live)
    j = _draw(f, be, F.col("_live")).select(*front.columns, "_v", "_live", "dst", "dst_deg")
    # the first step has no walker's past to meet: its key matches nothing and spreads
    j = j.withColumn("_from", F.coalesce("prev", -1 - F.col("walk_id")))
    near = adjacent.select(F.col("prev").alias("_from"), "dst", "_near")
    j = j.join(near, ["_from", "dst"], "left")
    bias = F.when(F.col("prev").isNull(), F.lit(top)).when(F.col("dst") == F.col("prev"), F.lit(back)).when(F.col("_near"), F.lit(1.0)).otherwise(F.lit(far))
    taken = F.col("_live") & F.col("dst").isNotNull() & (F.col("_v") * top < bias)
    step = F.col("_taken")
    return j.withColumn("_taken", F.coalesce(taken, F.lit(False))).select(
        "walk_id", "start", F.when(step, F.col("t") + 1).otherwise(F.col("t")).alias("t"),
        F.when(step, F.lit(0).cast("long")).otherwise(F.col("attempt") + 1).alias("attempt"),
        F.when(step, F.col("cur")).otherwise(F.col("prev")).alias("prev"), F.when(step, F.col("dst")).otherwise(F.col("cur")).alias("cur"),
        F.when(step, F.col("dst_deg")).otherwise(F.col("deg")).alias("deg"),
        F.when(step, F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"))


def roulette(front: DataFrame, g: DataFrame, cur: str, u: str, out: str) -> DataFrame:
    """One weighted draw per row of ``front``: from node ``cur`` to a neighbour in
    the edge table ``g`` with probability proportional to the weight, using the
    row's uniform number ``u`` (G10).  Rows whose node has no out-edge drop."""
    be = bucketed_edges(g, with_dst_deg=False)
    deg = g.groupBy(F.col("src").alias("_cur")).agg(F.count(F.lit(1)).alias("_deg"))
    f = front.join(deg, front[cur] == deg["_cur"]).withColumn(
        "bucket", F.least(F.floor(F.col(u) * F.col("_deg")).cast("long"), (F.col("_deg") - 1).cast("long")))
    j = f.join(be.select(F.col("src").alias("_cur"), "bucket", F.col("dst").alias(out), "lo", "hi"), ["_cur", "bucket"])
    return j.where((F.col("lo") <= F.col(u)) & (F.col(u) < F.col("hi"))).drop("_cur", "_deg", "bucket", "lo", "hi")


def config_context_pairs(g: DataFrame, groups: DataFrame, num_walks: int, seed: int = 0) -> DataFrame:
    """Context draws from a degree-corrected group null model (G15, D12 fixed).

    For every centre node and draw: pick the next group from the centre's group
    row of the group-to-group edge-count matrix, then a node of that group with
    probability proportional to its in-degree.  ``groups``: ``node, gid``.
    Returns ``center, context, freq``.
    """
    gid = groups.select(F.col("node"), F.col("gid"))
    gsrc = gid.select(F.col("node").alias("src"), F.col("gid").alias("gs"))
    gdst = gid.select(F.col("node").alias("dst"), F.col("gid").alias("gd"))
    gg = g.join(gsrc, "src").join(gdst, "dst").groupBy(F.col("gs").alias("src"), F.col("gd").alias("dst")).agg(F.sum("w").alias("w"))
    din = g.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("w"))
    c2n = din.join(gid, "node").select(F.col("gid").alias("src"), F.col("node").alias("dst"), "w")
    draws = gid.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_walks - 1).cast("long")))).select(
        F.col("node").alias("center"), F.col("gid").alias("g0"), (F.col("node") * num_walks + F.col("rep")).alias("draw"))
    draws = draws.withColumn("u1", hash_uniform(F.lit(seed), F.col("draw"), F.lit(0))) \
                 .withColumn("u2", hash_uniform(F.lit(seed), F.col("draw"), F.lit(1)))
    step1 = roulette(draws, gg, "g0", "u1", "g1")
    step2 = roulette(step1, c2n, "g1", "u2", "context")
    return step2.groupBy("center", "context").agg(F.count(F.lit(1)).cast("double").alias("freq"))
