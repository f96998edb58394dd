"""Vector operators over ``id, vec array<float|double>`` tables.

Row-wise measures are higher-order array expressions (JVM, codegen).  Group
measures explode vectors to ``(group, pos, value)`` and aggregate, so no group
is ever gathered into one task.  Exact nearest-neighbour search runs as blocked
NumPy products: train rows stream past blocks of queries inside ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.columns import cosine_similarity, hash_int, l2_normalize
from citeweave.session import fits_broadcast, materialize, tasks_for

# Broadcast limit for small per-class tables (centroids, axes), in bytes.
SMALL_TABLE_BYTES = 64 * 1024 * 1024
# Values of the vectors of members that one task reduces to distinct ones, so that its table stays small.
VALUES_PER_TASK = 2_000_000


def normalize_rows(df: DataFrame, vec: str = "vec") -> DataFrame:
    """L2 row normalisation, zero rows unchanged (V8)."""
    return df.withColumn(vec, l2_normalize(vec))


def pair_cosine(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b", key: str = "doi",
                vec: str = "vec", how: str = "inner") -> DataFrame:
    """Look up a vector for each end of a pair (J9) and score the pair with
    cosine similarity / distance (V9).  ``how="left"`` keeps unknown ends as null."""
    va = vectors.select(F.col(key).alias(a), F.col(vec).alias("_va"))
    vb = vectors.select(F.col(key).alias(b), F.col(vec).alias("_vb"))
    j = pairs.join(va, a, how).join(vb, b, how)
    sim = cosine_similarity("_va", "_vb")
    return j.withColumn("cos_sim", sim).withColumn("cos_dist", F.lit(1.0) - sim).drop("_va", "_vb")


def _maybe_broadcast(small: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(small) if n_rows * row_bytes <= SMALL_TABLE_BYTES else small


def class_centroids(members: DataFrame, group: Sequence[str], key: str = "doi", vec: str = "vec") -> DataFrame:
    """Per class and dimension, the mean of the **distinct** values among its
    members (A6).  ``members`` has one row per (member, class) with the vector.
    Returns ``*group, pos, c`` (one row per class and dimension)."""
    g = list(group)
    n = members.agg(F.sum(F.size(vec).cast("long")).alias("n")).first()["n"] or 0  # a scalar
    ex = members.select(*g, F.posexplode(vec).alias("pos", "val")).withColumn("val", F.col("val").cast("double"))
    # few values repeat: they are dealt by value before they are reduced once, in tasks that grow in number with the rows
    values = ex.repartition(tasks_for(members.sparkSession, n, VALUES_PER_TASK), *g, "pos", "val").dropDuplicates()
    return values.groupBy(*g, "pos").agg(F.avg("val").alias("c"))


def centroid_arrays(cent: DataFrame, group: Sequence[str]) -> DataFrame:
    """``*group, pos, c`` -> ``*group, centroid array<double>`` in position order."""
    g = list(group)
    return cent.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("_s")).select(
        *g, F.transform("_s", lambda x: x["c"]).alias("centroid"))


def class_members(vectors: DataFrame, codes: DataFrame, levels: Sequence[str], key: str = "doi", vec: str = "vec") -> DataFrame:
    """``key, level, code, vec``: each distinct (paper, level, code) with the paper's vector, all
    levels in one pass (A8, J7), stored: centroids and distances both read it.  ``codes``: ``key`` plus one column per level (e.g. ``pacs_code_1``);
    the level's name is the suffix after the last ``_``."""
    stacked = codes.select(key, F.explode(F.array(*[
        F.struct(F.lit(lv.rsplit("_", 1)[-1]).alias("level"), F.col(lv).alias("code")) for lv in levels])).alias("_x")) \
        .select(key, "_x.level", "_x.code").where(F.col("code").isNotNull()).distinct()
    return materialize(stacked.join(vectors.select(key, vec), key), "class-members")


def centroid_distances(vectors: DataFrame, codes: DataFrame, levels: Sequence[str], key: str = "doi", vec: str = "vec") -> DataFrame:
    """``key, level, code, dist``: cosine distance of every member to its class's centroid."""
    members = class_members(vectors, codes, levels, key, vec)
    cent = materialize(centroid_arrays(class_centroids(members, ["level", "code"], key, vec), ["level", "code"]), "centroids")
    n_classes, dim = cent.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first()
    cent = _maybe_broadcast(cent, n_classes, dim * 8 + 64)
    return members.join(cent, ["level", "code"]).select(key, "level", "code", (F.lit(1.0) - cosine_similarity(vec, "centroid")).alias("dist"))


def radius_of_gyration(vectors: DataFrame, codes: DataFrame, levels: Sequence[str],
                       key: str = "doi", vec: str = "vec") -> DataFrame:
    """Radius of gyration per class for several code levels in one pass
    (V15, J7, A6, J16, A7, A8): the mean squared cosine distance of members to
    the class centroid; ``paper_ct`` = distinct members."""
    d = centroid_distances(vectors, codes, levels, key, vec)
    return d.groupBy("level", "code").agg(F.count(key).alias("paper_ct"), F.avg(F.col("dist") * F.col("dist")).alias("rog"))


def semantic_axis(vectors: DataFrame, labels: DataFrame, key: str = "doi", vec: str = "vec",
                  side: str = "side") -> DataFrame:
    """Axis = mean(positive vectors) - mean(negative vectors) (D13: averaged),
    and every vector's cosine with it (V14).  ``labels``: ``key, side`` with
    side in {'pos', 'neg'}."""
    ex = vectors.join(labels, key).select(side, F.posexplode(vec).alias("pos", "val"))
    means = ex.groupBy(side, "pos").agg(F.avg(F.col("val").cast("double")).alias("m"))
    axis = means.groupBy("pos").agg(
        (F.sum(F.when(F.col(side) == "pos", F.col("m")).otherwise(0.0))
         - F.sum(F.when(F.col(side) == "neg", F.col("m")).otherwise(0.0))).alias("a"))
    # the axis is one vector of the embedding's dimension: a driver-side constant
    ax = [r["a"] for r in axis.orderBy("pos").collect()]
    lit_axis = F.array(*[F.lit(float(x)) for x in ax])
    return vectors.select(key, cosine_similarity(vec, lit_axis).alias("axis_cos"))


# ---- exact k nearest neighbours --------------------------------------------------

# Rows of the two tiles whose distances one task holds at a time, pairs whose exact distances
# it recomputes at a time, and bytes of queries with their lists in one block.
Q_TILE, T_TILE = 512, 2048
PAIR_CHUNK = 200_000
BLOCK_BYTES = 96 << 20
MERGE_LISTS = 32  # local top-k lists that one merge reads
LABEL_ROW_BYTES = 64


def _top(qi: np.ndarray, nid: np.ndarray, dist: np.ndarray, k: int):
    """The first k of each query in (distance, id) order."""
    order = np.lexsort((nid, dist, qi))
    qi, nid, dist = qi[order], nid[order], dist[order]
    first = np.searchsorted(qi, qi, "left")
    keep = np.arange(len(qi)) - first < k
    return qi[keep], nid[keep], dist[keep]


class _Tile:
    """Exact k nearest rows of all train rows that ``meet`` the queries ``Q``: ``best`` has the query row, neighbour id and
    squared distance of each, in the order of rows, distances and ids.

    The product form of the distance, in single precision where that is safe, picks of each tile all rows within rounding error of the
    k-th of the tile, or of those found so far if all queries have k; their distances are then summed over
    differences, so copies get exactly 0 and ties are cut by id.  What is picked is merged once it is as much as half the lists."""

    def __init__(self, Q: np.ndarray, qid: np.ndarray, k: int, exclude_self: bool):
        self.Q, self.qid, self.k, self.exclude_self = Q, qid, k, exclude_self
        self.qq = (Q * Q).sum(1)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.picked, self.waiting = [], 0
        self.left = {}  # -2 Q, |q|^2, 1 by precision

    def _product(self, part: np.ndarray, tt: np.ndarray):
        """Squared distances to ``part``, and twice their largest rounding error by query."""
        most = tt[np.isfinite(tt)].max(initial=0.0)
        top = max(self.qq.max(), most, tt.max())
        single = 1e-15 < top < 1e30  # neither squares nor their sums leave the range of single precision
        kind = np.float32 if single else np.float64
        if kind not in self.left:
            self.left[kind] = np.hstack((-2 * self.Q, self.qq[:, None], np.ones((len(self.Q), 1)))).astype(kind)
        right = np.hstack((part, np.ones((len(part), 1)), tt[:, None])).astype(kind)
        error = 4 * (part.shape[1] + 8) * 2.0 ** -24 if single else 1e-9
        return self.left[kind] @ right.T, error * (self.qq + most)

    def meet(self, part: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        d, slack = self._product(part, (part * part).sum(1))
        if self.exclude_self:
            own = np.flatnonzero(np.isin(ids, self.qid))
            at, col = np.nonzero(self.qid[:, None] == ids[own][None, :])
            d[at, own[col]] = np.inf
        if len(self.best[0]) == k * len(self.Q):  # sorted by query and distance: each k-th row is the farthest so far
            most = self.best[2][k - 1 :: k] + slack
        elif k < d.shape[1]:
            most = np.partition(d, k - 1, axis=1)[:, k - 1] + slack
        else:
            most = np.full(len(self.Q), np.inf)
        # rounded up, so that single precision cuts none off
        most = np.nextafter(most.astype(d.dtype), d.dtype.type(np.inf))
        i, j = np.divmod(np.flatnonzero(d <= most[:, None]), d.shape[1])
        ok = np.isfinite(d[i, j])
        i, j = i[ok], j[ok]
        exact = np.empty(len(i))
        for c in range(0, len(i), PAIR_CHUNK):
            diff = self.Q[i[c : c + PAIR_CHUNK]] - part[j[c : c + PAIR_CHUNK]]
            exact[c : c + PAIR_CHUNK] = np.einsum("ij,ij->i", diff, diff)
        self.picked.append((i, ids[j], exact))
        self.waiting += len(i)
        if len(self.best[0]) < k * len(self.Q) or 2 * self.waiting >= k * len(self.Q):
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            self.best = _top(*(np.concatenate(x) for x in zip(self.best, *self.picked)), self.k)
        self.picked, self.waiting = [], 0


def _tile_search(Q: np.ndarray, qid: np.ndarray, T: np.ndarray, tid: np.ndarray, k: int, exclude_self: bool):
    """Exact k nearest rows of ``T`` for a tile of queries: query row, neighbour id, squared distance."""
    tile = _Tile(Q, qid, k, exclude_self)
    for at in range(0, len(T), T_TILE):
        tile.meet(T[at : at + T_TILE], tid[at : at + T_TILE])
    tile.merge()
    return tile.best


def _vectors_of(vec) -> np.ndarray:
    """The vectors of an Arrow column of equally long lists, a row each."""
    from citeweave.operators.linalg import _matrix

    if len(vec) and len(set(np.diff(vec.offsets.to_numpy()).tolist())) > 1 or vec.null_count:
        raise ValueError("vectors of different lengths, or none")
    return _matrix(vec).astype(np.float64)


class _Cell:
    """One block of queries and the train rows that stream past it, in tiles."""

    def __init__(self, key: tuple, k: int, exclude_self: bool):
        self.key, self.k, self.exclude_self = key, k, exclude_self
        self.queries, self.tiles, self.held, self.rows = [], None, [], 0

    def add(self, batch) -> None:
        n = np.count_nonzero(~batch.column("train").to_numpy(zero_copy_only=False))  # queries come first
        ids, V = batch.column("id").to_numpy(), _vectors_of(batch.column("vec"))
        if n:
            self.queries.append((ids[:n], V[:n]))
        if n < len(ids) and self.queries:
            self.held.append((ids[n:], V[n:]))
            self.rows += len(ids) - n
            if self.rows >= T_TILE:
                self.search()

    def search(self) -> None:
        if self.tiles is None:
            ids, V = (np.concatenate(x) for x in zip(*self.queries))
            self.tiles = [_Tile(V[at : at + Q_TILE], ids[at : at + Q_TILE], self.k, self.exclude_self) for at in range(0, len(ids), Q_TILE)]
            self.queries = [(ids, None)]
        if self.rows:
            ids, V = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.rows = [], 0
            for at in range(0, len(ids), T_TILE):
                for tile in self.tiles:
                    tile.meet(V[at : at + T_TILE], ids[at : at + T_TILE])

    def found(self):
        """Query id, neighbour id, distance and rank, some queries at a time."""
        if not self.queries:
            return
        self.search()
        parts = []
        for tile in self.tiles:
            tile.merge()
            parts.append((tile.qid[tile.best[0]], *tile.best[1:]))
        ids = self.queries[0][0]
        if len(np.unique(ids)) < len(ids):  # a query that came more than once has one list
            parts = [_top(*(np.concatenate(x) for x in zip(*parts)), self.k)]
        for tile, part in zip(self.tiles, parts):
            change = np.flatnonzero(np.r_[True, part[0][1:] != part[0][:-1]]) if len(part[0]) else np.zeros(0, np.int64)
            first = np.repeat(change, np.diff(np.r_[change, len(part[0])]))
            yield *part, (np.arange(len(part[0])) - first + 1).astype(np.int32)


def _runs_of(batch, names: Sequence[str]):
    """``key, rows`` of the runs of rows of ``batch`` that are equal in the columns ``names``."""
    def key(at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in names)

    at, n = 0, batch.num_rows
    while at < n:
        own, end = key(at), n
        if key(n - 1) != own:  # the rows are sorted
            low = at
            while end - low > 1:
                mid = (low + end) // 2
                low, end = (mid, end) if key(mid) == own else (low, mid)
        yield own, batch.slice(at, end - at)
        at = end


def _search_fn(k: int, exclude_self: bool, by: Sequence[str]):
    names = [*by, "qb", "tb"]

    def run(batches):
        import pyarrow as pa

        def rows(cell, schema):
            for qid, nid, dist, rank in cell.found():
                key = [pa.repeat(pa.scalar(v, schema.field(c).type), len(qid)) for c, v in zip(names, cell.key)]
                yield pa.RecordBatch.from_arrays([*key[:-2], key[-1], pa.array(qid), pa.array(nid), pa.array(dist), pa.array(rank)],
                                                 names=[*by, "tb", "qid", "nid", "dist", "rank"])

        cell = None
        for batch in batches:
            for key, part in _runs_of(batch, names):
                if cell is None or key != cell.key:
                    if cell is not None:
                        yield from rows(cell, batch.schema)
                    cell = _Cell(key, k, exclude_self)
                cell.add(part)
        if cell is not None:
            yield from rows(cell, batch.schema)

    return run


def _blocks(nq: int, nt: int, dim: int, k: int, cells: int) -> tuple[int, int]:
    """Blocks of queries and of train rows of a run: about ``cells`` cells of some hundred rows a side, with queries that fit a task, and
    the fewest bytes of copies and of partial lists to merge."""
    fit = max(1, BLOCK_BYTES // (12 * max(1, dim) + 24 * k))
    least = max(1, -(-nq // fit))
    choices = []
    for q in range(least, max(least, min(cells, nq // 250)) + 1):
        t = max(1, min(-(-cells // q), nt // 250))
        choices.append((8 * dim * (nt * q + nq * t) + (32 * k * nq * t if t > 1 else 0), q, t))
    return min(choices)[1:]


def knn_search(queries: DataFrame, train: DataFrame, k: int, *, qid: str = "qid", tid: str = "tid",
               vec: str = "vec", by: Sequence[str] = (), exclude_self: bool = False,
               q_blocks: int | None = None, t_blocks: int | None = None) -> DataFrame:
    """Exact k nearest neighbours by squared L2 (V10, W15), for one or many
    independent runs at once (``by`` columns, e.g. trial and journal set).

    Queries and train rows are hashed into ``q_blocks`` x ``t_blocks`` cells
    per run: every query row is copied once per train block and every train row
    once per query block.  A cell's rows come to one task in order, queries first: it holds those, with their lists of k at most
    ``BLOCK_BYTES``, and the train rows stream past them in tiles, so its memory depends on neither side's size.  There is more than one train block
    only where the query blocks of all runs are fewer than the tasks ask for; the local top-k lists of a query are then merged ``MERGE_LISTS``
    at a time, in as many levels as needed.  Ties are broken by distance, then by neighbour id.
    Returns ``*by, qid, nid, dist, rank`` (rank 1 = nearest).
    """
    by = list(by)
    # fresh attribute ids on both sides: queries and train often share a lineage
    q = queries.select(*[F.col(c).alias(c) for c in by], F.col(qid).cast("long").alias("id"), F.col(vec).alias("vec"))
    t = train.select(*[F.col(c).alias(c) for c in by], F.col(tid).cast("long").alias("id"), F.col(vec).alias("vec"))
    spark = q.sparkSession
    size = q.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    runs, nq = size.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    if q_blocks is None or t_blocks is None:
        sizes = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
        nt, dim = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
        cells = -(-2 * spark.sparkContext.defaultParallelism // max(1, runs))
        of_q, of_t = _blocks(nq, nt, dim, k, cells)
        q_blocks, t_blocks = q_blocks or of_q, t_blocks or of_t
    side = [*by, F.col("qb").cast("long").alias("qb"), F.col("tb").cast("long").alias("tb"), "train", "id", "vec"]
    own = q.withColumn("qb", F.pmod(hash_int("id"), F.lit(q_blocks))).withColumn(
        "tb", F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1)))).withColumn("train", F.lit(False)).select(*side)
    others = t.withColumn("tb", F.pmod(hash_int("id"), F.lit(t_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("train", F.lit(True)).select(*side)
    laid = own.unionByName(others).repartition(2 * max(1, runs) * q_blocks * t_blocks, *by, "qb", "tb").sortWithinPartitions(*by, "qb", "tb", "train")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in q.schema.fields if f.name in by]
                       + ["tb long", "qid long", "nid long", "dist double", "rank int"])
    cand = laid.mapInArrow(_search_fn(k, exclude_self, by), schema)
    if t_blocks == 1:
        return cand.select(*by, "qid", "nid", "dist", "rank")
    top = F.slice(F.sort_array(F.collect_list(F.struct("dist", "nid"))), 1, k).alias("_top")
    lists = t_blocks
    while lists > MERGE_LISTS:
        lists = -(-lists // MERGE_LISTS)
        cand = cand.withColumn("tb", F.floor(F.col("tb") / MERGE_LISTS).cast("long")).groupBy(*by, "qid", "tb").agg(top) \
            .select(*by, "qid", "tb", F.explode("_top").alias("_x")).select(*by, "tb", "qid", F.col("_x.nid").alias("nid"), F.col("_x.dist").alias("dist"))
    best = cand.groupBy(*by, "qid").agg(top)
    return best.select(*by, "qid", F.posexplode("_top").alias("_p", "_x")).select(
        *by, "qid", F.col("_x.nid").alias("nid"), F.col("_x.dist").alias("dist"), (F.col("_p") + 1).alias("rank"))


def knn_vote(neigh: DataFrame, labels: DataFrame, ks: Sequence[int], *, by: Sequence[str] = (),
             nid: str = "nid", label: str = "label") -> DataFrame:
    """Majority vote of the k nearest labels for every k in ``ks`` from one
    search at ``max(ks)`` (A14, V11): a neighbour of rank r votes for every
    k >= r.  Ties go to the **smallest** label.  Returns ``*by, qid, k, pred``."""
    by = list(by)
    kk = F.array(*[F.lit(int(x)) for x in sorted(ks)])
    lab = labels.select(F.col(nid).alias("nid"), F.col(label).alias("_lab"))
    lab = F.broadcast(lab) if fits_broadcast(lab.count(), LABEL_ROW_BYTES) else lab  # the neighbours, which are many, stay where they are
    votes = neigh.join(lab, "nid").select(*by, "qid", "_lab",
                                          F.explode(F.filter(kk, lambda x: x >= F.col("rank"))).alias("k"))
    counts = votes.groupBy(*by, "qid", "k", "_lab").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*by, "qid", "k").agg(F.min(F.struct((-F.col("_n")).alias("_m"), F.col("_lab"))).alias("_w"))
    return best.select(*by, "qid", "k", F.col("_w._lab").alias("pred"))
