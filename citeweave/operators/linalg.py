"""Randomised truncated SVD and spectral embeddings over COO edge tables.

Dense factors are row tables ``id, vec array<double>`` (one row per node, a
short vector of ``r + p`` numbers).  ``spmm`` is one sparse x dense product as a join of the
edge table with the factor rows plus a vector sum per output row
(``Summarizer.sum``, a JVM aggregate with map-side combine); iterations lay the matrix out once as ``Panels``
and multiply panel by panel.  Tall factors are
orthonormalised by tree QR: k x k triangles per partition, stacked and reduced again, and
only a bounded number of them reaches the driver, where the small problems are solved.  Nothing of
size n is ever collected.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.columns import hash_uniform
from citeweave.session import Workspace, discard, fixed_plans, keep_layout, materialize, tasks_for


def gaussian_rows(ids: DataFrame, k: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``id, vec`` with k standard normal entries per row, a deterministic function
    of (seed, id, column) via Box-Muller on the portable hash."""
    def normal(c):
        u1 = F.greatest(hash_uniform(F.lit(seed), F.col(id_col), 2 * c), F.lit(1e-300))
        return F.sqrt(-2 * F.log(u1)) * F.cos(2 * np.pi * hash_uniform(F.lit(seed), F.col(id_col), 2 * c + 1))

    # one expression for all columns: k of them would outgrow a generated method
    vec = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), normal) if k else F.array().cast("array<double>")
    return ids.select(F.col(id_col).alias("id"), vec.alias("vec"))


def spmm(X: DataFrame, Z: DataFrame, transpose: bool = False) -> DataFrame:
    """``X @ Z`` (or ``X^T @ Z``) for sparse ``X(src, dst, w)`` and dense rows
    ``Z(id, vec)``.  Returns ``id, vec``."""
    a, b = ("dst", "src") if transpose else ("src", "dst")
    j = X.select(F.col(a).alias("id"), F.col(b).alias("_k"), "w").join(Z.select(F.col("id").alias("_k"), "vec"), "_k")
    scaled = j.select("id", array_to_vector(F.transform("vec", lambda x: x * F.col("w"))).alias("_v"))
    s = scaled.groupBy("id").agg(Summarizer.sum(F.col("_v")).alias("_s"))
    return s.select("id", vector_to_array("_s").alias("vec"))


# Bytes of the dense rows that one panel reads (those of its column block) and that it gives, at most, and its entries, at
# most.  They bound a task's memory at any size of the matrix; a panel of under ``CELL_ENTRIES`` entries is not worth its copy of a block.
BLOCK_BYTES = 64 << 20
PANEL_ENTRIES = 1 << 20
CELL_ENTRIES = 1 << 16
CELLS_PER_TASK = 4
LISTED_BLOCKS = 256
SLICE = 1 << 13
# Filter of ``truncated_svd``: largest degree, largest growth, filters at most, relative residual to reach.
DEGREE = 12
GROWTH = 1e8
DISCERN = 3.0  # least log growth of the largest value over the damped ones, about
ROUNDS = 4
TOL = 1e-2


class Panels:
    """A sparse matrix laid out once for products with dense rows of ``width`` numbers.

    Columns are dealt to blocks by hash, and the entries of a block to panels by the hash of their row, so a hub, be it a row
    or a column, is split.  A panel is as large as its entries, its dense rows and the rows that it gives allow, as each costs one copy of its block,
    but there are as many as the session has tasks where they keep ``CELL_ENTRIES``.  The layout is kept by a reliable checkpoint that holds its
    partitioning and order: a product moves dense rows only, one copy per panel of their block,
    and each panel is one numpy product that gives one row per row of the panel."""

    def __init__(self, f: DataFrame, width: int, transpose: bool):
        spark = f.sparkSession
        row, col = ("dst", "src") if transpose else ("src", "dst")
        e = f.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col("w").cast("double").alias("w"))
        size = e.agg(F.approx_count_distinct("col").alias("cols"), F.approx_count_distinct("row").alias("rows"), F.count(F.lit(1)).alias("n")).first()  # sizes the panels only
        cells = max(-(-size["n"] // PANEL_ENTRIES), min(-(-size["n"] // CELL_ENTRIES), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
        # a cell more in a column of cells copies the dense rows once more, one in a row of cells the rows that come out
        even = round((cells * max(size["cols"], 1) / max(size["rows"], 1)) ** 0.5)
        self.blocks = max(1, -(-size["cols"] * width * 8 // BLOCK_BYTES), min(even, cells))
        self.row_type = dict(e.dtypes)["row"]
        e = e.withColumn("cb", self._block("col"))
        n, rows = F.count(F.lit(1)), F.approx_count_distinct("row")
        least = -(-cells // self.blocks)
        parts = F.greatest(F.ceil(n / F.lit(PANEL_ENTRIES)), F.ceil(rows * F.lit(width * 8) / F.lit(BLOCK_BYTES)),
                           F.least(F.ceil(n / F.lit(CELL_ENTRIES)), F.lit(least)))
        self.counts = materialize(e.groupBy("cb").agg(parts.cast("int").alias("parts")), "panel-counts")
        self.panels = self.counts.agg(F.sum("parts").alias("n")).first()["n"] or 1
        # few blocks: their counts go with the plan, so that a product needs no join to them
        self.parts = dict(self.counts.collect()) if self.blocks <= LISTED_BLOCKS else None
        self.tasks = 1 if self.panels == 1 else tasks_for(spark, self.panels, CELLS_PER_TASK)
        chunk = F.pmod(F.xxhash64("row", F.lit(7)), F.col("parts").cast("long")).cast("int")
        laid = self._with_parts(e).select("cb", chunk.alias("chunk"), "row", "col", "w")
        # numbers go as one row a panel, which a product reads without taking it apart
        self.packed = {dict(e.dtypes)[c] for c in ("row", "col")} <= {"int", "bigint"}
        if self.packed:
            laid = materialize(laid.repartition(self.tasks, "cb", "chunk").groupBy("cb", "chunk").applyInArrow(_packed_panel, _PACKED), "panels")
        self.laid = keep_layout(laid.repartition(self.tasks, "cb", "chunk").sortWithinPartitions("cb", "chunk"))
        if self.packed:
            discard(laid)

    def _block(self, of: str):
        return F.pmod(F.xxhash64(of), F.lit(self.blocks)).cast("int")

    def _with_parts(self, df: DataFrame) -> DataFrame:
        """``df`` with the number ``parts`` of the panels of its block ``cb``; without the rows of blocks that have no entry."""
        if self.parts is None:
            return df.join(self.counts, "cb")
        parts = F.element_at(F.array(*[F.lit(self.parts.get(b, 0)) for b in range(self.blocks)]), F.col("cb") + 1)
        return df.withColumn("parts", parts).where("parts > 0")

    def times(self, Z: DataFrame) -> DataFrame:
        """``id, vec``: the product with the rows ``Z(id, vec)``, as one partial row per (row, panel) that has entries.
        With one block these are whole rows."""
        dense = self._with_parts(Z.withColumn("cb", self._block("id"))) \
            .select("cb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "id", "vec").repartition(self.tasks, "cb", "chunk")
        schema = f"id {self.row_type}, vec array<double>"
        run = _packed_product(self.row_type) if self.packed else _panel_product
        return self.laid.groupBy("cb", "chunk").cogroup(dense.groupBy("cb", "chunk")).applyInArrow(run, schema)


_PACKED = "cb int, chunk int, ids binary, starts binary, cols binary, at binary, w binary"


def _packed_panel(t: pa.Table) -> pa.Table:
    """The entries of a panel in the order of their rows: its rows, where each begins, its columns, and column and value of each entry."""
    rows, cols, w = (t[c].to_numpy() for c in ("row", "col", "w"))
    order = np.argsort(rows, kind="stable")
    rows = rows[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    cols, at = np.unique(cols[order].astype(np.int64), return_inverse=True)
    held = {"ids": rows[starts], "starts": starts, "cols": cols, "at": at.astype(np.int32), "w": w[order]}
    return pa.table({c: t[c][:1].cast(pa.int32()) for c in ("cb", "chunk")} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in held.items()})


def _packed_product(row_type: str):
    """One packed panel times its dense rows; an id without a dense row counts as zero."""
    def run(entries: pa.Table, dense: pa.Table) -> pa.Table:
        ids, starts, cols, w = (np.frombuffer(entries[c][0].as_py(), k) if entries.num_rows else np.zeros(0, k)
                                for c, k in (("ids", np.int64), ("starts", np.int64), ("cols", np.int64), ("w", np.float64)))
        at = np.frombuffer(entries["at"][0].as_py(), np.int32) if entries.num_rows else np.zeros(0, np.int32)
        known = dense["id"].to_numpy().astype(np.int64)
        order = np.argsort(known)
        known = known[order]
        place = np.minimum(np.searchsorted(known, cols), max(0, len(known) - 1))
        found = known[place] == cols if len(known) else np.zeros(len(cols), bool)
        at = np.where(found, order[place], -1)[at] if len(known) else np.full(len(at), -1)
        codes = np.repeat(np.arange(len(ids)), np.diff(np.r_[starts, len(at)]))
        if not found.all():
            here = at >= 0
            at, w, codes = at[here], w[here], codes[here]
            own, codes = np.unique(codes, return_inverse=True)
            ids = ids[own]
        return pa.table({"id": pa.array(ids, pa.int32() if row_type == "int" else pa.int64()), "vec": _lists(_sums(_matrix(dense["vec"]), at, w, codes, len(ids)))})

    return run


def _sums(Z: np.ndarray, at: np.ndarray, w: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``w * Z[at]`` over entries of the same of ``n`` ``codes``, in whose order they are."""
    out = np.zeros((n, Z.shape[1]))
    for lo in range(0, len(codes), SLICE):
        c, some = codes[lo : lo + SLICE], slice(lo, lo + SLICE)
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        out[c[starts]] += np.add.reduceat(Z[at[some]] * w[some, None], starts)
    return out


def _panel_product(entries: pa.Table, dense: pa.Table) -> pa.Table:
    """One panel times its dense rows; an id without a dense row counts as zero."""
    at = pd.Index(dense["id"].to_numpy()).get_indexer(entries["col"].to_numpy())
    here = at >= 0
    codes, ids = pd.factorize(entries["row"].to_numpy()[here])
    order = np.argsort(codes, kind="stable")
    codes, at, w = codes[order], at[here][order], entries["w"].to_numpy()[here][order]
    out = _sums(_matrix(dense["vec"]), at, w, codes, len(ids))
    return pa.table({"id": pa.array(ids, entries.schema.field("row").type), "vec": _lists(out)})


def _matrix(vec) -> np.ndarray:
    """The numbers of an Arrow column of equally long lists, a row each."""
    n = len(vec)
    flat = (pa.concat_arrays(vec.chunks) if isinstance(vec, pa.ChunkedArray) else vec).flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0)
    return flat.reshape(n, len(flat) // n if n else 0)


def _lists(M: np.ndarray) -> pa.Array:
    """The rows of ``M`` as an Arrow column of lists."""
    n, k = M.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(k)), pa.array(np.ascontiguousarray(M).ravel()))


def _sums_of_runs(batches):
    """Adds up ``by * vec`` over rows of one id, which follow each other; a run may go on in the next batch."""
    last = None  # id and sum of the run at the end of what was read
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column("id")
        keys = ids.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = np.add.reduceat(_matrix(batch.column("vec")) * batch.column("by").to_numpy()[:, None], starts)
        heads = ids.take(pa.array(starts))
        if last is not None and heads[0] == last[0][0]:
            sums[0] += last[1][0]
        elif last is not None:
            yield pa.RecordBatch.from_arrays([last[0], _lists(last[1])], ["id", "vec"])
        if len(starts) > 1:
            yield pa.RecordBatch.from_arrays([heads[:-1], _lists(sums[:-1])], ["id", "vec"])
        last = heads[-1:], sums[-1:]
    if last is not None:
        yield pa.RecordBatch.from_arrays([last[0], _lists(last[1])], ["id", "vec"])


def combine(terms) -> DataFrame:
    """``id, vec``: the sum of ``scale * Z`` over the ``(Z, scale)`` of ``terms``, rows of one id added up: one shuffle, and
    sums of the sorted rows batch by batch, so an id with very many rows needs no more memory."""
    total = None
    for Z, scale in terms:
        one = Z.select("id", "vec", F.lit(float(scale)).alias("by"))
        total = one if total is None else total.unionByName(one)
    n = int(total.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = total.repartition(n, "id").sortWithinPartitions("id")
    return laid.mapInArrow(_sums_of_runs, f"id {dict(total.dtypes)['id']}, vec array<double>")


def normal_rows(ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``id, vec`` with k standard normal entries per row, a function of (seed, id, column) alone, so that a
    task that is run again draws the same: a 64-bit counter hash per entry, and Box-Muller."""
    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def part(batches):
        step = (np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)[:, None]
            u = ((mixed(key + step) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:]))], ["id", "vec"])

    keyed = ids.select("id", F.xxhash64("id", F.lit(seed)).alias("key"))
    return keyed.mapInArrow(part, f"id {dict(ids.dtypes)['id']}, vec array<double>")


def merge_lone_columns(X: DataFrame) -> DataFrame:
    """``X(src, dst, w)`` with all columns of one entry that stand in the same row put together as one column, whose entry is the root of
    their squares' sum.  X X^T, and so the left singular vectors and the values, stay what they are."""
    held = X.groupBy("dst").agg(F.count(F.lit(1)).alias("_n"))
    each = X.join(held, "dst")
    lone = each.where("_n = 1").groupBy("src").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w"))
    # hashed words are the columns; 64 bits tell theirs from those of rows
    return each.where("_n > 1").select("src", F.xxhash64("dst").alias("dst"), "w").unionByName(
        lone.select("src", F.xxhash64(F.lit("lone"), "src").alias("dst"), "w"))


class Operand:
    """A sum of products of sparse matrices, applied factor by factor and never multiplied out.  A matrix is laid out once however
    often it stands in the products, and products that begin alike share their first step: P + P P is P (I + P)."""

    def __init__(self, products, width: int):
        laid = {}
        for f in (f for factors in products for f in factors):
            if id(f) not in laid:
                kept = materialize(f.select("src", "dst", "w"), "factor")
                laid[id(f)] = Panels(kept, width, False), Panels(kept, width, True)
                discard(kept)
        self.plain = [[laid[id(f)][0] for f in factors] for factors in products]
        self.turned = [[laid[id(f)][1] for f in factors[::-1]] for factors in products]
        self.products = 0
        self.many = any(p.blocks > 1 for pair in laid.values() for p in pair)

    def terms(self, Z: DataFrame, transpose: bool = False) -> list[tuple[DataFrame, float]]:
        """X Z or X^T Z as terms for ``combine``: partial rows, to be added up by id."""
        return [(Y, 1.0) for Y, _ in self._terms(self.turned if transpose else self.plain, Z)]

    def apply(self, Z: DataFrame, transpose: bool = False) -> DataFrame:
        """X Z or X^T Z: one row per id that has entries."""
        return self._whole(self._terms(self.turned if transpose else self.plain, Z))

    def _terms(self, chains, Z: DataFrame) -> list[tuple[DataFrame, bool]]:
        """Of the sum of ``chains`` times Z: rows, and whether each id has one of them only."""
        if not all(chains):
            return [(Z, True) for c in chains if not c] + (self._terms([c for c in chains if c], Z) if any(chains) else [])
        out = []
        for first in dict.fromkeys(c[0] for c in chains):
            inner = self._whole(self._terms([c[1:] for c in chains if c[0] is first], Z))
            self.products += 1
            out.append((first.times(inner), first.blocks == 1))
        return out

    @staticmethod
    def _whole(terms) -> DataFrame:
        return terms[0][0] if len(terms) == 1 and terms[0][1] else combine((Y, 1.0) for Y, _ in terms)


R_BUCKETS = 64


def r_factor(Z: DataFrame, k: int) -> np.ndarray:
    """The triangular factor R (k x k) of ``Z = Q R``, up to signs, by tree QR: every
    partition reduces its rows to a k x k triangle, ``R_BUCKETS`` tasks reduce stacks of
    triangles, and the driver the last ones.  Unlike a Gram matrix this squares no singular
    value, so small ones keep their digits."""
    def reduced(parts) -> np.ndarray:
        acc = np.zeros((0, k))
        for rows in parts:
            if len(rows):
                acc = np.linalg.qr(np.vstack((acc, rows)), mode="r")
        return acc

    def leaf(it):
        R = reduced(_matrix(batch.column("vec")) for batch in it)
        if len(R):
            yield pa.RecordBatch.from_arrays([_lists(R)], ["vec"])

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vec": list(reduced([np.vstack(pdf["vec"].to_numpy())]))})

    leaves = Z.select("vec").mapInArrow(leaf, "vec array<double>")
    nodes = leaves.withColumn("_b", F.pmod(F.spark_partition_id(), F.lit(R_BUCKETS))).groupBy("_b").applyInPandas(node, "vec array<double>")
    R = reduced([np.array([r["vec"] for r in nodes.collect()])]) if k else np.zeros((0, 0))  # R_BUCKETS * k rows at most
    return np.vstack((R, np.zeros((k - len(R), k))))


def right_multiply(Z: DataFrame, *factors: np.ndarray) -> DataFrame:
    """Rows of ``Z @ M`` for small driver matrices, one after the other (broadcast with the task)."""
    Mb = Z.sparkSession.sparkContext.broadcast([np.asarray(M, dtype=np.float64) for M in factors])

    def part(it):
        for batch in it:
            if batch.num_rows:
                V = _matrix(batch.column("vec"))
                for m in Mb.value:
                    V = V @ m
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(V)], ["id", "vec"])

    id_type = dict(Z.dtypes)["id"]
    return Z.select("id", "vec").mapInArrow(part, f"id {id_type}, vec array<double>")


def orthonormalize(Z: DataFrame, k: int, seed: int = 97, work: Workspace | None = None, name: str = "basis") -> DataFrame:
    """Orthonormal columns that span those of ``Z`` (rows ``id, vec[k]``, k at most the
    number of rows), whatever the lengths of those columns.  A direction that ``Z`` lacks to rounding error is replaced by a random one, so
    all k columns come back.  Each pass is a tree QR and a product; two passes reach rounding error.  ``Z`` is stored; the result
    is, and a pass between only where a direction was replaced."""
    Q, held, factors = Z, Z, []
    work = work or Workspace(Z.sparkSession, "basis")
    for turn in range(3):
        R = r_factor(Q, k)
        length = np.linalg.norm(R, axis=0)
        length[length == 0] = 1.0
        _, s, Vt = np.linalg.svd(R / length)
        weak = s <= s[0] * 1e-13 if s[0] > 0 else np.ones(k, bool)
        T = Vt.T / np.where(weak, 1.0, s) / length[:, None]
        T[:, weak] = 0.0
        factors.append(T)
        Q = right_multiply(held, *factors)
        if weak.any():
            fill = normal_rows(Q.select("id"), k, seed + turn).withColumnRenamed("vec", "_g")
            use = F.array(*[F.lit(1.0 if w else 0.0) for w in weak])
            Q = Q.join(fill, "id").select("id", F.zip_with("vec", F.zip_with("_g", use, lambda g, u: g * u), lambda x, y: x + y).alias("vec"))
            Q, factors = work.keep(Q, f"{name}-{uuid.uuid4().hex[:8]}"), []
            held = Q
        elif turn:
            break
    return work.keep(Q, name) if factors else Q


def randomized_svd(X, nodes: DataFrame, r: int, p: int = 10, q: int = ROUNDS, seed: int = 0, rows: DataFrame | None = None):
    """``(U, s)`` of ``truncated_svd``: the rows ``id, vec[r]`` and the r largest singular values."""
    svd = truncated_svd(X, nodes, r, p, q, seed, rows)
    return svd.U, svd.s


class SVD(NamedTuple):
    U: DataFrame  # id, vec[r]: left singular vectors
    s: np.ndarray  # r singular values, largest first
    residuals: np.ndarray  # |X X^T u - s^2 u| / s_1^2 of each
    rounds: int  # filters that were applied
    products: int  # sparse products, each with the whole block


def truncated_svd(X, nodes: DataFrame, r: int, p: int = 10, rounds: int = ROUNDS, seed: int = 0, rows: DataFrame | None = None,
                  tol: float = TOL, degree: int = DEGREE) -> SVD:
    """The r largest singular triples of a sparse matrix ``X(src, dst, w)`` (V1), or of a sum of
    products of such matrices (V2): ``X`` is then a list of products, each a list of matrices,
    which are applied in turn and never multiplied out.  ``nodes`` (``id``) are the columns, ``rows`` the rows (the same if
    not given).  Fewer than r triples come back only if the matrix is smaller.

    Subspace iteration with a Chebyshev filter on a block of r + p vectors.  A round orthonormalises the block, solves
    the small problem on it (Rayleigh-Ritz) and takes the residual of every wanted triple.  While one is above
    ``tol``, the block is filtered by the Chebyshev polynomial in X X^T that is at most 1 up to the smallest value
    of the block (or up to where its degree can still tell values apart) and grows fastest beyond it: values that crowd below the largest ones, as in graphs of many
    components, need its steep growth.  Its degree is at most ``degree``, and less where the growth would pass ``GROWTH``.
    The filter holds two blocks besides the result, however high the degree.  After ``rounds`` filters the
    best block so far is returned, with the residuals that it has."""
    products = [[X]] if isinstance(X, DataFrame) else X
    nodes, merge = materialize(nodes.select("id"), "columns"), rows is not None and isinstance(X, DataFrame)
    rows = nodes if rows is None else materialize(rows.select("id"), "rows")
    k = min(r + p, nodes.count(), rows.count())
    if k == 0:
        return SVD(rows.select("id", F.array().cast("array<double>").alias("vec")), np.zeros(0), np.zeros(0), 0, 0)
    if merge:
        merged = materialize(merge_lone_columns(X), "merged-columns")
        products, nodes = [[merged]], materialize(merged.select(F.col("dst").alias("id")).distinct(), "columns")
    with fixed_plans(nodes.sparkSession):  # every shuffle here has its number of tasks
        A = Operand(products, k)
        if merge:
            discard(merged)
        return _filtered(A, nodes, rows, r, k, rounds, seed, tol, degree)


def _filtered(A: Operand, nodes: DataFrame, rows: DataFrame, r: int, k: int, rounds: int, seed: int, tol: float, degree: int) -> SVD:
    """The rounds of ``truncated_svd`` with a block of ``k`` vectors."""
    work = Workspace(nodes.sparkSession, "svd")

    zero = rows.select("id", F.array_repeat(F.lit(0.0), k).alias("vec"))
    Z = work.keep(combine([*A.terms(normal_rows(nodes, k, seed)), (zero, 1.0)]), "start")
    for turn in range(rounds + 1):
        Q = orthonormalize(Z, k, work=work, name=f"basis{turn}")
        Y = work.keep(A.apply(Q, True), f"projected{turn}")
        UY, s, _ = np.linalg.svd(r_factor(Y, k).T)
        U = right_multiply(Q, UY)
        images = work.keep(A.apply(right_multiply(Y, UY)), f"images{turn}")  # X X^T U
        top = max(float(s[0]) ** 2, np.finfo(float).tiny)
        gaps = combine([(images, 1.0), (right_multiply(U, np.diag(-s ** 2)), 1.0)])
        residuals = np.linalg.norm(r_factor(gaps, k), axis=0) / top  # R has the column lengths of its matrix
        if turn == rounds or residuals[:r].max() <= tol:
            break
        # [0, 2 half] is what the filter damps; where the block is all but level, the interval ends where the degree still discerns
        half = max(min(float(s[-1]) ** 2, top * (1 - (DISCERN / (2 * degree)) ** 2)), 1e-12 * top) / 2
        steep = np.arccosh(max((top - half) / half, 1.0 + 1e-9))
        last = int(np.clip(np.ceil(np.arccosh(GROWTH) / steep), 1, degree))
        before, Z = U, work.keep(combine([(images, 1 / half), (U, -1.0)]), "filter1")
        for t in range(2, last + 1):
            W = A.apply(Z, True)
            if len(A.plain) > 1:  # a sum reads it more than once
                W = work.keep(W, f"half{turn}-{t}")
            before, Z = Z, work.keep(combine([*((B, 2 / half) for B, _ in A.terms(W)), (Z, -2.0), (before, -1.0)]), f"filter{t}")
            work.drop(f"half{turn}-{t}", f"filter{t - 2}" if t > 2 else "start")
        work.drop(f"basis{turn}", f"projected{turn}", f"images{turn}", f"filter{last - 1}")
    return SVD(right_multiply(Q, UY[:, :r]), s[:r], residuals[:r], turn, A.products)


def laplacian_eigenmap(g: DataFrame, nodes: DataFrame, dim: int, seed: int = 0):
    """Laplacian eigenmap (V3): rSVD of D^-1/2 A D^-1/2 with ``dim + 1``
    components, ordered by singular value, the first (trivial) dropped; the raw
    singular vectors are the embedding (D11).  Returns ``id, vec``."""
    from citeweave.operators.graph import normalized_adjacency

    U, s = randomized_svd(normalized_adjacency(g), nodes, dim + 1, seed=seed)
    return U.select("id", F.slice("vec", 2, dim).alias("vec")), s


def pca_2d(vectors: DataFrame, vec: str = "vec", key: str = "id", k: int = 2) -> DataFrame:
    """PCA projection to k components (V13) with Spark ML after mean-centring."""
    from pyspark.ml.feature import PCA, StandardScaler

    v = vectors.select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_f"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_f", outputCol="_c").fit(v).transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).select(key, vector_to_array("_p").alias("proj"))


def residual_matrix(pairs: DataFrame, g: DataFrame, eps: float = 1e-12) -> DataFrame:
    """residual2vec matrix on the support of the centre/context counts (V5):
    ``R_ij = ln(max(P_ij, eps)) - ln(max(d_j / 2m, eps))`` with P the
    row-normalised pair counts and d the node degrees."""
    tot = pairs.groupBy("center").agg(F.sum("freq").alias("_t"))
    P = pairs.join(tot, "center").select(F.col("center").alias("src"), F.col("context").alias("dst"),
                                         (F.col("freq") / F.col("_t")).alias("p"))
    deg = g.groupBy(F.col("src").alias("dst")).agg(F.sum("w").alias("_d"))
    two_m = g.agg(F.sum("w").alias("_m")).first()["_m"]  # a scalar
    R = P.join(deg, "dst")
    return R.select("src", "dst", (F.log(F.greatest(F.col("p"), F.lit(eps)))
                                   - F.log(F.greatest(F.col("_d") / F.lit(two_m), F.lit(eps)))).alias("w"))


def residual_operand(pairs: DataFrame, g: DataFrame, eps: float = 1e-12) -> list[list[DataFrame]]:
    """The whole residual2vec matrix ``R_ij = ln(max(P_ij, eps)) - ln(max(d_j / 2m, eps))`` of all nodes of ``g`` (V5) as a
    sum of products for ``truncated_svd``: entries beside the observed pairs are ln(eps) less the same term of their
    column, a matrix of rank one, so only ``ln(max(P_ij, eps)) - ln(eps)`` of the observed pairs is a sparse matrix."""
    tot = pairs.groupBy("center").agg(F.sum("freq").alias("_t"))
    above = F.log(F.greatest(F.col("freq") / F.col("_t"), F.lit(eps))) - F.log(F.lit(eps))
    seen = pairs.join(tot, "center").select(F.col("center").alias("src"), F.col("context").alias("dst"), above.alias("w"))
    deg = materialize(g.groupBy("src").agg(F.sum("w").alias("_d")), "degrees")
    two_m = float(deg.agg(F.sum("_d").alias("_m")).first()["_m"] or 1.0)  # a scalar
    floor = F.log(F.lit(eps)) - F.log(F.greatest(F.col("_d") / F.lit(two_m), F.lit(eps)))
    zero = F.lit(0).cast(dict(g.dtypes)["src"])
    ones = deg.select("src", zero.alias("dst"), F.lit(1.0).alias("w"))
    return [[seen], [ones, deg.select(zero.alias("src"), F.col("src").alias("dst"), floor.alias("w"))]]


def factor_embedding(U: DataFrame, s: np.ndarray) -> DataFrame:
    """``U diag(sqrt(s))`` rows."""
    return right_multiply(U, np.diag(np.sqrt(np.abs(s))))
