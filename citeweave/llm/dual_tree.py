"""Vector code compression: product codes fitted by Lloyd rounds over two trees (integers throughout).

Vectors become whole numbers, are cut into equal consecutive parts, and every part position has a
codebook of its own.  A round assigns each part to the nearest entry (squared distance, ties to the lower index) and
moves each entry to the floor of its parts' mean.

Rows are stored once in blocks, and with them, for every position, the order of the parts along a
space-filling curve.  Over that order stands a tree: a leaf holds ``LEAF`` neighbouring parts, a node
``FAN`` neighbouring nodes, each with its bounding box and the cached sum and count of its parts.  The entries of
the codebook have such a tree of their own.  The two are descended together:

1. A pair (node of parts, node of entries) lies between the least and the largest distance of
   their boxes.  A pair whose least distance is over the least of the largest distances known for that node of parts
   holds no nearest entry of any of its parts, nor a tie, and goes.
2. A node of parts with one entry left is assigned whole: its cached sum and count go to that entry.
3. Parts in leaves that still have several entries are compared with those one by one.

Boxes and distances are whole numbers, so nothing is approximate.  A round sends one row for each
(position, entry) and task to the sum of that entry; codebooks, bounded by their size, are all that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import attach, whole_vectors
from citeweave.session import Workspace

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BLOCK_CELLS = 1 << 19  # rows times components of a block
LEAF, FAN = 16, 4
ENTRY_LEAF = 2


class Tree:
    """Boxes of nodes over points in a fixed order: ``levels[0]`` are the leaves, the last level is the root."""

    def __init__(self, points: np.ndarray, leaf: int, sums: bool = False):
        self.points, self.leaf, self.n = points, leaf, len(points)
        starts = np.arange(0, self.n, leaf)
        self.low, self.high = [np.minimum.reduceat(points, starts)], [np.maximum.reduceat(points, starts)]
        self.sum = [np.add.reduceat(points, starts)] if sums else None
        self.size = [leaf]
        while len(self.low[-1]) > 1:
            starts = np.arange(0, len(self.low[-1]), FAN)
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            if sums:
                self.sum.append(np.add.reduceat(self.sum[-1], starts))
            self.size.append(self.size[-1] * FAN)


def curve_order(points: np.ndarray) -> np.ndarray:
    """The order of the points along a curve that visits near points together (bits of all components interleaved)."""
    dims = min(points.shape[1], 63)
    if not dims or not len(points):
        return np.arange(len(points))
    own = (points[:, :dims] - points[:, :dims].min(0)).astype(np.uint64)
    digits = max(1, int(own.max()).bit_length())
    kept = min(digits, 63 // dims)
    key = np.zeros(len(points), np.uint64)
    for b in range(digits - 1, digits - kept - 1, -1):
        for j in range(dims):
            key = key << np.uint64(1) | (own[:, j] >> np.uint64(b)) & np.uint64(1)
    return np.argsort(key, kind="stable")


def _children(pairs: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """For nodes ``pairs`` of a level: their children, of ``below`` nodes one level down, and which pair each comes from."""
    child = pairs[:, None] * FAN + np.arange(FAN)
    real = child < below
    return child[real], np.repeat(np.arange(len(pairs)), real.sum(1))


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal numbers."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def nearest(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """``codes, sums, counts, seen``: the nearest entry of each point of ``tree`` (in its order), the sum and number
    of each entry's points, and how many points were assigned with whole nodes and how many one by one."""
    codes = np.zeros(tree.n, np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    seen = {"whole": 0, "single": 0}
    order = curve_order(entries)
    other = Tree(entries[order], ENTRY_LEAF)
    level, depth = len(tree.low) - 1, len(other.low) - 1
    p, e, single = np.zeros(1, np.int64), np.zeros(1, np.int64), False  # pairs, ordered by node of parts
    while True:
        # the entries' side goes down, to their leaves and then to the entries themselves
        if not single:
            if depth:
                depth -= 1
                e, source = _children(e, len(other.low[depth]))
                low, high = other.low[depth][e], other.high[depth][e]
            else:
                single = True
                child = e[:, None] * ENTRY_LEAF + np.arange(ENTRY_LEAF)
                real = child < other.n
                source, e = np.repeat(np.arange(len(e)), real.sum(1)), child[real]
                low = high = other.points[e]
            p = p[source]
        else:
            low = high = other.points[e]
        a, b = tree.low[level][p], tree.high[level][p]
        least = (np.maximum(0, np.maximum(a - high, low - b)) ** 2).sum(1)
        most = (np.maximum(high - a, b - low) ** 2).sum(1)
        starts = _groups(p)
        bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.append(starts, len(p))))
        keep = least <= bound
        p, e = p[keep], e[keep]
        if single:
            starts = _groups(p)
            alone = starts[np.diff(np.append(starts, len(p))) == 1]
            if len(alone):
                at, to = p[alone], order[e[alone]]
                size = tree.size[level]
                n = np.minimum(size, tree.n - at * size)
                np.add.at(sums, to, tree.sum[level][at])
                np.add.at(counts, to, n)
                where = np.repeat(at * size - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                codes[where] = np.repeat(to, n)
                seen["whole"] += int(n.sum())
                open_ = np.ones(len(p), bool)
                open_[alone] = False
                p, e = p[open_], e[open_]
            if not len(p):
                return codes, sums, counts, seen
            if not level:
                break
        if level:
            level -= 1
            child, source = _children(p, len(tree.low[level]))
            e = e[source]
            turn = np.lexsort((e, child))
            p, e = child[turn], e[turn]
    # leaves with several entries left: part by part, entries in the order of their index
    turn = np.lexsort((order[e], p))
    p, to = p[turn], order[e[turn]]
    starts = _groups(p)
    leaves = p[starts]
    at = leaves[:, None] * tree.leaf + np.arange(tree.leaf)
    real = at < tree.n
    group = np.repeat(np.arange(len(leaves)), np.diff(np.append(starts, len(p))))
    d = ((tree.points[np.minimum(at, tree.n - 1)][group] - entries[to][:, None, :]) ** 2).sum(2)
    best = np.minimum.reduceat(d, starts)
    code = np.minimum.reduceat(np.where(d == best[group], to[:, None], len(entries)), starts)
    where, code = at[real], code[real]
    codes[where] = code
    np.add.at(sums, code, tree.points[where])
    np.add.at(counts, code, 1)
    seen["single"] += len(where)
    return codes, sums, counts, seen


def _blocks(rows: DataFrame, block_cells: int, parts: int, dims: int) -> DataFrame:
    """``n, ids, labels, values, orders``: rows in blocks, the values as 32-bit numbers, and the curve order of each position."""
    label = rows.schema["label"].dataType.simpleString()
    size = max(1, block_cells // max(1, dims))

    def run(batches):
        import pyarrow as pa

        def block(held):
            held = held.combine_chunks()
            values = np.zeros((held.num_rows, dims), np.int32)
            for i, v in enumerate(held.column("v").to_pylist()):
                values[i, : len(v)] = v
            width = dims // parts
            orders = np.array([curve_order(values[:, k * width : (k + 1) * width].astype(np.int64)) for k in range(parts)], np.int32)
            one = pa.array([0, held.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, c.chunk(0) if isinstance(c := held.column(n), pa.ChunkedArray) else c) for n in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([pa.array([held.num_rows], pa.int64()), *lists, pa.array([values.tobytes()], pa.binary()),
                                               pa.array([orders.tobytes()], pa.binary())], names=["n", "ids", "labels", "values", "orders"])

        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= size:
                yield block(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield block(held)

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"n long, ids array<long>, labels array<{label}>, values binary, orders binary")


def _arrays(batch, parts: int):
    """``values, trees' orders`` of each block of an Arrow batch, one at a time."""
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        values = np.frombuffer(batch.column("values")[i].as_py(), np.int32).reshape(n, -1).astype(np.int64)
        yield i, values, np.frombuffer(batch.column("orders")[i].as_py(), np.int32).reshape(parts, n)


def refined(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry moves to the floor of the mean of its parts; unused entries stay."""
    parts, width = len(books), books[0].shape[1]

    def run(batches):
        import pyarrow as pa

        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, values, orders in _arrays(batch, parts):
                for k in range(parts):
                    tree = Tree(values[orders[k], k * width : (k + 1) * width], LEAF, sums=True)
                    _, s, c, _ = nearest(tree, books[k])
                    sums[k] += s
                    counts[k] += c
        used = [(k, int(j)) for k in range(parts) for j in np.flatnonzero(counts[k])]
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in used], pa.int32()), pa.array([j for _, j in used], pa.int32()),
            pa.array([int(counts[k][j]) for k, j in used], pa.int64()), pa.array([sums[k][j].tolist() for k, j in used], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"])

    found = blocks.select("n", "values", "orders").mapInArrow(run, "part int, entry int, n long, total array<long>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    new = [b.copy() for b in books]
    for r in totals.collect():  # parts times entries rows at most
        new[r.part][r.entry] = [t // r.n for t in r.total]
    return new


def assigned(blocks: DataFrame, books: list[np.ndarray], label_type: str) -> DataFrame:
    """``vec_id, label, code, error`` of every row."""
    parts, width = len(books), books[0].shape[1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, values, orders in _arrays(batch, parts):
                codes, error = np.zeros((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
                for k in range(parts):
                    own = values[:, k * width : (k + 1) * width]
                    found, _, _, _ = nearest(Tree(own[orders[k]], LEAF, sums=True), books[k])
                    codes[orders[k], k] = found
                    error += ((own - books[k][codes[:, k]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array([c.tobytes().hex() for c in codes], pa.string()),
                     pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label_type}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a whole vector.

    Codebooks start as the parts of the ``entries`` (256 at most) rows of smallest id (null ids last, ties by the vector; fewer
    rows: fewer entries).  ``code`` has two hexadecimal digits for each part, ``error`` is the squared distance
    to the entries, ``label_error`` its sum over all rows of the same label (null labels are one), and
    ``codebooks_sha256`` the hash of all final components, joined by commas.

    Vectors that are null or hold null or non-finite components are left out.  Others are filled up with
    zeros to the longest, and that to a multiple of ``parts``.  Repeated rows each have their row.  Other
    columns are not read.  An empty table gives an empty result."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    ws = Workspace(vectors.sparkSession, "dual-tree")
    rows = ws.keep(whole_vectors(vectors, id_col, vec_col, scale, F.col(label_col).alias("label")), "vectors")
    total, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(1, -(-longest // parts)) * parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # bounded by the codebook
    start = np.array([r.v + [0] * (dims - len(r.v)) for r in first], np.int64).reshape(len(first), dims)
    width = dims // parts
    books = [start[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    kind = rows.schema["label"].dataType.simpleString()
    if not total:
        return rows.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    blocks = ws.keep(_blocks(rows, block_cells, parts, dims), "blocks")
    for _ in range(rounds):
        books = refined(blocks, books)
    sha = hashlib.sha256(",".join(str(x) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()
    coded = assigned(blocks, books, kind).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("_none", F.col("label").isNull())
    coded = ws.keep(coded, "coded")
    groups = coded.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return attach(coded, ws.keep(groups, "labels"), ["_label", "_none"], "_n", total).select(
        "vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
