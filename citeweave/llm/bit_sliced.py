"""Exact top-k inner-product search by a bit-sliced index.

Vectors become whole numbers ``floor(scale * x)``.  The index holds blocks of rows; in a block
every attribute (component), less its least value there, is kept as bit slices: one bitmap over
the block's rows for each binary digit.

A query meets a block by bitmap arithmetic alone:

1. A digit of a query component times a slice of that attribute is the slice itself at a higher place.
   For a negative component the complemented slices are taken, so that all terms are added.  Places
   under a cut are left out; what they can amount to at most is the error, which is
   kept under ``1 / 2^SLACK`` of the largest possible score.
2. Full adders (three bitmaps of one place give one of that place and one of the next) add all
   slices to the slices of one sum per row.
3. The sum's slices are read from the most significant downward: rows with the digit set stay
   while there are k of them, else they are counted as certain and the search goes on among the others.
   This gives the k-th largest sum.
4. Rows whose sum is within the error of it are the boundary: their components are put together
   from all slices, their scores computed exactly, and the k best kept (ties to the smaller id).

Every block answers with its own exact k best of each query; the k best of these are the result.
Blocks and batches of queries are bounded in cells (rows times components) and meet by an
equi-join on (block, batch), so no task depends on the size of either side.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import whole_vectors
from citeweave.session import Workspace

SCALE = 256
BLOCK_CELLS = 1 << 22  # rows times components of a block
BATCH_CELLS = 1 << 17  # of a batch of queries
LEAST_BATCH = 32
SLACK = 7  # the bits left out may add up to 1 / 2^SLACK of the largest score
DECODE = 4096  # boundary rows decoded at a time

INDEX = "block long, n long, ids array<long>, rows array<long>, low array<long>, width array<int>, slices binary"


def _matrix(lists: list) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to the longest."""
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``low, width, slices``: the least value and the number of digits of each attribute, and the
    bitmaps of all digits, least significant first, attribute by attribute (as 64-bit words)."""
    n, dims = values.shape
    low = values.min(0) if n else np.zeros(dims, np.int64)
    width = np.array([int(m).bit_length() for m in (values - low).max(0)] if n and dims else [0] * dims, np.int64)
    words = -(-n // 64)
    slices = np.zeros((int(width.sum()), words * 8), np.uint8)
    at = 0
    for j in range(dims):
        own = values[:, j] - low[j]
        for b in range(width[j]):
            packed = np.packbits(((own >> b) & 1).astype(np.uint8), bitorder="little")
            slices[at, : len(packed)] = packed
            at += 1
    return low, width, slices.view(np.uint64)


class Block:
    """One block of the index in memory."""

    def __init__(self, n: int, low: np.ndarray, width: np.ndarray, slices: np.ndarray):
        self.n, self.low, self.width, self.slices = n, low, width, slices
        self.inverse = ~slices
        self.start = np.concatenate(([0], np.cumsum(width)))
        self.digit = np.arange(len(slices)) - np.repeat(self.start[:-1], width)
        every = np.zeros(slices.shape[1] * 8, np.uint8)
        every[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.exists = every.view(np.uint64)

    def sums(self, weights: list[int]) -> tuple[list[np.ndarray], int, int]:
        """Slices of the rows' sums from place ``cut`` up, and the most that the places left out can add."""
        terms = defaultdict(list)
        for j, w in enumerate(weights):
            source, size = (self.slices, w) if w > 0 else (self.inverse, -w)
            a = 0
            while size:
                if size & 1:
                    for b in range(self.width[j]):
                        terms[a + b].append(source[self.start[j] + b])
                size >>= 1
                a += 1
        largest = sum(len(t) << place for place, t in terms.items())
        cut = error = 0
        while terms and (error + (len(terms.get(cut, ())) << cut)) << SLACK <= largest:
            error += len(terms.pop(cut, ())) << cut
            cut += 1
        out, place = [], cut
        while terms:
            own, carried = terms.pop(place, []), terms[place + 1]
            while len(own) > 2:
                a, b, c = own.pop(), own.pop(), own.pop()
                x = a ^ b
                carried.append((a & b) | (x & c))
                x ^= c
                own.append(x)
            if len(own) == 2:
                a, b = own
                carried.append(a & b)
                own = [a ^ b]
            out.append(own[0] if own else np.zeros_like(self.exists))
            if not carried:
                del terms[place + 1]
            place += 1
        return out, cut, error

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """The components of some rows, from all slices."""
        bits = (self.slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        parts = bits.astype(np.int64) << self.digit[:, None]
        total = np.concatenate((np.zeros((1, len(rows)), np.int64), np.cumsum(parts, 0)))
        return self.low[:, None] + total[self.start[1:]] - total[self.start[:-1]]

    def top(self, weights: np.ndarray, k: int, ids: np.ndarray, own_row: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the ``k`` best (fewer if there are not so many), ties by ``ids``."""
        weights = np.concatenate((weights[: len(self.low)], np.zeros(max(0, len(self.low) - len(weights)), np.int64)))
        if float(np.abs(weights).astype(np.float64) @ (np.abs(self.low) + (1 << self.width)).astype(np.float64)) >= 2.0**63:
            raise OverflowError("a score does not fit 64 bits")
        exists = self.exists
        if own_row is not None:
            exists = exists.copy()
            exists[own_row >> 6] &= ~(np.uint64(1) << np.uint64(own_row & 63))
        slices, cut, error = self.sums([int(w) for w in weights])
        error >>= cut
        if int(np.bitwise_count(exists).sum()) > k:
            tied, wanted, kth = exists, k, 0
            for place in range(len(slices) - 1, -1, -1):
                hit = tied & slices[place]
                count = int(np.bitwise_count(hit).sum())
                if count >= wanted:
                    tied, kth = hit, kth | 1 << place
                else:
                    tied, wanted = tied & ~slices[place], wanted - count
            exists = self.at_least(slices, exists, max(0, kth - error))
        rows = np.flatnonzero(np.unpackbits(exists.view(np.uint8), bitorder="little"))
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(rows), DECODE):
            some = rows[at : at + DECODE]
            best, score = np.concatenate((best, some)), np.concatenate((score, weights @ self.decode(some)))
            order = np.lexsort((best, ids[best], -score))[:k]
            best, score = best[order], score[order]
        return best, score

    @staticmethod
    def at_least(slices: list[np.ndarray], exists: np.ndarray, bound: int) -> np.ndarray:
        """The rows whose sum is ``bound`` or more."""
        above, equal = np.zeros_like(exists), exists
        if bound >> len(slices):
            return above
        for place in range(len(slices) - 1, -1, -1):
            if bound >> place & 1:
                equal = equal & slices[place]
            else:
                above |= equal & slices[place]
                equal = equal & ~slices[place]
        return above | equal


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The index (``INDEX``) of ``row, vec_id, v``, dealt evenly over ``blocks`` tasks; each makes one block."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = pa.Table.from_batches(list(batches), _row_schema())
        if held.num_rows:
            low, width, slices = slice_block(_matrix(held.column("v").to_pylist()))
            values = {"block": TaskContext.get().partitionId(), "n": held.num_rows, "ids": held.column("vec_id").to_pylist(),
                      "rows": held.column("row").to_pylist(), "low": low, "width": width.astype(np.int32), "slices": slices.tobytes()}
            yield pa.RecordBatch.from_pylist([values], pa.schema(
                [("block", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
                 ("low", pa.list_(pa.int64())), ("width", pa.list_(pa.int32())), ("slices", pa.binary())]))

    return vectors.select("row", "vec_id", "v").repartition(blocks).mapInArrow(run, INDEX)


def _row_schema():
    import pyarrow as pa

    return pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))])


def _search(k: int):
    def search(key, queries, index):
        import pyarrow as pa

        out = [[], [], [], [], []]
        if queries.num_rows and index.num_rows:
            b = index.to_pylist()[0]
            width = np.array(b["width"], np.int64)
            words = -(-b["n"] // 64)
            block = Block(b["n"], np.array(b["low"], np.int64), width, np.frombuffer(b["slices"], np.uint64).reshape(-1, words))
            # a null id comes after all others
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in b["ids"]], np.int64)
            place = {r: i for i, r in enumerate(b["rows"])}
            for q in queries.to_pylist()[0]["qs"]:
                rows, scores = block.top(np.array(q["v"], np.int64), k, ids, place.get(q["row"]))
                for column, values in zip(out, ([q["row"]] * len(rows), [q["vec_id"]] * len(rows), [b["ids"][r] for r in rows],
                                                [b["rows"][r] for r in rows], scores.tolist())):
                    column += values
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_row", "query_id", "vec_id", "row", "score"])

    return search


def top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
          block_cells: int = BLOCK_CELLS, batch_cells: int = BATCH_CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that the condition ``is_query`` names, the ``k`` largest inner
    products (all, if fewer) with all other rows, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part.  Vectors of unequal length are
    multiplied as far as both go; an empty one scores 0.  Rows are told apart by their place, so a row that is repeated
    finds its copies, and each of two rows with one id is a query.  A null id comes after all others.  Other
    columns are not read.  An empty table or no query gives an empty result."""
    ws = Workspace(vectors.sparkSession, "bit-sliced")
    whole = whole_vectors(vectors, id_col, vec_col, scale, is_query.alias("wanted"))
    rows = ws.keep(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries, dims = rows.agg(F.count(F.lit(1)), F.count_if("wanted"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n * max(1, dims) // block_cells))
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    batches = max(1, -(-n_queries * max(1, dims) // batch_cells), min(-(-n_queries // LEAST_BATCH), -(-tasks // blocks)))
    index = ws.keep(build_index(rows, blocks), "index")
    asked = rows.where("wanted").withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches))) \
        .groupBy("batch").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("qs"))  # bounded by the batch
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = index.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    found = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInArrow(
        _search(k), "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
