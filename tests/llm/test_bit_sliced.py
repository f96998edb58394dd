import numpy as np
import pytest

from citeweave.llm import bit_sliced, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(rows, k, wanted):
    """(query, [(score, id)]) by plain integer products over all pairs of rows."""
    import math

    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and wanted(i):
            scores = sorted(((sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(kept) if b != a),
                            key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out.append((i, scores[:k]))
    return sorted(out)


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in out.items()}


def test_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {q: s for q, s in brute(rows, 5, lambda i: i % 50 == 0)}
    assert grouped(queries.QUERIES["op11_bit_sliced_top_k"](spark, SF)) == want and len(want) == 10


def test_blocks_and_batches_do_not_matter(spark):
    """Many small blocks, ties, copies of a query, wide and constant components."""
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (700, 6)) / 16
    v[:, 3] = 0.5
    v[::7, 4] = 900.25
    v[100:160] = v[99]
    rows = [(int(i), [float(x) for x in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: s for q, s in brute(rows, 9, lambda i: i % 20 == 0)}
    for cells in (200, 1 << 22):
        got = bit_sliced.top_k(df, F.col("vec_id") % 20 == 0, 9, block_cells=cells, batch_cells=60)
        assert grouped(got) == want


def test_slices_add_up():
    """The approximate sums and their error hold the exact score of every row, and all slices give back the components."""
    rng = np.random.default_rng(3)
    values = rng.integers(-300, 200, (333, 20))
    low, width, slices = bit_sliced.slice_block(values)
    block = bit_sliced.Block(333, low, width, slices)
    assert (block.decode(np.arange(333)) == values.T).all()
    for weights in rng.integers(-90, 90, (20, 20)):
        sums, cut, error = block.sums([int(w) for w in weights])
        got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:333].astype(np.int64) << (k + cut) for k, s in enumerate(sums))
        base = sum(w * (lo if w > 0 else lo + (1 << b) - 1) for w, lo, b in zip(weights, low, width))
        rest = values @ weights - base - got
        assert 0 < error and 0 <= rest.min() and rest.max() <= error


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, None]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]),
            (None, [1.0, 2.0]), (250, []), (300, [1.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, row int, v int, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0, 4).collect()]
    top = 256 * 256 * 5
    assert sorted(x for x in got if x[0] == 0) == sorted(2 * [(0, 1, 0, top), (0, 2, 1, top), (0, 3, 1, top), (0, 4, None, top)])
    assert [x for x in sorted(got) if x[0] == 250] == [(250, 1, 0, 0), (250, 2, 0, 0), (250, 3, 1, 0), (250, 4, 1, 0)]
    assert {x[0] for x in got} == {0, 250, 300}
    assert bit_sliced.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 4).collect() == []
    assert bit_sliced.top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0, 4).collect() == []
    with pytest.raises(Exception, match="or more"):
        bit_sliced.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), F.lit(True), 1).collect()
