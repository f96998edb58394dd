import hashlib
import math

import numpy as np

from citeweave.llm import dual_tree, queries

SF = "/root/testdata/sf0.001"


def brute(rows, parts=16, entries=64, rounds=2):
    """{id: (code, error, label_error, sha)} by plain loops over all parts and entries."""
    kept = sorted((i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows
                  if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // parts
    cut = [[v[k * w : (k + 1) * w] for k in range(parts)] for _, v, _ in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[k])), key=lambda j: (d(c[k], books[k][j]), j)) for k in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for k in range(parts):
            for j in range(len(books[k])):
                own = [c[k] for c, code in zip(cut, codes) if code[k] == j]
                if own:
                    books[k][j] = [sum(x) // len(own) for x in zip(*own)]
    codes = assign()
    errors = [sum(d(c[k], books[k][code[k]]) for k in range(parts)) for c, code in zip(cut, codes)]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, bytes(code).hex(), e, by_label[label], sha) for (i, _, label), code, e in zip(kept, codes, errors)]


def rows_of(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries.QUERIES["op12_dual_tree_codes"](spark, SF)) == sorted(brute(rows))


def test_ties_clusters_and_block_sizes(spark):
    """Coarse grids full of ties and far clusters; the answer does not depend on the blocks."""
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 8)) / 64
    v[100:200] += rng.integers(0, 3, (100, 1))
    rows = [(int(i), [float(x) for x in x], [None, 1, 2][i % 3]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(brute(rows, 2, 20, 3))
    for cells in (8 * 37, 1 << 19):
        assert rows_of(dual_tree.compress(df, parts=2, entries=20, rounds=3, block_cells=cells)) == want


def test_trees_equal_all_distances():
    rng = np.random.default_rng(6)
    for n, m, spread in ((1, 1, 5), (17, 3, 2), (500, 64, 40), (5000, 64, 150), (5000, 200, 4)):
        points = np.cumsum(rng.integers(-spread, spread + 1, (n, 3)), 0)
        entries = points[rng.integers(0, n, m)] + rng.integers(-2, 3, (m, 3))
        tree = dual_tree.Tree(points[dual_tree.curve_order(points)], dual_tree.LEAF, sums=True)
        codes, sums, counts, seen = dual_tree.nearest(tree, entries)
        d = ((tree.points[:, None] - entries) ** 2).sum(2)
        assert (codes == d.argmin(1)).all() and seen["whole"] + seen["single"] == n
        assert (counts == np.bincount(codes, minlength=m)).all()
        assert (sums == np.array([tree.points[codes == j].sum(0) for j in range(m)])).all()
        assert n < 5000 or seen["whole"] > 0


def test_odd_rows(spark):
    nan = float("nan")
    good = [float(k) / 8 for k in range(16)]
    rows = [(1, good, 1), (1, good, 1), (2, None, 1), (3, good[:-1] + [None], 1), (4, good[:-1] + [nan], 1), (None, good, None), (5, good[:3], None), (6, [], 2)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, v int, code string, n int")
    got = sorted(dual_tree.compress(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [r.vec_id for r in got] == [1, 1, 5, 6, None] and all(r.error == 0 for r in got)
    assert got[0].code == "00" * 16 and got[-1].code == "00" * 16 and got[2].code == "00" * 3 + "02" * 13
    assert dual_tree.compress(df.limit(0)).collect() == []
    assert dual_tree.compress(df.where("vec_id = 2")).collect() == []
