"""Hand-made cases for the traps listed in FIXTURES.md part C, plus invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.functions.columns import cantor_pair, cantor_unpair, doi_journal, strip_ws
from citeweave.operators import clean, components, evaluate, graph as G, prefix, relate, sample, stats, walks
from citeweave.operators import vectors as V


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_doi_journal_and_strip(spark):
    df = spark.createDataFrame([("10.1103/PhysRevB.12.345", " \t x \n")], "doi string, s string")
    r = df.select(doi_journal("doi").alias("j"), strip_ws("s").alias("s")).first()
    assert r["j"] == "PhysRevB" and r["s"] == "x"


def test_code_cleaning_cases(spark):
    raw = [("a", " 0367Aa ", "03.67.-a", "03.67.-a42.50.Dv", "n0367Aa", "1977PACS: 0367Aa and 4250Dv"),
           ("b", "abc", None, None, None, None)]
    df = spark.createDataFrame(raw, "doi string, pacs1 string, pacs2 string, pacs3 string, pacs4 string, pacs5 string")
    got = rows(clean.clean_codes(df), "doi", "pacs_code")
    # '03.67.-a' -> '0367-a' (6 chars, kept); glued 16 chars split in two; duplicates kept
    assert ("a", "0367Aa") in got and ("a", "4250Dv") in got and ("a", "0367-a") in got
    assert sum(1 for g in got if g == ("a", "0367Aa")) == 3
    assert not [g for g in got if g[0] == "b"]


def test_null_type_kept_and_unknown_paper_dropped(spark):
    meta = spark.createDataFrame([("10.1103/A.1.1", "2000-01-01", None), ("10.1103/A.1.2", "1999-01-01", "P"),
                                  ("10.1103/A.1.3", "1998-01-01", "F")], "doi string, d string, article_type string") \
        .withColumn("date", F.to_timestamp("d")).drop("d")
    edges = spark.createDataFrame([("10.1103/A.1.1", "10.1103/A.1.3"), ("10.1103/A.1.1", "10.1103/A.1.2"),
                                   ("10.1103/A.1.1", "10.1103/A.1.9")], "citing_doi string, cited_doi string")
    net = clean.citation_network(edges, meta, max_year=2005, remove_types=["P"])
    assert rows(net, "citing_doi", "cited_doi") == [("10.1103/A.1.1", "10.1103/A.1.3")]


def test_vote_tie_rules(spark):
    df = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1"), ("q", "1"), ("q", "3")], "k string, lab string")
    assert rows(relate.top_label(df, ["k"], "lab", tie="largest"), "k", "lab") == [("p", "2"), ("q", "1")]
    assert rows(relate.top_label(df, ["k"], "lab", tie="smallest"), "k", "lab") == [("p", "1"), ("q", "1")]


def test_knn_vote_smallest_label_on_tie(spark):
    nb = spark.createDataFrame([(1, 10, 0.1, 1), (1, 11, 0.2, 2)], "qid long, nid long, dist double, rank int")
    lab = spark.createDataFrame([(10, "b"), (11, "a")], "nid long, label string")
    r = {x["k"]: x["pred"] for x in V.knn_vote(nb, lab, [1, 2]).collect()}
    assert r == {1: "b", 2: "a"}


def test_exact_knn_matches_bruteforce(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(60)], "id long, vec array<double>")
    nb = V.knn_search(df, df, 4, qid="id", tid="id", exclude_self=True, q_blocks=3, t_blocks=2)
    got = {(r["qid"], r["rank"]): r["nid"] for r in nb.collect()}
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for i in range(60):
        want = np.argsort(D[i], kind="stable")[:4]
        assert [got[(i, k + 1)] for k in range(4)] == list(want)


def test_centroid_uses_distinct_values(spark):
    m = spark.createDataFrame([("c", "x", [1.0, 2.0]), ("c", "x", [1.0, 2.0]), ("c", "y", [3.0, 2.0])],
                              "code string, doi string, vec array<double>")
    c = {r["pos"]: r["c"] for r in V.class_centroids(m, ["code"]).collect()}
    assert c == {0: 2.0, 1: 2.0}


def test_cosine_zero_vector_is_null(spark):
    p = spark.createDataFrame([(1, 2)], "a long, b long")
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, vec array<double>")
    assert V.pair_cosine(p, v, key="id").first()["cos_sim"] is None


def test_cantor_roundtrip(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") * 104729 % 997).alias("b"))
    z = df.withColumn("z", cantor_pair("a", "b"))
    k1, k2 = cantor_unpair("z")
    assert z.where((k1 != F.col("a")) | (k2 != F.col("b"))).count() == 0


def test_cantor_roundtrip_of_large_ids(spark):
    ids = [0, 1, 2, 300_000_000, (1 << 30) - 1, 1 << 30, 1_073_741_822, 1_500_000_000, (1 << 31) - 1]
    pairs = [(a, b) for a in ids for b in ids]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("z", cantor_pair("a", "b"))
    k1, k2 = cantor_unpair("z")
    for r in df.select("a", "b", "z", k1.alias("x"), k2.alias("y")).collect():
        assert r.z == (r.a + r.b) * (r.a + r.b + 1) // 2 + r.b and (r.x, r.y) == (r.a, r.b)


def test_prefix_sums_and_dense_index(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 37) % 5000).alias("v"), F.lit(1.0).alias("one"))
    ps = prefix.prefix_sums(df, ["v"], ["one"], with_index=True, num_partitions=7)
    assert ps.where(F.col("cum_one") != F.col("v") + 1).count() == 0
    assert ps.where(F.col("row_idx") != F.col("v")).count() == 0
    di = prefix.dense_index(df.select("v"), ["v"], num_partitions=5)
    assert di.where(F.col("idx") != F.col("v")).count() == 0


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 2.0, 3.0, 3.0, 3.0]], "x double")
    r = {row["x"]: row["rank"] for row in prefix.average_ranks(df, "x", num_partitions=3).collect()}
    assert r == {1.0: 1.0, 2.0: 2.5, 3.0: 5.0}


def test_auc_equals_pairwise_count(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(200), 2)
    y = (rng.random(200) < 0.4).astype(int)
    df = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(s, y)], "method string, score double, label int")
    auc = evaluate.roc_auc(df, "method").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([("m", 0.1, 1), ("m", 0.2, 1)], "method string, score double, label int")
    assert evaluate.roc_auc(df, "method").first()["auc"] is None


def test_scores_label_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "true_label string, pred_label string")
    s = {r["average"]: r for r in evaluate.classification_scores(df.withColumn("g", F.lit(1)), ["g"]).collect()}
    assert abs(s["micro"]["f1_score"] - 2 / 3) < 1e-12
    # labels a (P=.5,R=1), b (0,0), c (1,1): macro precision = 0.5
    assert abs(s["macro"]["precision"] - 0.5) < 1e-12


def test_kruskal_matches_formula(spark):
    rng = np.random.default_rng(2)
    vals = [(g, float(np.round(rng.normal(g * 0.3), 1))) for g in range(4) for _ in range(25)]
    df = spark.createDataFrame(vals, "g int, v double")
    res = stats.kruskal(df, "g", "v").first()
    x = np.array([v for _, v in vals])
    order = np.argsort(x, kind="stable")
    ranks = np.empty(len(x))
    ux, inv, cnt = np.unique(x, return_inverse=True, return_counts=True)
    before = np.cumsum(cnt) - cnt
    ranks = before[inv] + (cnt[inv] + 1) / 2
    N = len(x)
    H = 12 / (N * (N + 1)) * sum(ranks[[i for i, (g, _) in enumerate(vals) if g == k]].sum() ** 2 / 25 for k in range(4)) - 3 * (N + 1)
    H /= 1 - (cnt ** 3 - cnt).sum() / (N ** 3 - N)
    assert abs(res["h"] - H) < 1e-9 and 0 <= res["p"] <= 1 and (res["df"], res["n"]) == (3, 100)
    assert order is not None


def test_t_distribution_helpers():
    assert abs(stats.t_cdf(0.0, 5) - 0.5) < 1e-12
    assert abs(stats.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-6
    assert abs(stats.chi2_sf_df3(7.814727903251178) - 0.05) < 1e-6


def test_walk_steps_are_edges(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    g = G.build_graph(e, mode="to_cited")
    w = walks.random_walks(g, 3, 6, seed=4)
    arr = walks.walk_arrays(w).collect()
    edges = {(0, 1), (1, 2), (2, 0), (2, 3)}
    for r in arr:
        seq = r["nodes"]
        for a, b in zip(seq, seq[1:]):
            assert (a, b) in edges or (a == b == 3)
    # node 3 is a sink: walks starting there record it twice and stop
    starts3 = [r["nodes"] for r in arr if r["walk_id"] // 3 == 3]
    assert all(s == [3, 3] for s in starts3)


def test_second_order_walks_have_the_law_of_the_second_order_network(spark):
    """Chi-square of the moves from every (previous, current) state against the weights of ``second_order_edges``."""
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 0), (1, 4)]
    far = 300_000_000  # ids that a paired state would not bring back
    e = spark.createDataFrame([(a * far, b * far) for a, b in pairs], "src long, dst long")
    g = G.build_graph(e)
    p, q = 0.25, 3.0
    law = {}
    for r in G.second_order_edges(g, p, q, add_source=False).collect():
        law.setdefault((r.prev, r.cur), {})[r.nxt] = r.w
    seen = {}
    for r in walks.walk_arrays(walks.rejection_walks(g, 1200, 6, p, q, seed=5)).collect():
        assert len(r.nodes) == 6
        for a, b, c in zip(r.nodes, r.nodes[1:], r.nodes[2:]):
            own = seen.setdefault((a, b), {})
            own[c] = own.get(c, 0) + 1
    assert set(seen) == set(law)
    chi = free = 0
    for state, own in seen.items():
        n, total = sum(own.values()), sum(law[state].values())
        chi += sum((own.get(c, 0) - n * w / total) ** 2 / (n * w / total) for c, w in law[state].items())
        free += len(law[state]) - 1
    assert chi < free + 4 * (2 * free) ** 0.5


def test_second_order_walks_pass_a_hub(spark):
    """A star of 20,000 leaves: its second-order network would have 400 million edges."""
    n = 20_000
    e = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    w = walks.rejection_walks(G.build_graph(e), 1, 3, 0.5, 2.0, seed=1)
    r = w.groupBy("walk_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("node") == 0)).alias("hub"))
    assert r.where("n <> 3 OR hub NOT IN (1, 2)").count() == 0 and r.count() == n + 1


def test_pieces_give_the_pairs_of_whole_walks(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    for mode in ("undirected", "to_cited"):
        pieces = walks.walk_pieces(G.build_graph(e, mode=mode), 3, 24, seed=4)
        got = {(r.center, r.context): r.freq for r in walks.piece_pairs(pieces, 10, 24).collect()}
        want = {}
        for r in walks.walk_arrays(walks.walk_rows(pieces)).collect():
            for a in range(min(24 - 10, len(r.nodes))):
                for b in range(a + 1, min(a + 11, len(r.nodes))):
                    want[r.nodes[a], r.nodes[b]] = want.get((r.nodes[a], r.nodes[b]), 0) + 1
        assert got == want
        assert got == {(r.center, r.context): r.freq for r in walks.context_pairs(walks.walk_rows(pieces), 10, 24).collect()}


def test_pairs_and_whole_walks_are_shared_by_size(spark, monkeypatch):
    """Walkers carry no copy of stored nodes, and the tasks that put walks together and count pairs grow with the corpus."""
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (-2, 5)], "src long, dst long")
    pieces = walks.walk_pieces(G.build_graph(e), 3, 24, seed=4)
    assert pieces.columns == ["walk_id", "start", "t", "path"]
    assert pieces.where("start <> cast(floor(walk_id / 3) as long) OR (t = 0 AND path[0] <> start)").count() == 0
    want = sorted((r.walk_id, tuple(r.nodes)) for r in walks.walk_arrays(walks.walk_rows(pieces)).collect())
    counts = sorted(map(tuple, walks.piece_pairs(pieces, 10, 24).collect()))
    monkeypatch.setattr(walks, "NODES_PER_TASK", 20)
    monkeypatch.setattr(walks, "PAIRS_PER_TASK", 50)
    whole, pairs = walks.whole_walks(pieces), walks.piece_pairs(pieces, 10, 24)
    assert whole.rdd.getNumPartitions() == -(-7 * 3 * 24 // 20) and pairs.rdd.getNumPartitions() == -(-7 * 3 * 24 * 10 // 50)
    assert sorted((r.walk_id, tuple(r.nodes)) for r in whole.collect()) == want
    assert sorted(map(tuple, pairs.collect())) == counts
    assert walks.piece_pairs(pieces, 10, 10).count() == 0


def test_walk_edges_are_not_sorted_again(spark, monkeypatch):
    monkeypatch.setattr(walks, "fits_broadcast", lambda rows, width: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    e = spark.range(400).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 400).alias("dst"))
    g = G.build_graph(e)
    be = walks.laid_out(walks.bucketed_edges(g))
    front = spark.range(400).select(F.col("id").alias("walk_id"), F.col("id").alias("start"), F.lit(2).alias("start_deg"), F.col("id").alias("cur"),
                                    F.lit(2).cast("long").alias("deg"), F.array().cast("array<bigint>").alias("tail"), F.array("id").alias("path"))
    plan = walks._step(front, be, 1, 1, 0.0, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Sort [") == 1, plan
    whole = walks.walk_arrays(walks.random_walks(g, 2, 15, seed=3)).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, walks.walk_arrays(walks.random_walks(g, 2, 15, seed=3)).collect()))


def test_components_two_equal(spark):
    e = spark.createDataFrame([(5, 6), (6, 7), (1, 2), (2, 3), (9, 9)], "a long, b long")
    c = {r["node"]: r["component"] for r in components.connected_components(e, "a", "b").collect()}
    assert c[7] == 5 and c[3] == 1 and c[9] == 9
    lc = components.largest_component(e, components.connected_components(e, "a", "b"), "a", "b")
    assert rows(lc, "a", "b") == [(1, 2), (2, 3)]


def test_randomized_svd_singular_values(spark):
    from citeweave.operators import linalg

    rng = np.random.default_rng(3)
    n = 40
    A = (rng.random((n, n)) < 0.15).astype(float)
    A = np.triu(A, 1)
    A = A + A.T
    trip = [(int(i), int(j), float(A[i, j])) for i in range(n) for j in range(n) if A[i, j]]
    X = spark.createDataFrame(trip, "src long, dst long, w double")
    nodes = spark.range(n).select(F.col("id"))
    _, s = linalg.randomized_svd(X, nodes, 5, p=30, q=3, seed=1)
    want = np.sort(np.abs(np.linalg.eigvalsh(A)))[::-1][:5]
    assert np.allclose(np.sort(s)[::-1], want, atol=1e-6)


def test_sampling_is_deterministic_and_exact(spark):
    df = spark.range(0, 1000).select(F.col("id"))
    a = rows(sample.sample_n(df, ["id"], 123, seed=9), "id")
    b = rows(sample.sample_n(df.repartition(13), ["id"], 123, seed=9), "id")
    assert a == b and len(a) == 123


def test_html_clean_modes(spark):
    df = spark.createDataFrame([(1, "<p>a &amp; b</p><script>x</script>/emph>"), (2, "")], "id int, h string")
    sql = {r["id"]: r["h"] for r in clean.clean_text(df, "h", mode="sql").collect()}
    par = {r["id"]: r["h"] for r in clean.clean_text(df, "h", mode="parser").collect()}
    assert sql == {1: "a & bx"} and par == {1: "a & bx"}


def test_normaltest_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double")
    r = stats.normaltest(df, "g", "v").first()
    assert 0 <= r["p"] <= 1 and r["n"] == 300
    m = x.mean()
    g1 = ((x - m) ** 3).mean() / ((x - m) ** 2).mean() ** 1.5
    assert math.isclose(r["skew"], g1, rel_tol=1e-9)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = [(g, float(v)) for g in ("a", "b") for v in np.round(rng.normal(size=37 if g == "a" else 50), 3)]
    df = spark.createDataFrame(vals, "g string, v double")
    got = {r["g"]: (r["n"], r["q_0"], r["q_1"], r["q_2"]) for r in stats.exact_quantiles(df, "g", "v", [0.25, 0.5, 0.9]).collect()}
    for g in ("a", "b"):
        x = np.array([v for k, v in vals if k == g])
        assert got[g][0] == len(x)
        assert np.allclose(got[g][1:], np.quantile(x, [0.25, 0.5, 0.9]), atol=1e-12)


def test_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, 5, "q")], "k int, t int, s string")
    assert rows(relate.keep_first(df, ["k"], ["t", "s"]), "k", "t", "s") == [(1, 1, "a"), (2, 5, "q")]


# ---- draws -------------------------------------------------------------------------

def test_draws_are_independent(spark):
    from citeweave.functions.columns import hash_int, hash_uniform

    n = 20_000
    ids = spark.range(n).select("id")
    s = sample.trial_split(ids, "id", [1, 2, 3], 0.2).where("is_test").groupBy("id").agg(F.collect_set("trial").alias("t")).collect()
    for a, b in ((1, 2), (2, 3), (1, 3)):
        both = sum(a in r["t"] and b in r["t"] for r in s)
        assert abs(both - 0.04 * n) < 5 * (0.04 * n) ** 0.5
    u = np.array([[r[0], r[1], r[2]] for r in ids.select(
        hash_uniform(F.lit(5), "id", F.lit(0)), hash_uniform(F.lit(5), "id", F.lit(1)), hash_uniform(F.lit(6), "id", F.lit(0))).collect()])
    c = np.corrcoef(u, rowvar=False) - np.eye(3)
    assert np.abs(c).max() < 0.03 and 0 <= u.min() and u.max() < 1 and np.abs(u.mean(0) - 0.5).max() < 0.01
    far = spark.range(0, 4).select(hash_int(F.col("id") * ((1 << 31) - 1)).alias("h")).collect()
    assert len({r["h"] for r in far}) == 4


def test_pair_offsets_vary(spark):
    df = spark.range(1000).select(F.col("id"))
    pairs = sample.sample_with_replacement_pairs(df, ["id"], 3, seed=4).collect()
    assert len(pairs) == 3000 and len({r["y_id"] - r["x_id"] for r in pairs}) > 1000


def test_sample_n_takes_the_lowest_hashes(spark):
    from citeweave.functions.columns import hash_int

    df = spark.range(5000).select(F.col("id"))
    order = [r["id"] for r in df.orderBy(hash_int(F.lit(3), F.col("id")), "id").collect()]
    for n in (0, 1, 777, 4999, 5000, 9000):
        assert sorted(r["id"] for r in sample.sample_n(df, ["id"], n, seed=3).collect()) == sorted(order[:n])


# ---- neighbours --------------------------------------------------------------------

@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_knn_ties_go_to_the_smallest_ids(spark, blocks):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(500, [0.0, 0.0, 0.0])], "id long, vec array<double>")
    nb = V.knn_search(df.where("id in (7, 500)"), df, 5, qid="id", tid="id", exclude_self=True, q_blocks=2, t_blocks=blocks)
    got = {}
    for r in nb.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["nid"], r["dist"]))
    assert got == {7: [(i, 0.0) for i in range(5)], 500: [(i, 14.0) for i in range(5)]}


def test_knn_near_copies_keep_their_order(spark):
    rows_ = [(i, [1e4 + i * 1e-5, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows_, "id long, vec array<double>")
    nb = V.knn_search(df.where("id = 0"), df, 6, qid="id", tid="id", exclude_self=True)
    assert [r["nid"] for r in nb.orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]


# ---- hubs --------------------------------------------------------------------------

def test_edge_intervals_of_a_hub(spark):
    """A star with one hub: intervals are those of a running sum over the whole row."""
    e = spark.createDataFrame([(0, i) for i in range(1, 2001)] + [(i, 0) for i in range(1, 2001)], "src long, dst long")
    g = e.withColumn("w", (F.col("dst") % 5 + 1).cast("double"))
    got = [(r["dst"], r["lo"], r["hi"], r["deg"]) for r in G.cum_edges(g).where("src = 0").orderBy("dst").collect()]
    w = np.array([d % 5 + 1 for d in range(1, 2001)], float)
    hi = np.cumsum(w) / w.sum()
    assert [x[0] for x in got] == list(range(1, 2001)) and {x[3] for x in got} == {2000}
    assert np.allclose([x[2] for x in got], hi) and np.allclose([x[1] for x in got], np.concatenate(([0], hi[:-1])))
    assert {(r["dst"], r["lo"], r["hi"]) for r in G.cum_edges(g).where("src = 9").collect()} == {(0, 0.0, 1.0)}


def test_components_of_a_long_path_and_a_star(spark):
    n = 600
    path = [(i, i + 1) for i in range(n)]
    star = [(10_000, 10_000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*path, *star, (None, 3), (20_000, 20_000)], "a long, b long")
    comp = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
    assert {comp[i] for i in range(n + 1)} == {0} and {comp[10_000 + i] for i in range(300)} == {10_000} and comp[20_000] == 20_000
    assert components.connected_components(df.limit(0), "a", "b").collect() == []


# ---- factorisation -----------------------------------------------------------------

def test_svd_keeps_small_values(spark):
    from citeweave.operators import linalg

    d = [1, 0.5, 0.1, 0.05, 0.02, 0.008, 0.004, 0.002] + [1e-4] * 12
    X = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(d)], "src long, dst long, w double")
    nodes = spark.range(len(d)).select("id")
    U, s = linalg.randomized_svd(X, nodes, 8, p=12, q=2, seed=1)
    assert np.allclose(s, d[:8], atol=1e-6)
    M = np.array([r["vec"] for r in U.orderBy("id").collect()])
    assert np.allclose(M.T @ M, np.eye(8), atol=1e-9)


def test_svd_of_a_sum_of_products_and_of_a_deficient_matrix(spark):
    from citeweave.operators import linalg

    rng = np.random.default_rng(2)
    A, B, C = (np.where(rng.random((25, 25)) < 0.2, rng.normal(size=(25, 25)), 0) for _ in range(3))

    def table(M):
        return spark.createDataFrame([(int(i), int(j), float(M[i, j])) for i, j in zip(*np.nonzero(M))], "src long, dst long, w double")

    nodes = spark.range(25).select("id")
    U, s = linalg.randomized_svd([[table(A), table(B)], [table(C)]], nodes, 6, p=19, q=2, seed=5)
    assert np.allclose(s, np.linalg.svd(A @ B + C)[1][:6], atol=1e-8)
    low = np.outer(rng.normal(size=25), rng.normal(size=25))
    U, s = linalg.randomized_svd(table(low), nodes, 5, p=5, q=1, seed=5)
    M = np.array([r["vec"] for r in U.orderBy("id").collect()])
    assert M.shape == (25, 5) and np.allclose(M.T @ M, np.eye(5), atol=1e-9)
    assert np.isclose(s[0], np.linalg.svd(low)[1][0]) and np.all(s[1:] < 1e-9)


def test_eigenmap_of_a_path(spark):
    from citeweave.operators import linalg

    n = 12
    g = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)], "src long, dst long").withColumn("w", F.lit(1.0))
    emb, s = linalg.laplacian_eigenmap(g, spark.range(n).select("id"), 3, seed=3)
    A = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    deg = A.sum(1)
    assert np.allclose(s, np.sort(np.abs(np.linalg.eigvalsh(A / np.sqrt(np.outer(deg, deg)))))[::-1][:4], atol=1e-8)
    assert {len(r["vec"]) for r in emb.collect()} == {3}


# ---- tests and intervals against published table values ------------------------------

def test_one_sample_t_and_interval(spark):
    x = [5.1, 4.9, 6.2, 5.7, 5.5, 5.0, 6.0, 5.8, 5.4, 5.6]
    df = spark.createDataFrame([("g", v) for v in x], "g string, v double")
    t = stats.ttest_1samp(df, "g", "v", 5.0).first()
    m, s = np.mean(x), np.std(x, ddof=1)
    assert math.isclose(t["T"], (m - 5) / (s / 10**0.5)) and t["n"] == 10
    # 9 degrees of freedom: P(T <= 2.262157) = 0.975
    assert abs(stats.t_cdf(2.262157, 9) - 0.975) < 1e-6 and math.isclose(t["p_two_sided"], 2 * (1 - stats.t_cdf(t["T"], 9)))
    c = stats.mean_ci(df, "g", "v").first()
    assert abs(c["hi"] - (m + 2.262157 * s / 10**0.5)) < 1e-6 and abs(c["lo"] + c["hi"] - 2 * m) < 1e-9


def test_wilcoxon_by_hand(spark):
    rows_ = [("a", 1.0), ("a", -2.0), ("a", 3.0), ("a", -4.0), ("a", 0.0), ("a", -3.0), ("b", 1.0), ("b", 1.0), ("b", -1.0)]
    df = spark.createDataFrame(rows_, "g string, v double").withColumn("mu", F.lit(0.0))
    r = {x["g"]: x for x in stats.wilcoxon_less(df, "g", "v", "mu").collect()}
    # |d| 1 2 3 3 4 -> ranks 1 2 3.5 3.5 5; the positive differences are 1 and 3
    assert (r["a"]["n"], r["a"]["n_used"], r["a"]["T"]) == (6, 5, 4.5)
    z = (4.5 - 7.5) / math.sqrt((5 * 6 * 11 - 0.5 * 6) / 24)
    assert math.isclose(r["a"]["z"], z) and math.isclose(r["a"]["p"], 0.5 * math.erfc(-z / 2**0.5), rel_tol=1e-9)
    assert (r["b"]["n"], r["b"]["T"]) == (3, 4.0)


def test_html_references_by_hand(spark):
    pages = [("<p>caf&eacute; &#233; &#xE9; &hellip;</p>", "café é é …"), ("a &lt;b&gt; &amp;amp; c", "a <b> &amp; c"), ("x &unknown; &notit; y", "x &unknown; ¬it; y"),
             ("<b>1 &le; 2</b><!-- &copy; -->", "1 ≤ 2")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "id int, h string")
    for mode in ("sql", "parser"):
        assert {r["id"]: r["h"] for r in clean.clean_text(df, "h", mode=mode).collect()} == {i: t for i, (_, t) in enumerate(pages)}


def test_batch_encoder_sees_bounded_batches(spark):
    from citeweave.operators import embed

    def model(texts):
        assert len(texts) <= 7
        return np.array([[len(t), len(texts)] for t in texts])

    df = spark.createDataFrame([(i, "x" * i) for i in range(40)], "id long, t string")
    rows_ = {r["id"]: r["vec"] for r in embed.embed_texts(df, "id", "t", embed.batch_encoder(model, 7)).collect()}
    assert len(rows_) == 39 and all(v[0] == i for i, v in rows_.items())


def test_walks_restart_at_dangling_nodes(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (5, 5)], "src long, dst long")
    w = walks.walk_arrays(walks.random_walks(G.build_graph(e, mode="to_cited"), 2, 8, seed=4, restart_at_dangling=True)).collect()
    paths = {r["walk_id"] // 2: r["nodes"] for r in w}
    assert paths == {0: [0, 1, 2, 0, 1, 2, 0, 1], 1: [1, 2, 1, 2, 1, 2, 1, 2], 2: [2] * 8, 5: [5] * 8}


def test_panels_split_hubs_and_blocks(spark, monkeypatch):
    from citeweave.operators import linalg

    monkeypatch.setattr(linalg, "BLOCK_BYTES", 160)  # about ten dense rows of two numbers
    monkeypatch.setattr(linalg, "PANEL_ENTRIES", 16)
    rng = np.random.default_rng(3)
    n = 60
    A = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.05)
    A[3], A[:, 7] = rng.normal(size=n), rng.normal(size=n)  # a hub of each kind
    X = spark.createDataFrame([(int(i), int(j), float(A[i, j])) for i, j in zip(*np.nonzero(A))], "src long, dst long, w double")
    Z = linalg.normal_rows(spark.range(n - 5), 2, seed=4)  # the last ids have no dense row
    D = np.zeros((n, 2))
    for r in Z.collect():
        D[r["id"]] = r["vec"]
    for transpose, want in ((False, A @ D), (True, A.T @ D)):
        panels = linalg.Panels(X, 2, transpose)
        got = np.zeros((n, 2))
        for r in linalg.combine([(panels.times(Z), 2.0), (Z, -1.0)]).collect():
            got[r["id"]] = r["vec"]
        assert panels.blocks > 1 and np.allclose(got, 2 * want - D, atol=1e-12)
        assert panels.laid.groupBy("cb", "chunk").count().agg(F.max("count")).first()[0] < n


def test_svd_of_many_components_reaches_its_residual(spark):
    from citeweave.operators import graph as G
    from citeweave.operators import linalg

    pairs = [(2 * i, 2 * i + 1) for i in range(20)] + [(100 + i, 101 + i) for i in range(20)]  # values 1 many times over, and a crowd below
    g = G.build_graph(spark.createDataFrame(pairs, "src long, dst long"))
    svd = linalg.truncated_svd(G.normalized_adjacency(g), G.nodes_of(g).select(F.col("node").alias("id")), 10, p=6, seed=2, tol=1e-4, rounds=6)
    assert 1 <= svd.rounds <= 6 and svd.residuals.max() <= 1e-4 and np.allclose(svd.s, 1.0, atol=1e-6)
    U = np.array([r["vec"] for r in svd.U.collect()])
    assert np.allclose(U.T @ U, np.eye(10), atol=1e-10)


def test_residual_operand_is_the_whole_matrix(spark):
    from citeweave.operators import graph as G
    from citeweave.operators import linalg

    rng = np.random.default_rng(6)
    n = 30
    g = G.build_graph(spark.createDataFrame([(i, int(rng.integers(n))) for i in range(n) for _ in range(2)], "src long, dst long"))
    E = {(r["src"], r["dst"]): r["w"] for r in g.collect()}
    freq = {(i, int(j)): float(rng.integers(1, 9)) for i in range(n - 2) for j in rng.choice(n, 4, replace=False)}  # two nodes are no centre
    pairs = spark.createDataFrame([(i, j, f) for (i, j), f in freq.items()], "center long, context long, freq double")
    C, deg = np.zeros((n, n)), np.zeros(n)
    for (i, j), f in freq.items():
        C[i, j] = f
    for (i, _), w in E.items():
        deg[i] += w
    P = C / np.maximum(C.sum(1, keepdims=True), 1e-300)
    dense = np.log(np.maximum(P, 1e-12)) - np.log(deg / deg.sum())
    _, s = linalg.randomized_svd(linalg.residual_operand(pairs, g), spark.range(n), 6, p=24, seed=1)
    assert np.allclose(s, np.linalg.svd(dense)[1][:6], rtol=1e-9)


def test_codes_of_papers_with_vectors_are_those_of_all_papers(spark, tmp_path):
    """Codes are cleaned for papers with vectors only, repeated and null ids included."""
    from citeweave.plans.q_core import pacs, vector_pacs
    from citeweave.sources import fixtures as fx

    day = __import__("datetime").datetime(1998, 1, 2)
    tables = {
        "orders": ([(1, "1-HIGH", day), (1, "2-LOW", day), (2, "1-HIGH", day), (3, "1-HIGH", day), (None, "1-HIGH", day)],
                   "o_orderkey long, o_orderpriority string, o_orderdate timestamp"),
        "lineitem": ([(o, p, n, "A") for o in (1, 2, 3, None) for p, n in ((7, 1), (8, 1), (7, 3), (None, 2))],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string"),
        "part": ([(7, "Brand#12", 5, "STEEL"), (8, "Brand#34", 15, "TIN"), (8, "Brand#34", 15, None)],
                 "p_partkey long, p_brand string, p_size int, p_type string"),
        "embeddings": ([(1, [1.0], 0), (1, [2.0], 0), (3, [1.0], 1), (9, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.selectExpr("o_orderkey", "o_orderpriority", "o_orderdate", "'F' AS o_orderstatus")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    mine = {r.doi for r in fx.vectors(spark, d).collect()}
    want = sorted(tuple(r) for r in pacs(spark, d).collect() if r.doi in mine)
    assert want and want == sorted(tuple(r) for r in vector_pacs(spark, d).collect())
    # lineitem meets the ids before it meets its parts
    plan = vector_pacs(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("p_partkey") < plan.rindex("LeftSemi")


def test_search_over_many_tiles_is_exact(spark):
    """later tiles are cut at the k-th row found so far; ties go to the smallest id."""
    import numpy as np

    from citeweave.operators import vectors as V

    rng = np.random.default_rng(3)
    T = np.round(rng.normal(size=(3 * V.T_TILE + 5, 4)), 1)
    Q, tid = np.round(rng.normal(size=(20, 4)), 1), rng.permutation(len(T)).astype(np.int64)
    i, nid, dist = V._tile_search(Q, np.arange(20), T, tid, 9, False)
    for q in range(20):
        d = ((T - Q[q]) ** 2).sum(1)
        order = np.lexsort((tid, np.einsum("ij,ij->i", Q[q] - T, Q[q] - T)))[:9]
        assert list(nid[i == q]) == list(tid[order]) and np.allclose(dist[i == q], d[order])


def test_centroids_take_more_tasks_for_more_values(spark, monkeypatch):
    """the tasks that hold distinct values grow in number with the rows; repeated and null values count as before."""
    from citeweave.operators import vectors as V

    members = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 4.0]), ("a", [3.0, None]), ("b", [None, 5.0])], "code string, vec array<float>")
    monkeypatch.setattr(V, "VALUES_PER_TASK", 1)
    out = V.class_centroids(members, ["code"])
    assert {(r.code, r.pos): r.c for r in out.collect()} == {("a", 0): 2.0, ("a", 1): 3.0, ("b", 0): None, ("b", 1): 5.0}
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    many = V.tasks_for(spark, 10**6, V.VALUES_PER_TASK)
    assert many == 10**6


def test_sample_n_computes_its_rows_once(spark):
    """rows that are dear to make are made once, whether the sample cuts them or not."""
    for n in (5, 1000):
        made = spark.sparkContext.accumulator(0)
        dear = F.udf(lambda x: (made.add(1), x)[1], "long")
        df = spark.range(100).select(dear("id").alias("id"))
        out = sample.sample_n(df, ["id"], n, seed=1)
        assert out.columns == ["id"] and out.count() == len(set(r.id for r in out.collect())) == min(n, 100)
        assert made.value == 100


def test_text_vectors_by_hand(spark):
    """every token is hashed once; repeated keys, null keys and texts without tokens keep their vectors."""
    from citeweave.functions.columns import text_hash_int
    from citeweave.operators import embed

    texts = [(1, "b a b"), (1, "c"), (2, "!!"), (None, "a"), (3, "x y z w v u t s"), (4, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    for dim in (1, 2, 7):
        def bucket(w):
            return spark.range(1).select(F.pmod(text_hash_int(F.lit(w)), F.lit(dim))).first()[0]

        def vec(words):
            v = np.zeros(dim)
            for w in words:
                v[bucket(w)] += 1
            return v / (np.linalg.norm(v) or 1)

        got = embed.embed_texts(df, "id", "text", embed.hashing_encoder(dim)).collect()
        want = {1: vec("babc"), 2: vec(""), None: vec(""), 3: vec("xyzwvuts")}
        assert sorted(str(r.id) for r in got) == ["1", "1", "2", "3", "None"]
        assert all(len(r.vec) == dim and np.allclose(r.vec, want[r.id]) for r in got)
    plan = embed.embed_texts(df, "id", "text", embed.hashing_encoder(4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def _triples(spark, M):
    return spark.createDataFrame([(int(i), int(j), float(M[i, j])) for i, j in zip(*np.nonzero(M))], "src long, dst long, w double")


def test_products_that_begin_alike_share_their_first_step(spark):
    """P + P P is two sparse products of a block, not three, and P is laid out once."""
    from citeweave.operators import linalg

    rng = np.random.default_rng(8)
    A, B = (np.where(rng.random((9, 9)) < 0.4, rng.normal(size=(9, 9)), 0) for _ in range(2))
    P, C = _triples(spark, A), _triples(spark, B)
    X, Z = linalg.Operand([[P], [P, P], [P, C], [C]], 2), linalg.normal_rows(spark.range(9), 2, seed=1)
    D = np.array([r["vec"] for r in Z.orderBy("id").collect()])
    whole, got = A + A @ A + A @ B + B, np.zeros((9, 2))
    for transpose, want in ((False, whole @ D), (True, whole.T @ D)):
        got[:] = 0
        for r in X.apply(Z, transpose).collect():
            got[r["id"]] = r["vec"]
        assert np.allclose(got, want, atol=1e-12)
    first = linalg.Operand([[P], [P, P]], 2)
    first.apply(Z), first.apply(Z, True)
    assert first.products == 4 and len({id(p) for c in first.plain + first.turned for p in c}) == 2


def test_columns_of_one_entry_are_one_column_of_their_row(spark):
    """words of one document make one column; rows, left vectors and values stay."""
    from citeweave.operators import linalg

    rng = np.random.default_rng(9)
    M = np.zeros((12, 60))
    M[:, :6] = np.where(rng.random((12, 6)) < 0.6, rng.normal(size=(12, 6)), 0)
    for j in range(6, 60):
        M[rng.integers(11), j] = rng.normal()  # the last row has none of its own
    X = _triples(spark, M)
    merged = linalg.merge_lone_columns(X).toPandas().pivot(index="src", columns="dst", values="w").fillna(0.0)
    assert merged.shape[1] <= 6 + 11 and np.allclose(merged.to_numpy() @ merged.to_numpy().T, (M @ M.T)[merged.index][:, merged.index])
    U, s = linalg.randomized_svd(X, spark.range(60), 4, p=8, seed=1, rows=spark.range(12))
    V = np.array([r["vec"] for r in U.orderBy("id").collect()])
    assert np.allclose(s, np.linalg.svd(M)[1][:4]) and np.allclose(np.linalg.norm(M.T @ V, axis=0), s)


def test_a_block_is_copied_to_few_panels(spark, monkeypatch):
    """entries of one block make as many panels as their bound asks for, not one for every ``CELL_ENTRIES``."""
    from citeweave.operators import linalg

    monkeypatch.setattr(linalg, "CELL_ENTRIES", 16)
    X = _triples(spark, np.ones((40, 40)))
    panels = linalg.Panels(X, 2, False)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= panels.panels < 1600 / 16 / 4
    monkeypatch.setattr(linalg, "BLOCK_BYTES", 40 * 16 // 2)  # rows read and given are bounded too
    monkeypatch.setattr(linalg, "CELL_ENTRIES", 1 << 16)
    panels = linalg.Panels(X, 2, False)
    assert panels.blocks >= 2 and panels.panels >= 4


def test_knn_blocks_are_those_of_a_run_and_partial_lists_are_few():
    """Six runs of a million train rows: a block of queries takes what a task holds, and there is one train block."""
    q, t = V._blocks(240_000, 960_000, 64, 128, 2)
    assert t == 1 and 240_000 / q * (12 * 64 + 24 * 128) <= V.BLOCK_BYTES and q <= 10
    assert V._blocks(100, 1_000_000, 64, 10, 40) == (1, 40)  # few queries: the train rows are dealt
    assert V._blocks(10, 10, 4, 3, 40) == (1, 1)


@pytest.mark.parametrize("scale", [1.0, 2.0**-40, 2.0**60])
def test_knn_of_runs_in_cells_that_share_a_task(spark, scale):
    """Rows of many cells follow each other in a batch; numbers that single precision cannot square are compared in double."""
    rng = np.random.default_rng(12)
    rows = [(run, i, [float(x * scale) for x in rng.integers(0, 9, 5)]) for run in (1, 2, 3) for i in range(40 * run)]
    df = spark.createDataFrame(rows, "run int, id long, vec array<double>")
    for blocks in ({}, {"q_blocks": 4, "t_blocks": 1}, {"q_blocks": 2, "t_blocks": 3}):
        got = {(r.run, r.qid, r["rank"]): (r.nid, r.dist) for r in V.knn_search(df, df, 7, qid="id", tid="id", by=["run"], exclude_self=True, **blocks).collect()}
        for run in (1, 2, 3):
            X = np.array([v for k, _, v in rows if k == run])
            for i in range(len(X)):
                d = ((X - X[i]) ** 2).sum(1)
                order = [j for j in np.lexsort((np.arange(len(X)), d)) if j != i][:7]
                assert [got[run, i, n + 1] for n in range(7)] == [(j, d[j]) for j in order]
        assert len(got) == 7 * 240


def test_files_of_a_shuffle_go_with_the_action(spark):
    """What an operator stores leaves no shuffle files behind."""
    from citeweave.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    df = spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    assert sorted(df.collect()) == sorted(df.collect()) and df.count() == 10  # an action that comes again makes them again


def test_packed_hashes_are_those_of_the_columns(spark):
    from citeweave.functions.columns import hash_uniform
    from citeweave.operators import packed

    ids = np.array([0, 5, 9, 10, 99, 100, 12345, 10**15, 3, 77777] + list(range(900, 1100)), np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long")
    want = {r.id: r.u for r in df.select("id", hash_uniform(F.lit(21), F.col("id"), F.lit(7), F.lit(1)).alias("u")).collect()}
    assert packed.uniforms("21|", ids, "|7|1").tolist() == [want[i] for i in ids.tolist()]
    # an edge owns [j / deg, (j + 1) / deg), as doubles
    deg = np.repeat(np.arange(1, 60), 300)
    u = np.concatenate((np.random.default_rng(1).random(len(deg) - 100), np.arange(100) / 100))
    j = packed.edge_of(u, np.zeros(len(deg), np.int64), deg)
    assert ((j / deg <= u) & (u < (j + 1) / deg)).all()


@pytest.mark.parametrize("length", [2, 7, 24])
def test_packed_walks_are_the_walks(spark, monkeypatch, length):
    """Shards, buckets and tasks of a few edges, walks and pairs each; a hub lies in many shards."""
    for name, n in (("EDGES_PER_SHARD", 16), ("WALKS_PER_BUCKET", 8), ("PAIRS_PER_TASK", 400)):
        monkeypatch.setattr(walks, name, n)
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(int(a), int(b)) for a, b in rng.integers(40, 60, (30, 2))], "src long, dst long")
    g = G.build_graph(e)
    plain, own = walks.walk_pieces(g, 3, length, seed=4), walks.walk_pieces(g, 3, length, seed=4, undirected=True)
    assert isinstance(own, walks.PackedWalks) and own.rows.select("bucket").distinct().count() > 4

    def rows(df):
        return sorted(tuple(map(str, r)) for r in df.collect())

    assert rows(walks.walk_rows(own)) == rows(walks.walk_rows(plain))
    assert rows(walks.whole_walks(own)) == rows(walks.whole_walks(plain))
    for window in (1, 5, 10):
        assert rows(walks.piece_pairs(own, window, length)) == rows(walks.piece_pairs(plain, window, length))
    # weights, or ids below 0: the walks by joins
    for odd in (g.withColumn("w", F.when(F.col("src") < 20, 2.0).otherwise(1.0)), g.withColumn("src", F.col("src") - 5).withColumn("dst", F.col("dst") - 5)):
        assert not isinstance(walks.walk_pieces(odd, 1, 3, undirected=True), walks.PackedWalks)


def test_counts_of_pairs_that_come_often():
    from citeweave.operators import packed
    import pyarrow as pa
    import pyarrow.compute

    p = packed.Pairs(10**9, 3, 2, 1, "<i8")
    nodes = np.random.default_rng(2).choice([0, 1, 5, 10**9 - 1], (50, 6))
    rest = nodes[:, 1:]
    ids = np.arange(50)  # whole() takes the start from the id: numbers below 50
    t = pa.table({"t": pa.array([1], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "path": [rest.astype("<i8").tobytes()]})
    made = p.counted()(t)
    got, want = {}, {}
    for task in set(made["task"].to_pylist()):
        out = p.summed()(made.filter(pa.compute.equal(made["task"], task)))
        got |= {(a, b): f for a, b, f in zip(*(out[c].to_pylist() for c in ("center", "context", "freq")))}
    for i, row in zip(ids, np.hstack((ids[:, None], rest))):
        for a in range(4):
            for b in row[a + 1 : a + 3]:
                want[int(row[a]), int(b)] = want.get((int(row[a]), int(b)), 0) + 1
    assert got == want and max(got.values()) > 1


def test_undirected_graphs_hold_each_direction_once_and_index_graph_reads_them_once(spark):
    rows = [("b", "a"), ("a", "b"), ("a", "a"), ("c", "a"), ("c", "a"), (None, "a"), ("d", None)]
    g = G.build_graph(spark.createDataFrame(rows, "src string, dst string"))
    assert sorted(map(tuple, g.collect())) == [("a", "a", 1.0), ("a", "b", 1.0), ("a", "c", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)]
    nodes, e = walks.index_graph(g)
    assert sorted(map(tuple, nodes.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0)]
    # the fixture's joins are not part of what the edges read
    assert "LocalTableScan" not in e._jdf.queryExecution().optimizedPlan().toString() and "LogicalRDD" not in e._jdf.queryExecution().optimizedPlan().toString()


def test_packed_panels_give_the_same_products(spark):
    import pyarrow as pa
    from citeweave.operators import linalg

    rng = np.random.default_rng(31)
    t = pa.table({"cb": pa.array([0] * 300, pa.int32()), "chunk": pa.array([2] * 300, pa.int32()), "row": rng.integers(-9, 40, 300), "col": rng.integers(-5, 60, 300), "w": rng.normal(size=300)})
    for known in (np.arange(-5, 60), np.arange(-5, 60, 3), np.array([7]), np.array([1000])):
        known = rng.permutation(known)
        dense = pa.table({"id": known, "vec": linalg._lists(rng.normal(size=(len(known), 3)))})
        one, two = linalg._panel_product(t, dense), linalg._packed_product("bigint")(linalg._packed_panel(t), dense)
        got, want = ({i: v for i, v in zip(x["id"].to_pylist(), x["vec"].to_pylist())} for x in (two, one))
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in got)
    # ids that are no numbers keep their rows
    X = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 3.0), ("b", "y", -1.0)], "src string, dst string, w double")
    Z = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 5.0])], "id string, vec array<double>")
    with linalg.fixed_plans(spark):
        assert {r.id: r.vec for r in linalg.combine([(linalg.Panels(X, 2, False).times(Z), 1.0)]).collect()} == {"a": [2.0, 0.0], "b": [3.0, -5.0]}


def test_tables_that_nothing_reads_any_more_go(spark):
    import os
    from citeweave.session import discard, materialize

    df = materialize(spark.range(5), "gone")
    path = df.stored_at.removeprefix("file:")
    assert os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)
