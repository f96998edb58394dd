import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from citeweave.llm import exact_dedup, queries, simhash

SF = "/root/testdata/sf0.001"


def test_exact_matches_sql(spark):
    from citeweave.plans.oracle_check import digest, duck

    got = digest(queries.QUERIES["op1_exact_dedup"](spark, SF).toPandas())
    assert got == digest(duck(queries.SQL["op1_exact_dedup"], SF))


def test_exact_odd_rows(odd_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    for own in groups.values():
        assert sum(r.kept for r in own) == 1 and {r.group_size for r in own} == {len(own)}
        best = max((r.doc_id for r in own if r.doc_id is not None), default=None)
        assert {r.keep_id for r in own} == {best} and [r.doc_id for r in own if r.kept] == [best]
    empty = groups[hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {2}


def test_exact_small_filter_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_WORDS", 1)
    docs = spark.createDataFrame([(i, f"t{i % 700}") for i in range(1000)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in rows) == 700 and sum(r.group_size == 2 for r in rows) == 600


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == []
    assert simhash.simhash_dedup(no_docs).collect() == []


def brute_print(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, d):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    arr = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= d):
            parent[root(int(j))] = root(i)
    out = defaultdict(list)
    for i in range(len(ids)):
        out[root(i)].append(ids[i])
    return {i: min(own) for own in out.values() for i in own}


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op5_simhash_dedup"](spark, SF).collect()}
    fps = [brute_print(r.text) for r in docs]
    assert [got[r.doc_id].fingerprint for r in docs] == [f"{f:016x}" for f in fps]
    want = brute_components([r.doc_id for r in docs], fps, 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_simhash_odd_rows(odd_docs):
    rows = simhash.simhash_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert len({r.component_id for r in rows if r.doc_id in (4, 5)}) == 1


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_forest_finds_every_pair(distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:800].copy()
    for _ in range(max(1, distance)):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    fps = np.unique(np.concatenate((base, near)))
    met = set()
    for tree in simhash.forest(fps, len(fps), distance):
        rows, leaf = tree.route(fps)
        for one in np.unique(leaf):
            own = fps[rows[leaf == one]]
            i, j = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= distance, 1))
            met |= {frozenset((int(a), int(b))) for a, b in zip(own[i], own[j])}
    want = set()
    for k in range(0, len(fps), 256):
        i, j = np.nonzero(np.bitwise_count(fps[k : k + 256, None] ^ fps[None, :]) <= distance)
        want |= {frozenset((int(fps[k + a]), int(fps[b]))) for a, b in zip(i, j) if k + a != b}
    assert met == want


def test_leaf_links_keep_components_of_a_dense_group():
    rng = np.random.default_rng(1)
    center = np.uint64(0x0123456789ABCDEF)
    one = np.uint64(1) << rng.integers(0, 64, (900, 2), dtype=np.uint64)
    fps = np.unique(np.concatenate((center ^ one[:, 0] ^ one[:, 1], rng.integers(0, 1 << 63, 300, dtype=np.uint64))))
    a, b = simhash.leaf_links(fps, 4)
    assert len(b) < len(fps)
    want = brute_components(list(map(int, fps)), fps, 4)
    groups = defaultdict(set)
    for i, r in want.items():
        groups[r].add(i)
    got = defaultdict(set)
    for x, y in zip(map(int, a), map(int, b)):
        got[x] |= {x, y}
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_repeat_filter_holds_every_bit_met_twice(spark):
    """Exactly those bits in words of fewer than ``COUNTED`` rows; all bits met in fuller words."""
    rng = np.random.default_rng(3)
    bits = lambda: int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 4).astype(np.uint64)).view(np.int64))
    rows = [(w, bits()) for w, n in enumerate([1, 2, 3, 7, 15, 16, 40] * 20) for _ in range(n)]
    rows += [(1000, -1)] * 9 + [(1001, -(1 << 63))] * 15 + [(1002, 5)] * 30_000
    got = {r._word: r._filter for r in exact_dedup.repeat_filter(spark.createDataFrame(rows, "_word long, _bits long")).collect()}
    by = defaultdict(list)
    for w, b in rows:
        by[w].append(b & (1 << 64) - 1)
    for w, own in by.items():
        twice = sum(1 << k for k in range(64) if sum(b >> k & 1 for b in own) >= 2)
        have = got.get(w, 0) & (1 << 64) - 1
        met = int(np.bitwise_or.reduce(np.array(own, np.uint64)))
        # a top counter of eight or more overflows its number: then, too, any bit met counts
        crowded = len(own) >= exact_dedup.COUNTED or any(sum(b >> k & 1 for b in own) >= 8 for k in (15, 31, 47, 63))
        assert have == (met if crowded else twice), w


def test_one_of_each_group_takes_any_column_names(spark):
    names = "doc_id long, text string, _id int, _key int, _k string, key int, id int, i int, k int, row string"
    docs = spark.createDataFrame([(i, t, 1, 2, "k", 3, 4, 5, 6, "r") for i, t in enumerate(["a b c d", "a b c d", None, "x y z w v u"])], names)
    kept = simhash.one_of_each_group(docs)
    assert kept.schema == docs.schema and [r._k for r in kept.collect()] == ["k"] * 3
