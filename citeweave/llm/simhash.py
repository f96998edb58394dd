"""SimHash near-duplicates by forests of vantage-point trees.

A fingerprint has 64 bits.  On whole fingerprints one vantage point prunes little:
distances to it crowd around 32 and a radius of 4 straddles most boundaries.  The
forest therefore has one tree for each of three disjoint bit blocks, with radii
(1, 1, 0): if two fingerprints differed by 2 bits or more in the first block, 2 in
the second and 1 in the third, they would differ by 5.  So every pair within 4
bits is within its radius in one block, and in that tree the distances to each
vantage point, taken on the block, differ by the radius at most (triangle
inequality).

A node sends a fingerprint to its near child when its distance to the vantage
point is at most the threshold plus the radius, and to its far child when it is over the
threshold; those between go to both.  Two fingerprints within the radius hence share
a child at every node, down to a leaf.  Leaves are the shards: Spark shuffles
(tree, leaf, fingerprint) rows, and a task searches its leaves with exact 64-bit
distances.  It sends on one link from each fingerprint to the head of its group, never all
pairs, and connected components join the groups.

Vantage points and thresholds come from a sample of at most ``SAMPLE`` distinct
fingerprints; every fingerprint is routed and compared.  Equal fingerprints
are merged first, so copies cost one row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import attach, columns_of, shingle_hashes, small, small_batches, text_bytes, text_key, whole_row
from citeweave.operators.components import connected_components
from citeweave.session import Workspace

SAMPLE = 1 << 16  # fingerprints that vantage points and thresholds are fitted on
LEAF = 64  # fingerprints at home in a leaf, on average
MAX_DEPTH = 14
SHARD_ROWS = 20_000  # routed rows that one task searches at a time, about
CHUNK = 50_000  # shingles hashed at a time
CELLS = 4_000_000  # distances computed at a time


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of UTF-8 ``text``: ASCII lower case, words between ASCII white space,
    shingles of ``shingle`` words, XXH64 with seed 42, strict majority of each bit."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    total, counts = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        hashes = shingle_hashes(words[at : at + CHUNK + size - 1], size)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > total).tolist())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, key, fp`` of every row: ``key`` is the ``text_key``, ``fp`` signed 64-bit; null text has fingerprint zero."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch, "t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fps)], names=["id", "key", "fp"])

    source = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return small_batches(source).mapInArrow(run, f"id {kind}, key long, fp long")


def _distance(x: np.ndarray, y, mask) -> np.ndarray:
    return np.bitwise_count((x ^ y) & mask)


class Tree:
    """One vantage-point tree over a block of bits: ``points`` and ``cuts`` of a complete
    binary tree in heap order; node ``i`` has the near child ``2i + 1`` and the far one ``2i + 2``."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, depth: int, seed: int):
        self.mask, self.radius, self.depth = np.uint64(mask), radius, depth
        nodes = (1 << depth) - 1
        rng = np.random.default_rng(seed)
        self.points = rng.integers(0, 1 << 63, max(nodes, 1), dtype=np.uint64)
        self.cuts = np.full(max(nodes, 1), mask.bit_count() // 2, np.int64)
        here = {0: sample}
        for node in range(nodes):
            own = here.pop(node, sample[:0])
            if len(own) > 1:
                tried = own[rng.integers(0, len(own), 4)]
                near = [_distance(own, p, self.mask) for p in tried]
                cuts = [int(np.median(d)) for d in near]
                # the cut that splits evenly with the fewest fingerprints on the boundary
                cost = [max((d <= c + radius).mean(), (d > c).mean()) for d, c in zip(near, cuts)]
                best = int(np.argmin(cost))
                self.points[node], self.cuts[node] = tried[best], cuts[best]
            d = _distance(own, self.points[node], self.mask)
            here[2 * node + 1], here[2 * node + 2] = own[d <= self.cuts[node]], own[d > self.cuts[node]]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of ``fps`` and the leaf of each of their routes."""
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = _distance(fps[rows], self.points[nodes], self.mask)
            near, far = d <= self.cuts[nodes] + self.radius, d > self.cuts[nodes]
            rows, nodes = np.concatenate((rows[near], rows[far])), np.concatenate((2 * nodes[near] + 1, 2 * nodes[far] + 2))
        return rows, nodes - ((1 << self.depth) - 1)


def forest(sample: np.ndarray, count: int, max_distance: int) -> list[Tree]:
    """Trees over disjoint bit blocks whose radii plus one add up to ``max_distance + 1``."""
    blocks = min(3, max_distance + 1)
    radii = [(max_distance + 1) // blocks - 1 + (i < (max_distance + 1) % blocks) for i in range(blocks)]
    edges = [64 * i // blocks for i in range(blocks + 1)]
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, count) / LEAF))))
    return [Tree(sample, ((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1), radii[i], depth, i) for i in range(blocks)]


def leaf_links(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (head, member) that connect exactly the fingerprints of one leaf that
    chains of pairs within ``max_distance`` connect.  Groups are grown from seeds and
    leave the pool whole, so a dense group of m costs about m rows of work, not m squared."""
    alive, heads, members = fps, [], []
    while len(alive) > 1:
        chunk = alive[: max(1, min(128, CELLS // len(alive)))]
        near = np.bitwise_count(chunk[:, None] ^ alive[None, :]) <= max_distance
        alone = near.sum(1) == 1
        seeds = np.flatnonzero(~alone)
        if not len(seeds):
            alive = alive[len(chunk) :]
            continue
        head, found = chunk[seeds[0]], near[seeds[0]].copy()
        rest, frontier = alive[~found], alive[found]
        group = [frontier]
        while len(frontier) and len(rest):
            width = max(1, min(128, CELLS // len(rest)))
            some, frontier = frontier[:width], frontier[width:]
            hit = (np.bitwise_count(some[:, None] ^ rest[None, :]) <= max_distance).any(0)
            if hit.any():
                group.append(rest[hit])
                frontier, rest = np.concatenate((frontier, rest[hit])), rest[~hit]
        own = np.concatenate(group)
        own = own[own != head]
        heads.append(np.full(len(own), head, np.uint64))
        members.append(own)
        gone = chunk[alone]
        alive = rest[~np.isin(rest, gone)] if len(gone) else rest
    if not heads:
        return fps[:0], fps[:0]
    return np.concatenate(heads), np.concatenate(members)


def links(distinct: DataFrame, count: int, max_distance: int) -> DataFrame:
    """``a, b``: links whose components are those of all pairs within ``max_distance``
    among the ``count`` distinct fingerprints ``fp``."""
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = forest(sample, count, max_distance)
    leaves = 1 << trees[0].depth
    shards = max(1, min(leaves, count * 6 // SHARD_ROWS))

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for t, tree in enumerate(trees):
                rows, leaf = tree.route(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t * shards + leaf * shards // leaves), pa.array(leaf), pa.array(fps[rows].view(np.int64))],
                    names=["shard", "leaf", "fp"])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("leaf", kind="stable")
        fps, leaf = part["fp"].to_numpy(np.int64).view(np.uint64), part["leaf"].to_numpy()
        found = [leaf_links(own, max_distance) for own in np.split(fps, np.flatnonzero(np.diff(leaf)) + 1)]
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]).view(np.int64),
                             "b": np.concatenate([f[1] for f in found]).view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "shard long, leaf long, fp long")
    return routed.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_distance: int, ws: Workspace) -> DataFrame:
    """``id, key, fp, component_id, stays`` of every row; of a component the row with the smallest
    id stays (null last, ties by key)."""
    prints = ws.keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    distinct = ws.keep(prints.groupBy("fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")), "distinct")
    seen = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows")).first()
    found = ws.keep(links(distinct, seen["n"], max_distance), "links")
    comp = connected_components(found, "a", "b").select(F.col("node").alias("fp"), "component")
    named = distinct.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    answer = ws.keep(named.join(best, "component").select("fp", "size", "best"), "answer")
    return attach(prints, answer, ["fp"], "size", seen["rows"] or 0).select(
        "id", "key", "fp", F.col("best.id").alias("component_id"), (place == F.col("best")).alias("stays"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                  max_distance: int = 4) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    Fingerprints link at ``max_distance`` or fewer differing bits and
    ``component_id`` is the smallest id that links reach, the row's own included.  Null
    text and text without words have fingerprint zero and link like any other.  Null ids
    are ignored when the smallest is taken (null if a component has no other).  Repeated
    rows stay, each with the same answer.  Other columns are not read.  An empty table
    gives an empty result."""
    ws = Workspace(docs.sparkSession, "simhash")
    return groups(docs, id_col, text_col, shingle, max_distance, ws).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                      max_distance: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of every group of linked documents the
    one with the smallest id (a null id only if there is no other; ties by text hash), once if
    it is repeated.  The names of other columns do not matter; an empty table gives an empty result."""
    ws = Workspace(docs.sparkSession, "simhash-kept")
    found = ws.keep(groups(docs, id_col, text_col, shingle, max_distance, ws).select("id", "key", "stays"), "found")
    gone = ws.keep(found.where("not stays").select(F.col("id").alias("i"), F.col("key").alias("k")).distinct(), "gone")
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    kept = rows.join(small(gone, gone.count(), 32), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_anti")
    if not found.where("stays").groupBy("id", "key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "key"])
    return kept.select(*columns_of(docs, "row"))
