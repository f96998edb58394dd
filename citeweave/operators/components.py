"""Weakly connected components (G4) and the largest-component subgraph.

Contraction rounds.  In each round every node takes as parent the neighbour (or
itself) whose id hashes lowest, one pointer jump shortens the chains, and the edges
are renamed to parents; loops and repeats go.  Under a hash order the graph shrinks
by a constant factor a round whatever its diameter.  The loop ends when no edge is
left, so there is no cap on rounds.  Parents come from a map-side combined ``min``,
so a hub costs one row per task; the renaming joins look up one row per node, which
adaptive execution splits where a name is hot.  Every round's tables are written
to the shared checkpoint folder, so lineage stays one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.session import materialize


def _order(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` where component = smallest node id in the weakly
    connected component.  Node ids must be orderable (ints or strings); edges with
    a null end are ignored; a loop makes its node a component."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    pairs = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    live = pairs.where(F.col("u") != F.col("v"))
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        sides = live.select(F.col("u").alias("node"), F.col("v").alias("nb")).union(
            live.select(F.col("v").alias("node"), F.col("u").alias("nb")))
        low = sides.groupBy("node").agg(F.min(_order("nb")).alias("low"))
        parent = materialize(low.select("node", F.least(F.col("low"), _order("node"))["node"].alias("parent")), "cc-parent")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        parent = materialize(parent.join(up, "parent").select("node", F.col("top").alias("parent")), "cc-jump")
        rounds.append(parent)
        pu = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        pv = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        live = materialize(
            live.join(pu, "u").join(pv, "v").where(F.col("pu") != F.col("pv"))
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-edges")
    if not rounds:
        return nodes.select("node", F.col("node").alias("component"))
    # names of later rounds are few: resolve them from the last round back to the first
    root = rounds[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(rounds[:-1]):
        nxt = root.select(F.col("node").alias("parent"), "root")
        root = parent.join(nxt, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    root = materialize(nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "cc-root")
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")


def component_sizes(comp: DataFrame) -> DataFrame:
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(edges: DataFrame, comp: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Induced subgraph on the largest component (ties -> the component with the
    smallest label).  The winner is one row found by an aggregate; the edges are
    kept by a semi join (G5)."""
    sizes = component_sizes(comp)
    best = sizes.agg(F.min(F.struct((-F.col("size")).alias("ns"), F.col("component"))).alias("w")) \
        .select(F.col("w.component").alias("component"))  # one row
    nodes = comp.join(F.broadcast(best), "component").select("node")
    return edges.join(nodes.withColumnRenamed("node", src), src, "left_semi").join(nodes.withColumnRenamed("node", dst), dst, "left_semi")
