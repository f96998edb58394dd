"""Deterministic sampling (M1-M9) from a portable integer hash.

The reference samples without seeds; here every draw is a function of
``(seed, row key)`` so results are reproducible, independent of partitioning,
survive task retries unchanged, and can be reproduced by SQL.  Exact-size
samples use the distributed dense index instead of a single-task ``limit``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.columns import HASH_BITS, hash_int, hash_uniform
from citeweave.operators.prefix import dense_index
from citeweave.session import materialize

SAMPLE_BITS = 14


def sample_fraction(df: DataFrame, key: str, frac: float, seed: int = 0) -> DataFrame:
    """Bernoulli sample without replacement: keep rows whose hash falls below ``frac`` (M1)."""
    return df.where(hash_uniform(F.lit(seed), F.col(key)) < F.lit(frac))


def with_hash_rank(df: DataFrame, key: Sequence[str], seed: int, group: str | None = None,
                   out: str = "_rank") -> DataFrame:
    """0-based rank of each row in ``(group, hash(seed, key...), key...)`` order;
    with ``group`` the rank restarts per group.  Distributed (range partitioning)."""
    h = hash_int(F.lit(seed), *[F.col(k) for k in key])
    d = df.withColumn("_h", h)
    order = ([group] if group else []) + ["_h"] + list(key)
    idx = dense_index(d, order, out="_gidx")
    if group:
        start = idx.groupBy(group).agg(F.min("_gidx").alias("_start"))
        idx = idx.join(F.broadcast(start), group).withColumn(out, F.col("_gidx") - F.col("_start")).drop("_start")
    else:
        idx = idx.withColumnRenamed("_gidx", out)
    return idx.drop("_h", "_gidx")


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement (M3): those that come first in
    ``(hash(seed, key...), key...)`` order.

    A histogram of hash prefixes (at most ``2^SAMPLE_BITS`` counts) tells the prefix at which
    the sample ends.  Rows below it are kept where they are; only those of that one
    prefix, about ``rows / 2^SAMPLE_BITS``, are sorted.  The rows are stored, so that they and
    their hashes are computed once."""
    d = materialize(df.withColumn("_h", hash_int(F.lit(seed), *[F.col(k) for k in key])).withColumn("_b", F.shiftright("_h", HASH_BITS - SAMPLE_BITS)), "hashed")
    left, cut = n, None
    for r in sorted(d.groupBy("_b").count().collect()):
        if r["count"] > left:
            cut = r["_b"]
            break
        left -= r["count"]
    if cut is None:
        return d.drop("_h", "_b")
    last = d.where(F.col("_b") == cut).orderBy("_h", *key).limit(left)
    return d.where(F.col("_b") < cut).unionByName(last).drop("_h", "_b")


def sample_with_replacement_pairs(rows: DataFrame, order: Sequence[str], factor: int, seed: int = 0) -> DataFrame:
    """``factor * n`` draws with replacement, twice, zipped by position.

    Rows get a dense index; a distributed ``range(factor * n)`` picks two row
    indexes per draw by hash, and each side is attached by an equi-join on the
    index (no cross join).  Returns ``draw, x_<col>..., y_<col>...``.
    """
    spark = rows.sparkSession
    idx = materialize(dense_index(rows, order, out="_ix"), "indexed")
    n = idx.count()
    if n == 0:
        return spark.createDataFrame([], "draw long")
    draws = spark.range(factor * n).select(
        F.col("id").alias("draw"),
        F.pmod(hash_int(F.lit(seed), F.lit(1), F.col("id")), F.lit(n)).alias("_ix_x"),
        F.pmod(hash_int(F.lit(seed), F.lit(2), F.col("id")), F.lit(n)).alias("_ix_y"))
    cols = [c for c in rows.columns]
    x = idx.select(F.col("_ix").alias("_ix_x"), *[F.col(c).alias(f"x_{c}") for c in cols])
    y = idx.select(F.col("_ix").alias("_ix_y"), *[F.col(c).alias(f"y_{c}") for c in cols])
    return draws.join(x, "_ix_x").join(y, "_ix_y").drop("_ix_x", "_ix_y")


def trial_split(df: DataFrame, key: str, trials: Sequence[int], test_frac: float = 0.2) -> DataFrame:
    """Repeated train/test splits (M6, M8): one copy of each row per trial with
    ``is_test`` from the hash of (trial, key) - all trials in one job."""
    t = F.explode(F.array(*[F.lit(int(x)) for x in trials]))
    d = df.withColumn("trial", t)
    return d.withColumn("is_test", hash_uniform(F.col("trial"), F.col(key)) < F.lit(test_frac))
