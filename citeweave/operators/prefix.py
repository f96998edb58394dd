"""Distributed prefix sums, dense ids and tie-averaged ranks.

A window ``sum() over (order by x)`` without a partition key plans an
``Exchange SinglePartition``: the whole table in one task.  Instead:

1. range-partition on the order key and sort inside partitions;
2. materialise that layout (``checkpoint`` to the session's checkpoint dir), so
   the boundaries cannot move between the passes below and a lost executor
   recomputes from the checkpoint;
3. take one total per partition (a handful of numbers reach the driver);
4. turn them into per-partition offsets and finish the running sum inside each
   partition with an Arrow-batched ``mapInPandas`` (order within a partition is
   preserved, no second shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.session import ensure_checkpoint_dir


def _partitions_for(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_sorted(df: DataFrame, order: Sequence[str], ascending: Sequence[bool] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Range-partition + sort within partitions, then checkpoint (reliable)."""
    ensure_checkpoint_dir(df.sparkSession)
    asc = list(ascending) if ascending else [True] * len(order)
    cols = [F.col(c).asc() if a else F.col(c).desc() for c, a in zip(order, asc)]
    laid = df.repartitionByRange(_partitions_for(df, num_partitions), *cols).sortWithinPartitions(*cols)
    return laid.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def _offsets(laid: DataFrame, value_cols: Sequence[str]) -> dict[int, list[float]]:
    aggs = [F.sum(F.col(c)).alias(c) for c in value_cols] + [F.count(F.lit(1)).alias("_n")]
    rows = laid.groupBy("_pid").agg(*aggs).collect()  # one row per partition
    tot = {r["_pid"]: [r[c] or 0 for c in value_cols] + [r["_n"]] for r in rows}
    out, run = {}, [0] * (len(value_cols) + 1)
    for pid in sorted(tot):
        out[pid] = list(run)
        run = [a + b for a, b in zip(run, tot[pid])]
    return out


def prefix_sums(df: DataFrame, order: Sequence[str], value_cols: Sequence[str],
                ascending: Sequence[bool] | None = None, inclusive: bool = True,
                with_index: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Running sums of ``value_cols`` in the global order ``order``.

    Adds ``cum_<col>`` per value column (inclusive of the row unless
    ``inclusive=False``) and, with ``with_index``, a dense 0-based ``row_idx``.
    Rows with equal order keys get an arbitrary but fixed relative order:
    aggregate ties first when they must share a value.
    """
    laid = range_sorted(df, order, ascending, num_partitions)
    offs = _offsets(laid, value_cols)
    sc = laid.sparkSession.sparkContext
    b_offs = sc.broadcast(offs)
    vcols = list(value_cols)
    fields = [f for f in laid.schema.fields if f.name != "_pid"]
    out_schema = T.StructType(fields + [T.StructField(f"cum_{c}", T.DoubleType()) for c in vcols]
                              + ([T.StructField("row_idx", T.LongType())] if with_index else []))

    def run(it):
        offsets = b_offs.value
        state = None
        for pdf in it:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            if state is None or state[0] != pid:
                base = offsets.get(pid, [0] * (len(vcols) + 1))
                state = [pid, [float(x) for x in base[:-1]], int(base[-1])]
            res = pdf.drop(columns=["_pid"])
            for i, c in enumerate(vcols):
                v = pdf[c].fillna(0).astype("float64").to_numpy()
                cs = np.cumsum(v) + state[1][i]
                res[f"cum_{c}"] = cs if inclusive else cs - v
                state[1][i] = float(cs[-1]) if len(cs) else state[1][i]
            if with_index:
                res["row_idx"] = np.arange(state[2], state[2] + len(pdf), dtype="int64")
            state[2] += len(pdf)
            yield res

    return laid.mapInPandas(run, out_schema)


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the global order (node ids, G2).  Uses
    per-partition counts and ``monotonically_increasing_id`` inside the
    range-sorted layout, so no shuffle beyond the range partitioning."""
    laid = range_sorted(df, order, None, num_partitions).withColumn("_mid", F.monotonically_increasing_id())
    offs = _offsets(laid, [])
    spark = df.sparkSession
    off_df = spark.createDataFrame([(int(p), int(v[-1])) for p, v in offs.items()], "_pid int, _off long")
    # one row per partition: bounded by the partition count, safe to broadcast
    res = laid.join(F.broadcast(off_df), "_pid")
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return res.withColumn(out, (F.col("_off") + pos).cast("long")).drop("_pid", "_mid", "_off")


def average_ranks(values: DataFrame, value_col: str, count_col: str | None = None,
                  num_partitions: int | None = None) -> DataFrame:
    """Tie-averaged 1-based ranks of distinct values.

    ``values`` is first reduced to one row per distinct value with its
    multiplicity (a normal aggregate with map-side combine), so ties never
    split across partitions; the rank of a value with ``c`` copies and ``b``
    smaller items is ``b + (c + 1) / 2``.  Returns ``value, n, rank``.
    """
    if count_col is None:
        hist = values.groupBy(value_col).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    else:
        hist = values.groupBy(value_col).agg(F.sum(count_col).cast("double").alias("_c"))
    cum = prefix_sums(hist, [value_col], ["_c"], inclusive=False, num_partitions=num_partitions)
    return cum.select(F.col(value_col), F.col("_c").alias("n"),
                      (F.col("cum__c") + (F.col("_c") + 1) / 2).alias("rank"))
