"""Votes, modal classes, deduplication and the citation-majority classifier.

Winner-per-group is written as a hash aggregate over a struct
(``max(struct(count, label))``) instead of a sorted window: Spark then does a
map-side partial aggregate before the shuffle, and nothing sorts whole groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_label(df: DataFrame, group: Sequence[str], label: str, *, tie: str = "largest",
              count_col: str | None = None, out: str | None = None, keep_count: bool = False) -> DataFrame:
    """Most frequent ``label`` per ``group`` (rows with a null group key or label
    are ignored, as pandas ``groupby`` does).

    ``tie="largest"``: among equally frequent labels the largest wins (modal
    class, citation vote); ``tie="smallest"``: the smallest wins (kNN vote).
    ``count_col`` counts non-null values of that column instead of rows.
    """
    out = out or label
    g = list(group)
    nn = F.lit(True)
    for k in g + [label]:
        nn = nn & F.col(k).isNotNull()
    cnt = F.count(count_col) if count_col else F.count(F.lit(1))
    counts = df.where(nn).groupBy(*g, label).agg(cnt.alias("_n"))
    if tie == "largest":
        best = F.max(F.struct(F.col("_n"), F.col(label))).alias("_w")
        res = counts.groupBy(*g).agg(best).select(*g, F.col("_w").getField(label).alias(out),
                                                   F.col("_w._n").alias("_n"))
    elif tie == "smallest":
        best = F.min(F.struct((-F.col("_n")).alias("_m"), F.col(label))).alias("_w")
        res = counts.groupBy(*g).agg(best).select(*g, F.col("_w").getField(label).alias(out),
                                                   (-F.col("_w._m")).alias("_n"))
    else:
        raise ValueError(tie)
    return res if keep_count else res.drop("_n")


def modal_code(codes: DataFrame, key: str = "doi", code: str = "pacs_code_1") -> DataFrame:
    """Modal code per paper: highest count, ties -> largest code."""
    return top_label(codes, [key], code, tie="largest")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Deduplicate on ``key`` keeping the first row in ascending ``order``.
    ``dropDuplicates`` keeps an arbitrary row; this is deterministic.  Written as
    ``min(struct(order..., rest...))``: a hash aggregate with map-side combine,
    so a key with millions of duplicates is reduced before the shuffle and never
    sorted in one task."""
    order = list(order)
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_r")
    return df.groupBy(*key).agg(packed).select(*key, *[F.col(f"_r.{c}").alias(c) for c in order + rest])


def keep_first_agg(df: DataFrame, key: Sequence[str], order_col: str) -> DataFrame:
    """Same as :func:`keep_first` when the order is one column: ``min_by`` as a
    hash aggregate (partial aggregation, no group sort)."""
    others = [c for c in df.columns if c not in key]
    packed = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("_r")
    return df.groupBy(*key).agg(packed).select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def citation_classes(network: DataFrame, modal: DataFrame, focus_journals: Sequence[str],
                     key: str = "doi", code: str = "pacs_code_1") -> DataFrame:
    """Citation-majority classifier.

    Each citing paper is given the most cited journal and the most cited level-1
    code among its references (ties -> largest), beside its true values.  It is
    run on the full network (``is_all_journals = "1"``) and on the edges whose
    two ends are in ``focus_journals`` (``"0"``), in a single pass: a focus edge
    is emitted once per network it belongs to.
    """
    m = modal.select(F.col(key).alias("_k"), F.col(code).alias("_c"))
    e = network.select("citing_doi", "cited_doi", "citing_journal", "cited_journal")
    e = (e.join(m.withColumnRenamed("_k", "citing_doi").withColumnRenamed("_c", "citing_pacs_1"), "citing_doi", "left")
          .join(m.withColumnRenamed("_k", "cited_doi").withColumnRenamed("_c", "cited_pacs_1"), "cited_doi", "left"))
    focus = F.col("citing_journal").isin(list(focus_journals)) & F.col("cited_journal").isin(list(focus_journals))
    tagged = e.withColumn("is_all_journals", F.explode(F.when(focus, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("1")))))
    journal = top_label(tagged, ["is_all_journals", "citing_doi", "citing_journal"], "cited_journal",
                        count_col="cited_doi", out="class_journal")
    pacs = top_label(tagged, ["is_all_journals", "citing_doi", "citing_pacs_1"], "cited_pacs_1",
                     count_col="cited_doi", out="class_pacs_1")
    return (
        journal.join(pacs, ["is_all_journals", "citing_doi"], "left")
        .select("is_all_journals", F.col("citing_doi").alias("doi"),
                F.col("citing_journal").alias("true_journal"), "class_journal",
                F.col("citing_pacs_1").alias("true_pacs_1"), "class_pacs_1")
    )
