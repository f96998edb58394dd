"""Line deduplication by a suffix array over line numbers (built-in functions only).

A document is the sequence of its lines that hold a word.  The suffixes of all
documents are sorted by prefix doubling: first by one line, then, from the ranks of a
suffix and of the suffix ``depth`` lines further on, by twice as many.  Each round is one
equi-join on (document, position), one map-side combined count of rank pairs, and ranks
from a range-partitioned prefix sum over the distinct pairs, so a line that a third of
all lines equal costs one row a task.

Suffixes that share a rank at depth d are an interval of the suffix array whose
longest common prefix is d or more.  A suffix alone in its interval leaves: its longest common prefix with any other is
known to less than a doubling; so does one whose document ends sooner.  The rounds go on until no interval of two is
left, so the whole suffix array is sorted, whatever the length of the longest repeated run; up to ``min_run`` lines (where
the last step overlaps if it is no power of two), they only sort.

In each interval of ``min_run`` lines or more the first occurrence stays and every other suffix is a later copy to that depth.
Its deepest interval gives the common prefix with an earlier occurrence; overlapping prefixes of one document chain to the
maximal repeated runs (``repeated_runs``), whose lines go.  With ``min_run`` 1 every later copy of a line goes; with more, lines that
repeat only between differing neighbours stay.  A line's own first occurrence is never
a later copy, so no line vanishes from the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import attach, text_key, without_lines
from citeweave.session import Workspace

MIN_RUN = 2


def line_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, key, id, pos, line, a, b``: every line that holds a word, its position among such
    lines and its number among all lines from 0, and 96 bits of hash.  (doc, key) names the document."""
    key = text_key(text_col)
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.xxhash64(F.col(id_col), key).alias("doc"),
                       F.split(F.col(text_col).cast("string"), "\n", -1).alias("lines"))
    with_word = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("a"), F.hash(x).cast("long").alias("b"),
                                                   (F.length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) > 0).alias("full"))), lambda s: s["full"])
    flat = rows.select("doc", "key", "id", F.posexplode(with_word).alias("pos", "s"))
    return flat.select("doc", "key", "id", "pos", "s.line", "s.a", "s.b")


def ranked(active: DataFrame, ws: Workspace, depth: int, total: int) -> DataFrame:
    """``active`` (order keys ``a, b``) with ``rank, n``: the suffix array's first place of the
    suffix's interval, and the interval's size.  Suffixes alone in theirs are left out."""
    classes = active.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = max(1, int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # stored, so that the ranges cannot move between the two uses below
    laid = ws.keep(classes.repartitionByRange(parts, "a", "b").withColumn("_part", F.spark_partition_id()), f"classes{depth}")
    sums = laid.groupBy("_part").agg(F.sum("n").alias("s"))  # one row per range
    before = sums.select("_part", (F.sum("s").over(Window.orderBy("_part")) - F.col("s")).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("_part").orderBy("a", "b")) - F.col("n")
    ranks = laid.withColumn("_inside", inside).join(F.broadcast(before), "_part") \
        .select("a", "b", "n", (F.col("_before") + F.col("_inside")).alias("rank"))
    return attach(active, ws.keep(ranks, f"ranks{depth}"), ["a", "b"], "n", total).where("rank is not null").drop("a", "b")


def repeated_runs(start: DataFrame, ws: Workspace, min_run: int) -> DataFrame:
    """``doc, key, id, first, last``: the maximal runs of lines (positions of ``start``, ``line_sequences``) of which every
    ``min_run`` lines in a row repeat an earlier occurrence."""
    total, place = start.count(), F.struct("id", "key", "pos")
    active = ws.keep(ranked(start.drop("line"), ws, 1, total), "suffixes1")
    depth, found = 1, []
    while True:
        if depth >= min_run:
            first = active.groupBy("rank").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"))
            later = attach(active, ws.keep(first, f"first{depth}"), ["rank"], "size", total).where(place > F.col("first"))
            found.append(ws.keep(later.select("doc", "key", "id", "pos", (F.col("pos") + (depth - 1)).alias("last")), f"later{depth}"))
        step = min(depth, min_run - depth) if depth < min_run else depth
        ahead = active.select("doc", "key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = ws.keep(active.drop("n").withColumnRenamed("rank", "a").join(ahead, ["doc", "key", "pos"]), f"pairs{depth}")
        ws.drop(f"classes{depth}", f"ranks{depth}", f"first{depth}", f"suffixes{depth}")
        if depth >= min_run and pairs.isEmpty():
            break
        active = ws.keep(ranked(pairs, ws, depth + step, total), f"suffixes{depth + step}")
        ws.drop(f"pairs{depth}")
        depth += step
    # the deepest common prefix of each suffix, and the chains of those that overlap or touch
    spans = reduce(DataFrame.unionByName, found).groupBy("doc", "key", "pos").agg(F.first("id").alias("id"), F.max("last").alias("last"))
    by_doc = Window.partitionBy("doc", "key").orderBy("pos")
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("pos") > reach + 1, F.lit(True)).cast("int")
    chained = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_doc))
    return chained.groupBy("doc", "key", "run").agg(F.first("id").alias("id"), F.min("pos").alias("first"), F.max("last").alias("last")).drop("run")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``id, key, line``: the lines of all but the first occurrence of each repeated run of ``min_run``
    lines or more.  Order is by id (null first), then ``key``, then line."""
    ws = Workspace(docs.sparkSession, "line-dedup")
    # rows that repeat id and text are one document
    start = ws.keep(line_sequences(docs, id_col, text_col).dropDuplicates(["doc", "key", "pos"]), "lines")
    runs = ws.keep(repeated_runs(start, ws, min_run), "runs")
    gone = runs.select("doc", "key", F.explode(F.sequence("first", "last")).alias("pos"))
    return start.join(gone, ["doc", "key", "pos"], "left_semi").select("id", "key", "line")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``docs``, all its columns and rows, with later copies of repeated line runs taken out of the text,
    and ``_gone``, how many lines that were (``_gone_1`` and so on if ``docs`` has a column of that name; no other
    name of its columns matters).

    Lines without a word belong to no run and stay.  A null text stays null.  Rows that
    repeat both id and text are one document and get the same text.  A null id comes before all
    others.  A run that overlaps its own copy (one line many times over) leaves its first line.
    An empty table gives an empty result."""
    ws = Workspace(docs.sparkSession, "line-dedup-marks")
    return without_lines(docs, ws.keep(later_copies(docs, id_col, text_col, min_run), "marks"), id_col, text_col)
