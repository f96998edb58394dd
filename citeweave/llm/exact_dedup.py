"""Exact deduplication by two-pass Bloom filtering (built-in functions only).

Every text is read once, into a narrow table (id, SHA-256, row number).

Pass 1 adds four bits of one 64-bit word of a register-blocked counting Bloom filter per
hash.  A word's row holds the bits met, how many hashes met the word, and a counter of four bits
for each of its 64 bits, sixteen to a number, so that sums count all of them at once; tasks
combine their words before the shuffle.  A counter cannot overflow in a word met by fewer than
``COUNTED`` hashes, so there a bit met twice is known; in a fuller word every bit met counts as met
twice.  The bits met twice are the *repeat filter*, at most ``MAX_WORDS`` words, so broadcasting
it is safe at any input size and a word that a third of all rows meet costs a row a task.

Pass 2 probes the filter.  A row one of whose bits was met once cannot have a copy: it
passes straight through and its SHA-256 never shuffles.  The others, true repeats and some
false positives, shuffle on their full SHA-256 (never the text) and are resolved
exactly.  A digest that holds a large part of all rows is combined map-side and
meets its group by a bounded broadcast (``common.attach``).

Once the corpus outgrows the filter, more rows take the exact path: results stay
exact, only the saving shrinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import attach
from citeweave.session import Workspace

MAX_WORDS = 1 << 21  # 16 MB of filter bits
ROWS_PER_WORD = 2  # 32 bits a row while the filter may still grow
COUNTED = 16  # hashes from which the counters of a word may overflow


def _signature(digests: DataFrame, words: int) -> DataFrame:
    h = F.xxhash64("text_sha256")
    bit = " | ".join(f"shiftleft(1L, cast(shiftright(_h, {s}) & 63 AS int))" for s in (0, 6, 12, 18))
    return digests.withColumn("_h", h).withColumn("_word", F.pmod(F.shiftright("_h", 24), F.lit(words))) \
        .withColumn("_bits", F.expr(bit)).drop("_h")


def _spread(k: int) -> str:
    """SQL: the sixteen bits of ``_bits`` from 16 * ``k`` on as sixteen counters of four bits."""
    x = f"(shiftrightunsigned(_bits, {16 * k}) & 65535L)"
    for shift, mask in ((24, 0x000000FF000000FF), (12, 0x000F000F000F000F), (6, 0x0303030303030303), (3, 0x1111111111111111)):
        x = f"transform(array({x}), x -> (x | shiftleft(x, {shift})) & {mask}L)[0]"
    return x


def _gather(k: int) -> str:
    """SQL: the bits whose counters in ``_c{k}`` are two or more, back in their places."""
    x = f"((shiftrightunsigned(_c{k}, 1) | shiftrightunsigned(_c{k}, 2) | shiftrightunsigned(_c{k}, 3)) & {0x1111111111111111}L)"
    for shift, mask in ((3, 0x0303030303030303), (6, 0x000F000F000F000F), (12, 0x000000FF000000FF), (24, 0xFFFF)):
        x = f"transform(array({x}), x -> (x | shiftrightunsigned(x, {shift})) & {mask}L)[0]"
    return f"shiftleft({x}, {16 * k})"


def repeat_filter(signed: DataFrame) -> DataFrame:
    """``_word, _filter``: of rows ``_word, _bits`` the bits that more than one row holds (in crowded words: any row)."""
    counters = [F.try_sum(F.expr(_spread(k))).alias(f"_c{k}") for k in range(4)]  # null if a top counter overflows
    words = signed.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"), F.bit_or("_bits").alias("_met"), *counters)
    twice = F.expr(" | ".join(_gather(k) for k in range(4)))
    sure = (F.col("_n") < COUNTED) & twice.isNotNull()
    return words.select("_word", F.when(sure, twice).otherwise(F.col("_met")).alias("_filter")).where("_filter <> 0")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty.  Of equal texts the row with the largest id stays; a
    null id is the smallest.  Rows that repeat both id and text are told apart by
    their place in the table: exactly one row of each group is kept.  Other columns
    of ``docs`` are not read, so their names cannot clash.  An empty table gives an
    empty result."""
    ws = Workspace(docs.sparkSession, "exact-dedup")
    digests = ws.keep(
        docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
                    F.monotonically_increasing_id().alias("_row")), "digests")
    total = digests.count()
    words = 1 << 10
    while words < MAX_WORDS and words * ROWS_PER_WORD < total:
        words *= 2
    signed = _signature(digests, words)

    bloom = ws.keep(repeat_filter(signed.select("_word", "_bits")), "filter")
    probed = signed.join(F.broadcast(bloom), "_word", "left") \
        .withColumn("_maybe", F.coalesce(F.col("_filter").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False)))

    single = probed.where(~F.col("_maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = probed.where("_maybe").select("id", "text_sha256", "_row")
    groups = ws.keep(maybe.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "_row")).alias("_best")), "groups")
    resolved = attach(maybe, groups, ["text_sha256"], "group_size", total).select(
        "id", F.col("_best.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256")
    return single.unionByName(resolved).withColumnRenamed("id", id_col)
