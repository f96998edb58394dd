"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.session import fits_broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rows of whole texts that go to a Python worker at a time: a worker keeps the memory of its largest batch.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows if they are larger; returns ``df``."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def text_bytes(batch, column: str) -> list:
    """The UTF-8 bytes of a string column of an Arrow batch (None for null)."""
    import pyarrow as pa

    return batch.column(column).cast(pa.large_binary()).to_pylist()


def sub_batches(values: list, most: int):
    """Index ranges of ``values`` whose items sum to about ``most`` bytes (one item at least)."""
    start, size = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def text_slices(texts, most: int):
    """Index ranges of an Arrow string array whose texts sum to about ``most`` bytes (one text at least)."""
    import pyarrow.compute as pc

    yield from _ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most)


def _ranges(sizes: list[int], most: int):
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def as_column(ids: DataFrame, name: str, like: DataFrame, source: str) -> DataFrame:
    """``ids`` with column ``name`` cast to the type ``source`` has in ``like``."""
    return ids.withColumn(name, F.col(name).cast(like.schema[source].dataType))


def shingle_hashes(words: list[bytes], size: int):
    """XXH64 (seed 42) of each run of ``size`` words joined by a space, as an uint64 array."""
    import numpy as np
    import xxhash

    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    return np.fromiter((xxhash.xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` fit, else unchanged."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def text_key(text_col: str):
    """64-bit hash that, with the id, names a document; null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def whole_row(docs: DataFrame):
    """All columns of ``docs`` as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def columns_of(docs: DataFrame, row: str, **changed) -> list:
    """The columns of ``docs`` out of the struct ``row``, those named in ``changed`` replaced."""
    return [(changed[c] if c in changed else F.col(row).getField(c)).alias(c) for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with a number behind it if ``docs`` has such a column (in whatever case)."""
    taken, found, n = {c.lower() for c in docs.columns}, name, 1
    while found.lower() in taken:
        found, n = f"{name}_{n}", n + 1
    return found


def without_lines(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the lines named in ``marks`` (``id, key, line``: line numbers from 0,
    ``key`` the ``text_key``) taken out of the text, and the column ``_gone`` (how many;
    ``_gone_1`` and so on if ``docs`` has that name).

    A text's lines are gathered and filtered inside its own row; a text without marks
    is unchanged.  The line numbers of a document are as many as its lines at most."""
    gone = marks.groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.collect_set("line").alias("lines"))
    # split before the join, so that the lines are a column when they are picked below
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.split(F.col(text_col).cast("string"), "\n", -1).alias("split"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("lines"))
    text = F.when(F.col("lines").isNull(), F.col("row").getField(text_col)).otherwise(
        F.array_join(F.transform(keep, lambda i: F.col("split")[i]), "\n"))
    count = F.greatest(F.lit(0), F.coalesce(F.size("lines"), F.lit(0))).cast("long")
    return rows.select(*columns_of(docs, "row", **{text_col: text}), count.alias(free_name(docs, "_gone")))


# A key is hot when it holds more than 1/HOT_SHARE of the rows: fewer than HOT_SHARE
# keys can be, whatever the data, which bounds the broadcast below.
HOT_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join ``rows`` with ``groups`` (one row per ``keys``, never null; ``size``
    holds the number of rows of the key, ``total`` of all rows).

    Rows of hot keys meet their group by a broadcast of fewer than ``HOT_SHARE``
    rows and never shuffle; all others meet by a shuffled join in which no key
    holds more than ``total / HOT_SHARE`` rows."""
    hot = groups.where(F.col(size) * HOT_SHARE > total)
    cold = groups.where(F.col(size) * HOT_SHARE <= total)
    near = rows.join(F.broadcast(hot), keys, "inner")
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return near.unionByName(far)


# Whole-number components stay below this size, so that products and squared distances of
# vectors of a thousand components fit 64 bits.
MAX_WHOLE = 1 << 26


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *others: str) -> DataFrame:
    """``vec_id, v, *others``: the components as ``floor(scale * x)``, x as double.  Vectors that are null or
    hold null or non-finite components are left out; a component of ``MAX_WHOLE`` or more is an error."""
    x = F.col(vec_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    size = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < MAX_WHOLE - 1)
    v = F.when(fits, size).otherwise(F.raise_error(F.lit(f"a component times {scale} is {MAX_WHOLE} or more")).cast("array<bigint>"))
    return vectors.where(x.isNotNull()).where(~odd).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *others)
