"""Sources and sinks (S1-S12): CSV in every flavour, nested JSON metadata, file
keys, embedding and graph tables, run parameters recovered from file paths, and
parameter grids as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.functions.columns import col_

# ---- CSV (S1, S2, S3, S7) -------------------------------------------------------


def read_csv_table(spark: SparkSession, path: str, schema: str | T.StructType, *, header: bool = True,
                   sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """CSV scan with declared types (no inference), optional header, any
    separator; gzip/bz2 are recognised from the file suffix by the reader.
    ``columns`` selects a subset (pruned at the scan)."""
    df = (spark.read.schema(schema).option("header", header).option("sep", sep)
          .option("mode", "PERMISSIVE").csv(path))
    return df.select(*columns) if columns else df


def write_csv_table(df: DataFrame, path: str, *, header: bool = True, sep: str = ",",
                    compression: str | None = None, mode: str = "overwrite") -> str:
    """CSV sink; ``compression`` one of None/gzip/bzip2."""
    w = df.write.mode(mode).option("header", header).option("sep", sep)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
    return path


def read_compressed_csv(spark: SparkSession, path: str, schema, *, partitions: int | None = None, **kw) -> DataFrame:
    """gzip is not splittable: one task per file.  Re-spread the rows right after
    the scan so the rest of the plan is parallel (S2)."""
    df = read_csv_table(spark, path, schema, **kw)
    return df.repartition(partitions) if partitions else df


# ---- nested JSON metadata (S5) --------------------------------------------------

METADATA_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("articleType", T.StringType()),
    T.StructField("title", T.StructType([T.StructField("value", T.StringType())])),
    T.StructField("journal", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("abbreviatedName", T.StringType())])),
])


def extract_metadata(df: DataFrame, json_col: str, schema: T.StructType = METADATA_SCHEMA) -> DataFrame:
    """Parse a JSON text column with a declared nested schema; a missing file,
    field or parent object yields null (never an error)."""
    parsed = F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("_m", parsed)


def flatten_metadata(df: DataFrame, struct_col: str = "_m") -> DataFrame:
    m = F.col(struct_col)
    return df.select(
        *[c for c in df.columns if c != struct_col],
        m.getField("date").alias("date_text"), m.getField("articleType").alias("article_type"),
        m.getField("title").getField("value").alias("title"),
        m.getField("journal").getField("id").alias("journal_id"),
        m.getField("journal").getField("name").alias("journal_name"),
        m.getField("journal").getField("abbreviatedName").alias("journal_abbrev"),
    )


def read_metadata_dir(spark: SparkSession, path: str, key_from_path: str = r"([^/]+)\.json$", fields: str = "") -> DataFrame:
    """Bulk scan of a directory tree of JSON documents (one scan instead of one ``open()`` per
    paper): ``paper`` (what ``key_from_path`` finds in the file's path), ``fields`` (further top-level
    fields, as a DDL string) and the flattened metadata."""
    extra = T.StructType.fromDDL(fields) if fields else T.StructType([])
    df = spark.read.schema(T.StructType(METADATA_SCHEMA.fields + extra.fields)).option("recursiveFileLookup", "true").json(path)
    df = df.withColumn("paper", F.regexp_extract(F.col("_metadata.file_path"), key_from_path, 1))
    return flatten_metadata(df.withColumn("_m", F.struct(*[F.col(c) for c in METADATA_SCHEMA.fieldNames()]))
                            .select("paper", *extra.fieldNames(), "_m"))


# ---- file key from DOI (S6) -------------------------------------------------------

# Journal token -> metadata folder of the reference corpus.
JOURNAL_FOLDERS = [
    ("PhysRev", "PR"), ("PhysRevA", "PRA"), ("PhysRevAccelBeams", "PRAB"), ("PhysRevApplied", "PRAPPLIED"),
    ("PhysRevB", "PRB"), ("PhysRevC", "PRC"), ("PhysRevD", "PRD"), ("PhysRevE", "PRE"),
    ("PhysRevFluids", "PRFLUIDS"), ("PhysRevSeriesI", "PRI"), ("PhysRevLett", "PRL"),
    ("PhysRevMaterials", "PRMATERIALS"), ("PhysRevPhysEducRes", "PRPER"), ("PhysRevSTAB", "PRSTAB"),
    ("PhysRevSTPER", "PRSTPER"), ("PhysRevX", "PRX"), ("RevModPhys", "RMP"), ("Physics", ""),
    ("PhysicsPhysiqueFizika", ""), ("PhysRevFocus", ""),
]


def doi_file_key(df: DataFrame, folders: DataFrame, base: str, doi: str = "doi") -> DataFrame:
    """``base + folder[journal] + '/' + volume + '/' + paper + '.json'`` where
    paper = DOI after '/', journal/volume = its 1st/2nd dotted parts.  An
    unknown journal gives a null key (left join).  ``folders`` is a lookup
    table ``journal, folder`` with one row per journal, so it is broadcast."""
    paper = F.split_part(col_(doi), F.lit("/"), F.lit(2))
    d = df.withColumn("_paper", paper).withColumn("_journal", F.split_part(F.col("_paper"), F.lit("."), F.lit(1))) \
        .withColumn("_volume", F.split_part(F.col("_paper"), F.lit("."), F.lit(2)))
    f = F.broadcast(folders.select(F.col("journal").alias("_journal"), F.col("folder").alias("_folder")))
    key = F.concat(F.lit(base), F.col("_folder"), F.lit("/"), F.col("_volume"), F.lit("/"), F.col("_paper"), F.lit(".json"))
    return d.join(f, "_journal", "left").withColumn("meta_filename", key).drop("_paper", "_journal", "_volume", "_folder")


# ---- vectors and graphs as tables (S8, S9, S11) -----------------------------------

def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- run parameters from file paths (S10) ---------------------------------------

def with_run_params(df: DataFrame, pattern: str = r"([A-Za-z_]+)=([^/]+)") -> DataFrame:
    """Recover ``key=value`` run parameters from each row's source file path
    (Hive-style directories, or ``key-value`` tokens joined by ``_``)."""
    path = F.col("_metadata.file_path")
    return df.withColumn("source_file", path).withColumn(
        "params", F.str_to_map(F.regexp_replace(F.regexp_extract(path, r"/([^/]+=[^/]+(?:/[^/]+=[^/]+)*)/[^/]+$", 1), "/", ","), F.lit(","), F.lit("=")))


def params_from_name(name_col: str, pair_sep: str = "_", kv_sep: str = "-") -> F.Column:
    """``embedding-node2vec_k-8_trial-2`` -> map (case-folded keys)."""
    return F.str_to_map(F.lower(F.col(name_col)), F.lit(pair_sep), F.lit(kv_sep))


# ---- parameter grids (S12) ------------------------------------------------------

def param_grid(spark: SparkSession, **axes: Iterable) -> DataFrame:
    """Cartesian product of small parameter axes as one DataFrame (a handful of
    rows), to be joined to data so that all runs execute in one job."""
    import itertools

    names = list(axes)
    rows = list(itertools.product(*[list(v) for v in axes.values()]))  # parameters, not data
    return spark.createDataFrame(rows, names)
