"""SentencePiece encoding and decoding as relations.

Text is cut into units that no piece spans: a run of spaces with the letters, or the other
marks, behind it; a line break.  (Where some piece of the vocabulary does mix letters and
marks, units are whole words.)  Each distinct unit is encoded once:

1. explode the unit's substrings of at most the longest piece's length,
2. equi-join them to the piece table (a bounded broadcast),
3. group the edges that match by unit: its lattice,
4. fold the lattice with ``aggregate``: Viterbi over the pieces' scores, then the path back.

The distinct units come out of their count already partitioned by unit, so steps 1 to 4 move
no row.  A character that no piece covers falls back to its bytes.

Encoded units meet their occurrences in two ways: the most frequent units, ``FREQUENT`` at most and none of over
``SHARED_CHARS`` characters, by broadcast, so no common unit shuffles, and the rest by a join on the unit.  The
digests of whole documents (``encoding_digest``) take the broadcast units as an Arrow table: a first pass
names the other units of each document, those alone shuffle to their encodings, and a second pass puts the
ids of each document together, decodes them and lets out digests only.

The path is the one of least cost, the cost of a piece being minus its score; of equal
paths the one with the longer last piece.  Text may hold U+2581 itself: it is written as bytes, so
decoding always gives back the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import small_batches, text_key
from citeweave.session import Workspace

FREQUENT, SHARED_CHARS = 1 << 19, 64  # units that are broadcast, characters of each, at most: 64 MB of text and ids
SLICE_UNITS = 1 << 20  # units of whole documents that a task puts together at a time
UNIT_CHARS, SPACES = 200, 16  # a longer unit is cut
TOP_COST, BYTE_COST = 400_000, 500_000  # of a piece at most; of a character written as bytes
WHOLE_WORDS = rf" {{0,{SPACES}}}[^ \n]{{1,{UNIT_CHARS}}}|\n| {{1,{SPACES}}}"
LETTERS_APART = rf" {{0,{SPACES}}}[a-zA-Z\p{{L}}]{{1,{UNIT_CHARS}}}| {{0,{SPACES}}}[^a-zA-Z\p{{L}} \n]{{1,{UNIT_CHARS}}}|\n| {{1,{SPACES}}}"
LATTICES = 100_000  # that one task may hold while it groups edges; Spark sorts beyond that


class Vocabulary:
    """The piece table of a model file: ``rows`` of (piece, cost, id) with spaces for U+2581, and the byte pieces."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rows = [(sp.id_to_piece(i).replace("▁", " "), int(min(TOP_COST, max(0, round(-sp.get_score(i))))), i) for i in plain]
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.byte_ids) or sp.get_piece_size() >= 1 << 20:
            raise ValueError("the model has no byte pieces or too many pieces")
        mixed = any(a.isalpha() != b.isalpha() for p, _, _ in self.rows for a, b in zip(p.lstrip(" "), p.lstrip(" ")[1:]))
        self.pattern = WHOLE_WORDS if mixed else LETTERS_APART

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "piece string, cost long, piece_id int")


def units_of(text: Column, vocabulary: Vocabulary) -> Column:
    """Units of a text, in order; together they are the text with a space before it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text != "", F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(vocabulary.pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


# An edge is one number: end (8 bits), cost (27), start (8), piece id (20).  So is a step of a path,
# without the end; the least number is the least cost, then the longest piece.
_STEP = """(s, e) -> if(shiftright(e, 55) = s.at,
    struct(s.done AS done, s.at AS at, least(s.best, {before_same} + (e & 36028797018963967L)) AS best),
    struct(if(s.at = 0, s.done, concat(s.done, array(s.best))) AS done, s.at + 1 AS at, {before_next} + (e & 36028797018963967L) AS best))"""
_START = "cast(shiftright(e, 20) & 255 AS int)"
_SAME = f"if({_START} = 0, 0L, s.done[{_START} - 1] & -268435456L)"
_NEXT = f"if({_START} = 0, 0L, if({_START} = s.at, s.best, s.done[{_START} - 1]) & -268435456L)"
_VITERBI = f"""aggregate(edges, struct(cast(array() AS array<bigint>) AS done, 0L AS at, 0L AS best),
    {_STEP.format(before_same=_SAME, before_next=_NEXT)}, s -> reverse(concat(s.done, array(s.best))))"""
# walking back from the last position, the steps that lie on the path
_PATH = """aggregate(back, struct(size(back) AS at, size(back) AS want, cast(array() AS array<bigint>) AS path),
    (s, b) -> if(s.at = s.want,
        struct(s.at - 1 AS at, cast(shiftright(b, 20) & 255 AS int) AS want, concat(array(b & 268435455L), s.path) AS path),
        struct(s.at - 1 AS at, s.want AS want, s.path AS path)), s -> s.path)"""


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``unit, n, ids`` for distinct rows ``unit, n`` that are partitioned by unit."""
    pieces = F.broadcast(vocabulary.table(units.sparkSession))  # bounded by the vocabulary
    ends = units.select("unit", "n", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("end"))
    parts = ends.select("unit", "n", "end", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.col("end")))).alias("len")) \
        .withColumn("piece", F.col("unit").substr(F.col("end") - F.col("len") + 1, F.col("len")))
    found = parts.join(pieces, "piece", "left").where("piece_id IS NOT NULL OR len = 1")
    edge = F.expr(f"shiftleft(cast(end AS bigint), 55) + shiftleft(coalesce(cost, {BYTE_COST}L), 28) "
                  "+ shiftleft(cast(end - len AS bigint), 20) + coalesce(piece_id, 0)")
    lattice = found.select("unit", "n", edge.alias("e")).groupBy("unit", "n").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    back = lattice.select("unit", "n", F.expr(_VITERBI).alias("back"))
    path = back.select("unit", "n", F.expr(_PATH).alias("path"))
    # piece id 0 stands for a character to be written as bytes
    byte_ids = F.array(*map(F.lit, vocabulary.byte_ids))
    as_bytes = F.expr("transform(path, p -> if((p & 1048575) <> 0, '', hex(encode(substring(unit, cast(shiftright(p, 20) AS int) + 1, 1), 'UTF-8'))))")
    spelled = path.withColumn("plain", F.expr("transform(path, p -> cast(p & 1048575 AS int))")).withColumn("hex", F.when(
        F.expr("array_contains(plain, 0)"), as_bytes))
    ids = F.when(F.col("hex").isNull(), F.col("plain")).otherwise(F.flatten(F.zip_with("plain", "hex", lambda i, h: F.when(i != 0, F.array(i)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(h) / 2).cast("int"))),
                    lambda k: F.element_at(byte_ids, F.conv(F.substr(h, k * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))))))
    return spelled.select("unit", "n", ids.alias("ids"))


def _rows(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), units_of(F.col(text_col), vocabulary).alias("units"))


def encoded_units(rows: DataFrame, vocabulary: Vocabulary, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Two parts ``unit, ids`` of a stored table of all distinct units of ``rows``: the most frequent, at most
    ``FREQUENT`` (to broadcast), and the others."""
    spark = rows.sparkSession
    counted = rows.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, LATTICES)
    try:
        known = ws.keep(encode_units(counted, vocabulary), "units")
    finally:
        spark.conf.set(setting, before)
    # the lowest class of counts (eighths of a power of two, a few hundred) that still fits
    shared = F.length("unit") <= SHARED_CHARS
    grade = F.floor(8 * F.log2("n"))
    least, total = 1 << 62, 0
    for r in sorted(known.where(shared).groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["g"]):
        total += r["k"]
        if total > FREQUENT:
            break
        least = r["n"]
    common = shared & (F.col("n") >= least)
    return known.where(common).select("unit", "ids"), known.where(~common).select("unit", "ids")


def encode(docs: DataFrame, vocabulary: Vocabulary, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, pos, ids``: the piece ids of each unit of each document, ``pos`` counting from 0.  A
    document without text has one row with nulls.  (id, key) names the document; rows that repeat
    id and text repeat its rows."""
    rows = _rows(docs, vocabulary, id_col, text_col)
    common, rare = encoded_units(rows, vocabulary, ws)
    each = rows.select("id", "key", F.posexplode("units").alias("pos", "unit"))
    near = each.join(F.broadcast(common), "unit")
    far = each.join(F.broadcast(common.select("unit")), "unit", "left_anti").join(rare, "unit")
    none = rows.where(F.size("units") == 0).select("id", "key", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("array<int>").alias("ids"))
    return near.select("id", "key", "pos", "ids").unionByName(far.select("id", "key", "pos", "ids")).unionByName(none)


def documents(encoded: DataFrame) -> DataFrame:
    """``id, key, ids``: the ids of each document in one array (no ids: an empty one).  A document repeated
    in full counts once."""
    parts = F.sort_array(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "ids"))))
    return encoded.groupBy("id", "key").agg(parts.alias("p")).select("id", "key", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def decode(ids: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``ids`` with the column ``decoded``: the text that its array of piece ids spells, by a join of the
    exploded ids to the piece table (spelled in UTF-8, as byte pieces hold parts of characters)."""
    spark = ids.sparkSession
    spell = [(i, p.encode()) for p, _, i in vocabulary.rows] + [(i, bytes([b])) for b, i in enumerate(vocabulary.byte_ids)]
    pieces = F.broadcast(spark.createDataFrame(spell, "_id int, _utf8 binary"))
    rows = ids.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", F.posexplode(ids_col).alias("_pos", "_id")).join(pieces, "_id")
    texts = each.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "_utf8"))).alias("_p")).select(
        F.col("_row"), F.array_join(F.transform("_p", lambda x: F.hex(x["_utf8"])), "").alias("_hex"))
    text = F.substr(F.decode(F.unhex("_hex"), "UTF-8"), F.lit(2))  # without the space put before
    return rows.join(texts, "_row", "left").withColumn("decoded", F.coalesce(text, F.lit(""))).select(*ids.columns, "decoded")


class _Shared:
    """The broadcast units in a task: where a unit stands among them, and their ids."""

    def __init__(self, ipc: bytes):
        import pyarrow as pa

        table = pa.ipc.open_stream(ipc).read_all().combine_chunks()
        self.units = pa.array([], pa.string()) if not len(table) else table.column("unit").chunk(0)
        self.ids = pa.array([], pa.list_(pa.int32())) if not len(table) else table.column("ids").chunk(0)

    def places(self, units):
        """Of each of ``units`` the place, -1 if it is not among them."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy(zero_copy_only=False)


def _slices(batch):
    """Parts of an Arrow batch whose ``units`` are about ``SLICE_UNITS`` (one document at least)."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.list_value_length(batch.column("units")).to_pylist()):
        if i > start and held + n > SLICE_UNITS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _bounds(lists):
    """Where each list of an Arrow array of lists (null: empty) starts among all items, and the end."""
    import numpy as np
    import pyarrow.compute as pc

    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)


def missing_units(rows: DataFrame, shared) -> DataFrame:
    """``id, key, pos, unit``: the units of ``rows`` (``id, key, units``) that are not among the broadcast ``shared``."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = _Shared(shared.value)
        for whole in batches:
            for batch in _slices(whole):
                units, bounds = batch.column("units").flatten(), _bounds(batch.column("units"))
                at = np.flatnonzero(table.places(units) < 0)
                row = np.searchsorted(bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), batch.column("key").take(pa.array(row)), pa.array((at - bounds[row]).astype(np.int32)),
                     units.take(pa.array(at))], names=["id", "key", "pos", "unit"])

    return small_batches(rows.select("id", "key", "units")).mapInArrow(run, f"id {kind}, key long, pos int, unit string")


def _sha256(ids, ends, words, between: bytes, skip: int) -> list[str]:
    """SHA-256 of each document's ``words[ids]`` joined, its first ``skip`` bytes left out; ``ends`` bound the documents."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), words.take(ids)), pa.scalar(between, pa.large_binary()))
    return [hashlib.sha256(memoryview(x.as_buffer())[skip:]).hexdigest() for x in joined]


def digests(rows: DataFrame, shared, vocabulary: Vocabulary) -> DataFrame:
    """``id, key, n_units, n_pieces, ids_digest, decoded_sha256, round_trip`` of ``rows`` (``id, key, sha256, units, pos, size, ids``):
    place, number of ids, and ids in a row, of the units that are not among the broadcast ``shared``.  The decoded text is
    put together from the ids alone."""
    kind = rows.schema["id"].dataType.simpleString()
    spell = {i: p.encode() for p, _, i in vocabulary.rows} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    spelled = [spell.get(i, b"") for i in range(max(spell) + 1)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table, wide = _Shared(shared.value), pa.large_binary()
        numbers, pieces = pa.array([str(i).encode() for i in range(len(spelled))], wide), pa.array(spelled, wide)
        first, own = _bounds(table.ids), table.ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        for whole in batches:
            for batch in _slices(whole):
                units, bounds = batch.column("units").flatten(), _bounds(batch.column("units"))
                place = table.places(units).astype(np.int64)
                late = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pos", "size", "ids")}
                at = np.repeat(bounds[:-1], np.diff(_bounds(batch.column("pos")))) + late["pos"]
                place[at] = len(table.units) + np.arange(len(at))
                if (place < 0).any():
                    raise ValueError("a unit has no encoding")
                starts, values = np.concatenate((first, first[-1] + np.cumsum(late["size"]))), np.concatenate((own, late["ids"].astype(np.int32)))
                size = np.diff(starts)[place]
                before = np.concatenate(([0], np.cumsum(size)))
                ids = pa.array(values[np.repeat(starts[place] - before[:-1], size) + np.arange(before[-1])])
                ends = before[bounds]
                # a space was put before the text
                digest = [_sha256(ids, ends, numbers, b",", 0), _sha256(ids, ends, pieces, b"", 1)]
                same = [a == b for a, b in zip(digest[1], batch.column("sha256").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array(np.diff(bounds)), pa.array(np.diff(ends)),
                     *(pa.array(x, pa.string()) for x in digest), pa.array(same, pa.bool_())], names=names)

    names = ["id", "key", "n_units", "n_pieces", "ids_digest", "decoded_sha256", "round_trip"]
    return small_batches(rows.select("id", "key", "sha256", "units", "pos", "size", "ids")).mapInArrow(
        run, f"id {kind}, key long, n_units long, n_pieces long, ids_digest string, decoded_sha256 string, round_trip boolean")


def encoding_digest(docs: DataFrame, vocabulary: Vocabulary, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, encoded and decoded: ``id_col, n_units, n_pieces, ids_digest`` (SHA-256 of all its ids
    in order, joined by commas), ``decoded_sha256`` (of the text that the ids spell) and ``round_trip`` (whether that is
    the SHA-256 of the text).

    The units that are not broadcast meet their encodings by a join, and each document meets the list of its own; no ids
    of whole documents are stored or shuffled.  Null and empty texts have no pieces.  Rows that repeat id and text make
    one row.  Null ids are ids like any other.  Other columns are not read; an empty table gives an empty result."""
    import pyarrow as pa

    rows = _rows(docs, vocabulary, id_col, text_col)
    common, rare = encoded_units(rows, vocabulary, ws)
    sink, held = pa.BufferOutputStream(), common.toArrow()  # bounded by FREQUENT and SHARED_CHARS
    with pa.ipc.new_stream(sink, held.schema) as writer:
        writer.write_table(held)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    met = missing_units(rows, shared).join(rare, "unit").groupBy(F.col("id").alias("i"), F.col("key").alias("k")) \
        .agg(F.collect_set(F.struct("pos", "ids")).alias("u"))  # of a repeated document's units one of each place
    # three flat arrays are a third of an array of structs
    late = ws.keep(met.select("i", "k", F.transform("u", lambda x: x["pos"]).alias("pos"), F.transform("u", lambda x: F.size(x["ids"])).alias("size"),
                              F.flatten(F.transform("u", lambda x: x["ids"])).alias("ids")), "late")
    ws.drop("units")
    flat = [F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("pos", "size", "ids")]
    whole = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")) \
        .join(late, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left") \
        .select("id", "key", F.sha2("t", 256).alias("sha256"), units_of(F.col("t"), vocabulary).alias("units"), *flat)
    made = ws.keep(digests(whole, shared, vocabulary).dropDuplicates(["id", "key"]), "digests")
    ws.drop("late")
    return made.withColumnRenamed("id", id_col).drop("key")
