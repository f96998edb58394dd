"""Queries of this package: ``QUERIES[name](spark, sf_dir)`` and DuckDB SQL in ``SQL``."""

from __future__ import annotations

from citeweave.llm import bit_sliced, chat, dual_tree, exact_dedup, language_id, line_dedup, packing, pieces, quality, repair, simhash, substring_dedup, warc
from citeweave.llm.common import table
from citeweave.session import Workspace
from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_simhash_dedup(spark, sf_dir):
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)


@query
def op8_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    placed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


@query
def op10_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(turns.unionByName(added)))


@query
def op9_warc(spark, sf_dir):
    return warc.read(warc.warc_derivatives(table(spark, sf_dir, "pages")))


@query
def op4_substring_dedup(spark, sf_dir):
    found = substring_dedup.repeated_substrings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "line", "start", "length", "n_words", F.col("keep_id").alias("keep_doc_id"),
                        "keep_line", "group_size", "kept")


@query
def op4_substring_passages(spark, sf_dir):
    docs = substring_dedup.passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


@query
def op7_line_dedup(spark, sf_dir):
    docs = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_gone").alias("lines_removed"), F.length("text").cast("long").alias("chars_left"),
                       F.sha2("text", 256).alias("text_sha256"))


SQL["op7_line_dedup"] = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS line FROM split),
full_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM flat
          WHERE length(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) > 0),
pairs AS (SELECT a.doc_id, a.pos, row_number() OVER (PARTITION BY a.x, b.x ORDER BY a.doc_id, a.pos) AS nth
          FROM full_ a JOIN full_ b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM pairs, (VALUES (0), (1)) v(d) WHERE nth > 1),
marked AS (SELECT f.doc_id, f.line, (g.pos IS NOT NULL) AS gone
           FROM (SELECT flat.doc_id, flat.line, full_.pos FROM flat LEFT JOIN full_ ON full_.doc_id = flat.doc_id AND full_.line = flat.line) f
           LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos),
built AS (SELECT m.doc_id, count(*) FILTER (WHERE gone) AS lines_removed,
                 coalesce(string_agg(x, chr(10) ORDER BY m.line) FILTER (WHERE NOT gone), '') AS t
          FROM marked m JOIN flat ON flat.doc_id = m.doc_id AND flat.line = m.line GROUP BY m.doc_id)
SELECT d.doc_id, coalesce(lines_removed, 0) AS lines_removed, length(CASE WHEN d.text IS NULL THEN NULL ELSE t END) AS chars_left,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE t END) AS text_sha256
FROM documents d LEFT JOIN built USING (doc_id)
"""


@query
def op7_line_dedup_all(spark, sf_dir):
    docs = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_run=1)
    return docs.select("doc_id", F.col("_gone").alias("lines_removed"), F.length("text").cast("long").alias("chars_left"),
                       F.sha2("text", 256).alias("text_sha256"))


SQL["op7_line_dedup_all"] = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS line FROM split),
marked AS (SELECT *, length(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) > 0
                     AND row_number() OVER (PARTITION BY x ORDER BY doc_id, line) > 1 AS gone FROM flat),
built AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS lines_removed,
                 coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(lines_removed, 0) AS lines_removed, length(CASE WHEN d.text IS NULL THEN NULL ELSE t END) AS chars_left,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE t END) AS text_sha256
FROM documents d LEFT JOIN built USING (doc_id)
"""


@query
def op2_sentencepiece(spark, sf_dir):
    import public_tokenizers

    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encoding_digest(table(spark, sf_dir, "documents"), vocabulary, Workspace(spark, "pieces"))


@query
def op11_bit_sliced_top_k(spark, sf_dir):
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL["op11_bit_sliced_top_k"] = """
WITH w AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
best AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
                row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
         FROM w q JOIN w c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM best WHERE rank <= 5
"""


@query
def op12_dual_tree_codes(spark, sf_dir):
    return dual_tree.compress(table(spark, sf_dir, "embeddings"))


_ASSIGN = """{name} AS MATERIALIZED (SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT s.r, s.p, s.x, b.e, list_sum([(s.x[i] - b.x[i]) * (s.x[i] - b.x[i]) for i in range(1, len(s.x) + 1)]) AS d
    FROM parts s JOIN {book} b ON s.p = b.p) GROUP BY r, p, x)"""
_REFINE = """{name} AS MATERIALIZED (SELECT b.p, b.e, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x FROM {book} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (
        SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM {assigned}) GROUP BY p, e, i) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
SQL["op12_dual_tree_codes"] = f"""
WITH w AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
     FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM w, range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, r AS e, x FROM parts WHERE r < 64),
{_ASSIGN.format(name="near0", book="book0")}, {_REFINE.format(name="book1", book="book0", assigned="near0")},
{_ASSIGN.format(name="near1", book="book1")}, {_REFINE.format(name="book2", book="book1", assigned="near1")},
{_ASSIGN.format(name="near2", book="book2")},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM w JOIN coded USING (r), sha
"""


@query
def op13_conversation_repair(spark, sf_dir):
    return repair.repair(table(spark, sf_dir, "conversations"))
