"""Packing token pieces into sequences by patterns fitted with non-negative least squares.

1. ``tokenize_pieces`` turns every document into token ids closed by an end id and
   cuts only documents longer than a sequence.
2. The histogram of piece lengths (at most ``capacity`` numbers) is all that the driver
   sees.  Patterns of one to three lengths that fill a sequence exactly are
   enumerated; non-negative least squares fits how often to use each so that together they
   use up the histogram; the counts are rounded, and what rounding leaves over is packed by
   best fit, largest first, on counts, never on single pieces.
3. Each plan row owns a range of ranks among the pieces of one length.  Ranks come from
   (length, salt) windows of bounded size plus one offset for each (length, salt), so a
   length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import sub_batches, text_bytes
from citeweave.session import Workspace

PARTNERS = 24  # lengths tried as second of three for each first length
STEPS = 400  # of the least-squares iteration
SALT_ROWS = 20_000  # pieces of one length that one window ranks, about
CACHE_WORDS = 1_000_000  # letter runs whose ids a worker remembers
MARKS = b".,;:!?#*$%&|()"  # none of them joins with a letter before it
LAST_LATIN = "\u017f"
BATCH = 12 << 20  # bytes of text handled at a time


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes.

    The tokenizer splits at white space before it merges, so a text's ids are those
    of its words in turn.  It also splits letters from marks and lower-cases, so a word of
    Latin letters with marks behind is looked up by its lower-case letters and by its marks.  New
    letter runs are encoded many at a time: each is one token run that ends with the only token
    of a word's end.  Texts with ``<|`` go to the tokenizer whole,
    as special tokens may hold white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.parts, self.marks = Tokenizer.from_file(path), {}, {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of each run of lower-case letters."""
        out = []
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(some) or stops[-1] != 4 * len(ids):
                out += [self._ids(x.decode()) for x in some]
                continue
            flat, stops = ids.tobytes(), stops.tolist()
            out += [flat[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _table(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each of the words of a batch."""
        parts, marks_ids, table = self.parts, self.marks, {}
        late: list[bytes] = []  # words whose letters are new, with these in lower case and the marks
        for w in words:
            letters = w.rstrip(MARKS)
            if letters.isalpha():  # ASCII only, as these are bytes
                low = letters.lower()
            else:
                text = letters.decode()
                if not text.isalpha() or max(text) > LAST_LATIN or "\u0130" in text:
                    ids = parts.get(w)
                    if ids is None:
                        ids = parts[w] = self._ids(w.decode())
                    table[w] = ids
                    continue
                low = text.lower().encode()
            marks = w[len(letters) :]
            if marks not in marks_ids:
                marks_ids[marks] = self._ids(marks.decode())
            ids = parts.get(low)
            if ids is None:
                late += (w, low, marks)
            else:
                table[w] = ids + marks_ids[marks] if marks else ids
        new = list(set(late[1::3]))
        parts.update(zip(new, self._runs(new)))
        for w, low, marks in zip(late[::3], late[1::3], late[2::3]):
            table[w] = parts[low] + marks_ids[marks]
        return table

    def __call__(self, texts: list) -> list[bytes]:
        """Ids of each text; None counts as empty."""
        for cache in (self.parts, self.marks):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        whole = [bool(t) and b"<|" in t for t in texts]
        split = [[] if w or not t else t.split() for t, w in zip(texts, whole)]
        # the table of a batch is small enough to stay in the processor's cache
        table = self._table(set().union(*split))
        return [self._ids(t.decode()) if w else b"".join([table[x] for x in own]) for t, w, own in zip(texts, whole, split)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder for all tasks of a worker process."""
    return WordIds(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                    capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, ids`` (``ids`` the token
    ids as little-endian 32-bit bytes).  Null text counts as empty and gives the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_ids(tokenizer_path)
        for batch in batches:
            texts = text_bytes(batch, "t")
            for i, j in sub_batches(texts, BATCH):
                row, piece, ids = [], [], []
                for k, own in zip(range(i, j), encode(texts[i:j])):
                    full = own + end
                    cut = [full[a : a + 4 * capacity] for a in range(0, len(full), 4 * capacity)]
                    row += [k] * len(cut)
                    piece += range(len(cut))
                    ids += cut
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()),
                     pa.array([p * capacity for p in piece], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, largest first and 0 for none, that add up to ``capacity``
    and occur in ``hist``: every single and pair, and for each length triples whose second
    is one of ``PARTNERS`` quantiles of the lengths that occur."""
    have = np.flatnonzero(hist)
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 3), np.int64)
    weight = np.cumsum(hist[have])
    second = np.unique(have[np.searchsorted(weight, weight[-1] * (np.arange(PARTNERS) + 0.5) / PARTNERS)])
    rows = [np.array([[capacity, 0, 0]])]
    rows.append(np.stack([have, capacity - have, np.zeros_like(have)], 1))
    first, mid = (x.ravel() for x in np.meshgrid(have, second))
    rows.append(np.stack([first, mid, capacity - first - mid], 1))
    out = np.concatenate(rows)
    out = out[(out >= 0).all(1)]
    out = -np.sort(-out, axis=1)
    known = np.zeros(capacity + 1, bool)
    known[have] = known[0] = True
    return np.unique(out[known[out].all(1)], axis=0)


def fit_repeats(pats: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - hist|^2 (A counts lengths in patterns), by
    accelerated projected gradient steps."""
    if not len(pats):
        return np.zeros(0)
    size = len(hist)

    def uses(x):
        out = np.bincount(pats.ravel(), np.repeat(x, pats.shape[1]), size)
        out[0] = 0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[pats].sum(1)

    v = np.ones(len(pats))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(uses(v))
        top = np.linalg.norm(v)
        v /= top
    target = hist.astype(float)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(uses(y) - target) / (1.05 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of a best-fit packing, largest length first, of ``left[l]`` pieces
    of each length l; equal open sequences are handled as one."""
    open_, done = {}, []  # free space -> [(lengths, repeats)]
    spaces = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        if not length:
            continue
        todo = int(left[length])
        while todo:
            fits = np.flatnonzero(spaces[length:])
            if not len(fits):
                each = capacity // length
                for many, of in ((each, todo // each), (todo % each, 1)):
                    if many and of:
                        free = capacity - many * length
                        open_.setdefault(free, []).append(((length,) * many, of))
                        spaces[free] = True
                break
            free = int(fits[0]) + length
            lengths, repeats = open_[free].pop()
            use = min(repeats, todo)
            if use < repeats:
                open_[free].append((lengths, repeats - use))
            if not open_[free]:
                spaces[free] = False
            open_.setdefault(free - length, []).append((lengths + (length,), use))
            spaces[free - length] = True
            todo -= use
    for own in open_.values():
        done += own
    return done


def plan(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows ``length, first rank, repeats, first sequence, offset``: the pieces of ``length``
    with ranks from ``first rank`` on go one each to ``repeats`` sequences."""
    left = hist.copy()
    left[0] = 0
    pats = patterns(left, capacity)
    x = fit_repeats(pats, left)
    chosen: list[tuple[tuple[int, ...], int]] = []
    for p in np.argsort(-x, kind="stable").tolist():
        want = int(x[p] + 0.5)
        if not want:
            break
        lengths, counts = np.unique(pats[p][pats[p] > 0], return_counts=True)
        want = min(want, int((left[lengths] // counts).min()))
        if want:
            left[lengths] -= want * counts
            chosen.append((tuple(pats[p][pats[p] > 0].tolist()), want))
    chosen += best_fit(left, capacity)
    rank, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, repeats in chosen:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], repeats, sequence, offset))
            rank[length] += repeats
            offset += length
        sequence += repeats
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with ``id, piece, length`` (1 to ``capacity``);
    other columns pass through.  ``pieces`` is read three times: give a stored table."""
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts:
        hist[r["length"]] = r["count"]
    rows = plan(hist, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = (rows[:, 0] << 44) + rows[:, 1]
    salts = 1 + int(hist.max()) // SALT_ROWS
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    per = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("id", "piece")) - 1
    ranked = salted.withColumn("_own", own).join(before, ["length", "_salt"]) \
        .withColumn("_rank", F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before")
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            rest = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], names=schema.names)

    return ranked.mapInArrow(place, schema)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the token bytes of each sequence, pieces in order
    (a sequence is bounded by the capacity)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids`` if asked for).

    Null and empty texts are one piece, the end id.  Null ids and repeated rows are
    documents of their own; which of two equal rows gets which place does not matter.
    Documents over ``capacity`` tokens are cut into full pieces and a last, shorter one.  Other
    columns are not read.  An empty table gives an empty result."""
    ws = Workspace(docs.sparkSession, "packing")
    pieces = tokenize_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    pieces = ws.keep(pieces if with_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
