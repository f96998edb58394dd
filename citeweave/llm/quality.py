"""Quality rules: base counts and a hashed n-gram logistic regression.

The model is fitted on the driver from at most ``2 * SAMPLE`` labelled rows
(``SAMPLE`` of each label, lowest id hashes first); features of those rows are
made by the same Arrow code that scores.  Features are frequencies of hashed byte
n-grams (2 to 4 bytes, case kept) and of hashed words and word pairs (ASCII lower case), so
a document's score is the mean of n-gram weights over its whole text, whatever its
length.  A quarter of the sample is held back from the fit and calibrates the score
(Platt scaling).  Every text is then scored in Arrow batches against one fixed threshold.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import text_bytes, text_key

SAMPLE = 800  # labelled rows of each label that the model may see
BITS = 15  # of the hashed feature space
CHARS = (2, 3, 4)
BLOCK = 1 << 18  # bytes whose n-grams are hashed at a time; n-grams do not cross blocks
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))  # wraps around 2^64
THRESHOLD = 0.3  # a document goes when poor quality is over twice as likely as good
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8 ``text``."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = len(b"".join(words).decode())
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    three = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(three)) < len(three):
        often = Counter(three)
        last = 0  # words before this one are counted
        for i, w in enumerate(three):
            if often[w] > 1:
                repeated += i + 3 - max(last, i)
                last = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _blocks(text: bytes):
    """``text`` in pieces of about ``BLOCK`` bytes, cut after white space where there is any."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        if end < len(text) and (cut := max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))) > at:
            end = cut + 1
        yield text[at:end]
        at = end


def features(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the byte n-grams and of the words and word pairs of a block."""
    shift = np.uint64(64 - BITS)
    b = np.frombuffer(block, np.uint8).astype(np.uint64)
    code, chars = b.copy(), []
    for n in range(2, max(CHARS) + 1):
        code = (code[:-1] << np.uint64(8)) | b[n - 1 :]
        if n in CHARS:
            chars.append(((code + np.uint64(n << 40)) * MIX) >> shift)
    low = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    begins = ~space & np.concatenate(([True], space[:-1]))
    start = np.flatnonzero(begins)
    words = np.zeros(0, np.uint64)
    if len(start):
        # polynomial hash of each word
        place = np.arange(len(b)) - start[np.maximum(np.cumsum(begins) - 1, 0)]
        value = np.where(space, np.uint64(0), (low + np.uint64(1)) * POWERS[np.clip(place, 0, len(POWERS) - 1)])
        words = np.add.reduceat(value, start)
    pairs = words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:] + np.uint64(7)
    return np.concatenate(chars), np.concatenate((words * MIX >> shift, pairs * MIX >> shift))


@dataclass
class Model:
    chars: np.ndarray  # weight of each byte n-gram feature
    words: np.ndarray  # weight of each word feature
    bias: float
    slope: float = 1.0  # calibration: probability = sigmoid(slope * score + offset)
    offset: float = 0.0

    def score(self, text: bytes | None) -> float:
        total, count = np.zeros(2), np.zeros(2)
        for block in _blocks(text or b""):
            for k, (f, w) in enumerate(zip(features(block), (self.chars, self.words))):
                total[k] += w[f].sum()
                count[k] += len(f)
        return float((total / np.maximum(count, 1)).sum() + self.bias)

    def probability(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.score(text) + self.offset, -30, 30))))


def _frequencies(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (words after byte n-grams) and frequencies of a whole text."""
    sums = np.zeros((2, 1 << BITS), np.int64)
    for block in _blocks(text or b""):
        for k, f in enumerate(features(block)):
            sums[k] += np.bincount(f.astype(np.int64), minlength=1 << BITS)
    freq = (sums / np.maximum(sums.sum(1, keepdims=True), 1)).ravel()
    at = np.flatnonzero(freq)
    return at.astype(np.int32), freq[at].astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``y, held, at, freq`` of at most ``SAMPLE`` labelled documents of each label (``at`` and ``freq``
    are the bytes of what ``_frequencies`` gives), however many rows an id has: rows that repeat id and
    text are one document.  Ids with a null label or with both labels are not used."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")

    def lowest(rows: DataFrame, *order) -> DataFrame:
        return functools.reduce(DataFrame.union, [rows.where(F.col("y") == y).orderBy(*order).limit(SAMPLE) for y in (0, 1)])

    # the lowest ids, then of their documents the lowest: both tables are bounded by SAMPLE
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), text_key(text_col).alias("key"))
    own = source.select("id", "key").join(F.broadcast(lowest(known, F.xxhash64("id"), "id")), "id").distinct()
    picked = lowest(own, F.xxhash64("id"), "id", "key")
    # combined in each task, so a document repeated many times costs one text a task
    rows = source.join(F.broadcast(picked), ["id", "key"]).groupBy("id", "key").agg(F.first("t").alias("t"), F.first("y").alias("y"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [_frequencies(t) for t in text_bytes(batch, "t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("held"), *(pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1))],
                names=["y", "held", "at", "freq"])

    held = (F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(4)) == 0).alias("held")
    return rows.select("t", "y", held).mapInArrow(run, "y int, held boolean, at binary, freq binary")


def fit(sample: list, steps: int = 100, decay: float = 1e-5) -> Model:
    """Logistic regression by Adam on the rows not held back, then Platt scaling on the rest.
    With a label missing the model has no say: it passes everything."""
    size = 2 << BITS
    y = np.array([r["y"] for r in sample], float)
    held = np.array([r["held"] for r in sample], bool)
    if len(set(y[~held])) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 10.0)
    at = np.frombuffer(b"".join(r["at"] for r in sample), np.int32).astype(np.intp)
    row = np.repeat(np.arange(len(sample)), [len(r["at"]) // 4 for r in sample])
    # frequencies are small: the square root of the mean frequency evens out their scales
    freq = np.frombuffer(b"".join(r["freq"] for r in sample), np.float32)
    scale = (1 / np.sqrt(np.bincount(at, freq, size) / len(sample) + 1e-6)).astype(np.float32)
    value = (freq * scale[at]).astype(float)
    weight = np.where(held, 0, np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())))
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[at], len(sample)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.append(np.bincount(at, value * g[row], size) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = np.bincount(row, value * w[at], len(sample)) + b
    slope, offset = platt(z[held], y[held]) if len(set(y[held])) == 2 else (1.0, 0.0)
    w = w * scale
    return Model(w[: 1 << BITS], w[1 << BITS :], float(b), slope, offset)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of sigmoid(slope * z + offset) by Newton steps, with Platt's
    smoothed targets, both labels weighing the same."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    spread = z.std() or 1.0
    x, a = np.stack([z / spread, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-4 * a * [1, 0]
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-6])
        a = a - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(max(a[0], 1e-3) / spread), float(a[1])


def quality_filter(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, probability``.

    Words are runs without ASCII white space; null text has none.  ``base_failed``: fewer than
    ``MIN_WORDS`` words, or over ``REPEAT_PERCENT`` percent of them in repeated 3-word windows.
    ``kept``: not ``base_failed`` and a calibrated probability of good quality of
    ``threshold`` or more.  Null ids and repeated rows are answered like any other row; other
    columns are not read; an empty table gives an empty result."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch, "t")
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
            prob = np.array([model.probability(t) for t in texts], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed),
                 pa.array(~failed & (prob >= threshold)), pa.array(prob)], names=names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["id", *longs, "base_failed", "kept", "probability"]
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean, probability double"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Fits the model on labelled rows (see ``labelled``) and applies ``quality_filter`` to all."""
    return quality_filter(docs, fit(labelled(docs, labels, id_col, text_col, label_col).collect()), id_col, text_col, threshold)
