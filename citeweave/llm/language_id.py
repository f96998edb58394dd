"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers (GRU), one from each side, read windows of a text's bytes;
a softmax over both states labels every position, and a document's
probabilities are the mean over all its positions.  The network is small and
written in numpy, forward and backward through time; it is fitted on the driver from
``PER_LANG`` documents of each language, ``PIECES`` short pieces of each.  Scoring runs in
Arrow batches on the executors, over every byte of every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import small_batches, sub_batches, text_bytes

PER_LANG = 400  # documents of a language that the fit may see
PIECES, PIECE_CHARS = 4, 160  # pieces of each of them
HIDDEN = 10  # units in each direction
WIDTH = 96  # bytes in a window when scoring
TRAIN_WIDTH, TRAIN_BATCH, STEPS = 48, 192, 320
ROWS = 2048  # windows scored at a time
PAD = 256
MIN_SCORE = 0.35  # of a document that counts as being in a language
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Layer:
    """One direction.  Rows are ordered reset, update, candidate."""

    inputs: np.ndarray  # (3 hidden, 257): what each byte adds to the gates
    back: np.ndarray  # (3 hidden, hidden): what the last state adds
    bias: np.ndarray  # (hidden, 1): added to the candidate's share of the last state

    def states(self, codes: np.ndarray, valid: np.ndarray | None = None, tape: list | None = None) -> np.ndarray:
        """States after each step, (steps, hidden, rows); ``codes`` is (steps, rows).  Rows
        where ``valid`` is 0 keep a zero state.  ``tape`` gets what ``gradient`` needs."""
        n = len(self.bias)
        out = np.empty((len(codes), n, codes.shape[1]), np.float32)
        h = np.zeros(out.shape[1:], np.float32)
        for t, code in enumerate(codes):
            x = self.inputs.take(code, axis=1)
            a = self.back @ h
            gate = x[: 2 * n]
            gate += a[: 2 * n]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            r, z = gate[:n], gate[n:]
            u = a[2 * n :]
            u += self.bias
            c = x[2 * n :]
            c += r * u
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if valid is not None:
                new *= valid[t]
            if tape is not None:
                tape.append((h, r, z, u.copy(), c))
            h = new
        return out

    def gradient(self, codes: np.ndarray, valid: np.ndarray, tape: list, d_out: np.ndarray) -> "Layer":
        """Backpropagation through time: the loss's slopes in the parameters, from those in the states."""
        n = len(self.bias)
        g = Layer(*(np.zeros_like(x) for x in (self.inputs, self.back, self.bias)))
        later = np.zeros_like(d_out[0])
        steps = np.empty((len(codes), 3 * n, codes.shape[1]), np.float32)
        for t in range(len(codes) - 1, -1, -1):
            h, r, z, u, c = tape[t]
            d = (d_out[t] + later) * valid[t]
            dc = d * (1 - z) * (1 - c * c)
            du = dc * r
            dr = dc * u * r * (1 - r)
            dz = d * (h - c) * z * (1 - z)
            da = np.concatenate((dr, dz, du))
            steps[t] = np.concatenate((dr, dz, dc))
            g.back += da @ h.T
            g.bias += du.sum(1, keepdims=True)
            later = d * z + self.back.T @ da
        flat = steps.transpose(1, 0, 2).reshape(3 * n, -1)
        for k in range(3 * n):
            g.inputs[k] = np.bincount(codes.ravel(), flat[k], self.inputs.shape[1])
        return g

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.back, self.bias]


@dataclass
class Network:
    langs: list[str]
    ahead: Layer
    behind: Layer
    head: np.ndarray  # (languages, 2 hidden)
    prior: np.ndarray  # (languages, 1)

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        def layer():
            return Layer(draw(3 * HIDDEN, PAD + 1, scale=0.4), draw(3 * HIDDEN, HIDDEN, scale=0.3), np.zeros((HIDDEN, 1), np.float32))

        return cls(langs, layer(), layer(), draw(len(langs), 2 * HIDDEN, scale=0.3), np.zeros((len(langs), 1), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [*self.ahead.parts(), *self.behind.parts(), self.head, self.prior]

    def positions(self, codes: np.ndarray, valid: np.ndarray | None = None, tapes: tuple | None = None):
        """Language probabilities at every position, (steps, languages, rows), and both directions' states."""
        one, two = tapes or (None, None)
        f = self.ahead.states(codes, valid, one)
        b = self.behind.states(codes[::-1], None if valid is None else valid[::-1], two)[::-1]
        p = np.matmul(self.head[:, :HIDDEN], f)
        p += np.matmul(self.head[:, HIDDEN:], b)
        p += self.prior
        if np.abs(self.head).sum(1).max() + np.abs(self.prior).max() > 80:  # states lie in [-1, 1]
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p, f, b

    def slopes(self, codes: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over valid positions and its slopes in ``parts()``."""
        tapes = ([], [])
        p, f, b = self.positions(codes, valid, tapes)
        count = valid.sum()
        own = p[:, y, np.arange(len(y))]
        loss = float(-(np.log(own + 1e-9) * valid).sum() / count)
        d = p.copy()
        d[:, y, np.arange(len(y))] -= 1
        d *= (valid / count)[:, None, :]
        d_head = np.concatenate([np.einsum("tlr,thr->lh", d, s) for s in (f, b)], 1)
        d_f = np.matmul(self.head[:, :HIDDEN].T, d)
        d_b = np.matmul(self.head[:, HIDDEN:].T, d)
        ga = self.ahead.gradient(codes, valid, tapes[0], d_f)
        gb = self.behind.gradient(codes[::-1], valid[::-1], tapes[1], d_b[::-1])
        return loss, [*ga.parts(), *gb.parts(), d_head, d.sum((0, 2))[:, None]]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities of whole non-empty texts, (texts, languages)."""
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum(size) - size
        total = np.zeros((len(texts), len(self.langs)))
        steps = np.arange(WIDTH)[:, None]
        # windows that end with their text; the last one reaches back over bytes already counted
        count = np.maximum(1, -(-size // WIDTH))
        doc = np.repeat(np.arange(len(texts)), count)
        at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WIDTH
        back = np.minimum(at, np.maximum(size[doc] - WIDTH, 0))
        short = size[doc] < WIDTH
        for rows in (np.flatnonzero(~short), np.flatnonzero(short)):
            for k in range(0, len(rows), ROWS):
                own = rows[k : k + ROWS]
                place = back[own] + steps
                new = (place >= at[own]) & (place < size[doc[own]])
                some_short = bool(short[own[0]])
                where = first[doc[own]] + np.minimum(place, size[doc[own]] - 1)
                codes = flat[where].astype(np.intp)
                if some_short:
                    codes[place >= size[doc[own]]] = PAD
                valid = (place < size[doc[own]]).astype(np.float32)[:, None, :] if some_short else None
                p = self.positions(codes, valid)[0]
                p *= new[:, None, :]
                np.add.at(total, doc[own], p.sum(0).T)
        return total / size[:, None]


def fit(sample: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Network fitted by Adam on (piece, language) pairs, languages weighing the same; None without any."""
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return None
    net, rng = Network.fresh(langs, seed), np.random.default_rng(seed)
    by = [[np.frombuffer(t, np.uint8) for t, lang in sample if lang == x and t] for x in langs]
    langs_with = [k for k, own in enumerate(by) if own]
    m, v = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()]
    for step in range(1, steps + 1 if len(langs_with) > 1 else 1):
        codes, y = np.full((TRAIN_WIDTH, TRAIN_BATCH), PAD, np.intp), np.zeros(TRAIN_BATCH, np.int64)
        for j in range(TRAIN_BATCH):
            y[j] = langs_with[j % len(langs_with)]
            text = by[y[j]][rng.integers(len(by[y[j]]))]
            a = rng.integers(0, max(1, len(text) - TRAIN_WIDTH + 1))
            text = text[a : a + TRAIN_WIDTH]
            codes[: len(text), j] = text
        valid = (codes != PAD).astype(np.float32)
        _, slopes = net.slopes(codes, valid, y)
        norm = np.sqrt(sum((g * g).sum() for g in slopes))
        for x, g, a, b in zip(net.parts(), slopes, m, v):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
            x -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(id_col: str):
    """crc32(id as text) mod 4 is 2: never learned from.  A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """(piece, language) pairs of at most ``PER_LANG`` rows of each language, those with the lowest id hashes (of
    one id those with the lowest hashes of the pieces), however many rows an id has."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & F.col(id_col).isNotNull())
    rows = known.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    start = [F.lit(1) + F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.lit(1), F.length("t") - PIECE_CHARS)).cast("int") for k in range(PIECES)]
    cut = rows.select("id", "lang", F.array(*[F.col("t").substr(s, F.lit(PIECE_CHARS)) for s in start]).alias("p"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("p"), "p")
    # the rank filter is applied in each task before the shuffle: a common language costs PER_LANG rows of short pieces a task
    picked = cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANG).select("lang", "p").collect()
    return [(t.encode(), r["lang"]) for r in sorted(picked, key=lambda r: (r["lang"], r["p"])) for t in r["p"]]


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text.decode()))


def answers(net: Network | None, texts: list) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    for i, j in sub_batches(texts, 2 << 20):
        known = [k for k in range(i, j) if net and has_letter(texts[k])]
        if known:
            p = net.documents([texts[k] for k in known])
            for k, best, top in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
                lang[k], score[k] = net.langs[best], min(1.0, top)
    return lang, score


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row; see ``language_id``."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score = answers(net, text_bytes(batch, "t"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return small_batches(source).mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that are in some language: not ``und`` and with a
    score of ``min_score`` or more.  Rows pass through their task; nothing shuffles.  Null text and text without a
    letter are in no language; repeated rows share their fate; an empty table gives an empty result."""
    net = fit(training_sample(docs, id_col, text_col, lang_col))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score = answers(net, text_bytes(batch, text_col))
            yield batch.filter(pa.array([x != "und" and s >= min_score for x, s in zip(lang, score)], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``id_col, held_out, lang_pred, score``.

    Learns from text and non-null language of rows that are not held out (rows with null ids
    or empty texts teach nothing); the language, the id and any other column are no inputs
    of a prediction, so equal texts get equal answers.  Null text and text without a letter: ``und``
    with score 0; so is everything if no row teaches.  An empty table gives an empty result."""
    return predict(docs, fit(training_sample(docs, id_col, text_col, lang_col)), id_col, text_col)
