import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citeweave.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_matches_the_tokenizer(spark):
    rows = queries.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer, by = Tokenizer.from_file(PATH), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(docs)
    for i, own in by.items():
        ids = np.array(tokenizer.encode(docs[i] or "", add_special_tokens=False).ids + [0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    used, least = check_places(rows), -(-sum(r.length for r in rows) // 2048)
    assert used <= 1.05 * least + 1


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    check_places(rows)
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    assert packing.pack_documents(no_docs, PATH).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 7)) for i in range(60)], "doc_id long, text string")
    placed = packing.pack_documents(docs, PATH, capacity=32, with_ids=True)
    seqs = {r.sequence_id: bytes(r.ids) for r in packing.packed_sequences(placed).collect()}
    for r in placed.collect():
        assert seqs[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048) if seed % 2 else rng.integers(1, 2049, 20_000)
    hist = np.bincount(lengths, minlength=2049)
    rows = packing.plan(hist, 2048)
    assert (np.bincount(rows[:, 0], rows[:, 2], 2049) == hist).all()
    fill = np.zeros(int((rows[:, 3] + rows[:, 2]).max()), np.int64)
    for length, _, repeats, first, offset in sorted(rows.tolist(), key=lambda r: r[4]):
        assert (fill[first : first + repeats] == offset).all()
        fill[first : first + repeats] += length
    assert fill.max() <= 2048
    big = (lengths > 1024).sum()
    assert len(fill) <= 1.02 * max(big, -(-lengths.sum() // 2048)) + 1


def test_word_cache_equals_the_tokenizer():
    ids, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = ["", "It's the  cat’s\tend\n", "a<|endoftext|>b <|start", "é é ﬁ Ǆ x\x1cy\x85z", "日本 語 don't!! 12 3.5", " x 　y"]
    texts += ["WORD!! Éa.., ÉA İx ſa ﬁ. word's, a!b a.b x", "e\u0301\u0301. a\u0301 ß. ẞ. Σίσυφος, don't."]
    for text, own in zip(texts, ids([t.encode() for t in texts])):
        assert np.frombuffer(own, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert ids([None, b""]) == [b"", b""]
