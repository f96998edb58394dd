import zlib

import numpy as np

from citeweave.llm import language_id, queries


def test_slopes_match_differences():
    net, rng = language_id.Network.fresh(["a", "b", "c"]), np.random.default_rng(0)
    codes, valid, y = rng.integers(0, 256, (7, 5)), np.ones((7, 5), np.float32), rng.integers(0, 3, 5)
    valid[5:, 1], codes[5:, 1] = 0, language_id.PAD
    slopes = net.slopes(codes, valid, y)[1]
    for part, slope in zip(net.parts(), slopes):
        for _ in range(8):
            i = (rng.integers(part.shape[0]), int(codes[rng.integers(5), rng.integers(5)]) if part.shape[1] == 257 else rng.integers(part.shape[1]))
            old = part[i]
            part[i] = old + 0.01
            up = net.slopes(codes, valid, y)[0]
            part[i] = old - 0.01
            down = net.slopes(codes, valid, y)[0]
            part[i] = old
            assert abs((up - down) / 0.02 - slope[i]) < 1e-4


def test_windows_cover_every_byte_once():
    net = language_id.Network.fresh(["a", "b"])
    texts = [b"x" * n for n in (1, 5, 95, 96, 97, 191, 192, 193, 1000)]
    p = net.documents(texts)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    one = net.documents([t for t in texts if len(t) > 96][:1])
    assert np.allclose(one, p[4:5], atol=1e-5)


def test_query_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(rows) == {d.doc_id for d in docs}
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]
    assert np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in rows.values())


def test_odd_rows(odd_docs, no_docs):
    rows = language_id.language_id(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 10, None} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language_id.language_id(no_docs).collect() == []
    assert not language_id.has_letter("²½ 12 _".encode()) and language_id.has_letter("12 é".encode())


def test_the_sample_is_bounded_when_one_id_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANG", 20)
    hot = [(1, f"the hot text number {i}", "en") for i in range(900)]
    docs = spark.createDataFrame(hot + hot[:1] * 300 + [(i, f"un texte {i}", "fr") for i in range(2, 60)], "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs, "doc_id", "text", "lang")
    by = {lang: sum(y == lang for _, y in sample) for lang in ("en", "fr")}
    assert by == {"en": 20 * language_id.PIECES, "fr": 20 * language_id.PIECES}
    assert sample == language_id.training_sample(docs.repartition(7), "doc_id", "text", "lang")
