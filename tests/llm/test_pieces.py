import public_tokenizers
import pytest

from citeweave.llm import pieces, queries
from citeweave.session import Workspace

SF = "/root/testdata/sf0.001"
TRAPS = ["", None, "a", " ", "  two  spaces ", "line\nbreak\n\n", "tab\tand▁mark", "日本語 😀!", "(x).com's 1234 ###", "é" * 450, "x" * 1000, " " * 40 + "end"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def brute_ids(text, v):
    """Viterbi over the whole text at once, without units."""
    if not text:
        return []
    text = " " + text
    table = {p: (c, i) for p, c, i in v.rows}
    best = [(0, 0, None)]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - v.longest), end):
            if (hit := table.get(text[start:end])) is not None:
                options.append((best[start][0] + hit[0], start, hit[1]))
            elif end - start == 1:
                options.append((best[start][0] + pieces.BYTE_COST, start, 0))
        best.append(min(options))
    path, at = [], len(text)
    while at:
        _, start, i = best[at]
        path.insert(0, [i] if i else [v.byte_ids[b] for b in text[start:at].encode()])
        at = start
    return [i for part in path for i in part]


def test_ids_match_brute_force_and_round_trip(spark, vocabulary):
    texts = TRAPS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = pieces.documents(pieces.encode(docs, vocabulary, Workspace(spark, "test-pieces")))
    rows = {r.id: r for r in pieces.decode(encoded, vocabulary).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        if not text or len(text) < 5000 and " " * pieces.SPACES not in text and max(map(len, text.split(" "))) <= pieces.UNIT_CHARS:
            assert list(rows[i].ids) == brute_ids(text, vocabulary), text
        assert rows[i].decoded == (text or "")


def test_query_matches_the_encoded_documents(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "FREQUENT", 50)  # most units take the join (none but the most frequent class or two is shared)
    rows = {r.doc_id: r for r in queries.QUERIES["op2_sentencepiece"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = {r.id: r for r in pieces.documents(pieces.encode(docs, vocabulary, Workspace(spark, "test-pieces"))).collect()}
    assert set(rows) == set(full) and all(rows[i].n_pieces == len(full[i].ids) for i in rows)
    monkeypatch.setattr(pieces, "FREQUENT", 1 << 18)  # all units are broadcast: the same answer
    assert {r.doc_id: r for r in queries.QUERIES["op2_sentencepiece"](spark, SF).collect()} == rows


def test_query_encodes_and_decodes_whole_documents(spark, vocabulary):
    import hashlib

    rows = queries.QUERIES["op2_sentencepiece"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    full = {r.id: r.ids for r in pieces.documents(pieces.encode(spark.read.parquet(f"{SF}/documents.parquet"), vocabulary, Workspace(spark, "test-pieces"))).collect()}
    sha = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    assert len(rows) == len(docs) and all(r.round_trip for r in rows)
    for r in rows:
        assert r.decoded_sha256 == sha(docs[r.doc_id]) and r.ids_digest == sha(",".join(map(str, full[r.doc_id])))


def test_digest_tells_every_swap_and_odd_texts_come_back(spark, vocabulary, odd_docs):
    """Two units swapped at places 4,096 apart or any other way give another digest; traps round-trip."""
    words = [f"w{k}" for k in range(300)]
    swapped = [" ".join(words[:a] + [words[b]] + words[a + 1 : b] + [words[a]] + words[b + 1 :]) for a in range(0, 290, 7) for b in (a + 1, 299)]
    docs = spark.createDataFrame(list(enumerate([" ".join(words)] + sorted(set(swapped)))), "doc_id long, text string")
    rows = pieces.encoding_digest(docs, vocabulary, Workspace(spark, "test-pieces")).collect()
    assert len({r.ids_digest for r in rows}) == len(rows) == docs.count() and all(r.round_trip for r in rows)
    traps = spark.createDataFrame(list(enumerate(TRAPS)), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    rows = pieces.encoding_digest(traps, vocabulary, Workspace(spark, "test-pieces")).collect()
    assert len(rows) == traps.distinct().count() and all(r.round_trip for r in rows)


def test_digest_tells_order_and_counts_repeats_once(spark, vocabulary):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a c b"), (None, "a b c"), (3, None), (3, None), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pieces.encoding_digest(docs, vocabulary, Workspace(spark, "test-pieces")).collect()}
    assert len(rows) == 5 and rows[1].ids_digest == rows[None].ids_digest != rows[2].ids_digest
    assert (rows[1].n_units, rows[1].n_pieces, rows[3].n_pieces, rows[4].n_units) == (3, 3, 0, 0)


def test_odd_rows(odd_docs, no_docs, spark, vocabulary):
    ws = Workspace(spark, "test-pieces")
    assert pieces.encoding_digest(odd_docs, vocabulary, ws).count() == odd_docs.select("doc_id", "text").distinct().count()
    assert pieces.encoding_digest(no_docs, vocabulary, Workspace(spark, "test-pieces")).collect() == []
