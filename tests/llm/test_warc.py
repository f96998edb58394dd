import hashlib

import pytest

from citeweave.llm import queries, warc

SF = "/root/testdata/sf0.001"


def test_records_round_trip():
    source = warc.response("5", "http://a/b\r\nX-Evil: 1", "<html lang='de'><title>A &amp; B</title><p>x<b>y</b><br>z<!-- c --><script>q</script><a href='/l?a=1&amp;b=2'>l</a>")
    headers, block = warc.parse(source)
    assert "x-evil" not in headers and block.endswith(b"l</a>")
    meta, conversion = map(warc.parse, warc.derived(source))
    assert meta[0]["warc-refers-to"] == conversion[0]["warc-refers-to"] == headers["warc-record-id"]
    assert meta[0]["x-source-payload-digest"] == headers["warc-payload-digest"]
    assert conversion[1].decode() == "xy\nz l"
    fields = meta[1].decode().split("\r\n")
    assert "title: A & B" in fields and "language: de" in fields and "outlink: /l?a=1&b=2" in fields and "source-X-Page-Id: 5" in fields
    for damaged in (source[:-1], source.replace(b"<b>", b"<i>"), b"x" + source):
        with pytest.raises(ValueError):
            warc.parse(damaged)


def test_query(spark):
    rows = queries.QUERIES["op9_warc"](spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == 3 * len(pages)
    by = {(r.page_id, r.warc_type): r for r in rows}
    for i, page in pages.items():
        source, meta, text = (by[i, k] for k in ("response", "metadata", "conversion"))
        assert meta.refers_to == text.refers_to == source.record_id and source.refers_to is None
        assert source.payload_digest == meta.source_digest == text.source_digest == warc.sha1(page.html.encode())
        assert text.block_sha256 == hashlib.sha256(warc.plain_text(page.html).encode()).hexdigest()
        assert {r.target_uri for r in (source, meta, text)} == {page.url}
        assert meta.n_links == page.html.count("<a href=")


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "", "", "x"), (1, "", "", "x"), (2, "u", "<p>" * 100_000 + "<b", "x"), (3, "u", "plain & < text", "x")],
                                  "page_id long, url string, html string, record string")
    rows = warc.read(warc.warc_derivatives(pages)).collect()
    assert len(rows) == 15 and len({r.record_id for r in rows}) == 12
    assert {r.block_length for r in rows if r.warc_type == "conversion" and r.page_id in (None, 1)} == {0}
    assert warc.read(warc.warc_derivatives(pages.limit(0))).collect() == []
