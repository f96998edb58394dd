"""WARC derivatives: responses turned into linked metadata and plain-text conversion records.

``responses`` wraps raw pages as WARC/1.1 response records.  ``derive`` reads response
records back and makes, for each, a ``metadata`` record (source HTTP headers, title, language,
links) and a ``conversion`` record (the page's plain text).  Both name the response in
``WARC-Refers-To``, keep its target address and date, and carry the source's payload digest, so
a text can be traced to the bytes it came from.  ``read`` parses records and checks their
lengths and digests.

A record is one value of a binary column; the concatenation of records (each may be
a gzip member of its own) is a WARC file.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space
DATE = "2024-01-01T00:00:00Z"  # of records whose source has no date

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"[^\S\n]+")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _value(text: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; its block digest and length are added to ``headers``."""
    full = [*headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {_value(v)}\r\n" for k, v in full if v)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; ValueError if it is damaged."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0].encode() != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or sha1(block) != headers["warc-block-digest"]:
        raise ValueError("a record's length or digest is wrong")
    return headers, block


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def response(page: str, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """Response record of a page; the same page always gets the same identifier."""
    body = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {_value(page)}\r\n\r\n"
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page, url or "", sha1(body))), ("WARC-Date", date),
        ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", sha1(body)), ("Content-Type", "application/http; msgtype=response"),
    ], http.encode() + body)


def plain_text(html: str) -> str:
    """Visible text of a page: one line per block, blanks collapsed, entities resolved."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", html)))
    lines = (_BLANK.sub(" ", x).strip() for x in entities.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derived(source: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response record."""
    headers, block = parse(source)
    http, _, body = block.partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    title, lang = _TITLE.search(page), _LANG.search(page)
    fields = [("source-" + k, v) for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])]
    fields += [("title", " ".join(entities.unescape(title[1]).split()))] if title else []
    fields += [("language", lang[1])] if lang else []
    fields += [("outlink", entities.unescape(next(g for g in m.groups() if g is not None))) for m in _LINK.finditer(page)]
    shared = [("WARC-Refers-To", headers["warc-record-id"]), ("WARC-Target-URI", headers.get("warc-target-uri", "")),
              ("WARC-Date", headers["warc-date"]), ("X-Source-Payload-Digest", headers["warc-payload-digest"])]
    text = plain_text(page).encode()
    about = "".join(f"{k}: {_value(v)}\r\n" for k, v in fields).encode()
    meta = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", headers["warc-record-id"])), *shared,
                   ("Content-Type", "application/warc-fields")], about)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", record_id("conversion", headers["warc-record-id"])), *shared,
                         ("WARC-Payload-Digest", sha1(text)), ("Content-Type", "text/plain; charset=utf-8")], text)
    return meta, conversion


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, record``: a response record for every row.

    Null html is an empty body, a null address leaves the header out, a null id counts as the
    text ``null``.  Equal rows give equal records.  Other columns are not read."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [response("null" if p is None else str(p), u, h) for p, u, h in
                    zip(batch.column("id").to_pylist(), batch.column("u").to_pylist(), batch.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], names=["id", "record"])

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, record binary")


def derive(records: DataFrame) -> DataFrame:
    """``id, record``: every response record followed by its metadata and its conversion record."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [r for source in batch.column("record").to_pylist() for r in (source, *derived(source))]
            ids = batch.column("id").take(pa.array([k for k in range(batch.num_rows) for _ in range(3)], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=["id", "record"])

    return records.select("id", "record").mapInArrow(run, records.select("id", "record").schema)


def read(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """What parsing each record gives: ``id_col, warc_type, record_id, refers_to, target_uri,
    warc_date, payload_digest, source_digest, block_length, block_sha256, n_links, title``."""
    names = ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest", "source_digest",
             "block_length", "block_sha256", "n_links", "title"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for data in batch.column("record").to_pylist():
                h, block = parse(data)
                fields = block.decode().split("\r\n") if h["warc-type"] == "metadata" else []
                rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"],
                             h.get("warc-payload-digest"), h.get("x-source-payload-digest"), len(block), hashlib.sha256(block).hexdigest(),
                             sum(f.startswith("outlink: ") for f in fields), next((f[7:] for f in fields if f.startswith("title: ")), None)))
            kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["id", *names])

    kind = records.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} {'long' if n in ('block_length', 'n_links') else 'string'}" for n in names)
    return records.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def warc_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, record``: response, metadata and conversion record of every page.  An empty table gives an empty result."""
    return derive(responses(pages, id_col, url_col, html_col))
