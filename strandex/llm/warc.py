"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A derivative refers to its response by WARC-Refers-To and keeps its target URI and date. The metadata record's
block (application/warc-fields) holds the response's own WARC headers, its HTTP status and headers, its
block and payload digests, and what the page says of itself; the conversion record's block is the
page's text in UTF-8, with the source's payload digest beside the digest of the text. Identifiers are name-based, so the
same response always gives the same derivatives. Chunked and compressed bodies are decoded first; what isn't text, or is
encoded in a way not known here, has no conversion record. Rows are independent; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

CRLF = "\r\n"
#: The date of records made from tables, which have none.
DATE = "1970-01-01T00:00:00Z"

#: Elements whose content is no text, and those that end a line.
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select")
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead title tr ul".split()
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(HIDDEN) + r""")\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9]*)(?:"[^"]*"|'[^']*'|[^'">])*+>""",
    re.S | re.I,
)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z-]+)""", re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """The visible text: one line for each block, single spaces, character references read."""
    text = _MARKUP.sub(lambda m: "\n" if m[2] and m[2].lower() in BLOCKS else " " if m[1] else "", page)
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def make_record(kind: str, ident: str, headers: list[tuple[str, str | None]], content_type: str, block: bytes) -> bytes:
    """A WARC/1.0 record without the two line ends that follow it; headers without a value are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_line(v)}{CRLF}" for k, v in head if v is not None)
    return f"WARC/1.0{CRLF}{lines}{CRLF}".encode() + block


def _line(value: str) -> str:
    return " ".join(value.split("\n")).replace("\r", " ")


def split_head(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, header fields (folded ones joined) and the rest of an HTTP message or WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split(CRLF)
    fields: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and fields:
            fields[-1] = fields[-1][0], f"{fields[-1][1]} {x.strip()}"
        elif ":" in x:
            k, _, v = x.partition(":")
            fields.append((k.strip(), v.strip()))
    return first, fields, rest


def parse_records(data: bytes) -> Iterator[bytes]:
    """Each record of a WARC file, without the two line ends after it. Compressed members are opened one at a time."""
    for part in _members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                break
            _, fields, _ = split_head(part[at : end + 4])
            size = next((int(v) for k, v in fields if k.lower() == "content-length" and v.isdigit()), 0)
            yield part[at : end + 4 + size]
            at = end + 4 + size


def _members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of each gzip member; a broken one ends the file."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        try:
            while at < len(view) and not d.eof:
                out.append(d.decompress(view[at : at + step]))
                at += step
        except zlib.error:
            return
        at = min(at, len(view)) - len(d.unused_data)
        yield b"".join(out)


def decoded_body(http: list[tuple[str, str]], body: bytes) -> bytes | None:
    """An HTTP body without its transfer and content encodings; None if they are not known or broken."""
    head = {k.lower(): v.lower() for k, v in http}
    try:
        for name in ("transfer-encoding", "content-encoding"):
            for kind in reversed([x.strip() for x in head.get(name, "").split(",")]):
                if kind == "chunked":
                    body = _dechunked(body)
                elif kind in ("gzip", "x-gzip", "deflate"):
                    raw = kind == "deflate" and (len(body) < 2 or body[0] & 15 != 8 or (body[0] * 256 + body[1]) % 31)
                    body = zlib.decompressobj(-15 if raw else 47).decompress(body)
                elif kind not in ("", "identity"):
                    return None
    except (zlib.error, ValueError):
        return None
    return body


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def is_text(http: list[tuple[str, str]]) -> bool:
    """Whether a body is text by its content type; without one it is."""
    kind = next((v.lower().partition(";")[0].strip() for k, v in http if k.lower() == "content-type"), "")
    return not kind or kind.startswith("text/") or any(x in kind for x in ("html", "xml", "json", "javascript"))


def response(page_id: object, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A page of a table as a response record."""
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(body)}{CRLF}{CRLF}".encode() + body
    headers = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(body))]
    return make_record("response", record_id("response", str(page_id), url or ""), headers, "application/http; msgtype=response", block)


def derive(record: bytes) -> list[tuple[str, bytes]]:
    """The (type, record) of each derivative of a response record; none for other records.

    A response without an identifier or digests gets them from its content. Digests are of the body as it was sent.
    """
    _, fields, block = split_head(record)
    warc = {k.lower(): v for k, v in fields}
    if warc.get("warc-type") != "response":
        return []
    status, http, body = split_head(block)
    source, uri, date = warc.get("warc-record-id") or record_id("response", digest(block)), warc.get("warc-target-uri"), warc.get("warc-date", DATE)
    charset = next((m[1] for k, v in http if k.lower() == "content-type" and (m := _CHARSET.search(v))), "utf-8")
    plain = decoded_body(http, body) if is_text(http) else None
    try:
        page = (plain or b"").decode(charset, "replace")
    except LookupError:
        page = (plain or b"").decode("utf-8", "replace")
    payload = warc.get("warc-payload-digest") or digest(body)
    title, lang = _TITLE.search(page), _LANG.search(page)
    notes = [
        *((f"source-{k}", v) for k, v in fields),
        ("source-computed-block-digest", digest(block)),
        ("source-computed-payload-digest", digest(body)),
        ("http-status-line", status),
        *((f"http-{k}", v) for k, v in http),
        ("title", " ".join(html.unescape(title[1]).split()) if title else None),
        ("html-lang", lang[1] if lang else None),
        *(("outlink", html.unescape(next(x for x in m if x is not None))) for m in (g.groups() for g in _LINK.finditer(page))),
    ]
    meta = "".join(f"{k}: {_line(v)}{CRLF}" for k, v in notes if v is not None).encode("utf-8", "replace")
    linked = [("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    out = [("metadata", make_record("metadata", record_id("metadata", source), linked, "application/warc-fields", meta))]
    if plain is not None:
        text = plain_text(page).encode("utf-8", "replace")
        out.append(("conversion", make_record("conversion", record_id("conversion", source), [*linked, ("WARC-Source-Payload-Digest", payload)], "text/plain; charset=utf-8", text)))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(id, record): each page as a response record. Null pages are empty; a null url is left out."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [response(*x, date) for x in zip(*(b[k].to_pylist() for k in ("id", "url", "html")), strict=True)]
        return pa.RecordBatch.from_arrays([b["id"], pa.array(made, pa.binary())], ["id", "record"])

    return c.mapped(rows, f, f"id {rows.schema['id'].dataType.simpleString()}, record binary")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(id, record) of WARC files, plain or compressed record by record; id is the place in the file. A task holds one file as
    it is stored, and one record opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                part: list[tuple[str, bytes]] = []
                for n, r in enumerate(parse_records(data)):
                    part.append((f"{path}#{n}", r))
                    if len(part) == c.BATCH_ROWS:
                        yield batch(part)
                        part = []
                if part:
                    yield batch(part)

    def batch(part: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part], pa.binary())], ["id", "record"])

    c.tune(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "id string, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """(id, record_type, record_id, refers_to, target_uri, block_digest, source_payload_digest, content_length, record).

    Takes rows (id, record); two rows for each response, the metadata alone if its body is no text or can't be decoded,
    none for other records or null ones. Ids don't matter: a null id and repeated rows get their own; an empty table gives
    none. source_payload_digest is the one the response states, or else the computed one.
    """
    kind = records.schema["id"].dataType.simpleString()

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for i, record in enumerate(b["record"].to_pylist()):
            made = derive(record) if record else []
            if made:
                _, fields, block = split_head(record)
                payload = {k.lower(): v for k, v in fields}.get("warc-payload-digest") or digest(split_head(block)[2])
            for what, r in made:
                _, fields, _ = split_head(r)
                head = dict(fields)
                at.append(i)
                out.append((what, head["WARC-Record-ID"], head["WARC-Refers-To"], head.get("WARC-Target-URI"), head["WARC-Block-Digest"], payload, int(head["Content-Length"]), r.decode()))
        names = ["record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_payload_digest", "content_length", "record"]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string()]
        cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, pa.int64())), *cols], ["id", *names])

    return c.mapped(records, f, f"id {kind}, record_type string, record_id string, refers_to string, target_uri string, block_digest string, source_payload_digest string, content_length long, record string")


def write_warc(derived: DataFrame, path: str) -> None:
    """Writes the records as WARC files; every record ends with two line ends."""
    derived.select("record").write.option("lineSep", CRLF * 2).text(path)
