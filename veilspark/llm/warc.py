"""WARC derivatives: metadata and plain-text records from responses.

A response record gives two new ones that refer to it: a ``metadata`` record (a JSON digest of the source's WARC and
HTTP headers, the title and the links) and a ``conversion`` record (the page's visible text). Each keeps the source's
target, date, digests and identifier (WARC-Refers-To and its companions) and has a digest of its own.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size

VERSION = "WARC/1.1"
EPOCH = "2024-01-01T00:00:00Z"
#: What no reader sees. A head may lack its end: it is over where the body, or the first thing that only a body has, begins.
UNREAD = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
HEAD = re.compile(r"<head\b[^>]*>.*?(?=</head\s*>|<body\b|<(?:address|article|aside|blockquote|div|dl|footer|form|h[1-6]|header|hr|img|main|nav|ol|p|pre|section|span|table|ul|a|b|i)\b|$)", re.S | re.I)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|$)")
BLANK = re.compile(r"[ \t\r\f\v ]+")
ATTRIBUTE = r"(?:[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|/)"
LINK = re.compile(rf"<a(?:\s+(?!href\s*=){ATTRIBUTE})*\s+href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    return " ".join(value.split())


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """A record's headers, continued lines joined, and its block."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
        else:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    length = int(dict((k.lower(), v) for k, v in headers).get("content-length", "0"))
    if length > len(rest):
        raise ValueError("a record ends early")
    return headers, rest[:length]


def response(key: object, url: str | None, page: str | None, date: str = EPOCH) -> bytes:
    """The response record of a stored page; its identifier follows from key, address and content, so reruns agree."""
    body = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {url} {hashlib.sha1(body).hexdigest()}")
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", url or ""), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(block))],
        block,
    )


def visible(page: str) -> str:
    """The text a reader sees: a line for each block, runs of blanks as one, no empty lines."""
    text = html.unescape(TAG.sub("", BREAK.sub("\n", HEAD.sub("\n", UNREAD.sub("\n", page)))))
    return "\n".join(line for line in (BLANK.sub(" ", x).strip() for x in text.split("\n")) if line)


def links(page: str, base: str) -> list[str]:
    """The targets of the page's ``a`` elements; what stands in comments, scripts and the like is none."""
    out = []
    for m in LINK.finditer(UNREAD.sub("\n", page)):
        target = html.unescape(next((g for g in m.groups() if g is not None), "")).strip()
        if not target:
            continue
        try:
            out.append(urljoin(base, target))
        except ValueError:
            out.append(target)
    return out


def payload(head: list[list[str]], body: bytes) -> bytes:
    """The body without its transfer and content encodings: chunks, gzip and deflate; left as it is if it doesn't hold what it says."""
    named = {k.lower(): v.lower() for k, v in head}
    try:
        if "chunked" in named.get("transfer-encoding", ""):
            rest, parts = body, []
            while rest:
                size, _, rest = rest.partition(b"\r\n")
                n = int(size.split(b";")[0], 16)
                if not n:
                    break
                parts.append(rest[:n])
                rest = rest[n + 2 :]
            body = b"".join(parts)
        for kind in reversed([x.strip() for x in named.get("content-encoding", "").split(",")]):
            if kind in ("gzip", "x-gzip", "deflate"):
                try:
                    body = zlib.decompress(body, 47)
                except zlib.error:
                    body = zlib.decompress(body, -15)
    except (ValueError, zlib.error):
        return body
    return body


def decoded(head: list[list[str]], body: bytes) -> str:
    """The page as text: by the header's charset, else one named near the page's beginning, else UTF-8."""
    said = next((v.encode("utf-8", "replace") for k, v in head if k.lower() == "content-type"), b"")
    name = CHARSET.search(said) or CHARSET.search(body[:1024])
    try:
        codec = codecs.lookup(name[1].decode("ascii")).name if name else "utf-8"
        # The web's rule: these labels mean Windows-1252.
        return body.decode("cp1252" if codec in ("iso8859-1", "ascii") else codec, "replace")
    except (LookupError, UnicodeDecodeError):
        return body.decode("utf-8", "replace")


def derive(data: bytes) -> list[tuple[str, dict[str, str], bytes, bytes]]:
    """(type, headers, block, whole record) of the two derivatives of a response; none of a record of another type, or of bytes that are no whole record."""
    try:
        source, block = parse(data)
    except ValueError:
        return []
    own = {k.lower(): v for k, v in source}
    if own.get("warc-type") != "response":
        return []
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, body = b"", block
    status, *http = head.decode("utf-8", "replace").split("\r\n")
    named = [[k.strip(), v.strip()] for k, _, v in (h.partition(":") for h in http)]
    page, at = decoded(named, payload(named, body)), own.get("warc-target-uri", "")
    title = TITLE.search(page)
    digest = {
        "source": source,
        "http": {"status": status, "headers": named},
        "title": BLANK.sub(" ", html.unescape(title[1])).strip() if title else None,
        "links": links(page, at),
    }
    refers = own.get("warc-record-id", "")
    out = []
    for kind, content, made in (("metadata", "application/json", json.dumps(digest, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", visible(page).encode("utf-8", "replace"))):
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers + kind)}>"),
            ("WARC-Refers-To", refers),
            ("WARC-Refers-To-Target-URI", at),
            ("WARC-Refers-To-Date", own.get("warc-date", "")),
            ("WARC-Target-URI", at),
            ("WARC-Date", own.get("warc-date", "")),
            ("WARC-Source-Payload-Digest", own.get("warc-payload-digest", "")),
            ("Content-Type", content),
            ("WARC-Block-Digest", sha1(made)),
        ]
        out.append((kind, dict(headers), made, record(headers, made)))
    return out


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, warc): the response record of each page (page_id, url, html). A null address or page counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 2):
            rows = [response(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["page_id", "warc"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, warc binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response of ``records`` (page_id, warc), none for other records.

    (page_id, record_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length, n_links, warc).
    Repeated rows give repeated records with the same identifiers; a null record, and bytes that aren't a whole record, give
    none, an empty page an empty text.
    """
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "n_links", "warc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 1):
            rows = []
            for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for kind, h, block, whole in derive(data) if data is not None else ():
                    n = len(json.loads(block)["links"]) if kind == "metadata" else None
                    rows.append((key, kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Source-Payload-Digest"], h["WARC-Block-Digest"], len(block), n, whole))
            kinds = (pa.int64(), *[pa.string()] * 6, pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return records.select("page_id", "warc").mapInArrow(run, "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, n_links long, warc binary")
