"""WARC derivative builder: linked metadata and plain-text conversion records of HTTP responses.

For every response two records are made, both naming the response in ``WARC-Refers-To``, with its URI,
date and digests carried over. The table links them to each other in ``concurrent_to``; of the records'
headers only the metadata's has ``WARC-Concurrent-To``, which the format does not allow on conversions:

* ``metadata`` (application/warc-fields): source headers, digests, title, charset and outlinks;
* ``conversion`` (text/plain): the visible text, a line for each block element.

The table ``pages`` has no HTTP or record headers: its responses are all dated ``DATE``, and their ids
are made from their URLs and contents. Record ids are name-based, so a task that is run again writes the
same records. Digests are SHA-1 in
base 32, as WARC files use. Rows hold bounded data (one page); there is no shuffle at all.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm.common import column, map_texts, ship

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
DATE = "1970-01-01T00:00:00Z"
_HIDDEN = "script|style|noscript|template|title|textarea|iframe|svg"
_BLOCK = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video".split())
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_CHARSET = re.compile(r"<meta\b[^>]*?charset\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[ \t\r\f\v ]+")


def plain_text(page: str, url: str | None) -> tuple[str, list[str], str, str]:
    """Visible text, outlinks (in order, each once, absolute where the URL is known), title, charset."""
    links: dict[str, None] = {}

    def tag(m: re.Match) -> str:
        name = m[2]
        if name is None:
            return "\n" if m[1] else ""
        name = name.lower()
        if name == "a" and m[3] and (h := _HREF.search(m[3])):
            href = html.unescape(h[1] or h[2] or h[3] or "").strip()
            if href and not href.lower().startswith(("javascript:", "data:", "mailto:")):
                try:
                    links[urljoin(url, href) if url else href] = None
                except ValueError:
                    links[href] = None
        return "\n" if name in _BLOCK else ""

    text = html.unescape(_TAG.sub(tag, page.replace("\n", " ")))
    lines = [s for line in text.split("\n") if (s := _SPACE.sub(" ", line).strip())]
    title = _TITLE.search(page)
    charset = _CHARSET.search(page)
    return "\n".join(lines), list(links), " ".join(html.unescape(title[1]).split()) if title else "", charset[1].lower() if charset else ""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, http_headers, payload, block_digest, payload_digest):
    response records of a table (page_id, url, html). A null html is an empty payload."""

    def run(part, texts):
        ids, uris = column(part, "page_id").to_pylist(), column(part, "url").to_pylist()
        heads = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(t)}\r\n\r\n" for t in texts]
        payload = [digest(t) for t in texts]
        rid = [_id("response", str(i), u or "", p) for i, u, p in zip(ids, uris, payload, strict=True)]
        cols = [column(part, "page_id").cast(pa.int64()), pa.array(rid), column(part, "url"), pa.array([date] * len(ids)), pa.array(heads), pa.array([t.decode("utf-8", "replace") for t in texts]), pa.array([digest(h.encode() + t) for h, t in zip(heads, texts, strict=True)]), pa.array(payload)]
        return pa.RecordBatch.from_arrays(cols, ["page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload", "block_digest", "payload_digest"])

    schema = "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string, block_digest string, payload_digest string"
    return map_texts(pages.select("page_id", "url", "html"), run, schema, "html")


def _line(value: str) -> str:
    return " ".join(value.split())


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response: the key, warc_type, record_id, refers_to, concurrent_to, target_uri,
    warc_date, content_type, content_length, block_digest, source_payload_digest, n_outlinks,
    headers (the record's header lines) and block.

    A null payload is an empty page (an empty conversion block); a null URI leaves its header out; a
    null record_id refers to nothing and gets ids from the payload's digest. Repeated responses repeat
    their records.
    """

    def run(part, texts):
        rows = []
        get = lambda c: column(part, c).to_pylist()
        for k, rid, uri, date, heads, block_crc, payload_crc, body in zip(get(key), get("record_id"), get("target_uri"), get("warc_date"), get("http_headers"), get("block_digest"), get("payload_digest"), texts, strict=True):
            text, links, title, charset = plain_text(body.decode("utf-8", "replace"), uri)
            payload_crc = payload_crc or digest(body)
            own = {t: _id(t, rid or "", payload_crc) for t in ("metadata", "conversion")}
            fields = [f"source-header: {_line(h)}" for h in (heads or "").split("\r\n") if h] + [f"source-block-digest: {block_crc}"] * bool(block_crc) + [f"source-payload-digest: {payload_crc}"]
            fields += [f"title: {title}"] * bool(title) + [f"charset: {charset}"] * bool(charset) + [f"outlink: {_line(x)}" for x in links]
            for kind, other, mime, block in (("metadata", "conversion", "application/warc-fields", "".join(f + "\r\n" for f in fields)), ("conversion", "metadata", "text/plain; charset=utf-8", text)):
                raw = block.encode("utf-8", "replace")
                crc = digest(raw)
                target = _line(uri) if uri else ""
                lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own[kind]}", *[f"WARC-Refers-To: {rid}"] * bool(rid), *[f"WARC-Concurrent-To: {own[other]}"] * (kind == "metadata"), *[f"WARC-Target-URI: {target}"] * bool(target), *[f"WARC-Date: {date}"] * bool(date)]
                lines += [f"WARC-Source-Payload-Digest: {payload_crc}", f"WARC-Block-Digest: {crc}", f"Content-Type: {mime}", f"Content-Length: {len(raw)}"]
                rows.append((k, kind, own[kind], rid, own[other], uri, date, mime, len(raw), crc, payload_crc, len(links), "\r\n".join(lines), raw.decode()))
        kinds = [column(part, key).type, *[pa.string()] * 7, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [key, *_COLUMNS])

    cols = [key, "record_id", "target_uri", "warc_date", "http_headers", "payload", "block_digest", "payload_digest"]
    schema = f"`{key}` {responses.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {'long' if c in ('content_length', 'n_outlinks') else 'string'}" for c in _COLUMNS)
    return map_texts(responses.select(*cols), run, schema, "payload")


_COLUMNS = ["warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "n_outlinks", "headers", "block"]


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (headers, block) as WARC text files: a record ends with two empty lines, which
    Spark's text writer puts between rows; files are committed whole and a lost task writes anew."""
    records.select(F.concat_ws("\r\n\r\n", "headers", "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes) -> list[tuple[str, str]]:
    """(headers, block) of the records of a file, by their Content-Length."""
    out, at = [], 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start)
        heads = data[start:end].decode()
        n = int(re.search(r"(?im)^content-length:\s*(\d+)", heads)[1])
        out.append((heads, data[end + 4 : end + 4 + n].decode()))
        at = end + 4 + n
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of the records in the files at ``path``."""
    ship(spark)

    def run(batches):
        for b in batches:
            for data in column(b, "content"):
                got = parse_warc(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers string, block string")


def derivatives_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    return derive(responses_of_pages(pages, date))
