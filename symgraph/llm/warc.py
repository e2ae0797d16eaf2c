"""Operator 4: derivative records of a web archive.

Each response record gets, linked to it by WARC-Refers-To, a metadata record and a conversion record with the page's
plain text. Record id, date, HTTP header block and digests of a response that comes from an archive stay as they are and
are named in its derivatives; a page of which only URL and HTML are known gets a response record of its own first. Block
and payload digests are SHA-1 in base 32, as archives write them; ids of new records follow from those they are made of,
so a rerun writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.common import slices

DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "symgraph"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 9562
#: Elements that are dropped with all they hold, and those that stand on lines of their own.
DROPPED = frozenset("script style noscript template svg head".split())
BREAKING = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer main aside blockquote pre hr form title dl dt dd figure figcaption".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*DROPPED, "title")}
_TITLE = re.compile(r"<title(?:\s[^>]*)?>", re.I)
_HTML = re.compile(r"<html[\s>]", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def plain_text(page: str) -> str:
    """Visible text: scripts, styles, comments and the head dropped, block elements on lines of their own, entities decoded.

    One pass: each kind of end mark is looked for from where the last one was found, and not again once there is none
    left, so time grows with the page whatever is left open in it. What isn't closed isn't a comment or a dropped element.
    """
    out: list[str] = []
    ahead: dict[str, tuple[int, int]] = {}  # end mark -> where it comes next (start, end); (-1, -1) if no more

    def next_end(kind: str, pos: int) -> tuple[int, int]:
        start, end = ahead.get(kind, (-2, -2))
        if start == -1 or start >= pos:
            return start, end
        if kind in _CLOSING:
            m = _CLOSING[kind].search(page, pos)
            start, end = m.span() if m else (-1, -1)
        else:
            start = page.find(kind, pos)
            end = start + len(kind)
        ahead[kind] = start, end
        return start, end

    pos = 0
    while (at := page.find("<", pos)) >= 0:
        out.append(page[pos:at])
        pos, put = at + 1, "<"
        if page.startswith("<!--", at):
            start, end = next_end("-->", at + 4)
            if start >= 0:
                pos, put = end, " "
        elif page.startswith("<!", at) and page[at + 2 : at + 3].isalpha():
            start, end = next_end(">", at)
            if start >= 0:
                pos, put = end, " "
        elif m := _NAME.match(page, at):
            name = m[2].lower()
            start, end = next_end(">", m.end())
            if start >= 0:
                pos, put = end, "\n" if name in BREAKING else ""
                if not m[1] and name in DROPPED:
                    start, end = next_end(name, pos)
                    if start >= 0:
                        pos, put = end, " "
        out.append(put)
    text = "".join([*out, page[pos:]])
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(text) if "&" in text else text)).strip()


def title_of(page: str) -> str:
    first = _TITLE.search(page)
    last = _CLOSING["title"].search(page, first.end()) if first else None
    return html.unescape(" ".join(page[first.end() : last.start()].split())) if last else ""


def language_of(page: str) -> str:
    first = _HTML.search(page)
    end = page.find(">", first.start()) if first else -1
    lang = _LANG.search(page, first.start(), end) if end >= 0 else None
    return lang[1].lower() if lang else ""


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(10).join(parts))}>"


def record(headers: list[tuple[str, str]], block: str) -> str:
    """A WARC/1.1 record but for the two line ends that close it. Header values can't break lines."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in headers if v]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block.encode())}", "", block])


RECORDS = pa.schema([("page_id", pa.int64()), ("seq", pa.int32())] + [(n, pa.string()) for n in ("warc_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", "payload_digest", "record")])
KINDS = "page_id long, seq int, warc_type string, record_id string, refers_to string, target_uri string, content_type string, block_digest string, payload_digest string, record string"
#: What is known of a response that comes from an archive, as columns; see derivatives.
SOURCE = ("record_id", "warc_date", "http_headers", "payload_digest")


def http_fields(block: str) -> tuple[str, dict[str, str]]:
    """Status code and fields (names lower-cased, the first of each) of an HTTP header block."""
    first, *rest = block.replace("\r\n", "\n").split("\n")
    status = first.split(" ", 2)[1] if first.count(" ") else ""
    fields: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return status, fields


def derive(page_id: int | None, url: str, page: str, date: str = DATE, source: dict[str, str | None] | None = None) -> list[tuple]:
    """The records of a page: response, metadata, conversion; without the response if `source` (values of SOURCE) names an archived one.

    An archived payload digest is kept as it is; where the page in UTF-8 has another (another charset, a cut page), that is in the metadata too.
    """
    body = page.encode()
    payload, out = digest(body), []
    kept = {k: v for k, v in (source or {}).items() if v}
    archived = "record_id" in kept
    http = kept.get("http_headers") or f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    if not http.endswith("\r\n\r\n"):
        http = http.rstrip("\r\n") + "\r\n\r\n"
    named, date = kept.get("payload_digest") or payload, kept.get("warc_date") or date
    origin = kept.get("record_id") or record_id("response", str(page_id), url, payload)
    status, given = http_fields(http)
    text = plain_text(page)
    charset = re.search(r"charset=[\"']?([\w-]+)", given.get("content-type", ""), re.I)
    fields = [("title", title_of(page)), ("language", language_of(page)), ("charset", charset[1].lower() if charset else ""), ("http-status", status), *((f"http-{k}", v) for k, v in given.items() if k != "content-length"), ("payload-length", str(len(body))), ("text-length", str(len(text.encode()))), ("source-payload-digest", named)]
    if named != payload:
        fields.append(("utf8-payload-digest", payload))
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v)
    for seq, (kind, content, type_, own) in enumerate([("response", http + page, "application/http; msgtype=response", named), ("metadata", meta, "application/warc-fields", ""), ("conversion", text, "text/plain; charset=utf-8", digest(text.encode()))]):
        if archived and seq == 0:
            continue
        rid = record_id(kind, origin) if seq else origin
        whole = digest(content.encode())
        links = [("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)] if seq else []
        headers = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url), *links, ("WARC-Block-Digest", whole), ("WARC-Payload-Digest", "" if seq else own), ("Content-Type", type_)]
        out.append((page_id, seq, kind, rid, origin if seq else None, url, type_, whole, own or None, record(headers, content)))
    return out


def derivatives(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", source: dict[str, str] | None = None) -> DataFrame:
    """Rows of each page, seq 0 response, 1 metadata, 2 conversion: see RECORDS. `source` names the columns that hold what
    is known of archived responses (keys of SOURCE, for example those of read_warc); where a row has a record id there, its
    response isn't written again.

    Null pages are empty pages, a null URL is an empty one (its header is left out). Rows repeated exactly name the same
    resource and so have the same record ids. An empty table gives no rows. Other columns, whatever their names, are
    ignored. Time grows with the length of a page, whatever it holds.
    """
    given = {k: c for k, c in (source or {}).items() if k in SOURCE}
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), *[F.col(c).cast("string").alias(f"source_{k}") for k, c in given.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for page_id, url, page, *known in zip(*(c.to_pylist() for c in batch.columns)):
                out += derive(page_id, url or "", page or "", date, dict(zip(given, known)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORDS)], schema=RECORDS)

    return rows.mapInArrow(run, KINDS)


RESPONSES = "record_id string, warc_date string, target_uri string, warc_headers map<string,string>, http_headers string, payload_digest string, html string"


def _unzipped(data: bytes) -> bytes:
    """The members of a gzip file one after another; a cut last member counts as far as it goes."""
    try:
        return gzip.decompress(data)
    except (EOFError, zlib.error):
        out = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                out.append(member.decompress(data))
            except zlib.error:
                break
            data = member.unused_data
        return b"".join(out)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Response records of the bytes of a WARC file (plain or gzipped), as rows of RESPONSES. A record cut short, and what follows, is left out."""
    data = _unzipped(data) if data[:2] == b"\x1f\x8b" else data
    pos = 0
    while (start := data.find(b"WARC/", pos)) >= 0 and (end := data.find(b"\r\n\r\n", start)) >= 0:
        headers: dict[str, str] = {}
        for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
        size = headers.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        block = data[end + 4 : end + 4 + int(size)]
        pos = end + 4 + int(size)
        if headers.get("warc-type") == "response":
            head, _, body = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
            charset = re.search(r"charset=[\"']?([\w-]+)", http_fields(http)[1].get("content-type", ""), re.I)
            try:
                page = body.decode(charset[1] if charset else "utf-8", "replace")
            except LookupError:
                page = body.decode("utf-8", "replace")
            yield {"record_id": headers.get("warc-record-id"), "warc_date": headers.get("warc-date"), "target_uri": headers.get("warc-target-uri"), "warc_headers": list(headers.items()), "http_headers": http, "payload_digest": headers.get("warc-payload-digest"), "html": page}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (gzipped or not) below a path that Spark can reach: see RESPONSES. A file is read by one task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(RESPONSES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0
                for row in parse_warc(data.as_py()):
                    held.append(row)
                    size += len(row["html"])
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, RESPONSES)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files, one for each partition, to a folder that Spark can reach."""
    ordered = records.select("record")
    ordered.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def record_digests(records: DataFrame) -> DataFrame:
    """The rows of derivatives with the length and SHA-256 of each whole record instead of its text."""
    return records.select("page_id", "seq", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", "payload_digest", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
