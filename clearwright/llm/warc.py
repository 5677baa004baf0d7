"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both refer to the response (WARC-Refers-To) and keep its target, date, HTTP headers and payload digest, so
a derivative can be traced and checked without its source.  The metadata record lists title,
language and outlinks as warc-fields; the conversion record holds the visible text, with character references
resolved.  Record ids are derived from (source id, kind), so a rebuilt derivative has the same id.  Digests are
SHA-256 in hex over UTF-8; lengths are bytes.  One scan, no shuffle.

Cases: a null payload is an empty one (zero length, digest of nothing), null headers and targets are
empty texts; a null record id gives derivatives that refer to an empty id; repeated rows give repeated records; an
empty table gives no record.  Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.llm.common import small_batches

VERSION = "WARC/1.1"
CRLF = "\r\n"
KINDS = ("metadata", "conversion")
MIMES = ("application/warc-fields", "text/plain; charset=utf-8")
_NAME = re.compile("!--|/?[A-Za-z][A-Za-z0-9]*")
# What no reader sees, with its end.
_UNSEEN = {"script": re.compile("</(?:script|style)>", re.I), "style": re.compile("</(?:script|style)>", re.I), "!--": re.compile("-->")}
_BLOCK_ENDS = frozenset(("br", "/p", "/li", "/div", "/title", "/tr", *(f"/h{n}" for n in range(1, 7))))
_TITLE_END = re.compile("</title>", re.I)
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_HREF = re.compile(r"\shref" + _VALUE, re.I)
_LANG = re.compile(r"\slang" + _VALUE, re.I)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def record_id(*parts: Column) -> Column:
    """urn:uuid of the MD5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def sha256(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def resolved(text: str) -> str:
    """Character references resolved once: named, decimal and hexadecimal ones; no-break spaces by name become spaces."""
    return unescape(text.replace("&nbsp;", " ")) if "&" in text else text


def _attribute(pattern: re.Pattern, tag: str) -> str | None:
    found = pattern.search(tag)
    return found and next(v for v in (*found.groups(), "") if v is not None)


def read_page(html: str) -> tuple[str, str, list[str], str]:
    """(title, language, outlinks, visible text) of a page, in one walk over its tags.

    Scripts, styles and comments are left out, ends of blocks become line ends, other tags and white space one space.
    What is not closed is no element: its tag alone is left out.
    """
    flat = html.replace("\t", " ").replace("\n", " ").replace("\f", " ").replace("\r", " ")
    parts, links, at, lost = [], [], 0, set()
    title = language = None
    while (start := flat.find("<", at)) >= 0:
        end = flat.find(">", start)
        if end < 0:
            break
        parts.append(flat[at:start])
        name = _NAME.match(flat, start + 1)
        name = name.group(0).lower() if name else ""
        at, mark = end + 1, " "
        if name in _UNSEEN and name not in lost:
            close = _UNSEEN[name].search(flat, at if name != "!--" else start + 4)
            if close:
                at = close.end()
            else:
                lost.add(name)  # no later one is closed either
        elif name in _BLOCK_ENDS:
            mark = "\n"
        elif name == "a":
            link = _attribute(_HREF, flat[start:end])
            if link is not None:
                links.append(resolved(link))
        elif name == "html" and language is None:
            language = _attribute(_LANG, flat[start:end])
        elif name == "title" and title is None and name not in lost:
            close = _TITLE_END.search(flat, at)
            if close:
                title = resolved(html[at:close.start()]).strip(" ")
            else:
                lost.add(name)
        parts.append(mark)
    parts.append(flat[at:])
    lines = (" ".join(filter(None, line.split(" "))) for line in resolved("".join(parts)).split("\n"))
    return title or "", language or "", links, "\n".join(filter(None, lines))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        metadata, plain = [], []
        for html in batch.column("payload").to_pylist():
            title, language, links, text = read_page(html)
            metadata.append("".join(f"{line}{CRLF}" for line in (f"title: {title}", f"language: {language}", *(f"outlink: {u}" for u in links))))
            plain.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(metadata, pa.string()), pa.array(plain, pa.string())], [*batch.schema.names, "metadata", "conversion"])


def derivatives(responses: DataFrame) -> DataFrame:
    """Records of `responses` (record_id, target_uri, date, http_headers, payload), two rows each.

    Returns record_id, record_type, refers_to, target_uri, date, content_type, source_headers,
    source_digest, block_digest, content_length, block.
    """
    small_batches(responses.sparkSession)
    names = {"record_id": "refers_to", "target_uri": "target_uri", "date": "date", "http_headers": "source_headers"}
    given = responses.select(*(_text(a).alias(b) for a, b in names.items()), _text("payload").alias("payload"), sha256(_text("payload")).alias("source_digest"))
    schema = ", ".join(f"{c} string" for c in (*given.columns, *KINDS))
    kinds = F.array(*(F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), F.col(kind).alias("block")) for kind, mime in zip(KINDS, MIMES)))
    rows = given.mapInArrow(_blocks, schema).select(*names.values(), "source_digest", F.explode(kinds).alias("r"))
    return rows.select(
        record_id(F.col("refers_to"), F.col("r.record_type")).alias("record_id"), "r.record_type", "refers_to", "target_uri", "date", "r.content_type",
        "source_headers", "source_digest", sha256(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block")


def record_text() -> Column:
    """A derivative as a WARC record: header lines, an empty line, the block."""
    headers = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"),
        ("WARC-Source-HTTP-Headers", "source"), ("Content-Type", "content_type"), ("Content-Length", "length"),
    )
    made = {"source": F.regexp_replace("source_headers", "[\\r\\n]+", "; "), "length": F.col("content_length").cast("string")}
    lines = [F.concat(F.lit(f"{name}: "), made.get(column, F.col(column))) for name, column in headers]
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines), F.lit(CRLF * 2), F.col("block"))


def write_warc(records: DataFrame, folder: str) -> None:
    """Records as gzip-compressed WARC files; two line ends close a record."""
    records.select(record_text().alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(folder)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html)."""
    html = _text("html")
    length = F.octet_length(html).cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length)
    return pages.select(
        record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("")), _text("url"), F.lit("response")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), F.col("html").alias("payload"))
