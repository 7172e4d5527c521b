"""WARC derivatives: linked metadata and plain-text conversion records of captured responses.

A response record has a capture's identifier, target, date, HTTP headers and body. From each one come a
metadata record (what was found in the body, and the source's headers and digests) and a conversion
record (the visible text of the whole page). Both refer to the response by its identifier, target and date; the
conversion also names the metadata record as concurrent. Identifiers follow from the content, so a task
that runs again writes the same records.

A table of response records has these besides page_id, url and html, as far as it knows them, and what it
has is kept: ``record_id``, ``date`` (a text or a time), ``http_headers`` (the header lines as sent, or a map),
``payload_digest`` and ``block_digest``. Where a column or a value is missing, as in tables of pages alone,
the date and headers given for all rows stand in, the identifier follows from target and body, and digests
are taken of the body as read and of a response made up of headers and body.

``record`` is a whole record but for the line ends that close it; ``write_files`` writes such records as
WARC files, with the closing line ends as the separator, and ``parse`` reads them back.

Edge cases: a null body counts as empty and a null URL as the empty target; a row without an id gets the
identifier of its target and body; repeated rows yield equal records each; an empty table yields none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, MapType, TimestampNTZType, TimestampType

from tidemark.llm import html_text

VERSION = "WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
HTTP_HEADERS = [("Content-Type", "text/html; charset=utf-8")]
COLUMNS = {
    "page_id": pa.int64(),
    "record_type": pa.string(),
    "record_id": pa.string(),
    "refers_to": pa.string(),
    "concurrent_to": pa.string(),
    "target_uri": pa.string(),
    "content_type": pa.string(),
    "content_length": pa.int64(),
    "block_digest": pa.string(),
    "source_payload_digest": pa.string(),
    "source_block_digest": pa.string(),
    "source_headers": pa.string(),
    "record": pa.string(),
}
#: Columns of a response's own record.
KNOWN = ["record_id", "date", "http_headers", "payload_digest", "block_digest"]
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)
_LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def digest(block: bytes) -> str:
    """Labelled SHA-1 in base 32, as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {name}')}>"


def one_line(text: str) -> str:
    """A header value: white space of any kind becomes one space."""
    return " ".join(text.split())


def http_block(body: bytes, headers: list[tuple[str, str]], status: str = "", sent: bool = False) -> bytes:
    """A response of these headers; the length is added unless they are those that were ``sent``."""
    length = [] if sent else [f"Content-Length: {len(body)}"]
    return "\r\n".join([status or "HTTP/1.1 200 OK", *[f"{k}: {v}" for k, v in headers], *length, "", ""]).encode("utf-8", "replace") + body


def header_lines(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The status line, if there is one, and the headers of a block; a line that begins with a space goes on."""
    status, found = "", []
    for line in text.splitlines():
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], one_line(f"{found[-1][1]} {line}"))
        elif line.startswith("HTTP/") and not found:
            status = one_line(line)
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((one_line(name), one_line(value)))
    return status, found


def record(headers: list[tuple[str, str]], block: str) -> str:
    return "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in headers if v], "", block])


def parse(text: str) -> tuple[dict[str, str], str]:
    """Headers and block of one record."""
    head, _, block = text.partition("\r\n\r\n")
    first, *lines = head.split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a {VERSION} record: {first[:40]!r}")
    return dict(line.split(": ", 1) for line in lines), block


def described(html: str) -> list[tuple[str, str]]:
    """What the body says of itself, as fields; links in page order, each once."""
    title, lang = _TITLE.search(html), _LANG.search(html)
    links = dict.fromkeys(one_line(unescape(a or b or c)) for a, b, c in _LINK.findall(html))
    fields = [("title", one_line(unescape(title[1])) if title else ""), ("language", lang[1] if lang else "")]
    return [f for f in fields if f[1]] + [("outlink", link) for link in links if link]


def derived(
    page_id: int | None, url: str, html: str, date: str, headers: list[tuple[str, str]], known: dict[str, str | None] | None = None
) -> list[dict]:
    """The metadata and the conversion record of one response; ``known`` has what the response's own record says."""
    known = {name: one_line(value or "") if name != "http_headers" else value for name, value in (known or {}).items()}
    body = html.encode("utf-8", "replace")
    target = one_line(url)
    date, status = known.get("date") or date, ""
    if known.get("http_headers"):
        status, headers = header_lines(known["http_headers"])
    made = digest(body)
    payload = known.get("payload_digest") or made
    source_block = known.get("block_digest") or digest(http_block(body, headers, status, bool(known.get("http_headers"))))
    source = known.get("record_id") or identifier("response", f"{page_id if page_id is not None else ''} {target} {made}")
    source = source if source.startswith("<") else f"<{source}>"
    ids = {kind: identifier(kind, source) for kind in ("metadata", "conversion")}
    fields = [
        ("source-payload-digest", payload),
        ("source-block-digest", source_block),
        *[(f"source-{k.lower()}", v) for k, v in headers],
        *described(html),
    ]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        "conversion": ("text/plain; charset=utf-8", html_text.visible_text(html)),
    }
    out = []
    for kind, (content_type, block) in blocks.items():
        raw = block.encode("utf-8", "replace")
        other = ids["metadata"] if kind == "conversion" else ""
        named = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", ids[kind]),
            ("WARC-Date", date),
            ("WARC-Target-URI", target),
            ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", target),
            ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", other),
            ("WARC-Block-Digest", digest(raw)),
            ("Content-Type", content_type),
            ("Content-Length", str(len(raw))),
        ]
        out.append(
            {
                "page_id": page_id,
                "record_type": kind,
                "record_id": ids[kind],
                "refers_to": source,
                "concurrent_to": other or None,
                "target_uri": target,
                "content_type": content_type,
                "content_length": len(raw),
                "block_digest": digest(raw),
                "source_payload_digest": payload,
                "source_block_digest": source_block,
                "source_headers": "\r\n".join(f"{k}: {v}" for k, v in headers),
                "record": record(named, block),
            }
        )
    return out


def _text(pages: DataFrame, name: str) -> Column:
    """A column of a response's own values as text: times as archives write them, in UTC; maps as header lines."""
    kind, column = pages.schema[name].dataType, F.col(name)
    if isinstance(kind, TimestampType):
        return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(kind, (DateType, TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(kind, MapType):
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws(": ", e.key, e.value)), "\r\n")
    return column.cast("string")


def derivatives(pages: DataFrame, date: str, headers: list[tuple[str, str]] | None = None) -> DataFrame:
    """Two records for each row of ``pages`` (page_id, url, html, and any of ``KNOWN``). No shuffle.

    ``date`` and ``headers`` are those of rows that have none of their own.
    """
    sent = HTTP_HEADERS if headers is None else headers
    schema = pa.schema(list(COLUMNS.items()))

    own = [name for name in KNOWN if name in pages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for start in range(0, len(ids), 256):
                rows: list[dict] = []
                part = slice(start, start + 256)
                values = zip(*[batch.column(name)[part].to_pylist() for name in own], strict=True) if own else [()] * len(ids[part])
                for page_id, url, html, known in zip(ids[part], urls[part], batch.column("html").slice(start, 256), values, strict=True):
                    rows += derived(page_id, url or "", html.as_py() or "", date, sent, dict(zip(own, known, strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        *[_text(pages, name).alias(name) for name in own],
    )
    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    return rows.mapInArrow(run, ", ".join(f"{name} {kinds[kind]}" for name, kind in COLUMNS.items()))


def write_files(records: DataFrame, folder: str) -> None:
    """The records as compressed WARC files, one per partition."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)
