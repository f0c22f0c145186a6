"""WARC derivatives: from responses to linked metadata and plain-text conversion records.

A record is a row: its type, identifier, the identifier that it refers to, address, date,
content type, digests, headers and block. ``lines`` gives the records' bytes as text
lines whose separator ends a record, so that Spark's text writer makes (gzipped) WARC files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import lean, slices, whole_texts

RECORD = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, block_digest string, payload_digest string, refers_to_digest string, headers map<string,string>, block binary"
)
#: What ends a record; the text writer puts it after each line.
SEPARATOR = "\r\n\r\n"
#: Elements whose text is not shown, and those that begin a line (fixed values).
HIDDEN = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object"}
BLOCKS = {"p", "div", "br", "hr", "li", "ul", "ol", "dl", "dt", "dd", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "main", "pre", "blockquote", "form", "figure", "figcaption", "option", "address", "body"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, uri: str, block: bytes) -> str:
    """Named by content, so that a task that runs again writes the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {uri} {hashlib.sha256(block).hexdigest()}')}>"


class _Page(HTMLParser):
    """Shown text by lines, title, links and metas."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[dict] = []
        self.metas: list[dict] = []
        self.title: list[str] = []
        self.hidden: list[str] = []
        self.lang = None

    def parse_marked_section(self, i, report=1):
        """``<![CDATA[`` is passed over up to its end, any other ``<![`` up to the next ``>``: the library raises at names that it doesn't know."""
        close = "]]>" if self.rawdata[i : i + 9].upper() == "<![CDATA[" else ">"
        at = self.rawdata.find(close, i + 3)
        return at if at < 0 else at + len(close)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        elif tag == "meta":
            self.metas.append({k: v or "" for k, v in a.items()})
        elif tag in ("a", "area", "link") and a.get("href"):
            self.links.append({"path": f"{tag.upper()}@/href", "url": a["href"]})
        elif tag in ("img", "script", "iframe", "source") and a.get("src"):
            self.links.append({"path": f"{tag.upper()}@/src", "url": a["src"]})
        if tag in BLOCKS:
            self.out.append("\n")
            if tag == "body":
                self.hidden.clear()
        if tag in HIDDEN or tag == "title":
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if "title" in self.hidden:
            self.title.append(data)
        elif not self.hidden:
            self.out.append(data)


def read_page(source: str) -> tuple[str, dict]:
    """(plain text, metadata) of a page: one line for each block, white space folded. Malformed markup is read as far as it can be; it never raises."""
    page = _Page()
    page.feed(source)
    page.close()
    fold = lambda s: " ".join(s.split())
    text = "\n".join(filter(None, map(fold, "".join(page.out).split("\n"))))
    return text, {"title": fold("".join(page.title)), "lang": page.lang, "metas": page.metas, "links": page.links}


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html); null values count as empty.

    The block is an HTTP response; digests are of the block and of its payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                rows = []
                for page, url, body in zip(*(c.to_pylist() for c in b.columns)):
                    url, body = url or "", (body or "")
                    payload = body.encode()
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    rows.append(_row(page, "response", url, date, "application/http; msgtype=response", block, digest(payload), None, None, {}))
                yield _batch(rows)

    return whole_texts(pages.select("page_id", "url", "html")).mapInArrow(lean(run), RECORD)


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _row(page, kind, uri, date, content_type, block: bytes, payload, refers_to, refers_digest, extra) -> dict:
    me = record_id(kind, uri, (refers_to or "").encode() + block)
    headers = {
        "WARC-Type": kind, "WARC-Record-ID": me, "WARC-Date": date, "WARC-Target-URI": _line(uri), "Content-Type": content_type,
        "WARC-Block-Digest": digest(block), "Content-Length": str(len(block)),
    }
    if payload:
        headers["WARC-Payload-Digest"] = payload
    if refers_to:
        headers["WARC-Refers-To"] = refers_to
    return {
        "page_id": page, "warc_type": kind, "record_id": me, "refers_to": refers_to, "target_uri": uri, "warc_date": date, "content_type": content_type,
        "block_digest": headers["WARC-Block-Digest"], "payload_digest": payload, "refers_to_digest": refers_digest, "headers": list((headers | extra).items()), "block": block,
    }


_ARROW = pa.schema(
    [("page_id", pa.int64())]
    + [(c, pa.string()) for c in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "refers_to_digest")]
    + [("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def decoded(body: bytes, content_type: str) -> str:
    """A payload's text by the character set that its header names, else UTF-8; bytes that don't fit become U+FFFD."""
    named = _CHARSET.search(content_type)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` (JSON) and ``conversion`` (plain text).

    Both refer to the response by its identifier, address and date, and keep its payload digest; the
    metadata also holds the response's WARC and HTTP headers, title, metas and links. Other types of
    records are passed over. Responses without an HTTP head are taken as a body; bytes outside the
    character set become U+FFFD in the text, digests are of the bytes as they are; malformed markup
    is read as far as it goes; a null block is an empty one; texts of any length are read whole;
    repeated rows derive the same records again; an empty table gives none; extra columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "block"):
                rows = []
                for r in b.to_pylist():
                    block = r["block"] or b""
                    head, found, body = block.partition(b"\r\n\r\n")
                    if not found or not head.startswith(b"HTTP/"):
                        head, body = b"", block
                    status, *fields = head.decode("utf-8", "replace").split("\r\n")
                    http = [dict(zip(("name", "value"), (x.strip() for x in line.split(":", 1)))) for line in fields if ":" in line]
                    text, facts = read_page(decoded(body, " ".join(h["value"] for h in http if h["name"].lower() == "content-type")))
                    uri, date, me = r["target_uri"] or "", r["warc_date"] or "", r["record_id"]
                    payload = r["payload_digest"] or digest(body)
                    source = {"WARC-Refers-To-Target-URI": _line(uri), "WARC-Refers-To-Date": date, "WARC-Refers-To-Payload-Digest": payload}
                    meta = {"Envelope": {"WARC-Header-Metadata": dict(r["headers"] or []), "Payload-Metadata": {"HTTP-Response-Metadata": {"Status": status, "Headers": http, "HTML-Metadata": facts, "Entity-Digest": payload, "Entity-Length": len(body)}}}}
                    block = json.dumps(meta, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
                    rows.append(_row(r["page_id"], "metadata", uri, date, "application/json", block, None, me, payload, source))
                    plain = text.encode("utf-8", "replace")
                    language = {"WARC-Identified-Content-Language": _line(facts["lang"])} if facts["lang"] else {}
                    rows.append(_row(r["page_id"], "conversion", uri, date, "text/plain", plain, digest(plain), me, payload, source | language))
                yield _batch(rows)

    source = records.where(F.col("warc_type") == "response")
    return whole_texts(source.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", "headers", "block")).mapInArrow(lean(run), RECORD)


def lines(records: DataFrame) -> DataFrame:
    """(value): a record's bytes, as a string that no one decodes, without its closing separator; header fields in the order that they were made."""
    fields = F.array_join(F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "\r\n")
    head = F.concat(F.lit("WARC/1.0\r\n"), fields, F.lit(SEPARATOR)).cast("binary")
    return records.select(F.concat(head, F.coalesce("block", F.lit("").cast("binary"))).cast("string").alias("value"))


def write(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one for each task, by Spark's own writer."""
    lines(records).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def parse(data: bytes) -> list[tuple[dict, bytes]]:
    """The records (headers, block) of a WARC file's bytes; for checks and small files."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        start = end + 4
        n = int(head["Content-Length"])
        out.append((head, data[start : start + n]))
        at = start + n + 4
    return out

