"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespace of record identifiers, so that each rerun names the same records.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:timberline:warc")
#: Response records that are made from a table of pages carry this date if the table has none.
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id {id}, record_type string, record_id string, refers_to string, target_uri string, block_digest string, payload_digest string, headers map<string,string>, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(parts))}>"


def _line(value: str | None) -> str:
    """A header's value: no line breaks, which would end the header."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value or "").strip()


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """A whole record: version line, headers (the type first, by name), block, and the two line ends that close it."""
    ordered = sorted(headers.items(), key=lambda x: (x[0] != "WARC-Type", x[0]))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in ordered).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records that stand in ``data`` one after another."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, length = end + 4, int(headers["Content-Length"])
        yield headers, data[start : start + length]
        at = start + length + 4


#: Elements that are dropped with all that is in them, and those that begin a line.
_DROPPED = {n: re.compile(rf"</{n}(?![\w-])[^>]*+>?", re.I) for n in ("script", "style", "noscript", "template")}
_LINES = frozenset("br p div li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre title head body".split())
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_TITLE_END = re.compile(r"</title(?![\w-])", re.I)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/"'<>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")


def _attribute(tag: str, name: str) -> str | None:
    for key, *values in _ATTRIBUTE.findall(tag):
        if key.lower() == name:
            return html.unescape(next((v for v in values if v), ""))
    return None


def read_page(page: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, links) of a page, in one walk from tag to tag.

    Text: scripts, styles and comments dropped, a line for each block, entities resolved, white space tidy. A comment or a dropped element
    without an end goes to the end of the page, as in browsers, and so does a tag without one. A ``<`` that begins no tag is text.
    """
    parts, links, title, lang, at = [], [], None, None, 0
    while (tag := page.find("<", at)) >= 0:
        parts.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            parts.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        named = _TAG.match(page, tag)
        if not named and page[tag + 1 : tag + 2] not in ("!", "?"):
            parts.append("<")
            at = tag + 1
            continue
        end = page.find(">", tag)
        if end < 0:
            at = len(page)
            break
        at = end + 1
        name, opens = (named[1].lower(), page[tag + 1] != "/") if named else ("", False)
        if opens and name in _DROPPED:
            closed = _DROPPED[name].search(page, at)
            parts.append(" ")
            at = closed.end() if closed else len(page)
        elif name in _LINES:
            parts.append("\n")
            if opens and name == "title" and title is None:
                closed = _TITLE_END.search(page, at)
                title = page[at : closed.start()] if closed else ""
                parts.append(title)
                at += len(title)
        elif opens and name == "a":
            link = _attribute(page[tag:end], "href")
            if link is not None:
                links.append(link)
        elif opens and name == "html" and lang is None:
            lang = _attribute(page[tag:end], "lang")
    parts.append(page[at:])
    text = "\n".join(x for x in (" ".join(line.split()) for line in html.unescape("".join(parts)).split("\n")) if x)
    return text, " ".join(html.unescape(title or "").split()), (lang or "").lower(), links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block without a header's end is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def _record(page_id, kind: str, uri: str, date: str, content_type: str, block: bytes, key: tuple[str, ...], source: dict[str, str] | None = None, payload: str | None = None) -> tuple:
    own = record_id(kind, *key)
    headers = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": uri}
    if source:
        headers["WARC-Refers-To"] = source["WARC-Record-ID"]
        if kind == "conversion":
            headers |= {"WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": source["WARC-Date"]}
    headers["WARC-Block-Digest"] = digest(block)
    if payload:
        headers["WARC-Payload-Digest"] = payload
    headers |= {"Content-Type": content_type, "Content-Length": str(len(block))}
    return page_id, kind, own, headers.get("WARC-Refers-To"), uri, headers["WARC-Block-Digest"], payload, list(headers.items()), block


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", "headers", "block"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def _mapped(rows: DataFrame, make, size: int = 256) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, size):
                batch = whole.slice(k, size)
                yield _batch([x for row in batch.to_pylist() for x in make(**row)], batch.schema.field(0).type)

    return rows.mapInArrow(run, RECORD.format(id=rows.schema[0].dataType.simpleString()))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages, one per row; repeated rows give equal records. A null url or page is an empty one, an empty table gives none."""

    def make(page_id, url, page):
        payload, uri = (page or "").encode("utf-8", "replace"), _line(url)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        yield _record(page_id, "response", uri, date, "application/http; msgtype=response", head.encode() + payload, (str(page_id), uri, digest(payload)), payload=digest(payload))

    return _mapped(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("page")), make)


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response record: ``metadata`` and ``conversion``, both naming it in WARC-Refers-To.

    The conversion's block is the page's plain text in UTF-8. The metadata's block has fields about the source: its digests, status
    and HTTP headers as they were, title, language, and links in the page's order. Each also holds its own block digest; the
    metadata keeps the source's payload digest as its ``source-payload-digest``. Headers of the source record that aren't its type,
    identifier or sizes are kept as ``source-...`` fields. Identifiers follow from the source's, so reruns agree.

    Records of other types give nothing. Empty pages give an empty text, and repeated rows repeat their records.
    Page bytes that aren't UTF-8 are replaced in the text, not in the source. A page is read in one walk, whatever its length. Null headers and blocks
    are empty ones. Other columns of the table are not read. An empty table gives an empty result.
    """

    def make(page_id, target_uri, headers, block):
        source = dict(headers or [])
        source = {"WARC-Record-ID": record_id("unknown", str(page_id)), "WARC-Date": DATE} | source
        status, fields, payload = http_parts(block or b"")
        page, uri, date = payload.decode("utf-8", "replace"), target_uri or "", source["WARC-Date"]
        kept = source.get("WARC-Payload-Digest") or digest(payload)
        text, title, lang, links = read_page(page)
        about = [("source-payload-digest", kept), ("source-block-digest", source.get("WARC-Block-Digest") or digest(block or b"")), ("source-status", status)]
        about += [(f"source-{k}", v) for k, v in source.items() if k not in ("WARC-Type", "WARC-Record-ID", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Length")]
        about += [(f"source-http-{k}", v) for k, v in fields]
        about += [("title", title), ("language", lang), *(("outlink", x) for x in links)]
        block_of = "".join(f"{k}: {_line(v)}\r\n" for k, v in about if v).encode("utf-8", "replace")
        key = (source["WARC-Record-ID"],)
        yield _record(page_id, "metadata", uri, date, "application/warc-fields", block_of, key, source)
        yield _record(page_id, "conversion", uri, date, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), key, source, kept)

    return _mapped(records.filter("record_type = 'response'").select("page_id", "target_uri", "headers", "block"), make)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the records as gzipped WARC files below ``path`` (a URI that all executors reach), one file per partition.

    Each record is a gzip member of its own. A file gets its name when it is whole, so that a repeated task leaves one file.
    """
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)
        name = f"{at}/part-{task.partitionId():05d}"
        n = 0
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None) as out:
            for batch in batches:
                for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out.write(gzip.compress(serialise(dict(headers), block), mtime=0))
                    n += 1
        store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    records.select("headers", "block").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))
