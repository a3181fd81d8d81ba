"""Metadata records, whole and line by line, from hashlib, uuid and Python's own HTML parser."""

import base64
import hashlib
import re
import uuid
from html.parser import HTMLParser

from timberline.llm import warc

SF = "/root/testdata/sf0.001"


class About(HTMLParser):
    """Title, language and links of a page."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.links, self.hidden, self.open = None, None, [], 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = {k: v for k, v in reversed(attrs) if v is not None}
        self.hidden += tag in ("script", "style", "noscript", "template")
        if tag == "title" and self.title is None:
            self.title, self.open = "", True
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang")
        if tag == "a" and not self.hidden and "href" in attrs:
            self.links.append(attrs["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.open &= tag != "title"

    def handle_data(self, data):
        if self.open:
            self.title += data


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def line(value):
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def test_metadata_against_plain(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    made = {r.page_id: r for r in warc.derivatives(warc.responses(spark.read.parquet(f"{SF}/pages.parquet"))).filter("record_type = 'metadata'").collect()}
    digests = {r.page_id: r for r in warc.op2_warc_derivatives(spark, SF).filter("record_type = 'metadata'").collect()}
    assert len(made) == len(digests) == len(pages)
    linked = titled = 0
    for p in pages:
        html, url = (p.html or "").encode(), line(p.url or "")
        about = About(p.html or "")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
        source = f"<urn:uuid:{uuid.uuid5(warc.NAMESPACE, f'response|{p.page_id}|{url}|{sha1(html)}')}>"
        fields = [
            ("source-payload-digest", sha1(html)), ("source-block-digest", sha1(head + html)), ("source-status", "HTTP/1.1 200 OK"), ("source-WARC-Date", warc.DATE), ("source-WARC-Target-URI", url),
            ("source-Content-Type", "application/http; msgtype=response"), ("source-http-Content-Type", "text/html; charset=utf-8"), ("source-http-Content-Length", str(len(html))),
            ("title", " ".join((about.title or "").split())), ("language", (about.lang or "").lower()), *(("outlink", x) for x in about.links),
        ]
        expected = sorted(f"{k}: {line(v)}" for k, v in fields if v)
        r, d = made[p.page_id], digests[p.page_id]
        lines = bytes(r.block).decode().split("\r\n")
        assert lines.pop() == "" and sorted(lines) == expected
        assert [x for x in lines if x.startswith("outlink")] == [f"outlink: {line(x)}" for x in about.links if x]  # the page's order
        own = f"<urn:uuid:{uuid.uuid5(warc.NAMESPACE, f'metadata|{source}')}>"
        assert r.headers == {
            "WARC-Type": "metadata", "WARC-Record-ID": own, "WARC-Date": warc.DATE, "WARC-Target-URI": url, "WARC-Refers-To": source, "WARC-Block-Digest": sha1(r.block),
            "Content-Type": "application/warc-fields", "Content-Length": str(len(r.block)),
        }
        assert (d.record_id, d.refers_to, d.target_uri, d.block_digest, d.payload_digest, d.n_bytes, d.block_sha256) == (own, source, url, sha1(r.block), None, len(r.block), hashlib.sha256(r.block).hexdigest())
        linked, titled = linked + bool(about.links), titled + bool(about.title)
    assert linked > len(pages) / 4 and titled > len(pages) / 4
