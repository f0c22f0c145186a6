"""Derived records against their sources, and files read back."""

import glob
import gzip
import html
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremolo.llm import warc
from tremolo.llm.queries import op3_warc

SF = "/root/testdata/sf0.001"


def plain(page):
    """The shown text by patterns instead of a parser; good for well-formed pages."""
    page = re.sub(r"(?is)<(head|script|style|noscript|template|svg|iframe|object)\b.*?</\1\s*>|<!--.*?-->", "", page)
    page = re.sub(rf"(?i)</?({'|'.join(sorted(warc.BLOCKS, key=len, reverse=True))})\b[^>]*>", "\n", page)
    page = html.unescape(re.sub(r"<[^>]*>", "", page))
    return "\n".join(x for x in (" ".join(line.split()) for line in page.split("\n")) if x)


def test_query_links_every_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op3_warc(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    sources = {r.page_id: r for r in warc.responses(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        page, source = pages[r.page_id], sources[r.page_id]
        assert r.refers_to == source.record_id and r.target_uri == page.url and r.refers_to_digest == warc.digest(page.html.encode()) == source.payload_digest
        assert r.block_digest == warc.digest(r.block.encode()) and r.n_bytes == len(r.block.encode())
        if r.warc_type == "metadata":
            assert json.loads(r.block)["Envelope"]["WARC-Header-Metadata"]["WARC-Record-ID"] == source.record_id
        else:
            assert r.block == plain(page.html) and "<p>" not in r.block and "track(0)" not in r.block
    assert len({r.record_id for r in rows}) == len(rows)


def test_files_round_trip(spark, tmp_path):
    records = warc.derive(warc.responses(spark.read.parquet(f"{SF}/pages.parquet")))
    warc.write(records, str(tmp_path / "out"))
    read = [x for f in glob.glob(str(tmp_path / "out/part-*.gz")) for x in warc.parse(gzip.open(f).read())]
    want = {r.record_id: r for r in records.collect()}
    assert len(read) == len(want)
    for head, block in read:
        r = want[head["WARC-Record-ID"]]
        assert block == bytes(r.block) and head == r.headers and head["WARC-Refers-To"] == r.refers_to
        assert (head["WARC-Refers-To-Target-URI"], head["WARC-Refers-To-Date"], head["WARC-Refers-To-Payload-Digest"]) == (r.target_uri, r.warc_date, r.refers_to_digest)


def test_reading_a_page():
    text, facts = warc.read_page("<html lang=de><head><title>A &amp; B</title><style>x</style></head><body><p>One<br>two  &lt;3<script>no()</script><ul><li>a<li><b>b</b>c</ul><a href=/x>l</a>")
    assert text == "One\ntwo <3\na\nbc\nl"
    assert (facts["title"], facts["lang"], facts["links"]) == ("A & B", "de", [{"path": "A@/href", "url": "/x"}])


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "x" * 200000), (2, "u", "x" * 200000), (3, "v", "<p")], "page_id long, url string, html string").selectExpr("*", "1 as block")
    made = warc.derive(warc.responses(pages))
    assert made.count() == 10
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    "odd, text",
    [("a<![foo[bar]]>b", "ab"), ("a<![>b", "ab"), ("a<![CDATA[x>y]]>b", "ab"), ("a<![if IE]>b<![endif]>c", "abc"), ("a<!foo>b<??>c", "abc"), ("a<!-- x", "a<!-- x"), ("a&#xD800;b&#1;", "a\ufffdb"), ("a</>b<p/><", "ab\n<")],
)
def test_malformed_pages(odd, text):
    assert warc.read_page(odd)[0] == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "!", "[", "]", ">", "/", "-", "--", "CDATA", "foo", "if", "&#", "x", ";", " ", "=", '"', "?", "title", "script", "doctype", "\x00", "é"]), max_size=30))
def test_no_page_raises(parts):
    text, facts = warc.read_page("".join(parts))
    json.dumps([text, facts]).encode()


def test_a_bad_page_and_bytes_of_another_character_set(spark):
    pages = spark.createDataFrame([(1, "u", "ok <![foo[bar]]> more"), (2, "v", "<p>fine")], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    assert {r.page_id: bytes(r.block).decode() for r in made.where("warc_type = 'conversion'").collect()} == {1: "ok more", 2: "fine"}
    heads = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none-such\r\n\r\n", b""]
    rows = [(k, "response", f"<urn:{k}>", None, "u", "2024-01-01T00:00:00Z", None, None, None, None, {}, bytearray(h + b"<p>caf\xe9")) for k, h in enumerate(heads)]
    derived = warc.derive(spark.createDataFrame(rows, warc.RECORD)).where("warc_type = 'conversion'").collect()
    assert {r.page_id: bytes(r.block).decode() for r in derived} == {0: "café", 1: "caf\ufffd", 2: "caf\ufffd"}
    assert {r.refers_to_digest for r in derived} == {warc.digest(b"<p>caf\xe9")}
