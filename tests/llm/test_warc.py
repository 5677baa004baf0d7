"""Derivatives against a plain Python version."""

import gzip
import hashlib

from tables import SF

from clearwright.llm import warc
from clearwright.llm.queries import QUERIES

HTML = '<html lang="fr"><head><title> A &amp; B </title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x\ny --><p>One<br>two &lt;3&gt;</p>\n<p>  three <a class="k" href="/a?b=1&amp;c=2">four</a></p></body></html>'


def responses(spark, rows):
    return spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string, block string")


def test_records(spark):
    got = {r.record_type: r for r in warc.derivatives(responses(spark, [("<urn:uuid:1>", "http://e.org/", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX: y", HTML, "clash")])).collect()}
    meta, text = got["metadata"], got["conversion"]
    assert text.block == "A & B \nOne\ntwo <3> \nthree four".replace(" \n", "\n")
    assert meta.block == "title: A & B\r\nlanguage: fr\r\noutlink: /a?b=1&c=2\r\n"
    for r in got.values():
        assert r.refers_to == "<urn:uuid:1>" and r.source_headers.endswith("X: y")
        assert r.source_digest == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
    assert meta.record_id != text.record_id


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None, None, None), ("<urn:uuid:2>", "u", "d", "h", "", None), ("<urn:uuid:2>", "u", "d", "h", "", None), ("<urn:uuid:3>", "u", "d", "h", "<p>" * 20_000, None)]
    got = warc.derivatives(responses(spark, rows)).collect()
    assert len(got) == 8 and all(r.block == "" and r.content_length == 0 for r in got if r.record_type == "conversion")
    assert warc.derivatives(responses(spark, rows).limit(0)).collect() == []


def test_written_records_can_be_parsed(spark, tmp_path):
    records = warc.derivatives(warc.responses_of_pages(spark.read.parquet(f"{SF}/pages.parquet"))).limit(30)
    want = {r.record_id: r for r in records.collect()}
    warc.write_warc(records, str(tmp_path / "w"))
    data, seen = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("*.gz"))), 0
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block, data = data[:size], data[size:]
        assert lines[0] == "WARC/1.1" and data[:4] == b"\r\n\r\n"
        data = data[4:]
        r = want[fields["WARC-Record-ID"]]
        assert block.decode() == r.block and fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Type"] == r.record_type
        seen += 1
    assert seen == len(want)


def test_query(spark):
    got = QUERIES["op1_warc_derivatives"](spark, SF)
    assert got.count() == 2 * spark.read.parquet(f"{SF}/pages.parquet").count()


def test_references_and_attribute_forms():
    page = "<HTML class=x lang='pt-BR'><title>&Eacute;t&#233; &#x26; &amp;copy;</title><a href=/x?a=1&amp;b=2>&copy;&middot;&nbsp;&hellip;</a><a title=t href = '/y'>&lt;b&gt;</a><a name=n>&unknown; &</a>"
    assert warc.read_page(page) == ("Été & &copy;", "pt-BR", ["/x?a=1&b=2", "/y"], "Été & &copy;\n©· … <b> &unknown; &")


def test_what_is_not_closed():
    assert warc.read_page("a<script>b<p>c") == ("", "", [], "a b c")
    assert warc.read_page("a<!-- b <i>c</i>") == ("", "", [], "a c")
    assert warc.read_page("a < b") == ("", "", [], "a < b")
    assert warc.read_page("<title>x<p>y")[3] == "x y"
    assert warc.read_page("a<!-->b--> c<style>p</style>d")[3] == "a c d"
    for part in ("<script>", "<!--", "<title>", "<", "<a href='"):
        warc.read_page(part * 200_000)  # linear


def test_no_reference_of_the_given_pages_stays(spark):
    blocks = [r.block for r in QUERIES["op1_warc_derivatives"](spark, SF).collect() if r.record_type == "conversion"]
    assert blocks and not any(x in b for b in blocks for x in ("&copy;", "&middot;", "&amp;", "&quot;")) and any("©" in b for b in blocks)
