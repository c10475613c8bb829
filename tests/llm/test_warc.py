"""WARC derivatives: links between records, digests, and files that parse."""

from __future__ import annotations

import gzip
import hashlib
import json
import re

from trailweave.llm import queries
from trailweave.llm.warc import derive, write_warc

HTML = '<html><head><title> A &amp; B </title><script>var x</script></head><body><h1>Head</h1><p>one  <b>two</b></p><!-- no --><a href="/x">link</a>é</body></html>'
ROWS = [(1, "http://a/", HTML), (2, None, ""), (3, "http://c/", None), (None, "http://d/", "<p>x"), (1, "http://a/", HTML), (5, "http://e/", "<p>" + "long " * 50_000)]


def test_records_name_their_source(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, content string, id int")
    got = derive(pages).collect()
    assert len(got) == 2 * len(ROWS)
    for r in got:
        html = next(h for i, _, h in ROWS if i == r.id) or ""
        assert r.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.content.encode()).hexdigest()
        assert r.content_length == len(r.content.encode())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
    own = {r.warc_type: r for r in got if r.id == 1}
    meta = json.loads(own["metadata"].content)
    assert own["metadata"].refers_to == own["conversion"].refers_to
    assert meta["conversion"] == own["conversion"].record_id
    assert meta["links"] == ["/x"]
    assert own["conversion"].content == "Head\none two\nlinké"
    assert len({r.refers_to for r in got}) == 5


def test_links_in_all_quotings(spark):
    html = """<a href="/a'b">1</a><a class=x href='/c"d?e=1'>2</a><A HREF = /f?g=1&h=2 id=y>3</A><a href=/i>4</a><a href=''>5</a><a name="no">6</a>"""
    got = derive(spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")).where("warc_type = 'metadata'").first()
    assert json.loads(got.content)["links"] == ["/a'b", '/c"d?e=1', "/f?g=1&h=2", "/i", ""]


def test_own_identifiers_and_headers_stay(spark):
    df = spark.createDataFrame([(1, "http://a/", "x", "<urn:uuid:own>", "Content-Type: text/html")], "page_id long, url string, html string, rid string, head string")
    got = derive(df, record_id_col="rid", headers_col="head").collect()
    assert {r.refers_to for r in got} == {"<urn:uuid:own>"}
    assert json.loads(next(r.content for r in got if r.warc_type == "metadata"))["headers"] == "Content-Type: text/html"


def test_written_files_parse(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    write_warc(derive(pages), str(tmp_path / "w"), "2024-01-01T00:00:00Z")
    records = 0
    for path in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert b"sha256:" + hashlib.sha256(rest[:n]).hexdigest().encode() == re.search(rb"WARC-Block-Digest: (\S+)", head)[1]
            assert rest[n : n + 4] == b"\r\n\r\n"
            data, records = rest[n + 4 :], records + 1
    assert records == 2 * len(ROWS)


def test_an_empty_table(spark):
    assert derive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query_matches_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.op8_warc_derivatives(spark, sf_dir), queries.SQL["op8_warc_derivatives"])
