import pytest

from tandem.llm import warc_derivatives as W

HTTP = "HTTP/1.1 200 OK\r\nServer: s\r\ncontent-type: text/html\r\nLast-Modified: Mon, 01 Jan 2024 00:00:00 GMT\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n\t two\r\nContent-Length: 2\r\n\r\n"
WARC = "WARC/1.1\r\nWARC-Type: response\r\nWARC-IP-Address: 192.0.2.1\r\nWARC-Concurrent-To: <urn:uuid:x>\r\n\r\n"


LINKS = """<a class="x" href="/1">a</a><A
    title='href="/no"' HREF = '/2?a="b"'>b</A><a href=/3 rel=nofollow>c</a><a/href="/4"><a data-href="/no" id=k href="/5"><a class="c"href="/6">
    <abbr href="/no"><a name="here">d</a><link href="/no"><a href="/1"><a =x href="/7"><a href="/8"""


def test_every_source_header_is_kept_in_order(spark):
    rows = [(1, "<r>", "http://a", "2024-01-01T00:00:00Z", HTTP, "hi", WARC), (2, "<s>", "http://b", "2024-01-01T00:00:00Z", None, "hi", None)]
    responses = spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, date string, http_header string, body string, warc_header string")
    got = {(r.page_id, r.record_type): r for r in W.derivatives(responses).collect()}
    of = lambda i, name: [x[len(name) + 2 :] for x in got[i, "metadata"].block.split("\r\n") if x.startswith(name + ": ")]
    assert of(1, "http-header") == ["Server: s", "content-type: text/html", "Last-Modified: Mon, 01 Jan 2024 00:00:00 GMT", "Set-Cookie: a=1", "Set-Cookie: b=2", "X-Long: one two", "Content-Length: 2"]
    assert of(1, "warc-header") == ["WARC-Type: response", "WARC-IP-Address: 192.0.2.1", "WARC-Concurrent-To: <urn:uuid:x>"]
    assert of(1, "http-content-type") == ["text/html"] and of(2, "http-header") == of(2, "warc-header") == []
    for kind in ("metadata", "conversion"):
        assert (got[1, kind].source_http_header, got[1, kind].source_warc_header) == (HTTP, WARC)
    made = W.derivatives(W.responses_from_pages(spark.createDataFrame([(1, "u", "hi")], "page_id long, url string, html string"))).collect()
    assert all("Content-Length: 2\r\n" in r.source_http_header for r in made)


def test_headers_like_made_ones_are_kept(spark):
    made = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
    rows = [(n, f"<{n}>", "http://a", "2024-01-01T00:00:00Z", made.format(n), "four") for n in (4, 5)]
    responses = spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, date string, http_header string, body string")
    for r in W.derivatives(responses).filter("record_type = 'metadata'").collect():
        lines = [x for x in r.block.split("\r\n") if x.startswith("http-header: ")]
        assert lines == ["http-header: Content-Type: text/html; charset=utf-8", f"http-header: Content-Length: {r.page_id}"]


def test_sql_finds_links_like_the_operator(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pages = [(1, "u", LINKS), (2, "u", None), (3, "u", "<a\nHREF='x y'>&amp;</a><a href=>n</a><a\thref = z/>"), (4, None, '<a href=""><a id href="q">')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = W.op10_warc_derivatives(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(W.ORACLE).df()
    key = ["page_id", "record_type"]
    assert got.sort_values(key).reset_index(drop=True).equals(want[got.columns].sort_values(key).reset_index(drop=True))


def test_links_with_any_attributes_and_quotes(spark):
    html = LINKS + '"><a ' + "k='v' " * 50_000 + 'href="/9">'
    links = spark.createDataFrame([(html,)], "h string").select(W.outlinks_of("h").alias("l")).first().l
    assert links == [f"/{i}" if i != 2 else '/2?a="b"' for i in range(1, 10)]
