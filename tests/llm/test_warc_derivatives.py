import hashlib

from tandem.llm import warc_derivatives as W

HTML = """<!DOCTYPE html><head><title> A &amp;
 B</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t="</p>";</script>
<nav><a href="/x">X</a><a href="/x">again</a> <A  HREF="/y?a=1&amp;b">Y</A></nav><p>One&nbsp;<b>two</b>
three<br>four</p><p> </p>1 < 2</body>"""


def made(spark, rows):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_id string")
    return W.derivatives(W.responses_from_pages(pages)).collect()


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_linked_records(spark):
    got = {r.record_type: r for r in made(spark, [(1, "http://a/b", HTML)])}
    meta, text = got["metadata"], got["conversion"]
    assert text.block == "X again Y\nOne two three\nfour\n1 < 2".replace("X again", "Xagain")
    assert meta.refers_to == text.refers_to and len({meta.record_id, text.record_id, meta.refers_to}) == 3
    assert meta.source_payload_digest == text.source_payload_digest == sha(HTML)
    header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(HTML.encode())}\r\n\r\n"
    assert meta.source_block_digest == sha(header + HTML) and text.block_digest == sha(text.block)
    assert "title: A & B\r\n" in meta.block and meta.block.count("outlink: ") == 2 and "http-status: HTTP/1.1 200 OK\r\n" in meta.block
    for r in got.values():
        head, _, rest = r.record.partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert head.startswith("WARC/1.1\r\n") and fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Target-URI"] == "http://a/b"
        assert int(fields["Content-Length"]) == len(r.block.encode()) and rest == r.block + "\r\n\r\n"
        assert fields["WARC-Source-Payload-Digest"] == sha(HTML) and fields["WARC-Type"] == r.record_type


def test_hard_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>é😀" * 30_000), (2, "u", "no tags"), (2, "u", "no tags"), (3, "u", "<script>never closed <p>x")]
    got = made(spark, rows)
    assert len(got) == 2 * len(rows)
    assert {r.block for r in got if r.page_id == 1 and r.record_type == "conversion"} == {""}
    assert len({r.record_id for r in got}) == 2 * (len(rows) - 1)
    assert made(spark, []) == []


def test_references_are_decoded_once(spark):
    cases = {
        "a &lt;b&gt; &amp;lt; &#38;lt; &amp;#39;": "a <b> &lt; &lt; &#39;", "&#39;&#x27;&#X1F600;&#233;&nbsp;&copy;": "''😀é ©", "&#0;&#xD800;&#9999999;": "\ufffd" * 3,
        "&unknown; & &; &#; &#x; x&amp": "&unknown; & &; &#; &#x; x&amp", "": "", "no": "no", "&amp;": "&",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", W.decoded_entities(df.t).alias("d")).collect()} == cases


def test_line_breaks_end_no_field(spark):
    got = {r.record_type: r for r in made(spark, [(1, "http://a/\r\nWARC-Type: x\n/b", '<a href="/x\r\noutlink: /no"><title>a\r\nb</title>')])}
    for r in got.values():
        head = r.record.partition("\r\n\r\n")[0].split("\r\n")
        assert len(head) == 10 and "WARC-Target-URI: http://a/WARC-Type: x/b" in head
    assert "outlink: /xoutlink: /no\r\n" in got["metadata"].block and "title: a b\r\n" in got["metadata"].block and got["metadata"].block.count("outlink: /") == 2
