"""WARC derivatives: metadata and plain-text conversion records of responses.

For each response record (id, target, date, HTTP header and body) two records
are made, both tied to it by ``WARC-Refers-To``:

* ``metadata``: warc-fields with the source's digests, HTTP status line, content
  type, title and outlinks, and every header of the source in order: WARC headers
  as ``warc-header``, HTTP headers as ``http-header``;
* ``conversion``: the page's text as text/plain.

Both keep the source's target, date and digests (``source_block_digest``,
``source_payload_digest``), have their own block digest and an id of their own,
which follows from the source's id and the block, so a second run makes the same
records. Record bytes follow WARC/1.1. Functions of DataFrames only, no shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Responses made from pages have this capture date unless the caller says otherwise.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made of a hash of the parts."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def made_header(body: Column) -> Column:
    """The HTTP header given to a page, which has none of its own."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body), F.lit(CRLF + CRLF))


def header_lines(header: Column) -> Column:
    """The lines of a header in order, without the first one; folded lines are joined."""
    unfolded = F.regexp_replace(header, r"\r?\n[ \t]+(?=[^ \t\r\n])", " ")
    lines = F.split(unfolded, r"\r?\n")
    return F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x) != "")


def responses_from_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (page_id, record_id, target_uri, date, http_header, body) of page_id, url, html; a null html is an empty body."""
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    return pages.select("page_id", record_id(F.lit("response"), url, F.coalesce(F.col("page_id").cast("string"), F.lit("")), body).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), made_header(body).alias("http_header"), body.alias("body"))


#: Named character references that are decoded.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·", "amp": "&"}
#: A numeric or named reference; the group is what stands between ampersand and semicolon.
REFERENCE = f"&(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(NAMED)});"


def decoded_entities(text: Column) -> Column:
    """Numeric and the common named character references decoded, each once; numbers that are no character become U+FFFD."""

    def char(name: Column) -> Column:
        digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
        code = digits.cast("int")
        good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
        return F.when(F.startswith(name, F.lit("#")), numeric).otherwise(named[name])

    chars = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), char)
    joined = F.array_join(F.zip_with(F.split(text, REFERENCE), chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def one_line(value: Column) -> Column:
    """A value without line breaks, which would end its field."""
    return F.regexp_replace(value, "[\r\n]+", "")


def stripped(html: Column) -> Column:
    """Text without markup, blocks on lines of their own; references as they are."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>", " ")
    t = F.regexp_replace(t, r"[ \t\r\n\f]+", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", "\n")
    return F.regexp_replace(t, r"<[!/?A-Za-z][^>]*>", "")


def tidied(text: Column) -> Column:
    """No blanks at the ends of lines, no empty lines."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" *\n[ \n]*", "\n"), r"\A[ \n]+", ""), r"[ \n]+\z", "")


def raw_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


#: A link up to its target: attributes other than href, then href with its value in either quotes or none. Possessive, so that long tags need no stack.
LINK = r"""(?i)<a(?=[\s/])(?:[\s/]*+(?!href\s*+=)[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+[\s/]*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""


def outlinks_of(html: Column) -> Column:
    """Targets of links as written, less tabs and line breaks, each once, in order of appearance; href may stand anywhere in the tag, in either quotes or none."""
    bare = lambda u: F.when(F.substring(u, 1, 1).isin('"', "'"), F.substring(u, F.lit(2), F.length(u) - 2)).otherwise(u)
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda u: F.regexp_replace(bare(u), "[\t\r\n]+", "")))


def record_bytes(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response: page_id, record_type, record_id, refers_to, target_uri, date, the source's headers and digests, the own digest, block, record.

    ``record`` is the whole record as text. The source's headers are whole in
    ``source_http_header`` and ``source_warc_header``; the latter is empty unless
    ``responses`` have a column ``warc_header`` (version line and named fields as
    in the file). Metadata name all of them, in order. Null headers, body, target
    or date are empty; every row of a response is taken, also repeated ones (their
    records have equal ids); line breaks in a target, id, date or link are left out;
    other columns are ignored; no responses, no records.
    """
    names = ("record_id", "target_uri", "date", "http_header", "body")
    warc_header = F.coalesce("warc_header", F.lit("")) if "warc_header" in responses.columns else F.lit("")
    fields = {"record_id", "target_uri", "date"}
    source = responses.select("page_id", *[(one_line if n in fields else lambda x: x)(F.coalesce(n, F.lit(""))).alias(n) for n in names], warc_header.alias("warc_header"))
    source = source.select(
        "*",
        digest(F.concat("http_header", "body")).alias("source_block_digest"),
        digest(F.col("body")).alias("source_payload_digest"),
        stripped(F.col("body")).alias("text"),
        raw_title(F.col("body")).alias("title"),
        outlinks_of(F.col("body")).alias("outlinks"),
    )
    # A step of its own, as references are looked at more than once.
    source = source.withColumns({"text": decoded_entities(F.col("text")), "title": decoded_entities(F.col("title"))})
    source = source.withColumns({"text": tidied(F.col("text")), "title": folded(F.col("title"))})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.replace(value, F.lit("\r"), F.lit("")), F.lit(CRLF))
    status = F.regexp_extract("http_header", r"\A([^\r\n]*)", 1)
    content_type = F.regexp_extract("http_header", r"(?i)\r\ncontent-type: *([^\r\n]*)", 1)
    meta = F.concat(
        line("source-block-digest", F.col("source_block_digest")),
        line("source-payload-digest", F.col("source_payload_digest")),
        line("http-status", status),
        line("http-content-type", content_type),
        F.array_join(F.transform(header_lines(F.col("warc_header")), lambda x: line("warc-header", x)), ""),
        F.array_join(F.transform(header_lines(F.col("http_header")), lambda x: line("http-header", x)), ""),
        line("title", F.col("title")),
        F.array_join(F.transform("outlinks", lambda u: line("outlink", u)), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    each = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_header").alias("source_http_header"), F.col("warc_header").alias("source_warc_header"), "source_block_digest", "source_payload_digest", F.explode(kinds).alias("k")).select("*", "k.*").drop("k")
    each = each.withColumn("block_digest", digest(F.col("block"))).withColumn("record_id", record_id(F.col("refers_to"), F.col("record_type"), F.col("block_digest")))
    fields = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"),
    ]
    return each.withColumn("record", record_bytes([(n, F.col(c)) for n, c in fields], F.col("block")))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, links, source headers and digests of the derivatives of all pages."""
    made = derivatives(responses_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "source_http_header", "source_block_digest", "source_payload_digest", "block_digest",
        F.length("block").cast("long").alias("block_chars"), F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"),
    )


def _uuid(parts: str) -> str:
    h = f"md5({parts})"
    return f"'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_NAMED = " ".join(f"WHEN '{name}' THEN '{char.replace(chr(39), chr(39) * 2)}'" for name, char in NAMED.items())
_CODE = "(CASE WHEN lower(substr(e, 2, 1)) = 'x' THEN ('0x' || substr(e, 3))::INT ELSE substr(e, 2)::INT END)"
_CHAR = f"""(CASE WHEN e[1] = '#' THEN CASE WHEN {_CODE} BETWEEN 1 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111 THEN chr({_CODE}) ELSE chr(65533) END ELSE CASE e {_NAMED} END END)"""
#: References decoded; the argument stands once.
_ENTITIES = f"""(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(c[i], '')), '') FROM (
      SELECT regexp_split_to_array(t, '{REFERENCE}') AS p, list_transform(regexp_extract_all(t, '{REFERENCE}', 1), lambda e: {_CHAR}) AS c FROM (SELECT @ AS t)))"""


def _decoded(sql: str) -> str:
    return _ENTITIES.replace("@", sql)


_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', ' ', 'gis'),
    '[ \t\r\n\f]+', ' ', 'g'), '</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>', chr(10), 'gi'), '<[!/?A-Za-z][^>]*>', '', 'g')"""

#: An attribute of a tag and a tag of links, for SQL: all attributes are read, then the first href is taken.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*))?"""
_HREFS = rf"""list_filter([list_filter(regexp_extract_all(tag[3:], '{_ATTRIBUTE}'), lambda a: regexp_matches(a, '^href\s*=\s*[^\s>]', 'i'))[1]
      FOR tag IN regexp_extract_all(body, '<a[\s/](?:[\s/]*{_ATTRIBUTE})*', 0, 'i')], lambda a: a IS NOT NULL)"""

ORACLE = rf"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS header,
    chr(13) || chr(10) AS crlf
  FROM pages),
parts AS (
  SELECT *, {_uuid("'response' || chr(10) || uri || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || body")} AS refers_to,
    'sha256:' || sha256(header || body) AS source_block_digest, 'sha256:' || sha256(body) AS source_payload_digest,
    regexp_replace(regexp_replace(regexp_replace({_decoded(_STRIPPED)}, ' *\n[ \n]*', chr(10), 'g'), '\A[ \n]+', ''), '[ \n]+\z', '') AS txt,
    trim(regexp_replace({_decoded(r"regexp_extract(body, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is')")}, '[ \t\r\n\f]+', ' ', 'g')) AS title,
    [regexp_replace(regexp_replace(regexp_replace(a, '^href\s*=\s*', '', 'i'), '^"(.*)"$|^''(.*)''$', '\1\2', 's'), '[\t\r\n]+', '', 'g') FOR a IN {_HREFS}] AS links
  FROM source),
blocks AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, txt AS block FROM parts
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields', 'source-block-digest: ' || source_block_digest || crlf || 'source-payload-digest: ' || source_payload_digest || crlf
    || 'http-status: HTTP/1.1 200 OK' || crlf || 'http-content-type: text/html; charset=utf-8' || crlf
    || 'http-header: Content-Type: text/html; charset=utf-8' || crlf || 'http-header: Content-Length: ' || strlen(body) || crlf || 'title: ' || title || crlf
    || array_to_string([ 'outlink: ' || u || crlf FOR u, i IN links IF list_position(links, u) = i ], '') FROM parts),
ided AS (SELECT *, 'sha256:' || sha256(block) AS block_digest FROM blocks),
named AS (SELECT *, {_uuid("refers_to || chr(10) || record_type || chr(10) || block_digest")} AS record_id FROM ided)
SELECT page_id, record_type, record_id, refers_to, uri AS target_uri, header AS source_http_header, source_block_digest, source_payload_digest, block_digest, length(block)::BIGINT AS block_chars,
  sha256('WARC/1.1' || crlf || 'WARC-Type: ' || record_type || crlf || 'WARC-Record-ID: ' || record_id || crlf || 'WARC-Refers-To: ' || refers_to || crlf || 'WARC-Target-URI: ' || uri || crlf
    || 'WARC-Date: {DATE}' || crlf || 'WARC-Block-Digest: ' || block_digest || crlf || 'WARC-Source-Payload-Digest: ' || source_payload_digest || crlf || 'Content-Type: ' || content_type || crlf
    || 'Content-Length: ' || strlen(block) || crlf || crlf || block || crlf || crlf) AS record_sha256
FROM named
"""
