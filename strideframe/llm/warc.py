"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives one ``metadata`` record (fields of its HTTP headers, title, language and counts of links) and one
``conversion`` record (its text).  Both name the response in WARC-Refers-To and keep its target URI,
date and payload digest; their own blocks are digested, and identifiers are name-based, so a second run
gives the same records.  One pass over the input: pages are read in Arrow batches, records and digests are column
expressions; no shuffle.

Text: comments, scripts, styles and the head go; block elements end a line; other tags go; entities
(the names below and all numeric ones) are decoded; white space is closed up.

Defined cases: a null payload is an empty one; a null URI or id is written as an empty field and still gets
records; a broken numeric entity stays as it is; very long pages are one value each; rows that repeat a response give
equal records; an empty table gives no records; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table

# Named entities and block elements.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "euro": "€"}
BLOCKS = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul"
DATE = "1970-01-01T00:00:00Z"

_DROPPED = [r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?is)<head\b[^>]*>.*?</head\s*>"]
_BLOCK = rf"(?i)</?(?:{'|'.join(BLOCKS.split())})\b[^>]*>"
_TAG = r"</?[a-zA-Z!?][^>]*>"
_SPACES = r"[ \t\x0B\f\r\x{00A0}]+"
_BLANKS = "\t\x0b\f\r\xa0"
_NUMERIC = (r"&#([0-9]{1,7});", r"&#[xX]([0-9a-fA-F]{1,6});")
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_LANG = r"""(?i)<html\b[^>]*\blang=["']?([a-zA-Z-]+)"""
_LINK = r"(?i)<a\s[^>]*href="
_DROP, (_BLOCK_TAG, _ANY_TAG, _TITLE_TAG, _LANG_TAG, _LINK_TAG) = ([re.compile(p, re.A) for p in x] for x in (_DROPPED, (_BLOCK, _TAG, _TITLE, _LANG, _LINK)))
_REFERENCES = tuple((re.compile(p.replace("(", "").replace(")", "")), base) for p, base in zip(_NUMERIC, (10, 16)))
SLICE = 256


def _closed_up(text: str) -> str:
    """One blank for each run of blanks, no blanks at line ends, no empty lines."""
    for blank in _BLANKS:
        text = text.replace(blank, " ")
    for run, one in (("  ", " "), (" \n", "\n"), ("\n ", "\n"), ("\n\n", "\n")):
        while run in text:
            text = text.replace(run, one)
    return text.strip(" \n")


def _decoded(text: str) -> str:
    """Entities as characters; the ampersand comes last, so that nothing is decoded twice."""
    if "&" not in text:
        return text
    for name, char in ENTITIES.items():
        text = text.replace(f"&{name};", char)
    for pattern, base in _REFERENCES:
        for ref in dict.fromkeys(pattern.findall(text)) if "&#" in text else ():
            code = int(ref.strip("&#xX;"), base)
            if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
                text = text.replace(ref, chr(code))
    return text.replace("&amp;", "&")


def _without_tags(html: str) -> str:
    for pattern in _DROP:
        html = pattern.sub(" ", html)
    return _ANY_TAG.sub("", _BLOCK_TAG.sub("\n", html))


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns of each response with its text, title, language and number of links."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            texts, titles, langs, links = [], [], [], []
            for html in batch.column("payload").to_pylist():
                html = html or ""
                title, lang = _TITLE_TAG.search(html), _LANG_TAG.search(html)
                texts.append(_closed_up(_decoded(_without_tags(html))))
                titles.append(_closed_up(_decoded(title[1].replace("\n", " "))) if title else "")
                langs.append(lang[1] if lang else "")
                links.append(len(_LINK_TAG.findall(html)))
            kept = batch.select([n for n in batch.schema.names if n != "payload"])
            made = [pa.array(x, pa.string()) for x in (texts, titles, langs)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made, pa.array(links, pa.int64())], [*kept.schema.names, "text", "title", "lang", "links"])


def record_uuid(*parts: Column) -> Column:
    """A name-based identifier: the MD5 digest of the parts with the marks of version 3."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a page table: source_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest."""
    payload = F.coalesce(F.col(html), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        F.col(page_id).alias("source_id"), record_uuid(F.lit("response"), F.col(page_id), F.col(url)).alias("record_id"), F.coalesce(F.col(url), F.lit("")).alias("target_uri"),
        F.lit(date).alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"), _digest(payload).alias("payload_digest"),
    )


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response: source_id, warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, payload_digest, header, block."""
    named = ["source_id", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest"]
    kinds = dict(source.dtypes)
    text = source.select(*named, "payload").mapInArrow(_read_pages, ", ".join(f"{c} {kinds[c]}" for c in named) + ", text string, title string, lang string, links long")
    fields = F.concat(
        F.lit("title: "), F.col("title"), F.lit("\r\nlanguage: "), F.col("lang"), F.lit("\r\nlinks: "), F.col("links").cast("string"),
        F.lit("\r\ncharacters: "), F.length("text").cast("string"), F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\nsource-http-headers: "),
        F.regexp_replace("http_headers", "\r\n", "\r\n\t"), F.lit("\r\n"),
    )
    both = text.select("*", F.inline(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )))
    out = both.select(
        "source_id", "warc_type", record_uuid(F.col("warc_type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), _digest(F.col("block")).alias("block_digest"), "payload_digest", "block",
    )
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    header = F.concat(F.lit("WARC/1.1"), *[F.concat(F.lit(f"\r\n{label}: "), F.col(c).cast("string")) for label, c in names])
    return out.withColumn("header", header)


def response_records(source: DataFrame) -> DataFrame:
    """header and block of the responses themselves."""
    block = F.concat("http_headers", F.lit("\r\n\r\n"), "payload")
    names = [("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest")]
    header = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response"), *[F.concat(F.lit(f"\r\n{label}: "), F.col(c)) for label, c in names], F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"))
    return source.select(header.alias("header"), block.alias("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file per task below ``path``, through Spark's own writer."""
    records.select(F.concat("header", F.lit("\r\n\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as header and block; ``intact`` says that the block has the length that its header names.

    Files are cut where a version line follows an empty line, so a block that holds such a line is read as not intact.
    """
    rows = spark.read.option("lineSep", "\r\n\r\nWARC/1.1\r\n").text(path)
    whole = F.regexp_replace(F.col("value"), r"\A(?:\s*WARC/1\.1\r\n)?", "WARC/1.1\r\n")
    cut = rows.select(whole.alias("value"), F.instr(whole, "\r\n\r\n").alias("at"))
    header = F.when(F.col("at") > 0, F.substring("value", F.lit(1), F.col("at") - 1)).otherwise(F.col("value"))
    rest = F.when(F.col("at") > 0, F.substring("value", F.col("at") + 4, F.length("value"))).otherwise(F.lit(""))
    size = F.regexp_extract("header", r"(?m)^Content-Length: (\d+)\r?$", 1).try_cast("long")
    parts = cut.select(header.alias("header"), rest.alias("rest")).select("header", "rest", size.alias("size"))
    # the last record of a file still has its end
    last = (F.octet_length("rest") == F.col("size") + 4) & F.endswith("rest", F.lit("\r\n\r\n"))
    block = F.when(last, F.substring("rest", F.lit(1), F.length("rest") - 4)).otherwise(F.col("rest"))
    return parts.select("header", block.alias("block"), F.coalesce(F.octet_length(block) == F.col("size"), F.lit(False)).alias("intact"))


def _sql_entities(text: str) -> str:
    for name, char in ENTITIES.items():
        text = f"replace({text}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def _sql_closed(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({text}, '{_SPACES}', ' ', 'g'), ' ?\n ?', '\n', 'g'), '\n+', '\n', 'g'), ' ' || chr(10))"


def _sql_decoded(text: str) -> str:
    out = _sql_entities(text)
    for pattern, value in zip(_NUMERIC, ("try_cast({} AS INT)", "try_cast('0x' || {} AS INT)")):
        code = value.format("regexp_extract(r, '([0-9a-fA-F]+);$', 1)")
        out = f"list_reduce(list_distinct(regexp_extract_all({out}, '{pattern}')), lambda t, r: CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN replace(t, r, chr({code})) ELSE t END, {out})"
    return f"replace({out}, '&amp;', '&')"


def _sql_uuid(value: str) -> str:
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] || '>' FROM (SELECT md5({value}) AS h))"


_DROP_SQL = "payload"
for _p in _DROPPED:
    _DROP_SQL = f"regexp_replace({_DROP_SQL}, '{_p}', ' ', 'g')"
ORACLE = rf"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, {_sql_uuid("'response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '')")} AS refers_to, coalesce(html, '') AS payload,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) AS headers FROM pages),
s AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest, regexp_replace(regexp_replace({_DROP_SQL}, '{_BLOCK}', chr(10), 'g'), '{_TAG}', '', 'g') AS bare,
  regexp_replace(regexp_extract(payload, '{_TITLE}', 1), chr(10), ' ', 'g') AS bare_title, regexp_extract(payload, '{_LANG.replace(chr(39), chr(39) * 2)}', 1) AS lang FROM r),
t AS (SELECT *, {_sql_closed(_sql_decoded('bare'))} AS text, {_sql_closed(_sql_decoded('bare_title'))} AS title FROM s),
b AS (SELECT *, 'metadata' AS warc_type, 'title: ' || title || chr(13) || chr(10) || 'language: ' || lang || chr(13) || chr(10) || 'links: ' || len(regexp_extract_all(payload, '(?i)<a\s[^>]*href=')) || chr(13) || chr(10)
  || 'characters: ' || length(text) || chr(13) || chr(10) || 'source-payload-digest: ' || payload_digest || chr(13) || chr(10) || 'source-http-headers: ' || replace(headers, chr(13) || chr(10), chr(13) || chr(10) || chr(9)) || chr(13) || chr(10) AS block FROM t
  UNION ALL SELECT *, 'conversion', text FROM t)
SELECT page_id, warc_type, {_sql_uuid("warc_type || chr(10) || refers_to")} AS record_id, refers_to, target_uri, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest FROM b
"""


@query("op4_warc_derivatives", ORACLE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The derived records of all pages, blocks as their digests."""
    records = derivatives(responses(table(spark, folder, "pages")))
    return records.select(F.col("source_id").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "payload_digest")
