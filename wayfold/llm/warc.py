"""WARC derivatives: a metadata and a plain-text conversion record for every response.

Both point back with ``WARC-Refers-To`` (id, target and date of the response) and
have ids that follow from it, so a second run makes the same records. The metadata
block repeats the source's HTTP headers and digests; the conversion block is the
page's text. All of it is built-in functions; one pass, no shuffle.

Null or empty payload: a response of length 0, hence an empty text. Null targets,
dates or headers: the field is left out. Null record ids: no link can be made, so
the response has no derivatives. Repeated rows give repeated records with one id.
Empty table: no rows. Extra columns are kept if asked for by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is no text, and elements that begin a line.
SILENT = ("script", "style", "noscript", "template")
LINES = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|th|thead|title|tr|ul"
#: Named signs that texts use; the ampersand comes last.
SIGNS = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))
#: Records of a file, at most: the reader takes a file whole.
RECORDS_PER_FILE = 20_000

#: (pattern, replacement) from page to text, in order; both engines read them alike.
STEPS = (
    *((rf"(?is)<{t}(?:[ \t\r\n/][^>]*)?>.*?</{t}[ \t\r\n]*>", " ") for t in SILENT), (r"(?s)<!--.*?-->", " "),
    (rf"(?i)</?(?:{LINES})(?:[ \t\r\n/][^>]*)?>", "\n"), (r"<[a-zA-Z/!?][^>]*>", ""),
)
TIDY = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))


def _text(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    for sign, to in SIGNS:
        out = F.replace(out, F.lit(sign), F.lit(to.replace("''", "'")))
    for pattern, to in TIDY:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return out


def _urn(name: Column) -> Column:
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload of a plain crawl table."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return pages.select(
        "page_id", _urn(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), F.col("url"))).alias("record_id"), F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"), head.alias("http_headers"), body.alias("payload"))


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """warc_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest, source_digest, block."""
    body = F.coalesce("payload", F.lit(""))
    base = responses.filter("record_id IS NOT NULL").select(
        *keep, F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", _digest(body).alias("source_digest"), F.octet_length(body).alias("source_length"),
        _text(body).alias("plain"), F.regexp_extract(body, r"(?is)<title[^>]*>([^<]*)</title", 1).alias("title"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"))  # null with its value

    headers = F.filter(F.split("http_headers", "\r\n"), lambda h: F.contains(h, F.lit(": ")))
    fields = F.concat_ws(
        "\r\n", line("source-payload-digest", F.col("source_digest")), line("source-content-length", F.col("source_length")), line("title", F.nullif(F.trim("title"), F.lit(""))),
        line("text-length", F.length("plain")), F.concat_ws("\r\n", F.transform(headers, lambda h: F.concat(F.lit("http-header: "), h))))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(fields, F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")))
    rows = base.select(*keep, "refers_to", "target_uri", "date", "source_digest", F.explode(made).alias("r")).select(*keep, "refers_to", "target_uri", "date", "source_digest", "r.*")
    return rows.select(
        *keep, "warc_type", _urn(F.concat_ws(" ", "warc_type", "refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), _digest(F.col("block")).alias("block_digest"), "source_digest", "block")


def record_text(r: DataFrame) -> Column:
    """A whole record but for the blank lines that end it."""
    def line(name: str, column: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.col(column).cast("string"))

    return F.concat(
        F.concat_ws(
            "\r\n", F.lit("WARC/1.1"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Refers-To-Target-URI", "target_uri"),
            line("WARC-Refers-To-Date", "date"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"), line("WARC-Block-Digest", "block_digest"), line("WARC-Source-Payload-Digest", "source_digest"),
            line("Content-Type", "content_type"), line("Content-Length", "content_length")),
        F.lit("\r\n\r\n"), F.col("block"))


def write(records: DataFrame, folder: str) -> None:
    """Gzipped WARC files."""
    records.select(record_text(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """headers (map, names in lower case) and block of every record under a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                data, at = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw, 0
                heads, blocks = [], []
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    lines = data[at:end].decode().split("\r\n")
                    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                    at = end + 4 + int(head["content-length"])
                    heads.append(list(head.items()))
                    blocks.append(data[end + 4 : at])
                    at += 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], names=["headers", "block"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, "headers map<string,string>, block binary")


def _sql(text: str, steps, global_: str = ", 'g'") -> str:
    for pattern, to in steps:
        to = "chr(10)" if to == "\n" else f"'{to}'"
        text = f"regexp_replace({text}, '{pattern}', {to}{global_})"
    return text


def _oracle() -> str:
    plain = _sql("body", STEPS)
    for sign, to in SIGNS:
        plain = f"replace({plain}, '{sign}', '{to}')"
    plain = _sql(plain, TIDY)
    urn = lambda x: "'<urn:uuid:' || substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21) || '>'".format(x)
    crlf = "chr(13) || chr(10)"
    return f"""WITH p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS body FROM pages),
b AS (SELECT page_id, target_uri, {urn("concat_ws(' ', 'response', page_id, target_uri)")} AS refers_to, '2024-01-01T00:00:00Z' AS date, 'sha256:' || sha256(body) AS source_digest, strlen(body) AS n, {plain} AS plain,
  nullif(trim(regexp_extract(body, '(?is)<title[^>]*>([^<]*)</title', 1)), '') AS title FROM p),
r AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, concat_ws({crlf}, 'source-payload-digest: ' || source_digest, 'source-content-length: ' || n, 'title: ' || title, 'text-length: ' || length(plain),
    'http-header: Content-Type: text/html; charset=utf-8', 'http-header: Content-Length: ' || n) || {crlf} AS block FROM b
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', plain FROM b)
SELECT page_id, warc_type, {urn("warc_type || ' ' || refers_to")} AS record_id, refers_to, target_uri, date, content_type, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block FROM r"""


#: The query over ``pages`` in DuckDB.
ORACLE_SQL = _oracle()
