"""HAR 1.2 files: calls in, calls out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.exprs import decode_percent, text
from ..functions.headers import header_value
from ..operators.ordered import dense_number
from ..schemas import HEADERS

_ENTRY = (
    f"struct<pageref:string,startedDateTime:string,time:double,comment:string,request:struct<method:string,url:string,headers:{HEADERS},postData:struct<mimeType:string,text:string>>,"
    f"response:struct<status:int,statusText:string,headers:{HEADERS},content:struct<size:bigint,mimeType:string,text:string>>,"
    "_capture:struct<id:string,kind:string,stateIdAtTime:string,actionIdAtTime:string,responseSize:bigint,bodyTruncated:boolean,disposition:string,dispositionExt:string,isDownload:boolean,hasFullBody:boolean>>"
)
HAR = f"log struct<version:string,pages:array<struct<id:string,title:string,startedDateTime:string>>,entries:array<{_ENTRY}>>"


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """``net`` rows from HAR files, one task per file and one row per entry."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r'"_[A-Za-z]+"(\s*:\s*\{\s*"id")', '"_capture"$1').alias("value"))
    doc = files.select(F.from_json("value", HAR).alias("h")).select("h.log.pages", F.posexplode("h.log.entries").alias("pos", "e"))
    page = F.get(F.filter("pages", lambda p: p["id"] == F.col("e.pageref")), F.lit(0))["title"]
    about = F.coalesce(F.col("e.comment"), F.lit(""))
    extra = lambda c: F.col(f"e._capture.{c}")
    return doc.select(
        F.coalesce(extra("id"), F.nullif(F.regexp_extract(about, r"internal id (\S+?)(?:;|\z)", 1), F.lit(""))).alias("id"), F.col("pos").cast("bigint").alias("seq"),
        F.regexp_extract(about, r"tab (-?[0-9]+)", 1).try_cast("bigint").alias("tab_id"), F.regexp_extract(about, r"frame ([0-9]+)", 1).try_cast("bigint").alias("frame_id"),
        extra("kind").alias("kind"), F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"), F.nullif(page, F.lit("unknown")).alias("page_url"), F.col("e.response.status").alias("status"),
        F.nullif(F.col("e.response.content.mimeType"), F.lit("x-unknown")).alias("mime_type"), F.try_to_timestamp("e.startedDateTime").alias("started_at"), F.col("e.time").cast("bigint").alias("duration_ms"),
        F.col("e.request.headers").alias("request_headers"), F.col("e.response.headers").alias("response_headers"), F.col("e.request.postData.text").alias("request_body"), F.col("e.response.content.text").alias("response_body"),
        F.coalesce(extra("responseSize"), F.lit(-1)).alias("response_size"), F.coalesce(extra("bodyTruncated"), F.lit(False)).alias("body_truncated"), extra("disposition").alias("disposition"), extra("dispositionExt").alias("disposition_ext"),
        F.coalesce(extra("isDownload"), F.lit(False)).alias("is_download"), extra("stateIdAtTime").alias("state_id_at_time"), about.contains("inferred from top frame").alias("state_id_inferred"),
        extra("actionIdAtTime").alias("action_id_at_time"), F.coalesce(extra("hasFullBody"), F.lit(False)).alias("has_full_body"),
    )


def query_pairs(url) -> Column:
    """Name and value pairs of a query string, in order."""
    query = F.regexp_extract(text(url), P.URL, 4)
    plain = lambda c: decode_percent(F.replace(c, F.lit("+"), F.lit(" ")))
    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("name"), plain(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("value")))


def har_pages(net: DataFrame, *, by=("session",)) -> DataFrame:
    """``page_1``, ``page_2`` … per session, in the order pages were first called from."""
    seen = net.groupBy(*by, F.coalesce("page_url", F.lit("unknown")).alias("title")).agg(F.min("seq").alias("first_seq"), F.min_by("started_at", "seq").alias("startedDateTime"))
    return dense_number(seen, by=by, order=["first_seq", "title"], out="__n", chunk=100_000).withColumn("id", F.concat(F.lit("page_"), F.col("__n").cast("string"))).drop("__n")


def har_entries(net: DataFrame, *, by=("session",)) -> DataFrame:
    """One HAR entry per call, as a struct. Timings a page never sees are ``-1``."""
    pages = har_pages(net, by=by).select(*by, F.col("title").alias("__page"), F.col("id").alias("pageref"))
    n = net.withColumn("__page", F.coalesce("page_url", F.lit("unknown"))).join(pages, [*by, "__page"])
    none = F.array().cast(HEADERS)
    iso = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ms = F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0)))
    comment = F.concat_ws("; ", F.coalesce(F.concat(F.lit("error: "), "error"), F.concat("kind", F.lit("; wrapper-reconstructed, timings approximate")), F.lit("wrapper-reconstructed, timings approximate")), F.concat(F.lit("internal id "), "id"),
                          F.concat(F.lit("state "), "state_id_at_time", F.when(F.col("state_id_inferred"), " (inferred from top frame)").otherwise("")),
                          F.concat(F.lit("tab "), F.coalesce("tab_id", F.lit(-1)).cast("string"), F.lit(" frame "), F.coalesce("frame_id", F.lit(0)).cast("string")))
    post = F.when(F.col("request_body").isNotNull(), F.struct(F.coalesce(header_value("request_headers", "content-type"), F.lit("application/octet-stream")).alias("mimeType"), F.col("request_body").alias("text")))
    entry = F.struct(
        "pageref", iso.alias("startedDateTime"), ms.alias("time"),
        F.struct("method", "url", F.lit("HTTP/1.1").alias("httpVersion"), F.array().alias("cookies"), F.coalesce("request_headers", none).alias("headers"), query_pairs("url").alias("queryString"), F.lit(-1).alias("headersSize"),
                 F.coalesce(F.nullif(F.length("request_body"), F.lit(0)), F.lit(-1)).alias("bodySize"), post.alias("postData")).alias("request"),
        F.struct("status", F.lit("").alias("statusText"), F.lit("HTTP/1.1").alias("httpVersion"), F.array().alias("cookies"), F.coalesce("response_headers", none).alias("headers"),
                 F.struct(F.coalesce(F.length("response_body"), F.lit(0)).alias("size"), F.coalesce(F.nullif(F.col("mime_type"), F.lit("")), F.lit("x-unknown")).alias("mimeType"), text("response_body").alias("text")).alias("content"),
                 F.lit("").alias("redirectURL"), F.lit(-1).alias("headersSize"), F.lit(-1).alias("bodySize")).alias("response"),
        F.create_map().alias("cache"),
        F.struct(*[F.lit(-1).alias(c) for c in ("blocked", "dns", "connect", "ssl")], F.lit(0).alias("send"), ms.alias("wait"), F.lit(0).alias("receive")).alias("timings"), comment.alias("comment"),
        F.struct("id", "kind", F.col("state_id_at_time").alias("stateIdAtTime"), F.col("action_id_at_time").alias("actionIdAtTime"), F.coalesce("response_size", F.lit(-1)).alias("responseSize"), F.coalesce("body_truncated", F.lit(False)).alias("bodyTruncated"),
                 "disposition", F.col("disposition_ext").alias("dispositionExt"), F.coalesce("is_download", F.lit(False)).alias("isDownload"), F.coalesce("has_full_body", F.lit(False)).alias("hasFullBody")).alias("_capture"),
    )
    return n.select(*by, "seq", F.col("id").alias("net_id"), F.to_json(entry).alias("entry"))


def write_har(net: DataFrame, path: str, *, by=("session",), per_file: int = 20_000) -> None:
    """HAR files per session, in parts of ``per_file`` calls so that none outgrows a task.

    Page ids are those of the whole session; every part lists the pages its own
    entries name, which keeps each file a valid HAR.
    """
    entries = har_entries(net, by=by).withColumn("part", F.floor(F.col("seq") / per_file))
    used = entries.select(*by, "part", F.get_json_object("entry", "$.pageref").alias("id")).distinct()
    pages = har_pages(net, by=by).join(used, [*by, "id"]).groupBy(*by, "part").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "id", "title", F.date_format("startedDateTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at")))),
                              lambda p: F.struct(p["at"].alias("startedDateTime"), p["id"].alias("id"), p["title"].alias("title"), F.struct(F.lit(-1).alias("onContentLoad"), F.lit(-1).alias("onLoad")).alias("pageTimings")))).alias("__pages"))
    files = entries.groupBy(*by, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "net_id", "entry"))), lambda e: e["entry"]), ",").alias("__entries"))
    whole = files.join(pages, [*by, "part"]).select(*by, "part", F.concat(
        F.lit('{"log":{"version":"1.2","creator":{"name":"wayfold","version":"1"},"pages":'), "__pages", F.lit(',"entries":['), "__entries", F.lit("]}}")).alias("value"))
    whole.write.mode("overwrite").partitionBy(*by, "part").text(path)
