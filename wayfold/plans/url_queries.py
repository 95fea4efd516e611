"""Queries on addresses and names, with the same results in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import redaction as R
from ..functions import urls as U
from ..operators import endpoints as E
from ..operators import records as Q
from ..session import cut_lineage
from .tables import table

_URL = r"'^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
_SEGS = rf"list_filter(list_transform(string_split(regexp_extract(url, {_URL}, 3), '/'), lambda s: string_split(s, ';')[1]), lambda s: s <> '')"
_KEYS = (
    rf"list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(url, {_URL}, 4), '&'), lambda p: string_split(p, '=')[1]), lambda k: k <> '')))"
)


def _idlike(s: str) -> str:
    churn = f"(len(regexp_extract_all({s}, '[a-z]+|[A-Z]+|[0-9]+|[_-]+')) - 1) * 10 >= (length({s}) - 1) * 4"
    return (
        f"(regexp_matches({s}, '^[0-9]+$') OR regexp_matches({s}, '(?i)^[0-9a-f]{{16,}}$') OR regexp_matches({s}, '<[A-Z][A-Z0-9_]*>')"
        f" OR regexp_matches({s}, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')"
        f" OR (regexp_matches({s}, '^[A-Za-z0-9_-]{{16,}}$') AND regexp_matches({s}, '[0-9]') AND regexp_matches({s}, '[A-Za-z]') AND {churn}))"
    )


def _template(s: str) -> str:
    ext, stem = rf"regexp_extract({s}, '\.([A-Za-z][A-Za-z0-9]{{0,4}})$', 1)", rf"regexp_replace({s}, '\.([A-Za-z][A-Za-z0-9]{{0,4}})$', '')"
    return f"CASE WHEN {_idlike(s)} THEN '{{id}}' WHEN {ext} <> '' AND {_idlike(stem)} THEN '{{id}}.' || lower({ext}) ELSE {s} END"


_TEMPLATED = f"list_transform({_SEGS}, lambda s: {_template('s')})"
_HOST = rf"lower(regexp_replace(regexp_extract(url, {_URL}, 2), '^[^@]*@', ''))"

# Segments that differ between calls alike elsewhere, both with a digit or
# templated already, become one placeholder; pages have two segments.
_FOLDED = f"""
WITH calls AS (SELECT page_id, {_HOST} AS host, lower(regexp_extract(url, {_URL}, 1)) AS scheme, {_TEMPLATED} AS segs, {_KEYS} AS keys FROM pages),
two AS (SELECT *, segs[1] AS a, segs[2] AS b, len(segs) AS n, regexp_matches(segs[1], '[0-9]') OR starts_with(segs[1], '{{id}}') AS la,
        regexp_matches(segs[2], '[0-9]') OR starts_with(segs[2], '{{id}}') AS lb FROM calls),
kinds AS (SELECT host, n, a, count(DISTINCT b) AS nb FROM two WHERE lb GROUP BY ALL),
folded AS (SELECT two.*, CASE WHEN lb AND nb > 1 THEN '{{id}}' ELSE b END AS b2 FROM two LEFT JOIN kinds USING (host, n, a)),
paths AS (SELECT page_id, host, scheme, keys, '/' || a || '/' || b2 AS path FROM folded)
"""


def _calls(spark, sf):
    return E.parsed_calls(table(spark, sf, "pages"), seq="page_id", call_id="page_id")


def url_parse(spark, sf):
    u = U.parse_call_url("url")
    return table(spark, sf, "pages").select("page_id", u.alias("u")).select(
        "page_id", "u.scheme", "u.host", F.array_join("u.segments", "/").alias("path"), F.array_join("u.query_keys", ",").alias("keys"), "u.ext")


def origins(spark, sf):
    return table(spark, sf, "pages").groupBy(U.origin_of("url").alias("origin")).agg(F.count(F.lit(1)).alias("n_pages"))


def url_templates(spark, sf):
    """Which endpoint templates a crawl has, how many pages and query keys each."""
    endpoints, call_map = E.group_endpoints(_calls(spark, sf))
    keys = call_map.select("endpoint_id", F.explode("query_keys").alias("k")).distinct().groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("n_query_keys"))
    return endpoints.join(keys, "endpoint_id", "left").select(
        "endpoint_id", "method", "scheme", "host", "path", F.col("n_calls").alias("n_pages"), F.coalesce("n_query_keys", F.lit(0)).alias("n_query_keys"))


def segment_variance(spark, sf):
    folded = E.template_by_variance(_calls(spark, sf))
    return folded.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_templates"))


def evidence_clusters(spark, sf):
    """Orders as calls to one address per priority: which of them answer alike, by the sizes of their lines."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.floor(F.col("l_quantity") / 8).cast("string"))).alias("evidence"))
    calls = table(spark, sf, "orders").join(lines, "o_orderkey", "left").withColumn("like", F.col("o_orderkey") % 2 == 0).filter(F.col("evidence").isNotNull() | F.col("like"))
    kind = F.concat_ws(":", F.col("like").cast("string"), F.coalesce(F.array_join("evidence", ","), F.lit("-")))
    kinds = calls.groupBy(F.col("o_orderpriority").alias("bucket"), kind.alias("kind"), "evidence", "like").agg(F.min("o_orderkey").alias("seen"), F.count(F.lit(1)).alias("n_calls"))
    kinds = cut_lineage(kinds.filter(F.col("bucket").isNotNull()))
    return E.first_come_clusters(kinds).join(kinds, ["bucket", "kind"]).groupBy("bucket", "cluster").agg(F.count(F.lit(1)).alias("n_kinds"), F.sum("n_calls").alias("n_calls"))


def endpoint_params(spark, sf):
    _, call_map = E.group_endpoints(_calls(spark, sf), fold_variance=False)
    spread = call_map.select("endpoint_id", F.explode("query_keys").alias("query_key")).groupBy("endpoint_id", "query_key").agg(F.count(F.lit(1)).alias("n_calls"))
    return spread.withColumn("is_paging", U.is_paging_param("query_key").cast("int"))


def query_keys(spark, sf):
    return table(spark, sf, "pages").select(F.explode(U.query_keys("url", packs=None)).alias("query_key")).groupBy("query_key").agg(F.count(F.lit(1)).alias("n_pages"))


def routes_of_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.route_of("url", packs=None).alias("route"), U.trim_route(U.route_of("url", packs=None)).alias("trimmed"))


def scrubbed_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.scrub_url("url").alias("address"), U.without_query("url").alias("plain"))


def static_assets(spark, sf):
    u = U.parse_call_url("url")
    return table(spark, sf, "pages").select("page_id", u["ext"].alias("ext"), U.is_static_asset(u["ext"], F.lit("text/html")).cast("int").alias("static"))


def links_of_pages(spark, sf):
    """Every link of every page as a route, read straight from the text."""
    hrefs = table(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.groupBy(U.clean_href("href", "url", packs=None).alias("route")).agg(F.count(F.lit(1)).alias("n_links"))


def call_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", N.slugify("p_name").alias("slug"), N.identifier("p_name").alias("identifier"), N.name_shape(F.concat(F.lit("/tmp/"), "p_name", F.lit(".PDF"))).alias("shape"))


def value_formats(spark, sf):
    """Formats of the columns of the order tables."""
    o = table(spark, sf, "orders")
    vals = o.select(F.explode(F.array(F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))).alias("v"))
    return vals.groupBy(N.format_of("v").alias("format")).agg(F.count(F.lit(1)).alias("n"))


def redacted_values(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.redact_value("c_name").alias("value"), N.truncate_body("c_name", 5).alias("cut"))


def element_ids(spark, sf):
    """Why an id looks generated, over ids built from the customer names and keys."""
    c = table(spark, sf, "customer")
    ids = c.select("c_custkey", F.explode(F.array(F.concat(F.lit("mat-input-"), "c_custkey"), F.concat(F.lit("field_"), "c_custkey"), F.md5(F.col("c_custkey").cast("string")), F.concat(F.lit("name"), "c_custkey"), F.lit(""))).alias("element_id"))
    return ids.groupBy(F.coalesce(N.classify_id("element_id"), F.lit("authored")).alias("why"), N.looks_random("element_id").cast("int").alias("random")).agg(F.count(F.lit(1)).alias("n"))


def packs_of_origins(spark, sf):
    o = table(spark, sf, "pages").select(U.origin_of(F.concat(F.lit("https://"), U.host_of("url"), F.when(F.col("page_id") % 3 == 0, ".in").otherwise(""), F.lit(":8443/x"))).alias("origin"))
    return o.groupBy(F.array_join(R.packs_for_origin("origin"), ",").alias("packs")).agg(F.count(F.lit(1)).alias("n"))


def display_text(spark, sf):
    o = table(spark, sf, "orders")
    size = (F.col("o_custkey") * F.col("o_custkey") * 97)
    return o.select("o_orderkey", N.human_bytes(size).alias("size"), N.shorten("o_orderpriority", 6).alias("short"), N.quoted("o_orderpriority").alias("quoted"), N.state_stem("o_orderkey", "o_orderpriority", F.lit("/x")).alias("stem"))


def page_ids(spark, sf):
    """Dense page ids by route and site, in order of first sight."""
    p = table(spark, sf, "pages").select(U.origin_of("url").alias("origin"), U.route_of("url", packs=None).alias("route"), "page_id")
    return Q.assign_ids(p, keys=["route"], first="page_id", prefix="pg_", by=["origin"])


def unique_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", N.slugify("p_brand").alias("base")) if "p_brand" in table(spark, sf, "part").columns else table(spark, sf, "part").select("p_partkey", F.substring(N.slugify("p_name"), 1, 3).alias("base"))
    return Q.unique_names(p, base="base", order=["p_partkey"]).select("p_partkey", "name")


QUERIES = {
    "url_parse": url_parse, "origins": origins, "url_templates": url_templates, "segment_variance": segment_variance, "evidence_clusters": evidence_clusters, "endpoint_params": endpoint_params, "query_keys": query_keys,
    "routes_of_pages": routes_of_pages, "scrubbed_urls": scrubbed_urls, "static_assets": static_assets, "links_of_pages": links_of_pages, "call_names": call_names,
    "value_formats": value_formats, "redacted_values": redacted_values, "element_ids": element_ids, "packs_of_origins": packs_of_origins, "display_text": display_text, "page_ids": page_ids, "unique_names": unique_names,
}

_ROUTE = rf"(CASE WHEN regexp_extract(url, {_URL}, 3) = '' THEN '/' ELSE regexp_extract(url, {_URL}, 3) END || regexp_extract(url, '(#!?/[^?]*)', 1))"
_ORIGIN = rf"regexp_extract(lower(url), '^(https?://[^/?#]*)', 1)"
_SLUG = lambda c: f"regexp_replace(left(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '-+$', '')"

ORACLE = {
    "url_parse": rf"SELECT page_id, lower(regexp_extract(url, {_URL}, 1)) AS scheme, {_HOST} AS host, array_to_string({_SEGS}, '/') AS path, array_to_string({_KEYS}, ',') AS keys, lower(regexp_extract(coalesce({_SEGS}[-1], ''), '\.([A-Za-z][A-Za-z0-9]{{0,4}})$', 1)) AS ext FROM pages",
    "origins": f"SELECT {_ORIGIN} AS origin, count(*) AS n_pages FROM pages GROUP BY 1",
    "url_templates": _FOLDED + """, eps AS (SELECT host, path, min(page_id) AS f, arg_min(scheme, page_id) AS scheme, count(*) AS n_pages FROM paths GROUP BY ALL),
k AS (SELECT host, path, count(DISTINCT k) AS n_query_keys FROM (SELECT host, path, unnest(keys) AS k FROM paths) GROUP BY ALL)
SELECT 'api_' || CASE WHEN row_number() OVER (ORDER BY f) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY f) AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER (ORDER BY f) AS VARCHAR) END AS endpoint_id,
'GET' AS method, scheme, host, path, n_pages, coalesce(n_query_keys, 0) AS n_query_keys FROM eps LEFT JOIN k USING (host, path)""",
    "segment_variance": _FOLDED + "SELECT host, path, count(*) AS n_templates FROM (SELECT DISTINCT host, a || '/' || b AS raw, '/' || a || '/' || b2 AS path FROM folded) GROUP BY ALL",
    # one step per kind in order of first call; a step looks for the first founder that is like it
    "evidence_clusters": """WITH RECURSIVE lines AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(CAST(floor(l_quantity / 8) AS BIGINT) AS VARCHAR)) FILTER (l_quantity IS NOT NULL))) AS e FROM lineitem GROUP BY 1),
calls AS (SELECT o_orderpriority AS bucket, o_orderkey, e, o_orderkey % 2 = 0 AS lk FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey WHERE o_orderpriority IS NOT NULL AND (e IS NOT NULL OR o_orderkey % 2 = 0)),
kinds AS (SELECT bucket, e, lk, CASE WHEN lk THEN 'true:' ELSE 'false:' END || coalesce(array_to_string(e, ','), '-') AS kind, min(o_orderkey) AS seen, count(*) AS n FROM calls GROUP BY bucket, e, lk),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seen, kind) AS r FROM kinds),
walk AS (SELECT bucket, r, kind, kind AS cluster, n, [{'e': e, 'lk': lk, 'kind': kind}] AS founders FROM ranked WHERE r = 1 UNION ALL
SELECT bucket, r, kind, coalesce(hit, kind), n, CASE WHEN hit IS NULL THEN list_append(founders, {'e': e, 'lk': lk, 'kind': kind}) ELSE founders END FROM (
SELECT k.bucket, k.r, k.kind, k.n, k.e, k.lk, w.founders, (list_filter(w.founders, lambda f: CASE WHEN f.e IS NULL OR k.e IS NULL THEN f.lk AND k.lk
WHEN len(list_distinct(list_concat(f.e, k.e))) = 0 THEN true ELSE len(list_intersect(f.e, k.e)) / len(list_distinct(list_concat(f.e, k.e))) >= 0.7 END)[1]).kind AS hit
FROM walk w JOIN ranked k ON k.bucket = w.bucket AND k.r = w.r + 1))
SELECT bucket, cluster, count(*) AS n_kinds, CAST(sum(n) AS BIGINT) AS n_calls FROM walk GROUP BY ALL""",
    "endpoint_params": f"""WITH calls AS (SELECT page_id, {_HOST} AS host, array_to_string({_TEMPLATED}, '/') AS path, {_KEYS} AS keys FROM pages),
eps AS (SELECT host, path, min(page_id) AS f FROM calls GROUP BY ALL), ids AS (SELECT host, path, row_number() OVER (ORDER BY f) AS r FROM eps)
SELECT 'api_' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS endpoint_id, query_key, count(*) AS n_calls, CAST(query_key = 'page' AS INTEGER) AS is_paging
FROM (SELECT host, path, unnest(keys) AS query_key FROM calls) JOIN ids USING (host, path) GROUP BY ALL""",
    "query_keys": f"SELECT k AS query_key, count(*) AS n_pages FROM (SELECT unnest({_KEYS}) AS k FROM pages) GROUP BY 1",
    "routes_of_pages": f"SELECT page_id, {_ROUTE} AS route, CASE WHEN length({_ROUTE}) > 1 THEN regexp_replace({_ROUTE}, '/$', '') ELSE {_ROUTE} END AS trimmed FROM pages",
    "scrubbed_urls": rf"""SELECT page_id, {_ORIGIN} || array_to_string(list_transform(string_split(CASE WHEN regexp_extract(url, {_URL}, 3) = '' THEN '/' ELSE regexp_extract(url, {_URL}, 3) END, '/'),
lambda s: CASE WHEN regexp_matches(regexp_replace(s, '\.(html|pdf)$', ''), '[0-9]{{6,}}|(?i)^[0-9a-f]{{16,}}$') THEN '{{id}}' || regexp_extract(s, '(\.(html|pdf))$', 1) ELSE s END), '/') AS address,
regexp_extract(url, '^([^?#]*)', 1) AS plain FROM pages""",
    "static_assets": rf"SELECT page_id, lower(regexp_extract(coalesce({_SEGS}[-1], ''), '\.([A-Za-z][A-Za-z0-9]{{0,4}})$', 1)) AS ext, CAST(lower(regexp_extract(coalesce({_SEGS}[-1], ''), '\.([A-Za-z][A-Za-z0-9]{{0,4}})$', 1)) IN ('js','mjs','cjs','css','map','png','jpg','jpeg','gif','svg','webp','avif','ico','bmp','woff','woff2','ttf','otf','eot') AS INTEGER) AS static FROM pages",
    "links_of_pages": rf"""SELECT CASE WHEN regexp_matches(href, '^#') OR href = '' THEN NULL WHEN regexp_matches(href, '^[a-z]+://') THEN {_ORIGIN.replace('url', 'href')} || CASE WHEN regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1) END
WHEN regexp_matches(href, '^[a-z]+:') THEN NULL ELSE regexp_extract(href, '^([^?#]*)', 1) END AS route, count(*) AS n_links FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""",
    "call_names": rf"""SELECT p_partkey, {_SLUG('p_name')} AS slug,
(WITH w AS (SELECT list_filter(string_split(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS l)
 SELECT array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(x[1]) || lower(x[2:]) END), '') FROM w) AS identifier,
array_to_string(list_transform(regexp_extract_all(p_name, '[\p{{L}}\p{{M}}]+|\p{{N}}+|[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda r: CASE WHEN regexp_matches(r, '^\p{{N}}') THEN '9{{' || length(r) || '}}' WHEN regexp_matches(r, '^[\p{{L}}\p{{M}}]') THEN 'A{{' || length(r) || '}}' ELSE r END), '') || '.pdf' AS shape FROM part""",
    "value_formats": r"""SELECT CASE WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') THEN 'datetime' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN 'date' WHEN regexp_matches(v, '^[+-]?(\d+|\d{1,3}(,\d{2,3})+)(\.\d+)?$') THEN 'numeric'
WHEN regexp_matches(v, '(?i)^(true|false|yes|no|y|n)$') THEN 'boolean' ELSE 'text' END AS format, count(*) AS n FROM (SELECT unnest([o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d %H:%M'), CAST(o_custkey AS VARCHAR), o_orderpriority]) AS v FROM orders) GROUP BY 1""",
    "redacted_values": "SELECT c_custkey, '<' || length(c_name) || ' chars>' AS value, CASE WHEN length(c_name) > 5 THEN left(c_name, 5) || '…[+' || (length(c_name) - 5) || ' chars]' ELSE c_name END AS cut FROM customer",
    "element_ids": r"""SELECT CASE WHEN i = '' THEN 'empty id' WHEN regexp_matches(i, '(?i)^(mat-|cdk-|ng-)') THEN 'id has a framework prefix' WHEN regexp_matches(i, '(?i)^([0-9a-f]{16,}|[a-z0-9]{24,})$') THEN 'id looks like a hash' WHEN regexp_matches(i, '[-_:.]\d+$') THEN 'id ends in a bare counter' ELSE 'authored' END AS why,
CAST(regexp_matches(i, '^[A-Za-z0-9]{8,}$') AND regexp_matches(regexp_replace(i, '[0-9]+$', ''), '[0-9]') AND regexp_matches(regexp_replace(i, '[0-9]+$', ''), '[A-Za-z]') AS INTEGER) AS random, count(*) AS n
FROM (SELECT unnest(['mat-input-' || c_custkey, 'field_' || c_custkey, md5(CAST(c_custkey AS VARCHAR)), 'name' || c_custkey, '']) AS i FROM customer) GROUP BY ALL""",
    "packs_of_origins": "SELECT CASE WHEN page_id % 3 = 0 THEN 'generic,india' ELSE 'generic' END AS packs, count(*) AS n FROM pages GROUP BY 1",
    "display_text": rf"""SELECT o_orderkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN CAST(floor(s / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f', floor(s / 1024 / 1024 * 10 + 0.5) / 10) || ' MB' END AS size,
CASE WHEN length(o_orderpriority) > 6 THEN left(o_orderpriority, 5) || '…' ELSE o_orderpriority END AS short, '"' || o_orderpriority || '"' AS quoted,
CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END || '-' || {_SLUG('o_orderpriority')} AS stem FROM (SELECT *, o_custkey * o_custkey * 97 AS s FROM orders)""",
    "page_ids": f"""WITH r AS (SELECT {_ORIGIN} AS origin, {_ROUTE} AS route, min(page_id) AS first_seen FROM pages GROUP BY ALL)
SELECT origin, route, first_seen, 'pg_' || lpad(CAST(row_number() OVER (PARTITION BY origin ORDER BY first_seen, route) AS VARCHAR), 3, '0') AS id FROM r""",
    "unique_names": f"SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS name FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM (SELECT p_partkey, {_SLUG('p_brand')} AS base FROM part))",
}
