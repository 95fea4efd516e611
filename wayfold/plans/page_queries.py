"""Queries on stored pages: outline, navigation, site map, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import controls as C
from ..operators import coverage as V
from ..operators import pages as G
from ..operators import redact as X
from ..operators import sitemap as M
from ..schemas import ACTIONS, STATES, TABLES
from ..session import cut_lineage
from .tables import _complete, table, text_table

_OUTCOMES = "session string, action_id string, from_id string, to_id string, via_new_tab boolean"


def nodes_of(spark, sf, write=False):
    """Page nodes with the address they were found at."""
    return G.page_nodes(text_table(spark, sf, "pages"), keep=["url"], write=write)


def crawl_states(spark, sf, pages=None):
    """Pages as states of one crawl: title, headings, route and menu of each."""
    pages = text_table(spark, sf, "pages") if pages is None else pages
    nodes = G.page_nodes(pages, keep=["url"], write=True)
    menus = G.nav_items(nodes, url="url").groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "text", "path", "href", "has_children", "current"))).alias("m"))
    nav = F.struct(F.transform("m", lambda i: F.struct(
        i["text"].alias("text"), i["path"].alias("path"), (F.size(i["path"]) - 1).alias("depth"), F.lit("").alias("selector"), i["href"].alias("href"), F.lit(True).alias("visible"),
        F.lit(None).cast("boolean").alias("expanded"), i["has_children"].alias("has_children"), i["current"].alias("current"))).alias("menus"),
        F.array().cast(spark.createDataFrame([], STATES).schema["nav"].dataType["view_groups"].dataType).alias("view_groups"), F.array().cast("array<string>").alias("breadcrumbs"))
    heads = G.page_outline(nodes).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "heading"))), lambda h: h["heading"]).alias("headings"))
    return cut_lineage(_complete(
        pages.select("page_id", "url").join(menus, "page_id", "left").join(G.page_title(nodes), "page_id", "left").join(heads, "page_id", "left").select(
            F.lit("crawl").alias("session"), F.concat(F.lit("st_"), "page_id").alias("id"), F.col("page_id").alias("seq"), U.origin_of("url").alias("origin"), "url",
            U.path_of("url").alias("pathname"), U.route_of("url", packs=None).alias("route"), "title", "headings", nav.alias("nav"), F.lit("load").alias("trigger"),
            F.array().cast("array<string>").alias("query_keys"),
        ),
        STATES,
    ))


def html_nodes(spark, sf):
    return nodes_of(spark, sf).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def text_nodes(spark, sf):
    """Text nodes of every page with labelled values replaced."""
    return X.scrub_labelled(nodes_of(spark, sf, write=True), doc=["page_id"]).select("page_id", "idx", "scrubbed")


def link_counts(spark, sf):
    n = nodes_of(spark, sf).filter(F.col("tag").isin("a", "li", "nav", "h1", "title", "article"))
    return n.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def page_outline(spark, sf):
    """Headings as written; the scrubbed form is what crawl states carry."""
    return G.page_outline(nodes_of(spark, sf), packs=None)


def page_titles(spark, sf):
    return G.page_title(nodes_of(spark, sf))


def nav_items(spark, sf):
    return G.nav_items(nodes_of(spark, sf, write=True), url="url", packs=None).select("page_id", "text", "href", F.array_join("path", " > ").alias("path"))


def repeats(spark, sf):
    return G.repeats(nodes_of(spark, sf, write=True))


def repeat_slots(spark, sf):
    nodes = nodes_of(spark, sf, write=True)
    return G.repeat_slots(nodes, G.repeats(nodes)).select("page_id", "container", "n", "kind", "sample")


def auth_hints(spark, sf):
    return G.auth_hint(nodes_of(spark, sf), url="url").groupBy("logged_in", "evidence", "confidence").agg(F.count(F.lit(1)).alias("n"))


def frameworks(spark, sf):
    return G.framework(nodes_of(spark, sf)).groupBy("framework", "confidence").agg(F.count(F.lit(1)).alias("n"))


def download_links(spark, sf):
    return G.download_links(nodes_of(spark, sf)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def page_controls(spark, sf):
    """Controls, buttons, tables and pagers per page (this crawl has none; the counts say so)."""
    nodes = nodes_of(spark, sf, write=True)
    parts = [G.controls(nodes).select("page_id", F.lit("control").alias("kind")), G.buttons(nodes).select("page_id", F.lit("button").alias("kind")),
             G.tables(nodes).select("page_id", F.lit("table").alias("kind")), G.pagination(nodes).select("page_id", F.lit("pager").alias("kind")), G.view_groups(nodes).select("page_id", F.lit("option").alias("kind"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counted = every.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_parts"))
    return table(spark, sf, "pages").select("page_id").join(counted, "page_id", "left").fillna(0, ["n_parts"])


def selector_candidates(spark, sf):
    nodes = nodes_of(spark, sf, write=True)
    links = nodes.filter(F.col("tag") == "a")
    return G.selector_candidates(nodes, links).groupBy("page_id", "stability").agg(F.count(F.lit(1)).alias("n"))


def menu_merge(spark, sf):
    """The menu of every site of the crawl, merged over its pages."""
    menu = M.merge_menu(M.menu_sightings(crawl_states(spark, sf)))
    return menu.select("origin", "menu_id", "text", "href", "depth", F.col("n_states").alias("n_pages"))


def _visited(spark, sf, built=None):
    states = crawl_states(spark, sf, built)
    pages = cut_lineage(M.site_pages(M.states_by_page(states)))
    merged = cut_lineage(M.merge_menu(M.menu_sightings(states)))
    menu, _, leads = M.menu_visits(merged, spark.createDataFrame([], ACTIONS), spark.createDataFrame([], _OUTCOMES), states, pages)
    return states, pages, cut_lineage(menu), cut_lineage(leads)


def site_pages(spark, sf):
    states = crawl_states(spark, sf)
    p = M.site_pages(M.states_by_page(states))
    return p.select("origin", "page_id", "route", "title", "n_states")


def page_labels(spark, sf):
    _, pages, menu, leads = _visited(spark, sf)
    return M.page_labels(pages, leads, menu).select("origin", "route", "label")


def menu_leads_to(spark, sf):
    """Links of the menu that open a page the crawl has, by site."""
    _, _, _, leads = _visited(spark, sf)
    return leads.select("origin", "menu_id", "route")


def unvisited_menu(spark, sf):
    _, _, menu, _ = _visited(spark, sf)
    return V.unvisited_menu(V.menu_covered(menu)).select("origin", "menu_id", "text")


def coverage_totals(spark, sf):
    _, pages, menu, _ = _visited(spark, sf)
    options = spark.createDataFrame([], "origin string, visited boolean")
    lists = spark.createDataFrame([], "origin string, paged boolean, has_pagination boolean")
    return V.coverage_totals(V.menu_covered(menu), pages, options, lists, spark.createDataFrame([], TABLES["downloads"]))


def coverage_hints(spark, sf):
    """How many findings every site has."""
    _, _, menu, _ = _visited(spark, sf)
    gaps = spark.createDataFrame([], "origin string, route string, first_seq bigint, class string, place string, sentence string")
    return V.coverage_hints(V.menu_covered(menu), gaps).groupBy("origin").agg(F.count(F.lit(1)).alias("n_hints"))


def page_inventory(spark, sf):
    return V.page_inventory(crawl_states(spark, sf)).select("state_id", "title", "route", "stem", "reached_by")


def merged_lists(spark, sf):
    """List patterns of every page, merged by site and selector."""
    nodes = nodes_of(spark, sf, write=True)
    found = G.repeats(nodes).join(table(spark, sf, "pages").select("page_id", U.origin_of("url").alias("origin")), "page_id")
    one = F.struct(F.col("signature").alias("container_selector"), F.col("signature").alias("item_selector"), F.col("n_items").alias("item_count"), F.lit(False).alias("has_download"))
    lists = F.struct(F.array().cast(spark.createDataFrame([], STATES).schema["lists"].dataType["tables"].dataType).alias("tables"), F.collect_list(one).alias("repeats"),
                     F.array().cast(spark.createDataFrame([], STATES).schema["lists"].dataType["pagination"].dataType).alias("pagination"), F.array().cast(spark.createDataFrame([], STATES).schema["lists"].dataType["downloads"].dataType).alias("downloads"))
    states = found.groupBy("origin", "page_id").agg(lists.alias("lists")).select("origin", F.col("page_id").alias("seq"), F.concat(F.lit("st_"), "page_id").alias("id"), "lists")
    return C.merge_lists(_complete(states, STATES)).select("origin", "kind", "selector", "n_states", "n_rows")


QUERIES = {
    "html_nodes": html_nodes, "text_nodes": text_nodes, "link_counts": link_counts, "page_outline": page_outline, "page_titles": page_titles, "nav_items": nav_items, "repeats": repeats, "repeat_slots": repeat_slots,
    "auth_hints": auth_hints, "frameworks": frameworks, "download_links": download_links, "page_controls": page_controls, "selector_candidates": selector_candidates, "menu_merge": menu_merge, "site_pages": site_pages,
    "page_labels": page_labels, "menu_leads_to": menu_leads_to, "unvisited_menu": unvisited_menu, "coverage_totals": coverage_totals, "coverage_hints": coverage_hints, "page_inventory": page_inventory, "merged_lists": merged_lists,
}

_URL = r"'^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
_TXT = lambda c: f"trim(regexp_replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_SITE = rf"regexp_extract(lower(url), '^(https?://[^/?#]*)', 1)"
_RT = rf"regexp_extract(url, {_URL}, 3)"
_NAV = rf"""p AS (SELECT *, {_SITE} AS origin, {_RT} AS route FROM pages), lis AS (SELECT page_id, origin, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM p),
raw AS (SELECT page_id, origin, unnest(l) AS li, generate_subscripts(l, 1) AS pos FROM lis),
nv AS (SELECT page_id, origin, text, href, min(pos) AS pos FROM (SELECT page_id, origin, pos, {_TXT("regexp_extract(li, '>([^<]*)</a>', 1)")} AS text, regexp_extract(li, 'href="([^"?#]*)', 1) AS href FROM raw) GROUP BY ALL),
mn AS (SELECT origin, lower(text) AS menu_id, arg_min(text, (page_id, pos)) AS text, arg_min(href, (page_id, pos)) AS href, count(DISTINCT page_id) AS n_pages FROM nv WHERE text <> '' GROUP BY ALL),
rt AS (SELECT DISTINCT origin, route FROM p), ld AS (SELECT DISTINCT mn.origin, mn.menu_id, rt.route FROM mn JOIN rt ON mn.origin = rt.origin AND (CASE WHEN length(mn.href) > 1 THEN regexp_replace(mn.href, '/$', '') ELSE mn.href END) = (CASE WHEN length(rt.route) > 1 THEN regexp_replace(rt.route, '/$', '') ELSE rt.route END)),
un AS (SELECT origin, menu_id, text FROM mn WHERE (origin, menu_id) NOT IN (SELECT (origin, menu_id) FROM ld) AND NOT regexp_matches(href, '(?i)(^|[/?#_-])(logout|signout|sign-out|log-out)([/?#_-]|$)'))"""
_TAGS = ["a", "li", "nav", "h1", "title", "article"]

ORACLE = {
    "link_counts": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, len(regexp_extract_all(html, '<{t}[ >]')) AS n FROM pages" for t in _TAGS) + ") WHERE n > 0",
    "page_outline": f"SELECT page_id, 1 AS n, {_TXT('regexp_extract(html, ' + chr(39) + '(?s)<h1>(.*?)</h1>' + chr(39) + ', 1)')} AS heading FROM pages",
    "page_titles": f"SELECT page_id, {_TXT('regexp_extract(html, ' + chr(39) + '(?s)<title>(.*?)</title>' + chr(39) + ', 1)')} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages",
    "nav_items": f"WITH {_NAV} SELECT page_id, text, href, text AS path FROM nv WHERE text <> ''",
    "page_controls": "SELECT page_id, 0 AS n_parts FROM pages",
    "menu_merge": f"WITH {_NAV} SELECT origin, menu_id, text, href, 0 AS depth, n_pages FROM mn",
    "site_pages": f"""WITH {_NAV}, g AS (SELECT origin, route, min(page_id) AS f, count(*) AS n_states, arg_min({_TXT('regexp_extract(html, ' + chr(39) + '(?s)<title>(.*?)</title>' + chr(39) + ', 1)')}, page_id) AS title FROM p GROUP BY ALL)
SELECT origin, 'pg_' || lpad(CAST(row_number() OVER (PARTITION BY origin ORDER BY f) AS VARCHAR), 3, '0') AS page_id, route, title, n_states FROM g""",
    "menu_leads_to": f"WITH {_NAV} SELECT origin, menu_id, route FROM ld",
    "unvisited_menu": f"WITH {_NAV} SELECT origin, menu_id, text FROM un",
    "coverage_totals": f"""WITH {_NAV}, t AS (SELECT origin, count(*) AS pages FROM rt GROUP BY 1), c AS (SELECT origin, count(*) AS items FROM mn WHERE NOT regexp_matches(href, '(?i)(^|[/?#_-])(logout|signout|sign-out|log-out)([/?#_-]|$)') GROUP BY 1), u AS (SELECT origin, count(*) AS missed FROM un GROUP BY 1)
SELECT t.origin, coalesce(items, 0) AS menu_items, coalesce(items, 0) - coalesce(missed, 0) AS menu_visited, pages, 0 AS view_options, 0 AS view_options_visited, 0 AS lists, 0 AS lists_paged, 0 AS downloads FROM t LEFT JOIN c USING (origin) LEFT JOIN u USING (origin)""",
    "coverage_hints": f"WITH {_NAV} SELECT origin, count(*) AS n_hints FROM un GROUP BY 1",
}
