"""Page operators on pages built from the given tables, so that SQL knows what they must find.

Every order book, part form, supplier page and customer page is written as HTML from
its rows and read back by the operators that read crawled pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pyrules as Y
from ..operators import coverage as V
from ..operators import pages as G
from ..schemas import TABLES
from .page_queries import _visited
from .tables import dealt_table


def _html(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.col(p[1:]).cast("string") if p[:1] == "$" else F.lit(p) for p in parts])


def order_books(spark, sf):
    """A page per customer with a table of the orders, in order of their keys."""
    o = dealt_table(spark, sf, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("r"))
    rows = F.array_join(F.transform("r", lambda x: F.concat(F.lit("<tr><td>"), x["o_orderkey"].cast("string"), F.lit("</td><td>"), x["o_orderstatus"], F.lit("</td><td>"), x["o_orderpriority"], F.lit("</td></tr>"))), "")
    return o.select("page_id", F.concat(F.lit("<h1>Orders</h1><table><tr><th>Order</th><th>Status</th><th>Priority</th></tr>"), rows, F.lit("</table>")).alias("html"))


def part_forms(spark, sf):
    """A page per part with a form: a number, a list, a text and a secret."""
    return dealt_table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), _html(
        '<form><label for="size">Size</label><input id="size" type="number" required maxlength="4" value="', "$p_size", '"><p><select name="brand" aria-label="Brand"><option value="', "$p_brand",
        '">', "$p_brand", '</option><option value="none">none</option></select></p><div class="form-group"><label>Remark</label><textarea name="note">', "$p_name",
        '</textarea></div><p><input type="password" name="pin" aria-label="Your PIN" value="1234"></p></form>').alias("html"))


def supplier_pages(spark, sf):
    """A page per supplier with a trail, tabs, a pager, files, buttons and an error."""
    return dealt_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), _html(
        '<ol class="breadcrumb"><li>Home</li><li>Suppliers</li><li>', "$s_name", '</li></ol><ul role="tablist"><li role="tab" aria-selected="true">Open ', "$s_nationkey",
        '</li><li role="tab">Closed</li></ul><a href="/files/', "$s_suppkey", '.pdf">File</a><a href="/page/', "$s_suppkey", '">No file</a><div class="error-text">No answer from ', "$s_name",
        '</div><button>Save</button><button>Delete ', "$s_suppkey", '</button><nav class="pages"><a href="?p=1" aria-current="page">', F.col("s_suppkey").cast("string"),
        '</a><a href="?p=2">2</a><a href="?p=3" rel="next">Next</a></nav>').alias("html"))


def customer_site(spark, sf):
    """A site per nation, a page per customer; its menu names the page itself and one that nobody opened."""
    c = dealt_table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("page_id"), _html("https://n", "$c_nationkey", ".example.com/c/", "$c_custkey").alias("url"), _html(
        "<html><head><title>", "$c_name", '</title></head><body><nav><ul><li><a href="/c/', "$c_custkey", '">', "$c_name", '</a></li><li><a href="/c/', "$c_custkey", '/orders">Orders of ', "$c_name",
        "</a></li></ul></nav><h1>", "$c_name", "</h1></body></html>").alias("html"))


def supplier_menus(spark, sf):
    """A page per supplier whose menus lie apart from what opens them, one of them inside another."""
    return dealt_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), _html(
        '<nav><a href="/">Home</a><button aria-controls="m', "$s_suppkey", '">Stock of ', "$s_name", '</button></nav><main><a href="/other">Other</a></main><div id="m', "$s_suppkey",
        '"><a href="/s/', "$s_suppkey", '">List</a><ul><li><button aria-owns="deep">More</button></li></ul></div><div><div id="deep"><ul><li>Nation<ul><li><a href="/n/', "$s_nationkey", '">Nation ', "$s_nationkey", "</a></li></ul></li></ul></div></div>").alias("html"))


def built_menus(spark, sf):
    m = G.nav_items(G.page_nodes(supplier_menus(spark, sf), write=True), packs=None)
    return m.select("page_id", F.array_join("path", " > ").alias("path"), "href", F.col("has_children").cast("int").alias("has_children"))


def built_tables(spark, sf):
    t = G.tables(G.page_nodes(order_books(spark, sf), write=True))
    return t.select("page_id", F.array_join("headers", "|").alias("headers"), F.col("n_rows").cast("bigint").alias("n_rows"), F.array_join("first_row", "|").alias("first_row"))


def built_controls(spark, sf):
    c = G.controls(G.page_nodes(part_forms(spark, sf), write=True))
    return c.select("page_id", "key", "label", "label_source", "type", F.col("required").cast("int").alias("required"), "max_length", "value", F.col("n_options").cast("int").alias("n_options"), F.col("redacted_entirely").cast("int").alias("secret"))


def built_clean_pages(spark, sf):
    """Forms as they may be kept: no comments, no scripts, values as lengths, secrets as such, mails as tokens."""
    p = part_forms(spark, sf).select("page_id", F.concat(F.lit("<!-- made by a tool --><script>var a = 1;</script><p title=\"ask me@ex.org\">Mail me@ex.org</p>"), "html").alias("html"))
    return p.select("page_id", Y.sanitise_html("html").alias("html"))


def built_trails(spark, sf):
    return G.breadcrumbs(G.page_nodes(supplier_pages(spark, sf), write=True)).select("page_id", F.col("n").cast("int").alias("n"), "text")


def built_tabs(spark, sf):
    return G.view_groups(G.page_nodes(supplier_pages(spark, sf), write=True)).select("page_id", "kind", "text", F.col("active").cast("int").alias("active"), F.col("disabled").cast("int").alias("disabled"))


def built_files(spark, sf):
    return G.download_links(G.page_nodes(supplier_pages(spark, sf), write=True)).select("page_id", "extension", "kind", F.col("n").cast("int").alias("n"))


def built_buttons(spark, sf):
    return G.buttons(G.page_nodes(supplier_pages(spark, sf), write=True)).select("page_id", "text", "type", F.col("danger").cast("int").alias("danger"))


def built_pagers(spark, sf):
    return G.pagination(G.page_nodes(supplier_pages(spark, sf), write=True)).select("page_id", "style", F.col("has_next").cast("int").alias("has_next"), F.col("has_prev").cast("int").alias("has_prev"), "current")


def built_errors(spark, sf):
    return G.page_errors(G.page_nodes(supplier_pages(spark, sf), write=True)).select("page_id", "text")


def built_steps(spark, sf):
    return G.page_steps(G.page_nodes(supplier_pages(spark, sf), write=True)).select("page_id", F.col("n").cast("int").alias("n"), "text", F.col("active").cast("int").alias("active"))


def built_leads(spark, sf):
    """Menu items that open a page of the crawl."""
    _, _, _, leads = _visited(spark, sf, customer_site(spark, sf))
    return leads.select("origin", "menu_id", "route")


def built_unvisited(spark, sf):
    """Menu items nobody opened: one of each customer."""
    _, _, menu, _ = _visited(spark, sf, customer_site(spark, sf))
    return V.unvisited_menu(V.menu_covered(menu)).select("origin", "menu_id", "text")


def built_coverage(spark, sf):
    _, pages, menu, _ = _visited(spark, sf, customer_site(spark, sf))
    options, lists = spark.createDataFrame([], "origin string, visited boolean"), spark.createDataFrame([], "origin string, paged boolean, has_pagination boolean")
    return V.coverage_totals(V.menu_covered(menu), pages, options, lists, spark.createDataFrame([], TABLES["downloads"])).select("origin", "menu_items", "menu_visited", "pages")


def built_findings(spark, sf):
    """Every finding of a site, in order, as a sentence."""
    _, _, menu, _ = _visited(spark, sf, customer_site(spark, sf))
    gaps = spark.createDataFrame([], "origin string, route string, first_seq bigint, class string, place string, sentence string")
    return V.coverage_hints(V.menu_covered(menu), gaps).select("origin", "class", "sentence")


QUERIES = {f.__name__: f for f in (built_tables, built_controls, built_clean_pages, built_trails, built_tabs, built_files, built_buttons, built_pagers, built_errors, built_steps, built_menus, built_leads, built_unvisited, built_coverage, built_findings)}

_CHARS = lambda c: f"'<' || length(CAST({c} AS VARCHAR)) || ' chars>'"
_SITE = "'https://n' || c_nationkey || '.example.com' AS origin"
ORACLE = {
    "built_tables": f"""SELECT o_custkey AS page_id, 'Order|Status|Priority' AS headers, count(*) AS n_rows, arg_min({_CHARS('o_orderkey')} || '|' || {_CHARS('o_orderstatus')} || '|' || {_CHARS('o_orderpriority')}, o_orderkey) AS first_row FROM orders GROUP BY o_custkey""",
    "built_controls": f"""SELECT p_partkey AS page_id, 'size' AS key, 'Size' AS label, 'for' AS label_source, 'number' AS type, 1 AS required, 4 AS max_length, {_CHARS('p_size')} AS value, NULL::INT AS n_options, 0 AS secret FROM part
UNION ALL SELECT p_partkey, 'brand', 'Brand', 'aria-label', 'select', 0, NULL, '<' || (length(p_brand) * 1 + 5) || ' chars>', 2, 0 FROM part
UNION ALL SELECT p_partkey, 'note', 'Remark', 'container', 'textarea', 0, NULL, {_CHARS('p_name')}, NULL, 0 FROM part
UNION ALL SELECT p_partkey, 'pin', 'Your PIN', 'aria-label', 'password', 0, NULL, NULL, NULL, 1 FROM part""",
    "built_clean_pages": """SELECT p_partkey AS page_id, '<script></script><p title="ask &lt;EMAIL&gt;">Mail &lt;EMAIL&gt;</p><form><label for="size">Size</label><input id="size" type="number" required="" maxlength="4" value="&lt;' || length(p_size::VARCHAR)
|| ' chars&gt;"><p><select name="brand" aria-label="Brand"><option value="' || p_brand || '">' || p_brand || '</option><option value="none">none</option></select></p><div class="form-group"><label>Remark</label><textarea name="note">&lt;' || length(p_name)
|| ' chars&gt;</textarea></div><p><input type="password" name="pin" aria-label="Your PIN" value="&lt;redacted&gt;"></p></form>' AS html FROM part""",
    "built_trails": "SELECT s_suppkey AS page_id, unnest([1, 2, 3])::INT AS n, unnest(['Home', 'Suppliers', s_name]) AS text FROM supplier",
    "built_tabs": "SELECT s_suppkey AS page_id, 'tabs' AS kind, unnest(['Open ' || s_nationkey, 'Closed']) AS text, unnest([1, 0]) AS active, 0 AS disabled FROM supplier",
    "built_files": "SELECT s_suppkey AS page_id, 'pdf' AS extension, 'direct' AS kind, 1 AS n FROM supplier",
    "built_buttons": "SELECT s_suppkey AS page_id, unnest(['Save', 'Delete ' || s_suppkey]) AS text, 'submit' AS type, unnest([0, 1]) AS danger FROM supplier",
    "built_pagers": "SELECT s_suppkey AS page_id, 'numbered' AS style, 1 AS has_next, 0 AS has_prev, CAST(s_suppkey AS VARCHAR) AS current FROM supplier",
    "built_errors": "SELECT s_suppkey AS page_id, 'No answer from ' || s_name AS text FROM supplier",
    "built_steps": "SELECT s_suppkey AS page_id, unnest([1, 2, 3, 4, 5])::INT AS n, unnest(['Home', 'Suppliers', s_name, 'Open ' || s_nationkey, 'Closed']) AS text, unnest([0, 0, 0, 1, 0]) AS active FROM supplier",
    "built_menus": """SELECT s_suppkey AS page_id, unnest(['Home', 'Stock of ' || s_name, 'Stock of ' || s_name || ' > List', 'Stock of ' || s_name || ' > More', 'Stock of ' || s_name || ' > More > Nation > Nation ' || s_nationkey]) AS path,
unnest(['/', NULL, '/s/' || s_suppkey, NULL, '/n/' || s_nationkey]) AS href, unnest([0, 1, 0, 1, 0]) AS has_children FROM supplier""",
    "built_leads": f"SELECT {_SITE}, lower(c_name) AS menu_id, '/c/' || c_custkey AS route FROM customer",
    "built_unvisited": f"SELECT {_SITE}, 'orders of ' || lower(c_name) AS menu_id, 'Orders of ' || c_name AS text FROM customer",
    "built_coverage": f"SELECT {_SITE}, 2 * count(*) AS menu_items, count(*) AS menu_visited, count(*) AS pages FROM customer GROUP BY c_nationkey",
    "built_findings": f"""SELECT {_SITE}, 'menu' AS class, 'Menu item "Orders of ' || c_name || '" was seen but never opened.' AS sentence FROM customer""",
}
