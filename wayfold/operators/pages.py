"""What a stored page shows: outline, navigation, lists, controls, hints.

A page becomes rows once (:func:`page_nodes`); everything else filters and joins
those rows. Containment is an equi join on the ancestor ids a node carries, so
no step pairs all elements of a page.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.exprs import at_most, first_of, norm, shortened, squeeze, text
from ..functions.html import html_nodes
from ..functions.names import classify_id, is_danger, looks_random
from ..functions.redaction import is_credential, redact_value, scrub_expr
from ..functions.urls import clean_href, path_of
from ..session import cut_lineage

DOC = ("page_id",)

#: Limits of display per page part; None keeps all. A caller with a use for one sets it.
CAPS: dict[str, int | None] = dict.fromkeys((
    "headings", "steps", "buttons", "errors", "notices", "text", "menu", "nav_text", "breadcrumbs", "tables", "headers", "repeats", "slots", "pagination", "downloads", "options", "view_options",
))

# ---- fixed values: roles and classes of page parts ---------------------------
_SEMANTIC_TAGS = ("nav", "mat-sidenav", "mat-nav-list")
_REGION_CLASS = r"(^|\s)(navbar|sidebar|sidenav|p-menubar|p-panelmenu|p-megamenu|dropdown-menu|mat-menu-panel|mat-mdc-menu-panel|p-menu|p-tieredmenu|p-slidemenu|p-contextmenu)(\s|$)"
_REGION_ROLE = ("navigation", "menubar", "tree", "menu")
_ITEM_TAGS = ("a", "button", "summary")
_ITEM_ROLES = ("button", "menuitem", "menuitemradio", "menuitemcheckbox", "treeitem", "link")
_ITEM_CLASS = r"(^|\s)(dropdown-item|nav-link|p-menuitem-link)(\s|$)"
_NOT_MENU_CLASS = r"(?i)nav-tabs|pagina|pager|paging|breadcrumb"
_NOT_MENU_ROLE = ("tablist", "listbox", "table", "grid", "treegrid")
_CONTENT_TAGS = ("article", "dialog", "form", "table", "li", "section", "main")
_SUBMENU_TAGS = ("ul", "ol", "menu")
_NO_OWNER_TAGS, _NO_OWNER_ROLES = ("input", "select", "textarea"), ("tab", "combobox")
_ACTIVE_CLASS = r"(?:^|[\s_-])(?:active|activated|selected|current|checked|highlight)(?:\s|$)"
_DISABLED_CLASS = r"(?:^|[\s_-])disabled(?:\s|$)"
_DOC_EXT = r"(?i)\.(pdf|docx?|xlsx?|csv|pptx?|zip|txt|json|xml|rtf|odt|ods)(?:[?#]|\z)"
_PAGE_INDICATOR = r"^[^0-9]{0,12}[0-9]+(?:[^0-9]{1,12}[0-9]+){1,2}[^0-9]{0,12}\z"
_DATE_HINT, _SEARCH_HINT = r"(?i)date|dob|calendar|picker", r"(?i)search|autocomplete|typeahead|lookup"
_ICON_HINT = r"(?i)calendar|date|picker|search|lookup|dropdown|arrow|chevron|caret|clock|icon"


def page_nodes(pages: DataFrame, *, html: str = "html", doc: Sequence[str] = DOC, keep: Sequence[str] = (), write: bool = False) -> DataFrame:
    """Elements and text nodes of every page, in document order per page.

    ``write`` puts the rows into the checkpoint folder first: a page is then
    parsed once however many extractors read it.
    """
    slim = pages.select(*doc, *keep, F.col(html).alias("__html"))
    nodes = html_nodes(slim, "__html")
    return cut_lineage(nodes) if write else nodes


def attr(name: str) -> Column:
    return text(F.col("attrs")[name])


def has_attr(name: str) -> Column:
    return F.array_contains(F.map_keys("attrs"), name)


def _within(nodes: DataFrame, outer: DataFrame, doc: Sequence[str], out: str) -> DataFrame:
    """``(doc…, idx, out)``: nearest matching ancestor of each node."""
    up = nodes.select(*doc, "idx", F.explode("path").alias(out))
    return up.join(outer.select(*doc, F.col("idx").alias(out)), [*doc, out]).groupBy(*doc, "idx").agg(F.max(out).alias(out))


def with_whole_text(rows: DataFrame, nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``rows`` of ``nodes`` with the text of elements that carry none because it is long and they only hold a page."""
    silent = rows.filter(F.col("text").isNull()).select(*doc, "idx")
    spoken = nodes.filter(F.col("tag") == "#text").select(*doc, F.col("idx").alias("__i"), squeeze("text").alias("__t"), F.explode("path").alias("idx"))
    whole = spoken.join(silent, [*doc, "idx"], "left_semi").groupBy(*doc, "idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__t"))), lambda x: x["__t"]), " ").alias("__whole"))
    return rows.join(whole, [*doc, "idx"], "left").withColumn("text", F.coalesce("text", "__whole")).drop("__whole")


def _first_distinct(rows: DataFrame, value: str, doc: Sequence[str], cap: int | None) -> DataFrame:
    """Distinct values of a page in order of first appearance, ``cap`` of them if asked."""
    first = rows.filter(F.col(value) != "").groupBy(*doc, value).agg(F.min("idx").alias("idx"))
    order = Window.partitionBy(*doc).orderBy("idx")
    return first.withColumn("n", F.row_number().over(order)).filter(at_most(F.col("n"), cap))


# -------------------------------------------------------------- page level


def page_outline(nodes: DataFrame, *, doc: Sequence[str] = DOC, packs=("generic",)) -> DataFrame:
    """``(doc…, n, heading)``: headings in order of first appearance."""
    wanted = F.col("tag").isin("h1", "h2", "h3", "h4", "legend") | ((F.col("tag") != "#text") & (attr("class").contains("title") | attr("class").contains("heading")))
    rows = nodes.filter(wanted).select(*doc, "idx", scrub_expr(shortened(squeeze("text"), CAPS["text"]), packs).alias("heading"))
    return _first_distinct(rows, "heading", doc, CAPS["headings"]).select(*doc, "n", "heading")


def page_title(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    return nodes.groupBy(*doc).agg(
        F.coalesce(F.min_by(squeeze("text"), F.when(F.col("tag") == "title", F.col("idx"))), F.lit("")).alias("title"),
        F.coalesce(F.min_by(attr("lang"), F.when(F.col("tag") == "html", F.col("idx"))), F.lit("")).alias("lang"),
    )


def _named_parts(nodes: DataFrame, cond: Column, cap: str, doc: Sequence[str], packs) -> DataFrame:
    rows = nodes.filter((F.col("tag") != "#text") & cond).select(*doc, "idx", scrub_expr(shortened(squeeze("text"), CAPS["text"]), packs).alias("text"))
    return _first_distinct(rows, "text", doc, CAPS[cap]).select(*doc, "n", "text")


def page_errors(nodes: DataFrame, *, doc: Sequence[str] = DOC, packs=("generic",)) -> DataFrame:
    c = attr("class")
    return _named_parts(nodes, c.contains("error") | c.contains("invalid") | c.contains("danger") | (attr("role") == "alert") | (F.col("tag") == "mat-error"), "errors", doc, packs)


def page_notices(nodes: DataFrame, *, doc: Sequence[str] = DOC, packs=("generic",)) -> DataFrame:
    c = attr("class")
    return _named_parts(nodes, c.contains("alert") | c.contains("info") | c.contains("note"), "notices", doc, packs)


def page_steps(nodes: DataFrame, *, doc: Sequence[str] = DOC, packs=("generic",)) -> DataFrame:
    """``(doc…, n, text, active)``: tabs, wizard steps and crumbs."""
    lists = nodes.filter(attr("class").rlike(r"nav-tabs|(^|\s)breadcrumb(\s|$)") | (attr("role") == "tablist"))
    inside = _within(nodes.filter(F.col("tag") != "#text"), lists, doc, "list")
    n = nodes.join(inside, [*doc, "idx"], "left")
    step = (attr("role") == "tab") | attr("class").contains("step") | attr("class").contains("wizard") | (F.col("list").isNotNull() & ((F.col("tag") == "li") | (F.col("parent") == F.col("list"))))
    active = attr("class").rlike(r"(^|\s)(active|current|selected|mat-tab-label-active|is-active)(\s|$)") | (attr("aria-selected") == "true") | has_attr("aria-current")
    rows = n.filter((F.col("tag") != "#text") & step).select(*doc, "idx", scrub_expr(shortened(squeeze("text"), CAPS["text"]), packs).alias("text"), active.alias("active"))
    first = rows.filter(F.col("text") != "").groupBy(*doc, "text").agg(F.min("idx").alias("idx"), F.min_by("active", "idx").alias("active"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(*doc).orderBy("idx"))).filter(at_most(F.col("n"), CAPS["steps"])).select(*doc, "n", "text", "active")


def auth_hint(nodes: DataFrame, *, url: str | None = None, doc: Sequence[str] = DOC) -> DataFrame:
    """Logged in, out or unknown, with evidence: password fields first, text last.

    ``url`` names a column carried on the nodes.
    """
    link = F.col("tag").isin("a", "button") | (attr("role") == "button")
    href = F.regexp_extract(attr("href"), r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    said = F.substring(squeeze("text"), 1, 40)
    first = lambda v, cond: F.min_by(v, F.when(cond, F.col("idx")))
    out_href, in_href = link & href.rlike(P.LOGOUT_PATH), link & href.rlike(P.LOGIN_PATH) & ~href.rlike(P.LOGOUT_PATH)
    out_text, in_text = link & said.rlike(P.LOGOUT_TEXT), link & said.rlike(P.LOGIN_TEXT) & ~said.rlike(P.LOGOUT_TEXT)
    tokens = attr("autocomplete").isin("current-password", "username", "one-time-code")
    g = nodes.groupBy(*doc).agg(
        F.max((F.col("tag") == "input") & (F.lower(attr("type")) == "password")).alias("pw"), F.max(tokens).alias("tok"),
        first(href, out_href).alias("oh"), first(href, in_href).alias("ih"), first(said, out_text).alias("ot"), first(said, in_text).alias("it"),
        (F.first(path_of(url)) if url else F.lit("")).alias("at"),
    )
    verdict = lambda logged, evidence, confidence: F.struct(F.lit(logged).cast("boolean").alias("logged_in"), evidence.alias("evidence"), F.lit(confidence).alias("confidence"))
    say = lambda prefix, c: F.concat(F.lit(prefix), scrub_expr(c))
    oh, ih, ot, it = (F.col(c).isNotNull() for c in ("oh", "ih", "ot", "it"))
    hint = (
        F.when(F.col("pw"), verdict(False, F.lit("password field present"), "high"))
        .when(F.col("tok"), verdict(False, F.lit("credential autocomplete token present"), "high"))
        .when(F.col("at").rlike(P.LOGOUT_PATH), verdict(None, F.lit("page path is a logout route"), "medium"))
        .when(F.col("at").rlike(P.LOGIN_PATH), verdict(False, F.concat(F.lit("page path matches login ("), "at", F.lit(")")), "medium"))
        .when(oh & ~ih, verdict(True, say("logout href: ", F.col("oh")), "medium"))
        .when(ih & ~oh, verdict(False, say("login href: ", F.col("ih")), "medium"))
        .when(oh & ih, verdict(None, F.lit("both login and logout hrefs present"), "medium"))
        .when(ot & ~it, verdict(True, F.concat(F.lit('English logout text: "'), "ot", F.lit('"')), "low"))
        .when(it & ~ot, verdict(False, F.concat(F.lit('English login text: "'), "it", F.lit('"')), "low"))
        .when(ot & it, verdict(None, F.lit("both login and logout text present"), "low"))
        .otherwise(verdict(None, F.lit("no auth signal found"), "low"))
    )
    return g.select(*doc, hint.alias("h")).select(*doc, "h.*")


def framework(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """Front-end framework from the attributes that outlive the page."""
    keys = F.map_keys("attrs")
    some = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    prefixed = lambda *ps: F.exists(keys, lambda k: F.greatest(*[k.startswith(p).cast("int") for p in ps], F.lit(0)) == 1)
    g = nodes.filter(F.col("tag") != "#text").groupBy(*doc).agg(
        F.min_by(attr("ng-version"), F.when(has_attr("ng-version"), F.col("idx"))).alias("ng"),
        some(prefixed("ng-reflect-", "_nghost-", "_ngcontent-")).alias("ng2"), some(has_attr("data-reactroot") | has_attr("data-reactid")).alias("react"),
        some(attr("id") == "__next").alias("next"), some((attr("id") == "__nuxt") | has_attr("data-v-app")).alias("nuxt"), some(prefixed("data-v-")).alias("vue"), some(attr("class").contains("svelte-")).alias("svelte"),
    )
    pick = lambda name, confidence: F.struct(F.lit(name).alias("framework"), F.lit(confidence).alias("confidence"))
    found = (
        F.when(F.col("ng").isNotNull(), pick("angular", "high")).when(F.col("ng2"), pick("angular", "medium")).when(F.col("react"), pick("react", "high"))
        .when(F.col("next"), pick("react", "medium")).when(F.col("nuxt") | F.col("vue"), pick("vue", "medium")).when(F.col("svelte"), pick("svelte", "medium")).otherwise(pick("plain", "low"))
    )
    return g.select(*doc, found.alias("f"), F.nullif(F.col("ng"), F.lit("")).alias("version")).select(*doc, "f.framework", "version", "f.confidence")


def custom_elements(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """Childless elements with a dash in their name: places a capture may not see into."""
    return nodes.filter(F.col("tag").contains("-") & (F.col("n_kids") == 0)).select(*doc, "idx", "tag")


# -------------------------------------------------------------- navigation


def accessible_name(nodes: DataFrame, *, doc: Sequence[str] = DOC, limit: int | None = None) -> DataFrame:
    """``(doc…, idx, name)``: labelled-by text, aria-label, caption, own text, title, alt; whole, or ``limit`` characters if asked."""
    return _names(with_whole_text(nodes, nodes, doc=doc), doc, limit)


def _names(nodes: DataFrame, doc: Sequence[str], limit: int | None) -> DataFrame:
    """Accessible names of elements that carry their text."""
    by_id = nodes.filter(attr("id") != "").groupBy(*doc, attr("id").alias("ref")).agg(F.min_by("text", "idx").alias("__said"))
    refs = nodes.filter(attr("aria-labelledby") != "").select(*doc, "idx", F.posexplode(F.split(F.trim(attr("aria-labelledby")), r"\s+")).alias("pos", "ref"))
    named = refs.join(by_id, [*doc, "ref"]).groupBy(*doc, "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__said"))), lambda x: x["__said"]), " ").alias("__by"))
    alt = nodes.filter((F.col("tag") == "img") & (attr("alt") != "")).select(*doc, F.explode("path").alias("idx"), attr("alt").alias("a"), F.col("idx").alias("i")).groupBy(*doc, "idx").agg(F.min_by("a", "i").alias("__alt"))
    n = nodes.filter(F.col("tag") != "#text").join(named, [*doc, "idx"], "left").join(alt, [*doc, "idx"], "left")
    kind = F.lower(attr("type"))
    caption = F.when((F.col("tag") == "input") & kind.isin("submit", "button", "reset"), attr("value")).when((F.col("tag") == "input") & (kind == "image"), attr("alt"))
    own = F.when(F.col("tag") == "img", attr("alt")).otherwise(text("text"))
    pick = F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in (text("__by"), attr("aria-label"), text(caption), own, attr("title"), text("__alt"))], F.lit(""))
    return n.select(*doc, "idx", shortened(pick, limit).alias("name"))


def _submenu() -> Column:
    return F.col("tag").isin(*_SUBMENU_TAGS) | attr("role").isin("menu", "group") | attr("class").rlike(r"submenu|sub-menu|(^|\s)(dropdown-menu|collapse)(\s|$)")


def owned_panels(el: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``(doc…, panel, owner, up)``: what an element elsewhere opens, by ids, and the panel that this element is in.

    The first element that names an id in ``aria-controls`` or ``aria-owns`` owns it; a submenu that
    none names is owned by the first element of its ``aria-labelledby``. Nothing owns what it is inside of.
    """
    ids = el.filter(attr("id") != "").groupBy(*doc, attr("id").alias("__ref")).agg(F.min("idx").alias("panel"))
    says = el.filter(~F.col("tag").isin(*_NO_OWNER_TAGS) & ~attr("role").isin(*_NO_OWNER_ROLES)).select(
        *doc, F.col("idx").alias("owner"), F.explode(F.split(F.concat_ws(" ", attr("aria-controls"), attr("aria-owns")), r"\s+")).alias("__ref"))
    named = says.filter(F.col("__ref") != "").groupBy(*doc, "__ref").agg(F.min("owner").alias("owner")).join(ids, [*doc, "__ref"]).select(*doc, "panel", "owner")
    labelled = el.filter(_submenu() & (attr("aria-labelledby") != "")).select(*doc, F.col("idx").alias("panel"), F.get(F.split(F.trim(attr("aria-labelledby")), r"\s+"), F.lit(0)).alias("__ref"))
    by_label = labelled.join(ids.withColumnRenamed("panel", "owner"), [*doc, "__ref"]).select(*doc, "panel", "owner").join(named.select(*doc, "panel"), [*doc, "panel"], "left_anti")
    place = el.select(*doc, F.col("idx").alias("owner"), F.col("path").alias("__path"))
    pairs = cut_lineage(named.unionByName(by_label).join(place, [*doc, "owner"]).filter((F.col("panel") != F.col("owner")) & ~F.array_contains("__path", F.col("panel"))))
    up = pairs.select(*doc, "owner", F.explode("__path").alias("up")).join(pairs.select(*doc, F.col("panel").alias("up")).distinct(), [*doc, "up"]).groupBy(*doc, "owner").agg(F.max("up").alias("up"))
    known = pairs.drop("__path").join(up, [*doc, "owner"], "left")
    return cut_lineage(known.select(*[F.col(c).alias(c) for c in known.columns]))


def _attached(panels: DataFrame, inside: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Panels whose owner is ``inside`` (``(doc…, owner)``) or in a panel that is attached, to a fix point."""
    seen = fresh = cut_lineage(panels.join(inside, [*doc, "owner"], "left_semi").select(*doc, "panel"))
    while fresh.limit(1).count():
        below = panels.join(fresh.select(*doc, F.col("panel").alias("up")), [*doc, "up"], "left_semi").select(*doc, "panel")
        fresh = cut_lineage(below.join(seen, [*doc, "panel"], "left_anti"))
        seen = cut_lineage(seen.unionByName(fresh))
    return seen


def _chains(levels: DataFrame, doc: Sequence[str]) -> DataFrame:
    """``(doc…, panel, chain)``: names above what is in a panel, from ``(doc…, panel, up, names)``; panels that own each other keep their own names."""
    whole = cut_lineage(levels.filter(F.col("up").isNull()).select(*doc, "panel", F.col("names").alias("chain")))
    left, fresh = cut_lineage(levels.filter(F.col("up").isNotNull())), whole
    while fresh.limit(1).count():
        above = fresh.select(*doc, F.col("panel").alias("up"), "chain")
        fresh = cut_lineage(left.join(above, [*doc, "up"]).select(*doc, "panel", F.concat("chain", "names").alias("chain")))
        left = cut_lineage(left.join(fresh, [*doc, "panel"], "left_anti"))
        whole = cut_lineage(whole.unionByName(fresh))
    return whole.unionByName(left.select(*doc, "panel", F.col("names").alias("chain")))


def _menu_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that menus are made of, written with what the rules say of each: the rules are tried once a node, however many steps read them."""
    role, cls = attr("role"), attr("class")
    item = F.col("tag").isin(*_ITEM_TAGS) | role.isin(*_ITEM_ROLES) | cls.rlike(_ITEM_CLASS) | has_attr("mat-menu-item") | has_attr("mat-list-item")
    rules = {
        "__landmark": F.col("tag").isin("header", "aside"),
        "__strong": F.col("tag").isin(*_SEMANTIC_TAGS) | role.isin(*_REGION_ROLE) | cls.rlike(_REGION_CLASS),
        "__content": F.col("tag").isin(*_CONTENT_TAGS) | (role == "dialog"),
        "__item": item & ~role.isin("tab", "combobox", "option"),
        "__banned": F.col("tag").isin("table", "mat-paginator") | role.isin(*_NOT_MENU_ROLE) | cls.rlike(_NOT_MENU_CLASS),
        "__sub": _submenu(),
        "__wrap": F.col("tag").isin("li", "details") | cls.rlike(r"(^|\s)(dropdown|dropup|btn-group|nav-item)(\s|$)"),
        "__refers": F.concat(*[attr(a) for a in ("id", "aria-controls", "aria-owns", "aria-labelledby")]) != "",
    }
    spoken = F.col("tag") == "#text"
    # No rule holds of an element without attributes but by its tag. This is all that is asked first, for a filter by the rules would try them twice.
    some = spoken | (F.size("attrs") > 0) | F.col("tag").isin("header", "aside", "li", "details", "mat-paginator", *_SEMANTIC_TAGS, *_ITEM_TAGS, *_CONTENT_TAGS, *_SUBMENU_TAGS)
    marked = nodes.filter(some).withColumns({name: F.coalesce(~spoken & rule, F.lit(False)) for name, rule in rules.items()})
    said = F.when(spoken | F.col("__item") | F.col("__refers"), F.col("text"))  # that of holders repeats what they hold
    return cut_lineage(marked.withColumn("text", said).drop("__refers"))


def nav_items(nodes: DataFrame, *, doc: Sequence[str] = DOC, url: str | None = None, packs=("generic",)) -> DataFrame:
    """Items of navigation regions: text, menu path, target, children, current.

    A panel that an element elsewhere owns by id belongs to where its owner is: its items
    count if the owner's do, and their path goes on from the owner's.
    ``url`` names a column carried on the nodes and is what links resolve on.
    """
    nodes = _menu_nodes(nodes)
    el = nodes.filter(F.col("tag") != "#text")
    inner = _within(el.filter(F.col("__landmark") & ~F.col("__strong")), el.filter("__content"), doc, "__at").select(*doc, "idx")
    regions = el.filter(F.col("__strong") | F.col("__landmark")).join(inner, [*doc, "idx"], "left_anti").withColumn("__loose", ~F.col("__strong"))
    items, banned = el.filter("__item"), el.filter("__banned")
    in_region = _within(items, regions, doc, "region").join(regions.select(*doc, F.col("idx").alias("region"), "__loose"), [*doc, "region"])
    out_of = _within(items, banned, doc, "__b").select(*doc, "idx")
    panels = owned_panels(el, doc=doc)
    owned = panels.limit(1).count() > 0
    if owned:
        owners = el.join(panels.select(*doc, F.col("owner").alias("idx")), [*doc, "idx"], "left_semi")
        attached = _attached(panels, _within(owners, regions, doc, "__r").select(*doc, F.col("idx").alias("owner")), doc)
        at = _within(items, panels.select(*doc, F.col("panel").alias("idx")), doc, "panel")
        # columns of their own, as this table meets others that come of the same nodes
        home = cut_lineage(at.select(*[F.col(c).alias(c) for c in at.columns]))
        more = home.join(attached, [*doc, "panel"], "left_semi").join(in_region, [*doc, "idx"], "left_anti")
        in_region = in_region.unionByName(more.select(*doc, "idx", F.col("panel").alias("region"), F.lit(False).alias("__loose")))
    names = _names(items, doc, CAPS["nav_text"]).withColumn("text", shortened(scrub_expr("name", packs), CAPS["nav_text"])).drop("name")
    expander = has_attr("aria-expanded") | has_attr("aria-haspopup") | has_attr("data-toggle") | has_attr("data-bs-toggle")
    loose_ok = ((F.col("tag") == "a") & has_attr("href")) | (F.col("tag") == "summary") | attr("role").isin(*_ITEM_ROLES[1:]) | expander
    kept = items.drop("text").join(in_region, [*doc, "idx"]).join(out_of, [*doc, "idx"], "left_anti").filter(~F.col("__loose") | loose_ok).join(names, [*doc, "idx"]).filter(F.col("text") != "")
    # A wrapper that only repeats the item inside it is not an item of its own.
    repeats = kept.select(*doc, "text", F.explode("path").alias("idx")).distinct()
    # The items of a page are few; writing them once keeps the path joins below short.
    kept = cut_lineage(kept.join(repeats, [*doc, "idx", "text"], "left_anti"))
    sub = el.filter("__sub").select(*doc, F.col("idx").alias("sub"), F.col("parent").alias("wrap"), "sib")
    if owned:
        sub = sub.join(panels.select(*doc, F.col("panel").alias("sub")), [*doc, "sub"], "left_anti")
    wrap = el.filter("__wrap").select(*doc, F.col("idx").alias("wrap"))
    levels = sub.join(wrap, [*doc, "wrap"])
    heads = kept.select(*doc, F.col("parent").alias("wrap"), F.col("idx").alias("head"), "text", F.col("sib").alias("__hs"))
    label = levels.join(heads, [*doc, "wrap"]).filter(F.col("__hs") < F.col("sib")).groupBy(*doc, "sub").agg(F.max_by(F.struct("text", "head"), "__hs").alias("h"))
    own = nodes.filter(F.col("tag") == "#text").select(*doc, F.col("parent").alias("wrap"), "idx", squeeze("text").alias("t")).groupBy(*doc, "wrap").agg(F.min_by("t", "idx").alias("__own"))
    titled = levels.join(label, [*doc, "sub"], "left").join(own, [*doc, "wrap"], "left").select(*doc, "sub", F.coalesce(F.col("h.text"), "__own").alias("__name"), F.col("h.head").alias("head")).filter(F.col("__name").isNotNull())
    names_above = lambda rows: rows.select(*doc, "idx", F.explode("path").alias("sub")).join(titled.select(*doc, "sub", "__name"), [*doc, "sub"]).groupBy(*doc, "idx").agg(F.array_sort(F.collect_list(F.struct("sub", "__name"))).alias("__up"))
    opens = titled.filter(F.col("head").isNotNull()).select(*doc, F.col("head").alias("idx"), F.lit(True).alias("__opens")).distinct()
    if owned:
        opens = opens.unionByName(panels.select(*doc, F.col("owner").alias("idx"), F.lit(True).alias("__opens"))).distinct()
    j = kept.join(names_above(kept), [*doc, "idx"], "left").join(opens, [*doc, "idx"], "left")
    below = lambda panel: F.transform(F.filter(F.coalesce("__up", F.array().cast("array<struct<sub:int,__name:string>>")), lambda x: F.col(panel).isNull() | (x["sub"] > F.col(panel))), lambda x: x["__name"])
    if owned:
        said = _names(owners, doc, CAPS["nav_text"]).select(*doc, F.col("idx").alias("owner"), shortened(scrub_expr("name", packs), CAPS["nav_text"]).alias("__said"))
        of_owner = panels.join(said, [*doc, "owner"], "left").join(names_above(owners).withColumnRenamed("idx", "owner"), [*doc, "owner"], "left")
        chains = _chains(of_owner.select(*doc, "panel", "up", F.concat(below("up"), F.filter(F.array("__said"), lambda x: x != "")).alias("names")), doc)
        j = j.join(home, [*doc, "idx"], "left").join(chains, [*doc, "panel"], "left")
        path = F.concat(F.coalesce("chain", F.array().cast("array<string>")), below("panel"), F.array("text"))
    else:
        path = F.concat(F.transform(F.coalesce("__up", F.array().cast("array<struct<sub:int,__name:string>>")), lambda x: x["__name"]), F.array("text"))
    target = clean_href(F.col("attrs")["href"], F.col(url) if url else F.lit("http://localhost/"), packs)
    found = j.select(
        *doc, "idx", "text", path.alias("path"), F.when((F.col("tag") == "a") & has_attr("href"), target).alias("href"),
        (F.coalesce("__opens", F.lit(False)) | expander | (F.col("tag") == "summary")).alias("has_children"),
        (attr("class").rlike(_ACTIVE_CLASS) | (has_attr("aria-current") & (attr("aria-current") != "false"))).alias("current"), attr("id").alias("id"),
    )
    first = found.groupBy(*doc, "path", F.coalesce("href", F.lit("")).alias("__h")).agg(F.min_by(F.struct("idx", "text", "href", "has_children", "current", "id"), "idx").alias("f"))
    ranked = first.select(*doc, "path", "f.*").withColumn("n", F.row_number().over(Window.partitionBy(*doc).orderBy("idx")))
    return ranked.filter(at_most(F.col("n"), CAPS["menu"])).withColumn("depth", F.size("path") - 1)


def breadcrumbs(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``(doc…, n, text)``: the first trail of the page, repeats next to each other dropped."""
    trails = nodes.filter((F.col("tag") != "#text") & (attr("class").contains("breadcrumb") | attr("itemtype").contains("BreadcrumbList") | F.lower(attr("aria-label")).contains("breadcrumb")))
    top = trails.groupBy(*doc).agg(F.min("idx").alias("__top"))
    inside = nodes.join(top, list(doc)).filter(F.array_contains("path", F.col("__top")))
    lis = inside.filter(F.col("tag") == "li")
    links = inside.filter(F.col("tag").isin("a", "span")).join(lis.select(*doc).distinct(), list(doc), "left_anti")
    rows = lis.unionByName(links)
    nested = rows.select(*doc, "idx", F.explode("path").alias("__up")).join(rows.select(*doc, F.col("idx").alias("__up")), [*doc, "__up"], "left_semi").select(*doc, "idx")
    w = Window.partitionBy(*doc).orderBy("idx")
    t = rows.join(nested, [*doc, "idx"], "left_anti").select(*doc, "idx", squeeze("text").alias("text")).filter(F.col("text") != "")
    kept = t.withColumn("__p", F.lag("text").over(w)).filter(~F.col("text").eqNullSafe(F.col("__p"))).withColumn("n", F.row_number().over(w))
    return kept.filter(at_most(F.col("n"), CAPS["breadcrumbs"])).select(*doc, "n", "text")


def view_groups(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """Tabs, chips, segmented buttons, radios and selects: two options or more.

    ``(doc…, group_idx, kind, name, option_idx, text, active, disabled)``; names
    are made unique with ``#2``. An option belongs to its nearest group.
    """
    from .records import unique_names

    el = nodes.filter(F.col("tag") != "#text")
    c, role = attr("class"), attr("role")
    kind = (
        F.when((role == "tablist") | c.rlike(r"(^|\s)(nav-tabs|nav-pills|mat-tab-nav-bar|p-tabview-nav|p-tabmenu-nav)(\s|$)"), "tabs")
        .when((role == "listbox") | c.rlike(r"chip-list|chip-group|chips|pill-group|mat-mdc-chip-set|mat-chip-list"), "chips")
        .when((role == "radiogroup") | (F.col("tag") == "fieldset"), "radios")
        .when((role == "toolbar") | c.rlike(r"btn-group|button-group|segmented|toggle-group|p-selectbutton"), "segmented")
        .when(F.col("tag") == "select", "select")
    )
    groups = el.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    option = (
        (role == "tab") | (role == "option") | (F.col("tag") == "option") | ((F.col("tag") == "input") & (F.lower(attr("type")) == "radio")) | (role == "radio")
        | F.col("tag").isin("button", "mat-chip", "mat-chip-option", "mat-button-toggle") | (F.col("tag") == "a") | c.rlike(r"(^|\s)(chip|pill)(\s|$)")
    )
    opts = el.filter(option)
    home = _within(opts, groups, doc, "group_idx").join(groups.select(*doc, F.col("idx").alias("group_idx"), "kind", attr("aria-label").alias("__gl"), attr("id").alias("__gid"), attr("name").alias("__gn"), c.alias("__gc")), [*doc, "group_idx"])
    fits = (
        ((F.col("kind") == "tabs") & ((role == "tab") | F.col("tag").isin("a", "button"))) | ((F.col("kind") == "chips") & ((role == "option") | F.col("tag").startswith("mat-chip") | c.rlike("chip|pill")))
        | ((F.col("kind") == "radios") & ((F.lower(attr("type")) == "radio") | (role == "radio"))) | ((F.col("kind") == "segmented") & (F.col("tag").isin("button", "mat-button-toggle") | (role == "button")))
        | ((F.col("kind") == "select") & (F.col("tag") == "option"))
    )
    label = resolve_labels(opts.filter(F.lower(attr("type")) == "radio"), nodes, doc=doc).select(*doc, "idx", F.col("label").alias("__lab"))
    rows = opts.join(home, [*doc, "idx"]).filter(fits).join(label, [*doc, "idx"], "left").select(
        *doc, "group_idx", "kind", F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in ("__gl", "__gid", "__gn", "__gc")], F.col("kind")).alias("__base"), F.col("idx").alias("option_idx"),
        F.coalesce(F.nullif(squeeze("text"), F.lit("")), "__lab", F.lit("")).alias("text"),
        (attr("class").rlike(_ACTIVE_CLASS) | (attr("aria-selected") == "true") | (attr("aria-pressed") == "true") | (attr("aria-checked") == "true") | has_attr("checked") | has_attr("selected")).alias("active"),
        (has_attr("disabled") | (attr("aria-disabled") == "true") | attr("class").rlike(_DISABLED_CLASS)).alias("disabled"),
    ).filter(F.col("text") != "")
    sizes = rows.groupBy(*doc, "group_idx", "__base").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    named = unique_names(sizes, base="__base", order=["group_idx"], by=list(doc), out="__u", chunk=5000).withColumn("name", F.when(F.col("__u") == F.col("__base"), F.col("__u")).otherwise(F.regexp_replace("__u", r"_([0-9]+)\z", "#$1")))
    w = Window.partitionBy(*doc, "group_idx").orderBy("option_idx")
    return rows.join(named.select(*doc, "group_idx", "name"), [*doc, "group_idx"]).withColumn("__n", F.row_number().over(w)).filter(at_most(F.col("__n"), CAPS["view_options"])).drop("__base", "__n")


# ------------------------------------------------------------------- lists


def tables(nodes: DataFrame, *, doc: Sequence[str] = DOC, packs=("generic",)) -> DataFrame:
    """``(doc…, idx, headers, n_rows, first_row)`` per table; cells keep only their length."""
    el = nodes.filter(F.col("tag") != "#text")
    native = F.col("tag") == "table"
    t = el.filter(native | attr("role").isin("table", "grid", "treegrid"))
    # What lies in a row of a table lies in the table, so cells need not be placed.
    parts = el.filter(F.col("tag").isin("tr", "th") | attr("role").isin("row", "columnheader"))
    home = parts.join(_within(parts, t, doc, "table"), [*doc, "idx"])
    heads = home.filter((F.col("tag") == "th") | (attr("role") == "columnheader"))
    rows = home.filter((F.col("tag") == "tr") | (attr("role") == "row"))
    cells = el.filter((F.col("tag") == "td") | attr("role").isin("cell", "gridcell", "rowheader"))
    data = cells.groupBy(*doc, F.col("parent").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("sib", redact_value(squeeze("text")).alias("v")))).alias("c"))
    filled = rows.join(data, [*doc, "idx"])
    body = filled.groupBy(*doc, "table").agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("c", "idx").alias("__first"))
    top = heads.groupBy(*doc, "table").agg(F.array_sort(F.collect_list(F.struct("idx", scrub_expr(shortened(squeeze("text"), CAPS["text"]), packs).alias("v")))).alias("__h"))
    out = t.select(*doc, F.col("idx").alias("table")).join(top, [*doc, "table"], "left").join(body, [*doc, "table"], "left").filter(F.col("__h").isNotNull() | F.col("n_rows").isNotNull())
    vals = lambda c: first_of(F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<idx:int,v:string>>")), lambda x: x["v"]), lambda v: v != ""), CAPS["headers"])
    return out.select(*doc, F.col("table").alias("idx"), vals(F.col("__h")).alias("headers"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                      F.transform(F.coalesce("__first", F.array().cast("array<struct<sib:int,v:string>>")), lambda x: x["v"]).alias("first_row"))


def repeats(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``(doc…, idx, signature, n_items)``: containers of three or more children of one kind.

    A kind is the tag and up to three steady classes; the largest kind counts,
    lists inside an item of another list are left out.
    """
    el = nodes.filter((F.col("tag") != "#text") & ~F.col("tag").isin("script", "style", "template", "link", "br", "hr"))
    skip = nodes.filter(F.col("tag").isin("table", "thead", "tbody", "tfoot", "tr", "select", "datalist", "optgroup", "head", "script", "style", "svg", "nav") | attr("role").isin("tablist", "listbox", "menu", "menubar", "radiogroup"))
    steady = F.slice(F.array_sort(F.filter(F.split(attr("class"), r"\s+"), lambda c: (c != "") & ~c.rlike(r"(?i)\d{3,}|[0-9a-f]{5,}|active|selected|odd|even|first|last|hover|focus"))), 1, 3)
    filled = el.filter((F.col("text_len") > 0) | (F.col("tag") == "img"))
    kinds = filled.filter(F.col("parent").isNotNull()).groupBy(*doc, F.col("parent").alias("idx"), F.concat_ws(".", F.col("tag"), F.array_join(steady, ".")).alias("signature")).agg(F.count(F.lit(1)).alias("n_items"), F.min("idx").alias("first_item"))
    best = kinds.filter(F.col("n_items") >= 3).groupBy(*doc, "idx").agg(F.max_by(F.struct("signature", "n_items", "first_item"), F.struct("n_items", -F.col("first_item"))).alias("b")).select(*doc, "idx", "b.*")
    boxes = best.join(el.select(*doc, "idx", "path"), [*doc, "idx"]).join(skip.select(*doc, "idx"), [*doc, "idx"], "left_anti")
    skipped = boxes.select(*doc, "idx", F.explode("path").alias("__up")).join(skip.select(*doc, F.col("idx").alias("__up")), [*doc, "__up"], "left_semi").select(*doc, "idx")
    free = boxes.join(skipped, [*doc, "idx"], "left_anti")
    nested = free.select(*doc, "idx", F.explode("path").alias("__up")).join(free.select(*doc, F.col("idx").alias("__up")), [*doc, "__up"], "left_semi").select(*doc, "idx").distinct()
    top = free.join(nested, [*doc, "idx"], "left_anti")
    w = Window.partitionBy(*doc).orderBy(F.col("n_items").desc(), "idx")
    return top.withColumn("__n", F.row_number().over(w)).filter(at_most(F.col("__n"), CAPS["repeats"])).select(*doc, "idx", "signature", "n_items", "first_item")


def repeat_slots(nodes: DataFrame, found: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``(doc…, container, n, kind, sample)``: links, images and texts of the first item of a list."""
    items = found.select(*doc, F.col("idx").alias("container"), F.col("first_item").alias("item"))
    inside = nodes.select(*doc, "idx", "tag", "attrs", "text", F.explode(F.concat("path", F.array("idx"))).alias("item")).join(items, [*doc, "item"])
    link = (F.col("tag") == "a") & has_attr("href")
    kind = F.when(link, "link").when((F.col("tag") == "img") | (attr("role") == "img"), "image").when(F.col("tag") == "#text", "text")
    sample = F.when(link, "<href>").when(F.col("tag") == "#text", redact_value(F.trim("text"))).otherwise("<img>")
    linked = _within(nodes.filter(F.col("tag") == "#text"), nodes.filter(link), doc, "__a").select(*doc, "idx")
    inside = inside.join(linked, [*doc, "idx"], "left_anti")
    rows = inside.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*doc, "container", "idx", "kind", sample.alias("sample"), (link & (has_attr("download") | attr("href").rlike(_DOC_EXT))).alias("download"))
    rank = F.when(F.col("kind") == "link", 0).when(F.col("kind") == "image", 1).otherwise(2)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*doc, "container").orderBy(rank, "idx"))).filter(at_most(F.col("n"), CAPS["slots"]))


def pagination(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``(doc…, idx, style, has_next, has_prev, current)``: pagers by class or label, and runs of page numbers."""
    el = nodes.filter(F.col("tag") != "#text")
    c, label, rel = attr("class"), F.lower(attr("aria-label")), attr("rel")
    marks = el.filter(c.contains("pag") | label.contains("page") | rel.isin("next", "prev"))
    block = el.filter(F.col("tag").isin("nav", "ul", "ol") | c.contains("pag") | (attr("role") == "navigation"))
    self_or_up = marks.select(*doc, F.col("idx").alias("m"), F.explode(F.concat("path", F.array("idx"))).alias("idx")).join(block.select(*doc, "idx"), [*doc, "idx"]).groupBy(*doc, "m").agg(F.max("idx").alias("idx"))
    number = F.trim("text").rlike(r"^[0-9]{1,4}\z")
    kids = el.filter(number & F.col("parent").isNotNull()).select(*doc, F.col("parent").alias("idx"), "sib", F.trim("text").cast("int").alias("v"))
    w = Window.partitionBy(*doc, "idx").orderBy("sib")
    # Consecutive integers: value minus position is the same all along.
    runs = kids.withColumn("__g", F.col("v") - F.row_number().over(w)).groupBy(*doc, "idx").agg(F.count(F.lit(1)).alias("n"), F.min("__g").alias("lo"), F.max("__g").alias("hi")).filter((F.col("n") >= 3) & (F.col("lo") == F.col("hi")))
    boxes = self_or_up.select(*doc, "idx").unionByName(runs.join(el.filter(F.col("tag").isin("ul", "ol", "nav", "div")).select(*doc, "idx"), [*doc, "idx"]).select(*doc, "idx")).distinct()
    inside = el.select(*doc, F.col("idx").alias("i"), "tag", "attrs", "text", "text_len", F.explode("path").alias("idx")).join(boxes, [*doc, "idx"])
    some = lambda cond: F.max(F.coalesce(cond, F.lit(False)))
    is_next = rel.isin("next") | label.contains("next") | c.contains("next") | F.lower(attr("data-testid")).contains("next")
    is_prev = rel.isin("prev", "previous") | label.contains("prev") | c.contains("prev") | F.lower(attr("data-testid")).contains("prev")
    here = ((has_attr("aria-current") & (attr("aria-current") != "false")) | (attr("aria-selected") == "true") | c.rlike(_ACTIVE_CLASS)) & F.col("text").rlike(r"\p{Nd}")
    shown = F.col("tag").isin("span", "div", "li", "p", "em", "strong") & (F.col("text_len") <= 40) & F.trim("text").rlike(_PAGE_INDICATOR)
    g = inside.groupBy(*doc, "idx").agg(
        some(is_next).alias("has_next"), some(is_prev).alias("has_prev"), F.sum(F.when(F.col("tag").isin("a", "button") & number, 1).otherwise(0)).alias("numbers"),
        some((F.col("tag") == "button") | (attr("role") == "button")).alias("button"), F.min_by(F.substring(squeeze("text"), 1, 40), F.when(here, F.col("i"))).alias("current"),
        F.min_by(F.substring(squeeze("text"), 1, 40), F.when(shown, F.col("i"))).alias("indicator"))
    style = F.when(F.col("numbers") >= 2, "numbered").when(F.col("has_next") | F.col("has_prev"), "next-prev").when(F.col("button"), "load-more").otherwise("unknown")
    ranked = g.withColumn("__n", F.row_number().over(Window.partitionBy(*doc).orderBy("idx"))).filter(at_most(F.col("__n"), CAPS["pagination"]))
    return ranked.select(*doc, "idx", style.alias("style"), "has_next", "has_prev", F.col("indicator").isNotNull().alias("has_indicator"), F.coalesce("current", "indicator").alias("current"))


def download_links(nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """Links with a download attribute or a document extension: direct or by script."""
    href = F.trim(attr("href"))
    ext = F.lower(F.regexp_extract(href, _DOC_EXT, 1))
    rows = nodes.filter((F.col("tag") == "a") & (has_attr("download") | (ext != ""))).select(
        *doc, "idx", F.coalesce(F.nullif(ext, F.lit("")), F.nullif(F.substring_index(attr("download"), ".", -1), F.lit(""))).alias("extension"),
        F.when(href.rlike(r"(?i)^(javascript:|#|\z)"), "script").otherwise("direct").alias("kind"), has_attr("download").alias("download_attr"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*doc).orderBy("idx"))).filter(at_most(F.col("n"), CAPS["downloads"]))


# ---------------------------------------------------------------- controls


def _control(c: Column | None = None) -> Column:
    return (F.col("tag").isin("input", "select", "textarea") & (F.lower(attr("type")) != "hidden")) | (attr("contenteditable") == "true") | attr("role").isin(
        "combobox", "listbox", "textbox", "spinbutton", "slider", "checkbox", "radio", "switch", "searchbox")


def resolve_labels(controls_: DataFrame, nodes: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``(doc…, idx, label, label_source)`` by eight strategies, none of which knows a language."""
    el = nodes.filter(F.col("tag") != "#text")
    said = squeeze(F.regexp_replace(text("text"), r"[\s:*]+\z", ""))
    labels = el.filter(F.col("tag") == "label").withColumn("__s", said)
    by_for = labels.filter(attr("for") != "").groupBy(*doc, attr("for").alias("__id")).agg(F.min_by("__s", "idx").alias("__for"))
    wrap = _within(controls_, labels, doc, "__l").join(labels.select(*doc, F.col("idx").alias("__l"), F.col("__s").alias("__wrap")), [*doc, "__l"]).drop("__l")
    names = el.filter(attr("id") != "").groupBy(*doc, attr("id").alias("__ref")).agg(F.min_by(squeeze("text"), "idx").alias("t"))
    refs = controls_.filter(attr("aria-labelledby") != "").select(*doc, "idx", F.posexplode(F.split(F.trim(attr("aria-labelledby")), r"\s+")).alias("pos", "__ref"))
    by_ref = refs.join(names, [*doc, "__ref"]).groupBy(*doc, "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("__by"))
    boxes = el.filter((F.col("tag") == "mat-form-field") | attr("class").rlike(r"(?i)form-group|form-field|form-item|form-row|field"))
    box = _within(controls_, boxes, doc, "__box")
    marks = el.filter((F.col("tag").isin("label", "mat-label")) | attr("class").rlike(r"(?i)label")).withColumn("__s", said)
    inside = marks.select(*doc, F.col("idx").alias("i"), "__s", F.explode("path").alias("__box")).join(box.select(*doc, "__box").distinct(), [*doc, "__box"]).groupBy(*doc, "__box").agg(F.min_by("__s", "i").alias("__cont"))
    before = el.select(*doc, "parent", (F.col("sib") + 1).alias("sib"), squeeze("text").alias("__sib"))
    j = (
        controls_.drop("text").withColumn("__id", attr("id")).join(by_for, [*doc, "__id"], "left").join(wrap, [*doc, "idx"], "left").join(by_ref, [*doc, "idx"], "left")
        .join(box.join(inside, [*doc, "__box"]).select(*doc, "idx", "__cont"), [*doc, "idx"], "left").join(before, [*doc, "parent", "sib"], "left")
    )
    options = [("for", F.when(F.col("__id") != "", F.col("__for"))), ("wrap", F.col("__wrap")), ("aria-labelledby", F.col("__by")), ("aria-label", squeeze(attr("aria-label"))),
               ("container", F.col("__cont")), ("sibling", F.when(F.length("__sib") < 60, F.col("__sib"))), ("placeholder", squeeze(attr("placeholder")))]
    pick = F.coalesce(*[F.when(text(v) != "", F.struct(shortened(v, CAPS["text"]).alias("label"), F.lit(s).alias("label_source"))) for s, v in options], F.struct(F.lit("").alias("label"), F.lit("none").alias("label_source")))
    return j.select(*doc, "idx", pick.alias("p")).select(*doc, "idx", "p.*")


# ---- fixed values: how a control is filled; the first row whose test holds answers, the last one any other control.
# Test, mode, evidence, widget ("guess": by what the control says of itself), whether an input mask is kept.
ENTRY_MODES = (
    ("file", "widget", "file input (setInputFiles)", None, False),
    ("select", "typed", "native select (selectOption)", None, False),
    ("check", "typed", "native checkable (check/click)", None, False),
    ("moment", "typed", "native date/time input", "datepicker", False),
    ("combobox", "widget", "role=combobox", "combobox", False),
    ("listbox", "widget", "role=listbox", "listbox", False),
    ("check role", "widget", "role={role} (click)", None, False),
    ("popup", "widget", "aria-haspopup / aria-expanded / aria-controls present", "popup", True),
    ("read only", "widget", "readonly but enabled; expects a widget to set it", "guess", True),
    ("icon", "widget", "adjacent icon control ({icon})", "guess", True),
    ("mask", "typed", "input mask present", "mask", True),
    ("locked", "unknown", "readonly and disabled at capture time", None, False),
    ("text", "typed", "plain {kind}", "date", False),
    ("other", "unknown", "unfamiliar {tag}", None, False),
)


def entry_mode(icon: Column) -> Column:
    """How a control is filled: typed, through a widget, or unknown. ``icon`` names a neighbouring icon control."""
    tag, kind, role, popup, ph = F.col("tag"), F.col("type"), attr("role"), attr("aria-haspopup"), attr("placeholder")
    about = F.concat_ws(" ", attr("id"), attr("class"), attr("name"), ph, attr("autocomplete"))
    nothing = F.lit(None).cast("string")
    mask = F.coalesce(*[F.nullif(attr(a), F.lit("")) for a in ("data-mask", "mask", "data-inputmask")], F.when(ph.rlike(r"^[_#9X0-9/\-.:() A-Z]{3,}\z") & ph.rlike("[_#9X]"), ph))
    completes = (attr("aria-autocomplete") != "") & (attr("aria-autocomplete") != "none")
    opens = (popup != "") & (popup != "false")
    fixed = has_attr("readonly") | (attr("aria-readonly") == "true")
    off = has_attr("disabled") | (attr("aria-disabled") == "true")
    date = F.when(about.rlike(_DATE_HINT), "datepicker")
    guess = date.when(about.rlike(_SEARCH_HINT), "autocomplete")
    tests = {
        "file": kind == "file",
        "select": tag == "select",
        "check": kind.isin("checkbox", "radio") & (tag == "input"),
        "moment": kind.isin("date", "datetime-local", "time", "month", "week"),
        "combobox": role == "combobox",
        "listbox": role == "listbox",
        "check role": role.isin("checkbox", "radio", "switch"),
        "popup": opens | has_attr("aria-expanded") | has_attr("aria-controls") | (has_attr("aria-autocomplete") & (attr("aria-autocomplete") != "none")),
        "read only": fixed & ~off,
        "icon": icon.isNotNull(),
        "mask": mask.isNotNull(),
        "locked": fixed & off,
        "text": tag.isin("input", "textarea") | (kind == "contenteditable"),
        "other": F.lit(True),
    }
    widgets = {
        "guess": guess,
        "date": date,
        "combobox": F.when(completes, "autocomplete").otherwise("listbox"),
        "popup": F.when(has_attr("aria-autocomplete"), "autocomplete").when(popup.isin("listbox", "menu"), "listbox").otherwise(guess),
    }
    named = {"icon": icon, "role": role, "kind": kind, "tag": tag}

    def told(evidence: str) -> Column:
        """The evidence, with what stands in braces put in."""
        parts = re.split(r"[{}]", evidence)
        return F.concat(*[named[x] if at % 2 else F.lit(x) for at, x in enumerate(parts)])

    rows = F.array(*[
        F.when(tests[test], F.struct(F.lit(mode).alias("mode"), told(evidence).alias("evidence"), widgets.get(widget, F.lit(widget).cast("string")).alias("widget_kind"), (mask if masked else nothing).alias("mask")))
        for test, mode, evidence, widget, masked in ENTRY_MODES
    ])
    return F.get(F.filter(rows, lambda x: x.isNotNull()), F.lit(0))


def controls(nodes: DataFrame, *, doc: Sequence[str] = DOC, packs=("generic",)) -> DataFrame:
    """Form controls with key, label, constraints, options and how to fill them.

    Credentials keep their identity and lose value and options. The key falls
    back from test id over binding, authored id, name and label to ``type@n``.
    """
    found = nodes.filter(_control())
    el = nodes.filter(F.col("tag") != "#text")
    kind = F.when(F.col("tag").isin("select", "textarea"), F.col("tag")).when(F.col("tag") == "input", F.lower(F.coalesce(F.nullif(attr("type"), F.lit("")), F.lit("text")))).when(attr("contenteditable") == "true", "contenteditable").otherwise(F.coalesce(F.nullif(attr("role"), F.lit("")), F.col("tag")))
    options = el.filter(F.col("tag") == "option")
    opts = _within(options, found.filter(F.col("tag") == "select"), doc, "c").join(options.drop("path"), [*doc, "idx"]).groupBy(*doc, F.col("c").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("idx", F.coalesce(F.nullif(attr("value"), F.lit("")), F.col("text")).alias("v"), F.col("text").alias("t")))).alias("__o"))
    near = el.withColumn("__probe", F.concat_ws(" ", attr("class"), attr("aria-label"), attr("title"), F.col("tag"))).filter((F.col("tag").isin("button", "i", "svg", "span", "mat-icon", "mat-datepicker-toggle") | (attr("role") == "button")) & F.col("__probe").rlike(_ICON_HINT))
    after = near.select(*doc, "parent", (F.col("sib") - 1).alias("sib"), F.col("tag").alias("__next"))
    prior = near.select(*doc, "parent", (F.col("sib") + 1).alias("sib"), F.col("tag").alias("__before"))
    fw = framework(nodes, doc=doc).select(*doc, F.col("framework").alias("__fw"))
    j = (
        found.withColumn("type", kind).join(resolve_labels(found, nodes, doc=doc), [*doc, "idx"]).join(opts, [*doc, "idx"], "left").join(after, [*doc, "parent", "sib"], "left")
        .join(prior, [*doc, "parent", "sib"], "left").join(fw, list(doc), "left").withColumn("__n", F.row_number().over(Window.partitionBy(*doc).orderBy("idx")) - 1)
    )
    some = lambda c: F.nullif(c, F.lit(""))
    binding = F.coalesce(some(attr("formcontrolname")), some(attr("ng-reflect-name")))
    key = F.coalesce(*[some(attr(a)) for a in P.TEST_ID_ATTRIBUTES], F.when(F.col("__fw") == "angular", binding), F.when(classify_id(attr("id")).isNull(), attr("id")), some(attr("name")), binding, some(F.col("label")), some(attr("aria-label")), F.concat("type", F.lit("@"), F.col("__n").cast("string")))
    secret = is_credential(attr("type"), attr("id"), attr("name"), attr("formcontrolname"), attr("ng-reflect-name"), attr("autocomplete"), attr("v-model"), F.col("label"))
    number = lambda a: F.try_to_number(some(F.regexp_extract(attr(a), "^([0-9]+)", 1)), F.lit("999999999")).cast("int")
    listed = F.transform(first_of(F.col("__o"), CAPS["options"]), lambda o: F.struct(scrub_expr(o["v"], packs).alias("v"), scrub_expr(o["t"], packs).alias("t")))
    held = F.when(F.col("tag") == "input", attr("value")).otherwise(text("text"))
    return j.select(
        *doc, "idx", "tag", "type", some(attr("role")).alias("role"), key.alias("key"), attr("id").alias("id"), attr("name").alias("name"), F.coalesce(binding, F.lit("")).alias("binding"),
        scrub_expr("label", packs).alias("label"), "label_source", (has_attr("required") | (attr("aria-required") == "true")).alias("required"), number("maxlength").alias("max_length"), some(attr("pattern")).alias("pattern"),
        secret.alias("redacted_entirely"), F.when(~secret & (F.col("type") != "file"), redact_value(held)).alias("value"), F.when(~secret, listed).alias("options"), F.when(~secret, F.size("__o")).alias("n_options"),
        entry_mode(F.coalesce("__next", "__before")).alias("entry"),
    )


def buttons(nodes: DataFrame, *, doc: Sequence[str] = DOC, words: Sequence[str] = P.DANGER_WORDS, packs=("generic",)) -> DataFrame:
    """Buttons with text, type, state and whether pressing them is dangerous."""
    el = nodes.filter(F.col("tag") != "#text")
    kind = F.lower(attr("type"))
    rows = el.filter((F.col("tag") == "button") | ((F.col("tag") == "input") & kind.isin("submit", "button", "reset")) | ((F.col("tag") == "a") & attr("class").rlike(r"(^|\s)btn(\s|$)")) | (attr("role") == "button"))
    in_form = _within(rows, el.filter(F.col("tag") == "form"), doc, "form")
    shown = F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in (text("text"), attr("value"), attr("aria-label"), attr("title"))], F.lit(""))
    typed = F.coalesce(F.nullif(kind, F.lit("")), F.when(F.col("tag") == "button", "submit").when(F.col("tag") == "a", "link").otherwise("button"))
    submits = (typed == "submit") & F.col("tag").isin("input", "button") & F.col("form").isNotNull()
    out = rows.join(in_form, [*doc, "idx"], "left").withColumn("__t", scrub_expr(shown, packs)).filter(F.col("__t") != "").select(
        *doc, "idx", F.col("__t").alias("text"), typed.alias("type"), (has_attr("disabled") | (attr("aria-disabled") == "true")).alias("disabled"), is_danger("__t", submits, words).alias("danger"))
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*doc).orderBy("idx"))).filter(at_most(F.col("n"), CAPS["buttons"]))


def selector_candidates(nodes: DataFrame, targets: DataFrame, *, doc: Sequence[str] = DOC) -> DataFrame:
    """``(doc…, idx, rank, selector, stability, unique)``: ways to find an element, sturdiest first.

    Uniqueness is a count of elements per page and selector, joined back.
    """
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    by = lambda a: F.when(attr(a) != "", F.concat(F.lit(f"[{a}="), q(attr(a)), F.lit("]")))
    authored = (attr("id") != "") & classify_id(attr("id")).isNull()
    test_id = F.coalesce(*[by(a) for a in P.TEST_ID_ATTRIBUTES])
    options = [
        (1, test_id, F.lit("stable")), (2, F.when(authored, F.concat(F.lit("#"), attr("id"))), F.when(looks_random(attr("id")), "likely").otherwise("stable")),
        (3, F.coalesce(by("formcontrolname"), by("ng-reflect-name")), F.lit("stable")), (4, F.when(attr("name") != "", F.concat("tag", F.lit("[name="), q(attr("name")), F.lit("]"))), F.lit("likely")),
        (5, F.when(attr("aria-label") != "", F.concat("tag", F.lit("[aria-label="), q(attr("aria-label")), F.lit("]"))), F.lit("likely")),
        (6, F.when(attr("placeholder") != "", F.concat("tag", F.lit("[placeholder="), q(attr("placeholder")), F.lit("]"))), F.lit("fragile")),
    ]
    spread = nodes.filter(F.col("tag") != "#text").select(*doc, "idx", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), c.alias("selector"), s.alias("stability")) for r, c, s in options])).alias("o")).select(*doc, "idx", "o.*").filter(F.col("selector").isNotNull())
    counts = spread.groupBy(*doc, "rank", "selector").agg(F.count(F.lit(1)).alias("n"))
    # Position in the tree, for what nothing else names: the tag path with child numbers.
    steps = nodes.filter(F.col("tag") != "#text").select(*doc, F.col("idx").alias("__s"), F.concat("tag", F.lit(":nth-child("), (F.col("sib") + 1).cast("string"), F.lit(")")).alias("__step"))
    place = targets.select(*doc, "idx").join(nodes.select(*doc, "idx", "path"), [*doc, "idx"]).select(*doc, "idx", F.explode(F.concat("path", F.array("idx"))).alias("__s")).join(steps, [*doc, "__s"]).groupBy(*doc, "idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__s", "__step"))), lambda x: x["__step"]), " > ").alias("selector")).select(*doc, "idx", F.lit(7).alias("rank"), "selector", F.lit("fragile").alias("stability"), F.lit(1).cast("bigint").alias("n"))
    named = spread.join(targets.select(*doc, "idx"), [*doc, "idx"], "left_semi").join(counts, [*doc, "rank", "selector"])
    return named.select(*doc, "idx", "rank", "selector", "stability", "n").unionByName(place).withColumn("unique", F.col("n") == 1).drop("n")


def repeat_label(actions: DataFrame, neighbours: DataFrame, *, by: Sequence[str] = ("session",)) -> DataFrame:
    """An action label inside a list stays only if a neighbouring row says the same; else its length.

    ``neighbours`` has ``(by…, action_id, text)``: the texts at the same place in
    the rows around it.
    """
    said = neighbours.select(*by, F.col("action_id").alias("id"), norm("text").alias("__n")).distinct().withColumn("__same", F.lit(True))
    j = actions.withColumn("__n", norm("label")).join(said, [*by, "id", "__n"], "left")
    inside = text("list_selector") != ""
    return j.withColumn("label", F.when(inside & F.col("__same").isNull() & ~F.coalesce("pagination", F.lit(False)), redact_value("label")).otherwise(F.col("label"))).drop("__n", "__same")
