"""HTML as rows: one per element and text node, in document order."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .columns import unfold

# ---- fixed values: elements that never hold others, and what closes what -----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "p": {"p"},
}
BLOCKS_CLOSE_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SCOPES = frozenset("html body table ul ol dl select div section article main nav td th form".split())
SILENT = frozenset(("script", "style", "template", "noscript"))

NODE_SCHEMA = (
    "idx int, parent int, tag string, attrs map<string,string>, text string, text_len int, path array<int>, depth int, sib int, n_kids int"
)

#: A text up to this length stands on every element; a longer one on those that are read as a whole,
#: and is NULL on all others, which only hold a page. ``text_len`` is exact on all.
SHORT_TEXT = 1000
READ_TAGS = frozenset("title h1 h2 h3 h4 legend label mat-label mat-error a button summary option select textarea li td th mat-chip mat-chip-option mat-button-toggle".split())
READ_ROLES = frozenset(
    "alert tab option radio button menuitem menuitemradio menuitemcheckbox treeitem link cell gridcell rowheader columnheader"
    " combobox listbox textbox spinbutton slider checkbox switch searchbox".split()
)
READ_ATTRS = ("aria-current", "aria-selected", "mat-menu-item", "mat-list-item", "aria-labelledby", "aria-controls", "aria-owns")
READ_CLASS = re.compile(
    r"title|heading|error|invalid|danger|alert|info|note|step|wizard|label|active|activated|selected|current|checked|highlight"
    r"|(?:^|\s)(?:dropdown-item|nav-link|p-menuitem-link|btn|chip|pill)(?:\s|$)", re.I)
TRAIL_CLASS = re.compile(r"nav-tabs|breadcrumb")


def _trail(row: dict) -> bool:
    """Trails and tab lists: their children and the spans in them are read."""
    a = row["attrs"]
    return bool(a) and (bool(TRAIL_CLASS.search(a.get("class", ""))) or a.get("role") == "tablist" or "BreadcrumbList" in a.get("itemtype", "") or "breadcrumb" in a.get("aria-label", "").lower())


def _read_whole(row: dict, named: set[str]) -> bool:
    """Does an operator read the text of this element, however long it is?"""
    a = row["attrs"]
    return (
        row["tag"] in READ_TAGS or a.get("role") in READ_ROLES or a.get("id") in named or a.get("contenteditable") == "true" or any(k in a for k in READ_ATTRS) or bool(READ_CLASS.search(a.get("class", "")))
    )


#: A tag that needs no rule for odd markup: no reference, no slash, each value in double quotes, a blank before each name.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)((?: [A-Za-z_][A-Za-z0-9_:-]*(?:=\"[^\"&<>]*\")?)*)>")
_ATTR = re.compile(r" ([A-Za-z_][A-Za-z0-9_:-]*)(?:=\"([^\"]*)\")?")
#: Elements whose text is not markup.
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


def plain_parts(html: str) -> list[tuple] | None:
    """What the parser would hand on, as (kind, name or text, attributes), of a page of plain tags and texts; None of any other."""
    if "&" in html or "<!" in html or "<?" in html:
        return None
    out: list[tuple] = []
    at, end, tag_at, raw = 0, len(html), _TAG.match, None
    while at < end:
        if html[at] != "<":
            to = html.find("<", at)
            to = end if to < 0 else to
            out.append((0, html[at:to], None))
            at = to
            continue
        m = tag_at(html, at)
        if m is None:
            return None
        close, tag, attrs = m.groups()
        tag = tag.lower()
        if close:
            if attrs or raw not in (None, tag):
                return None
            raw = None
            out.append((2, tag, None))
        else:
            if raw:
                return None
            if tag in RAW_TEXT:
                raw = tag
            out.append((1, tag, [(k.lower(), v) for k, v in _ATTR.findall(attrs)] if attrs else ()))
        at = m.end()
    return None if raw else out


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def updatepos(self, i, j):
        return j  # lines are not counted

    def page(self, html: str) -> list[dict]:
        """The rows of a page; plain markup is read without the parser's rules for odd markup."""
        parts = plain_parts(html)
        if parts is None:
            self.feed(html)
            self.close()
        else:
            of = (self.handle_data, self.handle_starttag, self.handle_endtag)
            for kind, name, attrs in parts:
                if kind == 1:
                    of[1](name, attrs)
                else:
                    of[kind](name)
        return self.rows

    def _add(self, tag, attrs, text=None):
        rows = self.rows
        if self.open:
            up = self.open[-1]
            parent = rows[up]
            path, sib = parent["below"], parent["kids"]
            if path is None:  # one list for all children
                path = parent["below"] = parent["path"] + [up]
            if text is None:
                parent["kids"] = sib + 1
        else:
            up, path, sib = None, [], 0
        rows.append({"idx": len(rows), "parent": up, "tag": tag, "attrs": attrs, "own": text, "path": path, "kids": 0, "sib": sib, "below": None})
        return len(rows) - 1

    def _close(self, tags, stop=SCOPES):
        for at in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[at]]["tag"]
            if name in tags:
                del self.open[at:]
                return
            if name in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            for _ in range(2):
                self._close(CLOSES[tag])
        if tag in BLOCKS_CLOSE_P:
            self._close({"p"})
        idx = self._add(tag, {k: (v or "") for k, v in attrs} if attrs else {})
        if tag not in VOID:
            self.open.append(idx)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]]["tag"] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        inside = self.rows[self.open[-1]]["tag"] if self.open else ""
        if data.strip() and inside not in SILENT:
            self._add("#text", {}, data)


class HtmlNodes:
    """Table function: the elements and text nodes of one page."""

    def eval(self, html: str):
        if not html:
            return
        rows = _Walk().page(html)
        # The words of a page once; an element is the stretch between the first and last of its texts.
        words, before, last = [], [0], list(range(len(rows)))
        for row in rows:
            if row["own"] is not None:
                words.append(" ".join(row["own"].split()))
            before.append(len(words))
        for row in reversed(rows):
            if row["parent"] is not None:
                last[row["parent"]] = max(last[row["parent"]], last[row["idx"]])
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        said = " ".join(words)
        named = {ref for row in rows if row["attrs"] for ref in row["attrs"].get("aria-labelledby", "").split()}
        trail = [bool(row["attrs"]) and _trail(row) for row in rows]
        in_trail: list[bool] = []
        for i, row in enumerate(rows):
            up, own, path = row["parent"], row["own"], row["path"]
            in_trail.append(up is not None and (in_trail[up] or trail[up]))
            if own is not None:
                text, size = own, len(own)
            else:
                a, z = starts[before[i]], starts[before[last[i] + 1]] - 1
                size = z - a if z > a else 0
                text = said[a:z] if size <= SHORT_TEXT or _read_whole(row, named) or (in_trail[-1] and (row["tag"] == "span" or trail[up])) else None
                text = "" if not size else text
            yield i, up, row["tag"], row["attrs"], text, size, path, len(path), row["sib"], row["kids"]


def html_nodes(pages: DataFrame, html: str) -> DataFrame:
    """The nodes of every page beside the other columns of ``pages``."""
    return unfold(pages, html, HtmlNodes().eval, NODE_SCHEMA)


# ------------------------------------------------------------ clean copies


class _Clean(HTMLParser):
    """Writes a page again without scripts, comments or values."""

    # ---- fixed values: what is emptied and how long attributes may be -------
    HOLLOW = frozenset(("script", "style", "noscript", "svg"))
    SPOKEN = ("title", "alt", "aria-label", "placeholder")
    KEPT_INPUTS = frozenset(("radio", "checkbox", "submit", "button", "reset"))
    MAX_ATTR, MAX_DATA_URI = 300, 64

    def __init__(self, scrub, credential):
        super().__init__(convert_charrefs=False)
        self.out, self.scrub, self.credential = [], scrub, credential
        self.hollow, self.value = 0, None

    def _attrs(self, tag, attrs):
        a = {k: (v if v is not None else "") for k, v in attrs}
        for k in self.SPOKEN:
            if a.get(k):
                a[k] = self.scrub(a[k])
        kind = (a.get("type") or "text").lower() if tag == "input" else ""
        secret = tag in ("input", "textarea", "select") and (kind == "password" or any(self.credential(a.get(k, "")) for k in ("id", "name", "formcontrolname", "ng-reflect-name", "autocomplete", "v-model", "aria-label", "placeholder")))
        if tag == "option":
            a.pop("selected", None)
        if kind == "hidden":
            a["value"] = "<hidden>"
        elif kind == "file":
            a.pop("value", None)
        elif kind and kind not in self.KEPT_INPUTS:
            v = "<redacted>" if secret else (f"<{len(a['value'])} chars>" if a.get("value") else "")
            a.pop("value", None)
            if v:
                a["value"] = v
        if tag == "textarea" or a.get("contenteditable") == "true":
            self.value = (tag, secret)
        for k, v in a.items():
            limit = self.MAX_DATA_URI if re.match(r"(?i)\s*data:", v) else self.MAX_ATTR
            if len(v) > limit:
                a[k] = v[:limit] + "…"
        esc = lambda v: v.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
        return "".join(f' {k}="{esc(v)}"' for k, v in a.items())

    def handle_starttag(self, tag, attrs):
        if self.hollow:
            self.hollow += tag in self.HOLLOW
            return
        self.out.append(f"<{tag}{self._attrs(tag, attrs)}>")
        if tag in self.HOLLOW:
            self.hollow = 1

    def handle_startendtag(self, tag, attrs):
        if not self.hollow:
            self.out.append(f"<{tag}{self._attrs(tag, attrs)}/>")

    def handle_endtag(self, tag):
        if self.hollow:
            self.hollow -= tag in self.HOLLOW
            if self.hollow:
                return
        if self.value and self.value[0] == tag:
            self.value = None
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.hollow:
            return
        if self.value:
            held = data.strip()
            self.out.append("" if not held else "&lt;redacted&gt;" if self.value[1] else f"&lt;{len(data)} chars&gt;")
        elif data.strip():
            self.out.append(self.scrub(data).replace("<", "&lt;").replace(">", "&gt;"))
        else:
            self.out.append(data)

    def handle_entityref(self, name):
        if not self.hollow and not self.value:
            self.out.append(f"&{name};")

    def handle_charref(self, name):
        if not self.hollow and not self.value:
            self.out.append(f"&#{name};")

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")


def clean_page(html: str, scrub, credential) -> str:
    work = _Clean(scrub, credential)
    work.feed(html)
    work.close()
    return "".join(work.out)
