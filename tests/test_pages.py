"""One made-up page through every extractor, and files in and out."""

import json

import captures
import pytest
from pyspark.sql import functions as F

from wayfold.functions import pyrules as Y
from wayfold.operators import pages as G
from wayfold.operators import redact as X
from wayfold.sources import capture_log as C
from wayfold.sources import har as H
from wayfold.sources import package as P

PAGE = """<!doctype html><html lang="en" ng-version="17"><head><title>My  Page</title><script>var a="<b>"</script></head><body><h1>Main</h1>
<nav><ul><li><a href="/home" class="active">Home</a></li><li><button aria-expanded="false">Reports</button><ul><li><a href="#/returns">Returns</a></li><li><a href="/x/../ledger?q=1">Ledger</a></li></ul></li><li><a href="javascript:void(0)">Help</a></li></ul></nav>
<ol class="breadcrumb"><li>Home</li><li>Home</li><li>Reports</li></ol><!-- note -->
<div role="tablist" aria-label="status"><button role="tab" aria-selected="true">Pending</button><button role="tab">Closed</button></div>
<section><table id="t"><thead><tr><th>Date</th><th>Name</th></tr></thead><tbody><tr><td>2024</td><td>Asha Rao</td></tr><tr><td>2025</td><td>B</td></tr></tbody></table>
<ul class="pagination"><li class="active"><a>1</a></li><li><a>2</a></li><li><a>3</a></li><li><a rel="next" href="#">Next</a></li></ul></section>
<div class="cards"><div class="card"><a href="/i/1.pdf">One</a></div><div class="card">Two</div><div class="card">Three</div></div>
<form><label for="u">User</label><input id="u" name="user" maxlength="9" value="asha" required><label>PIN <input type="password" name="pin" value="1"></label><div class="form-group"><span class="label">Year</span><select name="y"><option value="1">2024<option value="2">2025</select></div><input name="d" placeholder="dd/mm" readonly><button>Pay now</button></form>
<div><span>Full name</span><span>Asha Rao</span></div><span class="user-name">Bina K</span><my-widget></my-widget><div class="error">Bad thing</div><a href="/logout">Sign out</a></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return G.page_nodes(spark.createDataFrame([(1, "https://e.com/app/", PAGE)], "page_id long, url string, html string"), keep=["url"], write=True)


def one(df):
    return df.first().asDict(recursive=True)


def test_page_level(nodes):
    assert one(G.page_title(nodes)) == {"page_id": 1, "title": "My Page", "lang": "en"}
    assert [r.heading for r in G.page_outline(nodes).collect()] == ["Main"]
    assert [r.text for r in G.page_errors(nodes).collect()] == ["Bad thing"] and G.page_notices(nodes).count() == 0
    assert one(G.framework(nodes))["framework"] == "angular" and one(G.auth_hint(nodes, url="url"))["evidence"] == "password field present"
    assert [r.tag for r in G.custom_elements(nodes).collect()] == ["my-widget"]


def test_navigation(nodes):
    items = {" > ".join(r.path): (r.href, r.has_children, r.current) for r in G.nav_items(nodes, url="url").collect()}
    assert items == {"Home": ("/home", False, True), "Reports": (None, True, False), "Reports > Returns": ("/app/#/returns", False, False), "Reports > Ledger": ("/ledger", False, False), "Help": (None, False, False)}
    assert [r.text for r in G.breadcrumbs(nodes).orderBy("n").collect()] == ["Home", "Reports"]
    groups = {(r.name, r.text): r.active for r in G.view_groups(nodes).collect()}
    assert groups[("status", "Pending")] and not groups[("status", "Closed")]


def test_lists(nodes):
    t = one(G.tables(nodes))
    assert (t["headers"], t["n_rows"], t["first_row"]) == (["Date", "Name"], 2, ["<4 chars>", "<8 chars>"])
    p = one(G.pagination(nodes))
    assert (p["style"], p["has_next"], p["current"]) == ("numbered", True, "1")
    r = G.repeats(nodes)
    cards = r.filter("signature = 'div.card'")
    assert [x.n_items for x in cards.collect()] == [3] and r.count() == 3
    assert [(x.kind, x.sample, x.download) for x in G.repeat_slots(nodes, cards).collect()] == [("link", "<href>", True)]
    assert [(x.extension, x.kind) for x in G.download_links(nodes).collect()] == [("pdf", "direct")]


def test_controls(nodes):
    c = {r.key: r for r in G.controls(nodes).collect()}
    assert (c["u"].label, c["u"].label_source, c["u"].max_length, c["u"].value, c["u"].required) == ("User", "for", 9, "<4 chars>", True)
    assert c["pin"].redacted_entirely and c["pin"].value is None and c["pin"].label_source == "wrap"
    assert (c["y"].label, c["y"].label_source, c["y"].n_options) == ("Year", "container", 2) and c["d"].entry.mode == "widget"
    assert {r.text for r in G.buttons(nodes).filter("danger").collect()} == {"Pay now"}
    best = {r.idx: r.selector for r in G.selector_candidates(nodes, G.controls(nodes)).filter("rank = 2").collect()}
    assert list(best.values()) == ["#u"]


def test_structural_redaction(spark, nodes):
    hit = {r.text: r.scrubbed for r in X.scrub_labelled(nodes, doc=["page_id"]).filter("replacement is not null").collect()}
    assert hit == {"Asha Rao": "<NAME>", "Bina K": "<NAME>"}
    clean = spark.createDataFrame([(PAGE,)], "h string").select(Y.sanitise_html("h").alias("c")).first().c
    assert "<!-- note -->" not in clean and 'var a' not in clean and 'value="&lt;4 chars&gt;"' in clean and 'value="&lt;redacted&gt;"' in clean


def test_long_labelled_values_are_replaced(spark):
    long = "Asha Rao of " + "Long Lane " * 40
    page = f"<div><span>Full name</span><span>{long}</span></div><span class='user-name'>{long}</span><p>{long}</p>"
    nodes = G.page_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")).cache()
    assert [r.replacement for r in X.scrub_labelled(nodes, doc=["page_id"]).orderBy("idx").collect()] == [None, "<NAME>", "<NAME>", None]
    assert X.scrub_labelled(nodes, doc=["page_id"], value_max=200, hint_text_max=200).filter("replacement IS NOT NULL").count() == 0


def test_learned_values_leave_other_text(spark):
    bodies = spark.createDataFrame([("s", 1, '{"fullName":"Asha Rao","file":"a b.pdf"}')], "session string, seq long, b string")
    learned = X.learned_values(bodies, "b")
    note = spark.createDataFrame([("s", "welcome ASHA  rao, a@b.co"), ("other", "Asha Rao")], "session string, t string")
    assert sorted(r.t for r in X.scrub_learned(note, "t", learned).collect()) == ["Asha Rao", "welcome <NAME>, <EMAIL>"]


def test_capture_log_and_package(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"session":"s","type":"paused","at":"2026-01-01T00:00:00Z"}\n{broken\n')
    log = C.read_capture_log(spark, str(tmp_path / "log"), "timeline").cache()
    assert log.filter("type = 'paused'").count() == 1 and C.bad_lines(log).count() == 1
    empty = spark.createDataFrame([], "origin string, n long")
    out = P.write_package({"a": spark.createDataFrame([("https://x", 1)], "origin string, n long"), "none": empty, "bad": empty.select(F.raise_error(F.lit("no")).alias("x")).limit(0).unionByName(spark.range(1).select(F.raise_error(F.lit("no")).alias("x")))}, str(tmp_path / "pkg"))
    assert out["a"] == out["none"] == "ok" and out["bad"] != "ok"
    assert P.read_package_table(spark, str(tmp_path / "pkg"), "none").count() == 0 and P.read_package_table(spark, str(tmp_path / "pkg"), "a").first().n == 1


def test_old_records_are_completed(spark):
    s = C.complete_states(captures.frame(spark, "states", [{"session": "s", "id": "st_1", "pathname": "/p"}])).first()
    assert s.route == "/p" and s.query_keys == [] and s.action_ids == []
    n = C.complete_net(captures.frame(spark, "net", [{"session": "s", "id": "n"}])).first()
    assert n.response_size == -1 and n.is_download is False


def test_har_there_and_back(spark, tmp_path):
    net = captures.portal(spark)["net"]
    H.write_har(net, str(tmp_path / "har"), per_file=4)
    files = list((tmp_path / "har").rglob("*.txt"))
    docs = [json.loads(f.read_text()) for f in files if f.read_text().strip()]
    assert sum(len(d["log"]["entries"]) for d in docs) == 10 and all(d["log"]["pages"] for d in docs)
    back = {r.id: r for r in H.read_har(spark, f"{tmp_path}/har/*/*/*.txt").collect()}
    assert len(back) == 10 and back["net_0001"].url.endswith("/api/returns?page=1&size=10") and back["net_0010"].is_download and back["net_0001"].page_url == "https://portal.example.in/portal/"


def test_long_cells_and_fields_keep_their_length(spark):
    page = f"<table><tr><th>H</th></tr><tr><td>{'x' * 5000}</td></tr></table><textarea id='t'>{'y' * 3000}</textarea><h1>{'z' * 400}</h1><h2>{'z' * 400}!</h2>"
    nodes = G.page_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")).cache()
    assert G.tables(nodes).first().first_row == ["<5000 chars>"]
    assert [r.value for r in G.controls(nodes).collect()] == ["<3000 chars>"]
    assert sorted(len(r.heading) for r in G.page_outline(nodes).collect()) == [400, 401]


def test_texts_that_are_read_are_whole(spark):
    """Elements of any tag that an operator reads share their first letters and differ after them."""
    long = "word " * 400
    page = (
        f"<div class='page'><nav><div role='menuitem'>{long}one</div><div role='menuitem'>{long}two</div></nav>"
        f"<ul role='tablist'><div>{long}first tab</div><div>{long}second tab</div></ul><ol class='breadcrumb'><span>{long}here</span></ol>"
        f"<div id='l'>{long}name</div><div id='b' aria-labelledby='l'>x</div><section id='p'><p>{long}</p>end</section></div>"
    )
    nodes = G.page_nodes(spark.createDataFrame([(1, page), (2, "")], "page_id long, html string")).cache()
    assert [r.text[-3:] for r in G.nav_items(nodes).orderBy("n").collect()] == ["one", "two"]
    assert [r.text[-9:] for r in G.page_steps(nodes).orderBy("n").collect()] == ["first tab", "econd tab", "word here"]
    assert [r.text[-9:] for r in G.breadcrumbs(nodes).collect()] == ["word here"]
    ids = nodes.select("page_id", "idx", G.attr("id").alias("id"))
    names = {r.id: r.name for r in G.accessible_name(nodes).join(ids, ["page_id", "idx"]).collect() if r.id}
    assert names == {"l": long + "name", "b": long + "name", "p": long + "end"}
    # what only holds the page says nothing itself, and its length is exact
    outer = nodes.filter("tag = 'div' AND depth = 0").first()
    assert outer.text is None and outer.text_len == len(G.with_whole_text(nodes.filter("tag = 'div' AND depth = 0"), nodes).first().text)


def test_menus_owned_by_id(spark):
    """Panels in each other's hands, a label from afar, tabs that own nothing, and two pages that use the same ids."""
    pages = [
        (1, "<nav><button aria-controls='a b'>A</button></nav><div id='a'><a href='/x'>X</a><button aria-controls='c'>C</button></div><div id='c'><a href='/z'>Z</a></div><div id='b'><a href='/y'>Y</a></div>"),
        # the first to name an id owns it; what is inside a panel cannot own it
        (2, "<nav><a href='/h'>H</a><a aria-controls='a'>First</a><a aria-controls='a'>Second</a></nav><div id='a'><a href='/x'>X</a><a aria-controls='a'>Close</a></div>"),
        # two panels that own each other hang on nothing, nor does one that a tab or nobody in a menu opens
        (3, "<nav><a href='/h'>H</a><a role='tab' aria-controls='t'>T</a></nav><div id='p'><a aria-controls='q'>Q</a></div><div id='q'><a aria-controls='p'>P</a></div><div id='t'><a href='/t'>in t</a></div><b aria-controls='o'>O</b><div id='o'><a href='/o'>in o</a></div>"),
        # the same pair in a menu keeps its own names; the path ends
        (4, "<nav><div id='p'><a aria-controls='q'>Q</a></div></nav><nav><div id='q'><a aria-controls='p'>P</a></div></nav>"),
        (5, "<nav><span id='s'>Settings</span></nav><ul role='menu' aria-labelledby='s'><li><a href='/u'>Users</a></li></ul>"),
        (6, None), (7, ""),
    ]
    nodes = G.page_nodes(spark.createDataFrame(pages, "page_id long, html string")).cache()
    found = {}
    for r in G.nav_items(nodes).orderBy("page_id", "n").collect():
        found.setdefault(r.page_id, []).append(" > ".join(r.path))
    assert found == {
        1: ["A", "A > X", "A > C", "A > C > Z", "A > Y"], 2: ["H", "First", "Second", "First > X", "First > Close"], 3: ["H"], 4: ["P > Q", "Q > P"], 5: ["Settings > Users"]}


def test_deep_nesting_repeats_no_text():
    from wayfold.functions.html import HtmlNodes

    rows = list(HtmlNodes().eval("<span>" * 3000 + "word " * 2000 + "</span>" * 3000))
    assert len(rows) == 3001 and {r[5] for r in rows[:-1]} == {9999} and sum(len(r[4] or "") for r in rows) == 10_000


def test_widgets_are_met_by_their_whole_label(spark):
    """Two labels that share their first forty letters are told apart by a whole trigger; a cut one meets both."""
    from wayfold.operators.controls import promote_widgets

    long = "choose the office that handles this case"
    entry = "struct('unknown' as mode, '' as evidence, '' as widget_kind, '' as mask) as entry"
    merged = spark.createDataFrame([("o", "k1", f"{long} first"), ("o", "k2", f"{long} second"), ("o", "k3", long[:40] + " third")], "origin string, key string, label string").selectExpr("*", entry)
    seen = spark.createDataFrame([("o", f"k{i}", "s1", "a") for i in (1, 2, 3)] , "origin string, key string, state_id string, session string")

    def widgets(trigger):
        edges = spark.createDataFrame([("o", "a", "s1", "s2", trigger, ["x"])], "origin string, session string, from_id string, to_id string, trigger string, fields_added array<string>")
        return sorted(r.key for r in promote_widgets(merged, edges, seen).collect() if r.entry.mode == "widget")

    assert widgets(f"click:{long} second") == ["k2"]
    assert widgets(f"click:{long[:40]}") == ["k1", "k2", "k3"]


def test_menu_rules_are_tried_once_on_what_they_can_hold_of(spark):
    page = '<div><span>plain</span><div role="menu"><a href="/a">A</a></div><nav><ul><li>Shop<ul><li><b class="nav-link">B</b></li></ul></li></ul></nav></div><div id="x"><p>said</p></div>'
    nodes = G.page_nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))
    marked = G._menu_nodes(nodes)
    rows = {(r.tag, r.attrs["class"] if r.attrs and "class" in r.attrs else ""): r for r in marked.collect()}
    assert not {"p", "span"} & {t for t, _ in rows}
    assert rows["nav", ""]["__strong"] and rows["a", ""]["__item"] and rows["b", "nav-link"]["__item"] and rows["li", ""]["__wrap"] and rows["ul", ""]["__sub"]
    assert rows["nav", ""].text is None and rows["a", ""].text == "A"  # what a holder repeats is not written again
    assert "regexp" not in marked._jdf.queryExecution().optimizedPlan().toString().lower() and "rlike" not in marked._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {tuple(r.path) for r in G.nav_items(nodes, packs=None).collect()} == {("A",), ("Shop", "B")}
