"""The whole-capture plan on a made-up portal, and time joins against brute force."""

import random
from datetime import timedelta

import captures
import pytest
from pyspark.sql import functions as F

from wayfold.operators import endpoints as E
from wayfold.operators import joins as J
from wayfold.operators import records as Q
from wayfold.operators import shapes as S
from wayfold.operators import transitions as T
from wayfold.plans.capture import derive


@pytest.fixture(scope="module")
def portal(spark):
    return captures.portal(spark)


@pytest.fixture(scope="module")
def derived(portal):
    return derive(portal)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_edges_and_pause(derived):
    pairs = rows(derived["transitions"], "from_id", "to_id")
    assert ("st_0001", "st_0002") in pairs and ("st_0007", "st_0008") not in pairs and len(pairs) == 6


def test_dependency(derived):
    assert rows(derived["dependencies"], "source_key", "endpoint", "confidence") == [("year", "/api/subcategories", "high")]
    assert rows(derived["control_links"], "source", "target") == [("year", "category")]


def test_catalog(derived):
    found = {(r.method, r.path): r for r in derived["endpoints"].collect()}
    assert found[("GET", "/api/proceedings/{id}")].n_calls == 2
    assert found[("POST", "/api/updateEntity")].write_hint == 'path word "update"'
    assert found[("POST", "/api/search")].write_hint is None
    assert ("GET", "/assets/app.js") not in found and ("GET", "/files/demand-notice.pdf") in found
    assert {r.query_key for r in derived["endpoint_params"].filter("is_paging").collect()} == {"page", "size"}


def test_lists_and_feeds(derived):
    lst = derived["site_lists"].first()
    assert lst.has_pagination and lst.paged and not lst.item_opened
    assert derived["list_feeds"].count() == 1


def test_coverage(derived):
    t = derived["coverage_totals"].first()
    assert (t.menu_items, t.menu_visited, t.pages, t.view_options, t.view_options_visited, t.lists, t.lists_paged) == (6, 5, 5, 3, 2, 1, 1)
    assert rows(derived["unvisited_menu"], "text") == [("Archive",)]
    hints = [r.sentence for r in derived["coverage_hints"].orderBy("n").collect()]
    assert hints[0] == 'Menu item "Reports > Archive" was seen but never opened.'
    assert 'On "Ledger", the tab "Closed" was never opened.' in hints


def test_routes_never_press_danger(derived):
    recipes = {r.node: r for r in derived["route_recipes"].collect()}
    done = recipes["/portal/#/done\0"]
    assert not done.reachable and "flagged danger" in done.note
    assert recipes["/portal/#/ledger\0status=Pending|page=1"].steps == 2
    steps = derived["route_steps"].filter(F.col("node") == "/portal/#/returns\0").orderBy("n").collect()
    assert [(s.n, s.label) for s in steps] == [(1, "Reports"), (2, "Returns")]
    assert derived["route_steps"].filter("action_id = 'act_0008'").count() == 0


def test_controls(derived):
    c = {r.key: r for r in derived["controls"].collect()}
    assert c["category"].id_varies and c["category"].selectors.primary == '[name="category"]'
    assert c["pin"].redacted_entirely and c["pin"].options is None


def test_every_reference_exists(portal, derived):
    known = {"state": (portal["states"], "id"), "action": (portal["actions"], "id"), "net": (portal["net"], "id")}
    refs = {"transitions:state": (derived["transitions"], "to_id"), "claims:action": (derived["action_states"], "action_id"), "calls:net": (derived["endpoint_calls"], "net_id")}
    assert Q.reference_integrity(refs, known).count() == 0


def test_fold_by_shape(spark):
    net = spark.createDataFrame(
        [(1, "a", "/api/users", ["$.a", "$.b"]), (2, "b", "/api/orders", ["$.c"]), (3, "c", "/files/a1.pdf", None), (4, "d", "/files/b2.pdf", None), (5, "e", "/api/peter", ["$.x"]), (6, "f", "/api/paul", ["$.x"])],
        "seq long, id string, p string, response_paths array<string>").withColumns({"url": F.concat(F.lit("https://h"), "p"), "status": F.lit(200)})
    calls = E.parsed_calls(net, keep=["status", "response_paths"])
    endpoints, _ = E.group_endpoints(calls)
    assert {r.path for r in endpoints.collect()} == {"/api/users", "/api/orders", "/files/{id}.pdf", "/api/{id}"}


def first_come(kinds):
    """Clusters by reading the kinds of a bucket one after the other."""
    founders, home = [], {}
    for _, kind, evidence, like, _ in sorted(kinds, key=lambda k: (k[4], k[1])):
        for name, other, other_like in founders:
            if evidence is None or other is None:
                same = like and other_like
            else:
                both, one = set(evidence) & set(other), set(evidence) | set(other)
                same = not one or len(both) / len(one) >= 0.7
            if same:
                home[kind] = name
                break
        else:
            founders.append((kind, evidence, like))
            home[kind] = kind
    return home


@pytest.mark.parametrize("batch", [4, 4096])
def test_clusters_against_one_pass_in_order(spark, batch):
    rng = random.Random(3)
    kinds = []
    for bucket, n in (("a", 60), ("b", 25), ("c", 1)):
        for i in range(n):
            evidence = sorted(rng.sample("abcdefgh", rng.randint(0, 8))) if rng.random() < 0.8 else None
            if evidence is not None or i % 2:
                kinds.append((bucket, f"k{i}", evidence, bool(i % 2), rng.randint(0, 20)))
    df = spark.createDataFrame(kinds, "bucket string, kind string, evidence array<string>, like boolean, seen long")
    want = sorted((b, k, c) for b in "abc" for k, c in first_come([k for k in kinds if k[0] == b]).items())
    assert rows(E.first_come_clusters(df, batch=batch), "bucket", "kind", "cluster") == want
    assert E.first_come_clusters(df.limit(0), batch=batch).count() == 0


def test_a_bucket_of_many_kinds(spark):
    """Thirty thousand kinds, three alike each time, in a few rounds."""
    n = F.floor(F.col("id") / 3).cast("string")
    fields = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat_ws(".", n, i.cast("string")))
    kinds = spark.range(30_000).select(F.lit("b").alias("bucket"), F.col("id").cast("string").alias("kind"), F.concat(fields, F.array(F.concat(F.lit("own."), F.col("id").cast("string")))).alias("evidence"), F.lit(False).alias("like"), F.col("id").alias("seen"))
    found = E.first_come_clusters(kinds, batch=8192)
    assert found.filter("cast(cluster as long) = kind - kind % 3").count() == found.count() == 30_000


@pytest.mark.parametrize("direction,strict,slack,tolerance", [("backward", False, 0, None), ("backward", True, 0, 40), ("forward", False, 0, 25), ("backward", False, 7, 30)])
def test_asof_against_brute_force(spark, direction, strict, slack, tolerance):
    rng = random.Random(5)
    left = [(i, rng.choice("ab"), rng.randint(0, 300)) for i in range(80)]
    right = [(i, rng.choice("ab"), rng.randint(0, 300)) for i in range(60)]

    def best(key, t):
        ok = []
        for rid, rk, rt in right:
            d = (t - rt) if direction == "backward" else (rt - t)
            if rk == key and d >= -slack + (1 if strict else 0) and (tolerance is None or d <= tolerance):
                ok.append((rt, rid))
        return (max(ok) if direction == "backward" else min(ok))[1] if ok else None

    for chunk in (10, 1000):
        out = J.asof_join(spark.createDataFrame(left, "lid int, k string, t long"), spark.createDataFrame(right, "rid int, k string, u long"), by=["k"], left_ts="t", right_ts="u", right_cols=["rid"], right_tie=["rid"],
                          direction=direction, strict=strict, slack=slack, tolerance=tolerance, chunk=chunk)
        assert rows(out.select("lid", F.col("match.rid").alias("rid")).na.fill(-1), "lid", "rid") == sorted((i, -1 if best(k, t) is None else best(k, t)) for i, k, t in left)


def test_time_joins_build_no_pairs(spark, portal):
    plan = J.action_before_call(portal["net"], portal["actions"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_dedupe_keeps_a_b_a_and_manual(spark):
    states = [captures.state(i, i, "x", trigger=t, **{"signature": s}) for i, (s, t) in enumerate([("A", "load"), ("A", "click"), ("B", "click"), ("A", "click"), ("A", "manual")], 1)]
    kept = T.dedupe_states(captures.frame(spark, "states", states))
    assert rows(kept.select("seq", F.coalesce("duplicate_of", F.lit("")).alias("d")), "seq", "d") == [(1, ""), (3, ""), (4, ""), (5, "st_0004")]


def test_shapes_of_bodies(spark):
    b = spark.createDataFrame([("x", '{"items":[' + ",".join('{"s":"%s","v":%d}' % ("on" if i % 2 else "off", i) for i in range(6)) + ',{"s":"on","z":null}]}'), ("y", ")]}',\n" + '{"items":[],"n":"a"}')], "id string, response_body string")
    n = {(r.id, r.path): r for r in S.shape_nodes(S.shape_visits(b)).collect()}
    assert n[("x", "$.items[].s")]["values"] == ["off", "on"] and n[("x", "$.items[].v")].optional and n[("x", "$.items[].z")].type == "null"
    m = {r.path: r for r in S.merge_shapes(S.shape_nodes(S.shape_visits(b)).withColumn("e", F.lit(1)), by=["e"]).collect()}
    assert m["$.n"].optional and not m["$.items"].optional and m["$.items"].len == 7
    mixed = spark.createDataFrame([("x", '{"a":{"b":1}}'), ("y", '{"a":3}')], "id string, response_body string")
    paths = {r.path: r.type for r in S.merge_shapes(S.shape_nodes(S.shape_visits(mixed)).withColumn("e", F.lit(1)), by=["e"]).collect()}
    assert paths == {"$": "object", "$.a": "mixed"}


def test_retain_latest_over_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("session"), F.col("id").alias("seq"))
    kept = Q.retain_latest(df, 50, chunk=17)
    assert rows(kept.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo")), "session", "n", "lo") == [(0, 50, 852), (1, 50, 850), (2, 50, 851)]


def test_hint_is_used_once(spark):
    dl = spark.createDataFrame([("s", 1, "d1", 5.0), ("s", 1, "d2", 6.0), ("s", 1, "d3", 60.0)], "session string, tab_id long, id string, s double").withColumn("at", F.timestamp_seconds("s"))
    hints = spark.createDataFrame([("s", 1, "h1", 4.0)], "session string, tab_id long, hint_id string, s double").withColumn("at", F.timestamp_seconds("s"))
    assert rows(J.consume_hints(dl, hints).select("id", F.coalesce("hint.hint_id", F.lit("")).alias("h")), "id", "h") == [("d1", "h1"), ("d2", ""), ("d3", "")]


def test_opener_prefers_clicks(spark):
    tabs = spark.createDataFrame([("s", 1, 10.0)], "session string, tab_id long, s double").withColumn("at", F.timestamp_seconds("s"))
    acts = captures.frame(spark, "actions", [captures.act(1, 0, "a", route="x"), captures.act(2, 0, "b", route="x", kind="change")]).withColumn("session", F.lit("s")).withColumn("at", F.timestamp_seconds(F.when(F.col("seq") == 1, 8.0).otherwise(9.0)))
    assert J.opener_of_tab(tabs, acts).first().opener.id == "act_0001"


def test_timedelta_chunks_do_not_change_results(spark, portal):
    a = J.action_before_call(portal["net"], portal["actions"], chunk=timedelta(seconds=1))
    b = J.action_before_call(portal["net"], portal["actions"], chunk=timedelta(days=1))
    assert rows(a.select("id", F.coalesce("action_id", F.lit("")).alias("a")), "id", "a") == rows(b.select("id", F.coalesce("action_id", F.lit("")).alias("a")), "id", "a")


def test_nothing_in_a_body_is_left_out(spark):
    body = '{"rows":[' + ",".join(f'{{"k{i}":{i}}}' for i in range(100)) + "]}"
    deep = '{"a":' * 12 + "1" + "}" * 12
    n = S.shape_nodes(S.shape_visits(spark.createDataFrame([("x", body), ("y", deep), ("z", "[" * 5000)], "id string, response_body string"))).cache()
    assert n.filter("id = 'x' and key is not null and key <> 'rows'").count() == 100 and n.filter("id = 'y' and type = 'number'").count() == 1 and n.filter("id = 'z'").count() == 0
