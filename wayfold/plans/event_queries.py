"""Queries on the session log: time joins, the state graph, routes, upkeep."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import endpoints as E
from ..operators import joins as J
from ..operators import records as Q
from ..operators import routes as R
from ..operators import transitions as T
from .tables import event_actions, event_calls, event_pauses, event_states, events, table

#: Users act hours apart in this log, so windows are hours and chunks are days.
HOURS, DAY = timedelta(hours=12), timedelta(days=1)
BY = ["session"]


def _us(c):
    return F.unix_micros(c)


def asof_click_to_purchase(spark, sf):
    ev = events(spark, sf)
    out = J.action_before_call(event_calls(ev), event_actions(ev), tolerance=HOURS, chunk=DAY)
    return out.select(F.col("id").alias("net_id"), "action_id")


def next_state_after_call(spark, sf):
    ev = events(spark, sf)
    out = J.next_state(event_calls(ev), event_states(ev), state_cols=["id"], chunk=DAY)
    return out.select(F.col("id").alias("net_id"), F.col("next_state.id").alias("state_id"))


def state_on_screen(spark, sf):
    ev = events(spark, sf)
    calls = event_calls(ev).drop("state_id_at_time", "state_id_inferred").withColumn("frame_id", (F.col("seq") % 2))
    out = J.state_on_screen(calls, event_states(ev), row_ts="started_at", chunk=DAY)
    return out.select(F.col("id").alias("net_id"), "state_id_at_time", F.col("state_id_inferred").cast("int").alias("inferred"))


def action_of_download(spark, sf):
    """Purchases as downloads: an action on the same origin wins over a later one elsewhere."""
    ev = events(spark, sf)
    downloads = event_calls(ev).select("session", "id", "seq", F.col("started_at").alias("at"), F.lit("https://shop.example.com").alias("origin"))
    out = J.action_before_download(downloads, event_actions(ev), before=timedelta(hours=24), after=timedelta(hours=1), chunk=DAY)
    return out.select(F.col("id").alias("download_id"), F.col("actor.id").alias("action_id"))


def hints_used_once(spark, sf):
    ev = events(spark, sf)
    calls = event_calls(ev).select("session", "tab_id", "id", F.col("started_at").alias("at"))
    hints = event_actions(ev).select("session", "tab_id", F.col("id").alias("hint_id"), "at")
    out = J.consume_hints(calls, hints, before=timedelta(hours=48), after=timedelta(0), chunk=DAY)
    return out.select(F.col("id").alias("net_id"), F.col("hint.hint_id").alias("hint_id"))


def download_calls(spark, sf):
    """The latest call to each address."""
    ev = events(spark, sf)
    net = event_calls(ev)
    downloads = event_actions(ev).select("session", "id", "seq", "tab_id", "at", F.lit("http").alias("url_kind"), F.concat(F.lit("https://shop.example.com/api/"), F.substring("trigger", 8, 10), F.lit("?x=1")).alias("raw_url"))
    return J.download_to_call(downloads, net, chunk=DAY).select(F.col("id").alias("download_id"), "net_id")


def menu_hrefs_to_routes(spark, sf):
    """Fragment and path links met with the routes they open."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k")).distinct()
    items = o.select(F.concat(F.lit("#/item/"), "k").alias("href")).unionByName(o.select(F.concat(F.lit("/shop/"), "k", F.lit("/")).alias("href")))
    routes = table(spark, sf, "customer").select((F.col("c_custkey") % 40).alias("k")).distinct().select(F.explode(F.array(F.concat(F.lit("/app/#/item/"), "k"), F.concat(F.lit("/shop/"), "k"))).alias("route"))
    return J.href_to_route(items, routes).select("href", "route")


def dedupe_runs(spark, sf):
    ev = events(spark, sf)
    kept = T.keep_changes(ev, by=["user_id"], order=["ts", "event_id"], look=["event_type"], chunk=DAY)
    return kept.select("event_id")


def dedupe_states(spark, sf):
    kept = T.dedupe_states(event_states(events(spark, sf)), chunk=DAY)
    return kept.select("id", "signature")


def transitions(spark, sf):
    e = T.transitions(event_states(events(spark, sf)), chunk=DAY)
    return e.select("from_id", "to_id", "trigger", F.col("url_changed").cast("int").alias("url_changed"), F.col("route_changed").cast("int").alias("route_changed"))


def edges_without_pause(spark, sf):
    ev = events(spark, sf)
    e = T.transitions(event_states(ev), event_pauses(ev), chunk=DAY)
    return e.select("from_id", "to_id")


def transition_counts(spark, sf):
    e = T.transitions(event_states(events(spark, sf)), chunk=DAY)
    return e.groupBy("from_route", "to_route").agg(F.count(F.lit(1)).alias("n"))


def actions_of_states(spark, sf):
    ev = events(spark, sf)
    c = T.claim_actions(event_actions(ev), event_states(ev), event_pauses(ev), chunk=DAY)
    return c.select("action_id", "state_id", F.col("is_primary").cast("int").alias("is_primary"))


def calls_to_states(spark, sf):
    """Calls attributed to the state they fed."""
    ev = events(spark, sf)
    states = event_states(ev)
    net = J.state_on_screen(event_calls(ev).drop("state_id_at_time", "state_id_inferred"), states, row_ts="started_at", chunk=DAY)
    return E.attribute_calls(net, states, chunk=DAY).select("net_id", "state_id")


def dependencies(spark, sf):
    ev = events(spark, sf)
    states = event_states(ev)
    net = J.state_on_screen(event_calls(ev).drop("state_id_at_time", "state_id_inferred"), states, row_ts="started_at", chunk=DAY)
    edges = T.transitions(states, chunk=DAY)
    d = T.dependencies(edges, net, before=timedelta(hours=6), after=timedelta(hours=1))
    return d.select("state_id", "source_key", "endpoint", "confidence")


def distinct_dependencies(spark, sf):
    ev = events(spark, sf)
    states = event_states(ev)
    net = J.state_on_screen(event_calls(ev).drop("state_id_at_time", "state_id_inferred"), states, row_ts="started_at", chunk=DAY)
    d = T.dependencies(T.transitions(states, chunk=DAY), net, before=timedelta(hours=6), after=timedelta(hours=1)).withColumn("all", F.lit("x"))
    return T.distinct_dependencies(d, by=["all"]).select("source_key", "endpoint", "state_id")


def outcomes(spark, sf):
    ev = events(spark, sf)
    states, actions = event_states(ev), event_actions(ev)
    claims = T.claim_actions(actions, states, chunk=DAY)
    edges = T.edge_causes(T.transitions(states, chunk=DAY), claims)
    return T.outcomes(actions, edges, claims, states).select("action_id", "from_id", "to_id")


def reached_by(spark, sf):
    states = event_states(events(spark, sf))
    return T.reached_by(states, T.transitions(states, chunk=DAY)).select("state_id", "reached_by")


def entry_states(spark, sf):
    return T.entry_state(event_states(events(spark, sf)), by=["session"])


def recent_states(spark, sf):
    """The last sixty states of every user."""
    states = event_states(events(spark, sf))
    return Q.retain_latest(states, 60, by=["session"], chunk=5000).select("id")


def retain_latest(spark, sf):
    n = Q.retain_latest(events(spark, sf), 2500, by=["event_type"], seq="event_id", degraded=F.col("event_type") == "error", chunk=5000)
    return n.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("oldest"))


def consent_filter(spark, sf):
    """Clicks whose origin is on the allow list; the list is a table."""
    actions = event_actions(events(spark, sf))
    allowed = actions.select("origin").distinct().filter(F.col("origin").startswith("https://shop."))
    return Q.consent_filter(actions, allowed).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


def manifest_counts(spark, sf):
    ev = events(spark, sf)
    states, actions = event_states(ev), event_actions(ev)
    parts = Q.split_by_origin({"states": states, "net": event_calls(ev), "transitions": T.transitions(states, chunk=DAY).drop("origin")}, actions.select("origin").distinct())
    m = Q.manifest(parts["origins"], {"states": parts["states"], "net": parts["net"], "transitions": parts["transitions"], "actions": actions})
    return m


def dangling_references(spark, sf):
    """Ids that edges and claims mention, checked against the states and actions; then against clicks alone."""
    ev = events(spark, sf)
    states, actions = event_states(ev), event_actions(ev)
    edges = T.transitions(states, chunk=DAY)
    known = {"state": (states.filter(F.col("signature") == "view"), "id"), "action": (actions, "id")}
    refs = {"transitions.from:state": (edges, "from_id"), "transitions.to:state": (edges, "to_id"), "claims:action": (T.claim_actions(actions, states, chunk=DAY), "action_id")}
    return Q.reference_integrity(refs, known)


def blocked_frames(spark, sf):
    """Origins without consent per user, distinct."""
    actions = event_actions(events(spark, sf))
    return actions.filter(F.col("origin") != "https://shop.example.com").select("session", F.col("origin").alias("frame_origin")).distinct()


def common_value(spark, sf):
    """Most frequent status per customer; the one seen first wins a tie."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("mime_type"), F.col("o_orderkey").alias("seq"))
    return E.common_mime(o, by=["o_custkey"]).withColumnRenamed("mime_type", "status")


def structured_endpoints(spark, sf):
    return E.structured_endpoint_counts(event_calls(events(spark, sf)))


def routes_bfs(spark, sf):
    """Fewest steps from one item page to every other over observed moves; ties by how often seen."""
    e = T.transitions(event_states(events(spark, sf)), chunk=DAY).filter("route_changed")
    hops = e.groupBy(F.col("from_route").alias("from_node"), F.col("to_route").alias("to_node")).agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= 1)
    hops = hops.withColumns({"hop_cost": F.lit(1), "step": F.lit(None).cast("string"), "site": F.lit("shop")})
    entry = e.groupBy(F.lit("shop").alias("site")).agg(F.min("from_route").alias("node"))
    return R.shortest_paths(hops, entry, by=["site"], payload=False).select("node", "steps", "cost")


QUERIES = {
    "asof_click_to_purchase": asof_click_to_purchase, "next_state_after_call": next_state_after_call, "state_on_screen": state_on_screen, "action_of_download": action_of_download, "hints_used_once": hints_used_once,
    "download_calls": download_calls, "menu_hrefs_to_routes": menu_hrefs_to_routes, "dedupe_runs": dedupe_runs, "dedupe_states": dedupe_states, "transitions": transitions, "edges_without_pause": edges_without_pause,
    "transition_counts": transition_counts, "actions_of_states": actions_of_states, "calls_to_states": calls_to_states, "dependencies": dependencies, "distinct_dependencies": distinct_dependencies, "outcomes": outcomes,
    "reached_by": reached_by, "entry_states": entry_states, "recent_states": recent_states, "retain_latest": retain_latest, "consent_filter": consent_filter, "manifest_counts": manifest_counts,
    "dangling_references": dangling_references, "blocked_frames": blocked_frames, "common_value": common_value, "structured_endpoints": structured_endpoints, "routes_bfs": routes_bfs,
}

_CAP = """e AS (SELECT *, CAST(user_id AS VARCHAR) AS session, json_extract_string(props, '$.k') AS k FROM events),
st AS (SELECT *, 'st_' || event_id AS id FROM e WHERE event_type IN ('view', 'signup')),
ac AS (SELECT *, 'act_' || event_id AS id, CASE WHEN CAST(k AS INTEGER) % 2 = 0 THEN 'https://shop.example.com' ELSE 'https://help.example.com' END AS origin FROM e WHERE event_type = 'click'),
nt AS (SELECT *, 'net_' || event_id AS id FROM e WHERE event_type = 'purchase'),
pa AS (SELECT * FROM e WHERE event_type = 'error')"""
_EDGES = """ed AS (SELECT * FROM (SELECT session, lag(id) OVER w AS from_id, id AS to_id, lag(k) OVER w AS fk, k AS tk, lag(ts) OVER w AS from_at, ts AS to_at, event_type,
CASE WHEN event_type = 'signup' THEN 'load' ELSE 'change:' || k END AS trigger FROM st WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)) WHERE from_id IS NOT NULL)"""
_W = f"WITH {_CAP} "
_WE = f"WITH {_CAP}, {_EDGES} "
_H = lambda h: f"{h * 3600 * 1000000}"
_NEXT = "(SELECT min(s.event_id) FROM st s WHERE s.session = x.session AND s.ts >= x.ts AND s.ts = (SELECT min(ts) FROM st z WHERE z.session = x.session AND z.ts >= x.ts))"
_SCREEN = "sc AS (SELECT n.*, s.id AS sid, s.k AS sk FROM nt n ASOF LEFT JOIN st s ON n.session = s.session AND n.ts >= s.ts)"
_DEPS = f"""{_SCREEN}, dp AS (SELECT ed.session, ed.to_id, ed.to_at, substr(ed.trigger, 8) AS source_key, arg_min('/api/' || sc.k, sc.event_id) AS endpoint FROM ed JOIN sc ON sc.session = ed.session AND sc.sid = ed.from_id
WHERE ed.trigger LIKE 'change:%' AND epoch_us(sc.ts) BETWEEN epoch_us(ed.to_at) - {_H(6)} AND epoch_us(ed.to_at) + {_H(1)} GROUP BY ALL)"""
_CLAIM = "cl AS (SELECT a.session, a.id AS action_id, a.event_id AS aseq, a.ts AS at, a.k AS ak, s.id AS state_id, s.ts AS sat, s.k AS sk, s.event_type AS stype FROM ac a ASOF JOIN st s ON a.session = s.session AND a.ts <= s.ts)"

ORACLE = {
    "asof_click_to_purchase": _W + f"SELECT n.id AS net_id, CASE WHEN epoch_us(n.ts) - epoch_us(a.ts) <= {_H(12)} THEN a.id END AS action_id FROM nt n ASOF LEFT JOIN ac a ON n.session = a.session AND n.ts >= a.ts",
    "next_state_after_call": _W + "SELECT n.id AS net_id, s.id AS state_id FROM nt n ASOF LEFT JOIN st s ON n.session = s.session AND n.ts <= s.ts",
    "state_on_screen": _W + "SELECT n.id AS net_id, s.id AS state_id_at_time, CAST(n.event_id % 2 = 1 AND s.id IS NOT NULL AS INTEGER) AS inferred FROM nt n ASOF LEFT JOIN st s ON n.session = s.session AND n.ts >= s.ts",
    "action_of_download": _W + f""", same AS (SELECT n.id, a.id AS aid, a.ts AS ats, n.ts AS nts FROM nt n ASOF LEFT JOIN (SELECT *, ts - INTERVAL 1 HOUR AS t1 FROM ac WHERE origin = 'https://shop.example.com') a ON n.session = a.session AND n.ts >= a.t1),
anyo AS (SELECT n.id, a.id AS aid, a.ts AS ats, n.ts AS nts FROM nt n ASOF LEFT JOIN (SELECT *, ts - INTERVAL 1 HOUR AS t1 FROM ac) a ON n.session = a.session AND n.ts >= a.t1)
SELECT s.id AS download_id, coalesce(CASE WHEN epoch_us(s.nts) - epoch_us(s.ats) <= {_H(24)} THEN s.aid END, CASE WHEN epoch_us(o.nts) - epoch_us(o.ats) <= {_H(24)} THEN o.aid END) AS action_id FROM same s JOIN anyo o USING (id)""",
    "hints_used_once": _W + f""", m AS (SELECT n.id, n.ts, CASE WHEN epoch_us(n.ts) - epoch_us(a.ts) <= {_H(48)} THEN a.id END AS hint FROM nt n ASOF LEFT JOIN ac a ON n.session = a.session AND n.ts >= a.ts)
SELECT id AS net_id, CASE WHEN row_number() OVER (PARTITION BY hint ORDER BY ts, id) = 1 THEN hint END AS hint_id FROM m""",
    "download_calls": _W + ", l AS (SELECT session, k, arg_max(id, event_id) AS net_id FROM nt GROUP BY ALL) SELECT a.id AS download_id, l.net_id FROM ac a LEFT JOIN l ON l.session = a.session AND l.k = a.k",
    "menu_hrefs_to_routes": """WITH o AS (SELECT DISTINCT o_custkey % 50 AS k FROM orders), c AS (SELECT DISTINCT c_custkey % 40 AS k FROM customer)
SELECT '#/item/' || o.k AS href, '/app/#/item/' || c.k AS route FROM o JOIN c USING (k) UNION ALL SELECT '/shop/' || o.k || '/' AS href, '/shop/' || c.k AS route FROM o JOIN c USING (k)""",
    "dedupe_runs": "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type",
    "dedupe_states": _W + "SELECT id, event_type AS signature FROM (SELECT *, lag(event_type) OVER (PARTITION BY session ORDER BY ts, event_id) AS p FROM st) WHERE p IS NULL OR p <> event_type",
    "transitions": _WE + "SELECT from_id, to_id, trigger, CAST(fk <> tk AS INTEGER) AS url_changed, CAST(fk <> tk AS INTEGER) AS route_changed FROM ed",
    "edges_without_pause": _WE + "SELECT from_id, to_id FROM ed WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.session = ed.session AND pa.ts > ed.from_at AND pa.ts < ed.to_at)",
    "transition_counts": _WE + "SELECT '/k/' || fk AS from_route, '/k/' || tk AS to_route, count(*) AS n FROM ed GROUP BY ALL",
    "actions_of_states": _W + f""", {_CLAIM}, ok AS (SELECT * FROM cl WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.session = cl.session AND pa.ts > cl.at AND pa.ts < cl.sat))
SELECT action_id, state_id, CAST(row_number() OVER (PARTITION BY state_id ORDER BY (stype = 'view' AND ak = sk) DESC, aseq DESC) = 1 AS INTEGER) AS is_primary FROM ok""",
    "calls_to_states": _W + f""", {_SCREEN}, nx AS (SELECT sc.*, s.id AS nid, s.k AS nk, s.ts AS nts FROM sc ASOF LEFT JOIN st s ON sc.session = s.session AND sc.ts <= s.ts)
SELECT id AS net_id, CASE WHEN nid IS NULL OR nid = sid THEN sid WHEN sid IS NULL THEN nid WHEN ts >= nts OR (k = nk AND k <> sk) THEN nid ELSE sid END AS state_id FROM nx""",
    "dependencies": _WE + f", {_DEPS} SELECT to_id AS state_id, source_key, endpoint, 'high' AS confidence FROM dp",
    "distinct_dependencies": _WE + f", {_DEPS} SELECT source_key, endpoint, arg_min(to_id, (epoch_us(to_at), to_id)) AS state_id FROM dp GROUP BY ALL",
    "outcomes": _WE + f""", {_CLAIM}, mn AS (SELECT state_id, action_id FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY (stype = 'view' AND ak = sk) DESC, aseq DESC) AS r FROM cl) WHERE r = 1)
SELECT mn.action_id, ed.from_id, ed.to_id FROM ed JOIN mn ON mn.state_id = ed.to_id""",
    "reached_by": _WE + "SELECT st.id AS state_id, coalesce(ed.trigger || ' from ' || ed.from_id, CASE WHEN st.event_type = 'signup' THEN 'load' ELSE 'change:' || st.k END) AS reached_by FROM st LEFT JOIN ed ON ed.to_id = st.id",
    "entry_states": _W + "SELECT session, arg_min(id, event_id) AS entry_state_id FROM st GROUP BY 1",
    "recent_states": _W + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session ORDER BY event_id DESC) AS r FROM st) WHERE r <= 60",
    "retain_latest": "SELECT event_type, count(*) AS n, min(event_id) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= CASE WHEN event_type = 'error' THEN 625 ELSE 2500 END GROUP BY 1",
    "consent_filter": _W + "SELECT origin, count(*) AS n FROM ac WHERE origin = 'https://shop.example.com' GROUP BY 1",
    "manifest_counts": _WE + """SELECT o.origin, CASE WHEN o.origin LIKE '%shop%' THEN (SELECT count(*) FROM st) ELSE 0 END AS n_states, CASE WHEN o.origin LIKE '%shop%' THEN (SELECT count(*) FROM nt) ELSE 0 END AS n_net,
CASE WHEN o.origin LIKE '%shop%' THEN (SELECT count(*) FROM ed) ELSE 0 END AS n_transitions, (SELECT count(*) FROM ac WHERE ac.origin = o.origin) AS n_actions FROM (SELECT DISTINCT origin FROM ac) o""",
    "dangling_references": _WE + """SELECT 'transitions.from' AS source, 'state' AS kind, from_id AS ref FROM ed WHERE from_id NOT IN (SELECT id FROM st WHERE event_type = 'view') UNION
SELECT 'transitions.to', 'state', to_id FROM ed WHERE to_id NOT IN (SELECT id FROM st WHERE event_type = 'view')""",
    "blocked_frames": _W + "SELECT DISTINCT session, origin AS frame_origin FROM ac WHERE origin <> 'https://shop.example.com'",
    "common_value": "SELECT o_custkey, lower(s) AS status FROM (SELECT o_custkey, s, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL)) WHERE r = 1",
    "structured_endpoints": _W + "SELECT 'POST /api/' || k AS endpoint, count(*) AS n_calls FROM nt GROUP BY 1",
    "routes_bfs": "WITH RECURSIVE " + _CAP + ", " + _EDGES + """, h AS (SELECT DISTINCT '/k/' || fk AS a, '/k/' || tk AS b FROM ed WHERE fk <> tk), s0 AS (SELECT min(a) AS node FROM h),
r AS (SELECT node, 0 AS steps FROM s0 UNION SELECT h.b, r.steps + 1 FROM r JOIN h ON h.a = r.node WHERE r.steps < 12) SELECT node, min(steps) AS steps, min(steps) AS cost FROM r GROUP BY node""",
}
