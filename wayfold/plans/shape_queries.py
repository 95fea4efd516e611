"""Queries on bodies and controls: shapes, enums, the catalog, roll-ups, bursts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import controls as C
from ..operators import endpoints as E
from ..operators import shapes as S
from ..sources import har as H
from ..streaming import operators as L
from .event_queries import DAY
from .tables import event_actions, event_calls, event_pauses, event_states, events, table


def props_shape(spark, sf):
    """Shape of the event properties per event type."""
    nodes = S.body_shapes(events(spark, sf), body="props", owner=["event_type", "event_id"], by=["event_type"])
    merged = S.merge_shapes(nodes, by=["event_type"], bodies="bodies")
    return merged.select("event_type", "path", "type", F.col("nullable").cast("int").alias("nullable"), F.col("optional").cast("int").alias("optional"), F.col("n").cast("bigint").alias("n"))


def order_bodies(spark, sf):
    """One JSON document per order, with its lines as an array."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("items"))
    joined = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", "o_orderstatus", F.to_json(F.struct(F.struct("items", F.size("items").alias("total")).alias("data"), "o_orderpriority")).alias("body"))


def _order_shape(spark, sf):
    by = ["o_orderstatus"]
    return S.merge_shapes(S.body_shapes(order_bodies(spark, sf), body="body", owner=[*by, "o_orderkey"], by=by), by=by, bodies="bodies")


def order_shapes(spark, sf):
    m = _order_shape(spark, sf)
    return m.select("o_orderstatus", "path", "type", F.col("len").cast("bigint").alias("len"), F.col("n").cast("bigint").alias("n"), F.col("optional").cast("int").alias("optional"))


def order_list_paths(spark, sf):
    return S.list_paths(_order_shape(spark, sf), by=["o_orderstatus"]).select("o_orderstatus", "path", F.col("len").cast("bigint").alias("len"))


def order_row_fields(spark, sf):
    return S.row_fields(_order_shape(spark, sf), by=["o_orderstatus"])


def enum_columns(spark, sf):
    """Which text columns of the big tables hold enum-like values."""
    li = S.enum_columns(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])
    ord_ = S.enum_columns(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])
    ev = S.enum_columns(table(spark, sf, "events").select("event_type", "props"), ["event_type", "props"])
    return li.unionByName(ord_).unionByName(ev)


def shape_similarity(spark, sf):
    """Jaccard similarity of the leaf paths of three kinds of body."""
    one = lambda name, df, *cols: df.select(F.lit(name).alias("kind"), F.to_json(F.struct(*cols)).alias("body"))
    o, li, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "customer")
    bodies = (
        one("order", o, F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
        .unionByName(one("line", li, F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax")))
        .unionByName(one("customer", c, F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))
    )
    leaves = S.leaf_paths(S.shape_nodes(S.shape_visits(bodies, body="body", owner=["kind"]), owner=["kind"]), owner=["kind"])
    pairs = spark.createDataFrame([("order", "line"), ("order", "customer"), ("line", "customer")], "kind string, other string")
    return S.shape_similarity(leaves, pairs, "other", key="kind").select("kind", "other", F.round("similarity", 6).alias("similarity"))


def event_catalog(spark, sf):
    """Endpoints called in the session log with media type and flags."""
    ev = events(spark, sf)
    cat = E.api_catalog(event_calls(ev), event_states(ev), event_actions(ev), by=[], fold_variance=True, chunk=DAY)["endpoints"]
    return cat.select("endpoint_id", "method", "path", "n_calls", "mime_type", "write_hint")


def catalog_states(spark, sf):
    """Which states each endpoint fed, as pairs."""
    ev = events(spark, sf)
    cat = E.api_catalog(event_calls(ev), event_states(ev), event_actions(ev), by=["session"], fold_variance=False, chunk=DAY)
    return cat["endpoint_states"].select("session", "state_id")


def write_hints(spark, sf):
    """Why an endpoint may change data: method, path word, or the operation a body names."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    net = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.when(k == 0, "PUT").when(k == 3, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("https://shop.example.com/"), F.when(k == 1, "api/updateEntity").when(k == 2, "api/gateway").otherwise("orders")).alias("url"),
        F.when(k == 2, F.to_json(F.struct(F.lit("submitForm").alias("serviceName"), F.col("o_custkey").alias("id")))).alias("request_body"), F.lit(200).alias("status"))
    endpoints, call_map = E.group_endpoints(E.parsed_calls(net), fold_variance=False)
    hints = E.write_hints(endpoints, call_map, net)
    return endpoints.join(hints, "endpoint_id").select("method", "path", "n_calls", "write_hint")


def response_split(spark, sf):
    """Responses and errors told apart by status before shapes are merged."""
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, 404).when(F.col("o_orderkey") % 10 == 1, F.lit(None)).otherwise(200).alias("status"))
    return o.groupBy(E.response_split("status").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _line_controls(spark, sf):
    """Order lines as form controls: the order is the page state, the line number the key."""
    li = table(spark, sf, "lineitem")
    source = F.when(F.col("l_linestatus") == "O", "for").otherwise("sibling")
    sel = F.struct(F.concat(F.lit("#c"), "l_linenumber").alias("primary"), F.array(F.lit("[name=\"x\"]")).alias("fallbacks"), F.array().cast("array<string>").alias("shadow_path"),
                   F.when(F.col("l_returnflag") == "R", "fragile").otherwise("stable").alias("stability"), F.lit(True).alias("unique"), F.lit(True).alias("unique_in_form"), F.lit("").alias("notes"))
    return li.select(
        F.lit("shop").alias("origin"), F.concat(F.lit("st_"), "l_orderkey").alias("state_id"), F.col("l_orderkey").alias("state_seq"), F.lit("/cart").alias("route"), F.col("l_linenumber").cast("int").alias("pos"),
        F.concat(F.lit("k"), "l_linenumber").alias("key"), F.concat(F.lit("id"), F.col("l_suppkey") % 3).alias("id"), F.lit("").alias("name"), F.lit("").alias("binding"),
        F.concat(F.lit("Flag "), "l_returnflag").alias("label"), source.alias("label_source"), F.lit("text").alias("type"), (F.col("l_discount") > 0.09).alias("required"), F.lit(None).cast("int").alias("max_length"),
        F.lit("").alias("pattern"), F.lit(False).alias("redacted_entirely"), F.lit(None).cast("array<struct<v:string,t:string>>").alias("options"),
        F.lit(None).cast("struct<mode:string,evidence:string,widget_kind:string,mask:string>").alias("entry"), sel.alias("selectors"))


def varying_ids(spark, sf):
    return C.varying_ids(_line_controls(spark, sf)).select("id", "n_ids")


def merged_controls(spark, sf):
    controls = _line_controls(spark, sf)
    m = C.merge_controls(C.effective_controls(controls, C.varying_ids(controls).filter("false")))
    return m.select("key", "label", "label_source", F.col("required").cast("int").alias("required"), F.col("selectors.stability").alias("stability"), "n_states", F.col("collides").cast("int").alias("collides"))


def control_collisions(spark, sf):
    controls = _line_controls(spark, sf)
    m = C.merge_controls(C.effective_controls(controls, C.varying_ids(controls).filter("false")))
    return C.collisions(m).select("key", "n_colliding")


def session_bursts(spark, sf):
    """Sessions by gap: clicks and views of a user no more than six hours apart."""
    s = L.gap_sessions(events(spark, sf), by=["user_id"], ts="ts", gap="6 hours")
    return s.select("user_id", F.unix_micros("started_at").alias("started_us"), "n_events")


def bursts(spark, sf):
    """Bursts with a ceiling: closed after six quiet hours or a day after they began."""
    hour = 3_600_000
    ev = L.millis(events(spark, sf), "ts").withColumns({"trigger": F.col("event_type"), "route": F.lit("/")})
    return L.bursts(ev, by=["user_id"], gap=6 * hour, ceiling=24 * hour, tie=["event_id"], chunk=7 * 24 * hour).select("user_id", "started_ms", "fired_ms", "trigger", "n_events")


def gap_bursts(spark, sf):
    """The same machine with a ceiling out of reach is the gap session."""
    hour = 3_600_000
    ev = L.millis(events(spark, sf), "ts").withColumns({"trigger": F.col("event_type"), "route": F.lit("/")})
    return L.bursts(ev, by=["user_id"], gap=6 * hour, ceiling=10_000 * hour, tie=["event_id"], chunk=7 * 24 * hour).select("user_id", "started_ms", F.col("n_events"))


def volume_breaker(spark, sf):
    hour = 3_600_000
    ev = L.millis(events(spark, sf), "ts").select("user_id", "event_id", "ts_ms", F.lit("dom-change").alias("trigger"), (F.get_json_object("props", "$.k").cast("int")).alias("records"))
    return L.volume_breaker(ev, by=["user_id"], limit=150, window=24 * hour, cooldown=24 * hour, tie=["event_id"], chunk=7 * 24 * hour).groupBy("user_id").agg(F.sum(F.col("kept").cast("int")).alias("n_kept"), F.count(F.lit(1)).alias("n"))


def pause_gate(spark, sf):
    """Clicks made while recording ran: errors pause it, sign-ups resume it."""
    ev = events(spark, sf)
    resumes = ev.filter(F.col("event_type") == "signup").select(F.col("user_id").cast("string").alias("session"), F.lit("resumed").alias("type"), F.col("ts").alias("at"))
    return L.pause_gate(event_actions(ev), event_pauses(ev).unionByName(resumes), chunk=DAY).select("id")


def download_lifecycle(spark, sf):
    """Orders as downloads, their lines as patches: the last known size wins."""
    li = table(spark, sf, "lineitem")
    patches = li.select(
        F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit("patched").alias("kind"),
        F.when(F.col("l_linestatus") == "F", "complete").otherwise("in_progress").alias("state"), F.lit("").alias("mime"), F.lit("").alias("name_shape"), F.lit("").alias("extension"), F.lit(0).alias("size_bytes"))
    return L.download_lifecycle(patches).select("id", "state", F.col("size_bytes").cast("int").alias("size_bytes"), F.unix_micros("updated_at").alias("updated_us"))


def overlay_memory(spark, sf):
    """Properties seen by a user, and those seen earlier and not now."""
    ev = L.millis(events(spark, sf), "ts")
    seen = ev.select("user_id", "ts_ms", F.lit(0).alias("pos"), F.col("event_id").cast("string").alias("state_id"), F.col("event_type").alias("item"))
    return L.overlay_memory(seen, by=["user_id"]).groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n_states"), F.sum(F.col("visible").cast("int")).alias("n_visible"))


def har_entries(spark, sf):
    """Calls as HAR entries, numbered by page in order of first call."""
    net = event_calls(events(spark, sf))
    e = H.har_entries(net)
    return e.select("net_id", F.get_json_object("entry", "$.pageref").alias("pageref"), F.get_json_object("entry", "$.request.url").alias("url"), F.get_json_object("entry", "$.response.status").alias("status"))


def session_stats(spark, sf):
    ev = events(spark, sf).select("user_id", F.when(F.col("event_type").isin("view", "signup"), "state").when(F.col("event_type") == "purchase", "net").when(F.col("event_type") == "click", "action").otherwise("download").alias("kind"), F.lit(False).alias("throttled"))
    return L.session_stats(ev, by=["user_id"]).select("user_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_state", "n_net", "n_action", "n_download")])


QUERIES = {
    "props_shape": props_shape, "order_shapes": order_shapes, "order_list_paths": order_list_paths, "order_row_fields": order_row_fields, "enum_columns": enum_columns, "shape_similarity": shape_similarity, "event_catalog": event_catalog,
    "catalog_states": catalog_states, "write_hints": write_hints, "response_split": response_split, "varying_ids": varying_ids, "merged_controls": merged_controls, "control_collisions": control_collisions, "session_bursts": session_bursts,
    "bursts": bursts, "gap_bursts": gap_bursts, "volume_breaker": volume_breaker, "pause_gate": pause_gate, "download_lifecycle": download_lifecycle, "overlay_memory": overlay_memory, "har_entries": har_entries, "session_stats": session_stats,
}

_HOUR = 3_600_000
_GAPS = "SELECT user_id, min(ts) AS s, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g"
_LINES = "FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"
_SHAPE = f"""per AS (SELECT o_orderstatus, o_orderkey, count(*) AS c {_LINES} GROUP BY ALL), tot AS (SELECT o_orderstatus, count(*) AS orders, sum(c) AS lines, max(c) AS most FROM per GROUP BY 1),
pri AS (SELECT o_orderstatus, max(length(o_orderpriority)) AS p FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)"""
_PATHS = [("$", "object", "NULL", "orders"), ("$.data", "object", "NULL", "orders"), ("$.data.items", "array", "most", "orders"), ("$.data.items[]", "object", "NULL", "lines"), ("$.data.items[].l_linenumber", "number", "NULL", "lines"),
          ("$.data.items[].l_quantity", "number", "NULL", "lines"), ("$.data.items[].l_returnflag", "string", "1", "lines"), ("$.data.total", "number", "NULL", "orders"), ("$.o_orderpriority", "string", "p", "orders")]
_ENUM = lambda t, c: f"SELECT '{c}' AS \"column\", count(*) AS n_seen, count(DISTINCT {c}) AS n_distinct, array_to_string(list_sort(list(DISTINCT {c})), ',') AS \"values\" FROM {t} HAVING count(DISTINCT {c}) <= 8"
_CTL = "ct AS (SELECT 'k' || l_linenumber AS key, 'Flag ' || l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'for' ELSE 'sibling' END AS src, CASE WHEN l_returnflag = 'R' THEN 'fragile' ELSE 'stable' END AS stab, l_discount > 0.09 AS req, l_orderkey FROM lineitem), mg AS (SELECT key, label, min(src) AS label_source, max(CAST(req AS INTEGER)) AS required, min(stab) AS stability, count(DISTINCT l_orderkey) AS n_states FROM ct GROUP BY ALL), nv AS (SELECT key, count(*) AS n FROM mg GROUP BY 1)"
_E = "e AS (SELECT *, CAST(user_id AS VARCHAR) AS session, json_extract_string(props, '$.k') AS k FROM events)"

ORACLE = {
    "props_shape": "SELECT event_type, path, CASE WHEN path = '$' THEN 'object' ELSE 'number' END AS type, 0 AS nullable, 0 AS optional, count(*) AS n FROM events, (SELECT unnest(['$', '$.k']) AS path) GROUP BY ALL",
    "order_shapes": f"WITH {_SHAPE} " + " UNION ALL ".join(f"SELECT tot.o_orderstatus, '{p}' AS path, '{t}' AS type, CAST({ln} AS BIGINT) AS len, CAST({n} AS BIGINT) AS n, 0 AS optional FROM tot JOIN pri USING (o_orderstatus)" for p, t, ln, n in _PATHS),
    "order_list_paths": f"WITH {_SHAPE} SELECT o_orderstatus, '$.data.items' AS path, most AS len FROM tot WHERE most > 1",
    "enum_columns": " UNION ALL ".join([_ENUM("lineitem", "l_returnflag"), _ENUM("lineitem", "l_linestatus"), _ENUM("orders", "o_orderstatus"), _ENUM("orders", "o_orderpriority"), _ENUM("events", "event_type"), _ENUM("events", "props")]),
    "shape_similarity": """WITH j AS (SELECT 'order' AS kind, unnest(json_keys(json_object('key', o_orderkey, 'status', o_orderstatus, 'price', o_totalprice))) AS leaf FROM orders UNION SELECT 'line', unnest(json_keys(json_object('key', l_orderkey, 'status', l_linestatus, 'price', l_extendedprice, 'tax', l_tax))) FROM lineitem
UNION SELECT 'customer', unnest(json_keys(json_object('key', c_custkey, 'name', c_name))) FROM customer), d AS (SELECT DISTINCT * FROM j), p AS (SELECT * FROM (VALUES ('order', 'line'), ('order', 'customer'), ('line', 'customer')) t(kind, other))
SELECT kind, other, round((SELECT count(*) FROM d a JOIN d b USING (leaf) WHERE a.kind = p.kind AND b.kind = p.other) / (SELECT count(DISTINCT leaf) FROM d WHERE d.kind IN (p.kind, p.other)), 6) AS similarity FROM p""",
    "event_catalog": "SELECT 'api_001' AS endpoint_id, 'POST' AS method, '/api/{id}' AS path, count(*) AS n_calls, 'application/json' AS mime_type, CAST(NULL AS VARCHAR) AS write_hint FROM events WHERE event_type = 'purchase'",
    "catalog_states": f"""WITH {_E}, st AS (SELECT *, 'st_' || event_id AS id FROM e WHERE event_type IN ('view', 'signup')) SELECT DISTINCT n.session, s.id AS state_id FROM e n ASOF JOIN st s ON n.session = s.session AND n.ts <= s.ts WHERE n.event_type = 'purchase'""",
    "write_hints": """SELECT CASE WHEN k = 0 THEN 'PUT' WHEN k = 3 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN k = 1 THEN '/api/updateEntity' WHEN k = 2 THEN '/api/gateway' ELSE '/orders' END AS path, count(*) AS n_calls,
CASE WHEN k = 0 THEN 'method PUT' WHEN k = 1 THEN 'path word "update"' WHEN k = 2 THEN 'operation "submitForm"' END AS write_hint FROM (SELECT o_orderkey % 4 AS k FROM orders) GROUP BY k""",
    "response_split": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'error' ELSE 'response' END AS kind, count(*) AS n FROM orders GROUP BY 1",
    "varying_ids": "WITH g AS (SELECT l_returnflag, count(DISTINCT l_suppkey % 3) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) > 1) SELECT 'id' || (l_suppkey % 3) AS id, max(n) AS n_ids FROM lineitem JOIN g USING (l_returnflag) GROUP BY 1",
    "merged_controls": f"WITH {_CTL} SELECT CASE WHEN n > 1 THEN '/cart::' || key ELSE key END AS key, label, label_source, required, stability, n_states, CAST(n > 1 AS INTEGER) AS collides FROM mg JOIN nv USING (key)",
    "control_collisions": f"WITH {_CTL} SELECT '/cart::' || key AS key, n - 1 AS n_colliding FROM mg JOIN nv USING (key) WHERE n > 1",
    "session_bursts": f"SELECT user_id, epoch_us(s) AS started_us, n AS n_events FROM ({_GAPS})",
    "bursts": f"""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (SELECT user_id, i, t, t AS s, event_type AS kind FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t >= least(r.t + {6 * _HOUR}, r.s + {24 * _HOUR}) THEN e.t ELSE r.s END, e.event_type FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
b AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY i) AS part FROM (SELECT *, i = 1 OR t >= least(lag(t) OVER w + {6 * _HOUR}, lag(s) OVER w + {24 * _HOUR}) AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)))
SELECT user_id, min(s) AS started_ms, greatest(least(max(t) + {6 * _HOUR}, min(s) + {24 * _HOUR}), max(t)) AS fired_ms, min_by(kind, i) AS "trigger", count(*) AS n_events FROM b GROUP BY user_id, part""",
    "volume_breaker": f"""WITH RECURSIVE e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (SELECT user_id, i, t AS s, k AS n, CASE WHEN k > 150 THEN t + {24 * _HOUR} END AS stop, k > 150 AS cut FROM e WHERE i = 1
UNION ALL SELECT user_id, i, s, n, CASE WHEN trips THEN t + {24 * _HOUR} ELSE stop END, trips OR coalesce(t < stop, FALSE) FROM (SELECT *, n > 150 AND (stop IS NULL OR t >= stop) AS trips FROM
(SELECT e.user_id, e.i, e.t, CASE WHEN e.t - r.s > {24 * _HOUR} THEN e.t ELSE r.s END AS s, CASE WHEN e.t - r.s > {24 * _HOUR} THEN 0 ELSE r.n END + e.k AS n, r.stop FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id, count(*) FILTER (NOT cut) AS n_kept, count(*) AS n FROM r GROUP BY user_id""",
    "gap_bursts": f"SELECT user_id, epoch_us(s) // 1000 AS started_ms, n AS n_events FROM ({_GAPS})",
    "pause_gate": "SELECT 'act_' || c.event_id AS id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('error', 'signup')) m ON c.user_id = m.user_id AND c.ts >= m.ts WHERE m.event_type IS DISTINCT FROM 'error'",
    "download_lifecycle": "SELECT l_orderkey AS id, CASE WHEN bool_or(l_linestatus = 'F') THEN 'complete' ELSE 'in_progress' END AS state, -1 AS size_bytes, epoch_us(max(l_shipdate)) AS updated_us FROM lineitem GROUP BY 1",
    "overlay_memory": """WITH s AS (SELECT user_id, event_id, event_type, ts FROM events), f AS (SELECT user_id, event_type AS item, min((ts, event_id)) AS first FROM s GROUP BY ALL)
SELECT f.user_id, f.item, count(*) AS n_states, sum(CASE WHEN s.event_type = f.item THEN 1 ELSE 0 END) AS n_visible FROM f JOIN s ON s.user_id = f.user_id AND (s.ts, s.event_id) >= f.first GROUP BY ALL""",
    "har_entries": f"""WITH {_E}, n AS (SELECT * FROM e WHERE event_type = 'purchase'), p AS (SELECT session, k, row_number() OVER (PARTITION BY session ORDER BY min(event_id)) AS r FROM n GROUP BY session, k)
SELECT 'net_' || event_id AS net_id, 'page_' || r AS pageref, 'https://shop.example.com/api/' || k AS url, '200' AS status FROM n JOIN p USING (session, k)""",
    "session_stats": "SELECT user_id, count(*) FILTER (event_type IN ('view', 'signup')) AS n_state, count(*) FILTER (event_type = 'purchase') AS n_net, count(*) FILTER (event_type = 'click') AS n_action, count(*) FILTER (event_type = 'error') AS n_download FROM events GROUP BY 1",
}
