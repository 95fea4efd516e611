"""A made-up portal session: small, but it exercises every derived table."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from wayfold.schemas import TABLES

START = datetime(2026, 3, 1, 9, 0, 0, tzinfo=timezone.utc)
SITE = "https://portal.example.in"


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def _fill(value, kind):
    if isinstance(kind, T.StructType):
        if value is None:
            return None
        return {f.name: _fill(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and value is not None:
        return [_fill(v, kind.elementType) for v in value]
    return value


def frame(spark: SparkSession, table: str, rows: list[dict]):
    schema = spark.createDataFrame([], TABLES[table]).schema
    return spark.createDataFrame([tuple(_fill(r.get(f.name), f.dataType) for f in schema) for r in rows], schema)


def control(key, label, *, id="", type="text", primary=None, stability="stable", options=None, **more):
    return {
        "key": key, "id": id, "label": label, "label_source": "for", "type": type, "required": False, "redacted_entirely": False, "options": options,
        "entry": {"mode": "typed", "evidence": "native input"},
        "selectors": {"primary": primary or f"#{id or key}", "fallbacks": [f'[name="{key}"]'], "shadow_path": [], "stability": stability, "unique": True, "unique_in_form": True, "notes": ""},
        **more,
    }


MENU = [
    (["Home"], "/portal/#/home"),
    (["Reports"], None),
    (["Reports", "Returns"], "/portal/#/returns"),
    (["Reports", "Ledger"], "/portal/#/ledger"),
    (["Reports", "Archive"], "/portal/#/archive"),
    (["Help"], "/portal/#/help"),
    (["Sign out"], "/logout"),
]


def nav(active_tab=None):
    groups = []
    if active_tab:
        groups.append({"kind": "tabs", "label": "", "name": "status", "container_selector": ".tabs",
                       "options": [{"text": t, "selector": f"#tab-{t}", "active": t == active_tab, "disabled": False} for t in ("Pending", "Responded", "Closed")]})
    menus = [{"text": p[-1], "path": p, "depth": len(p) - 1, "selector": f"#m-{p[-1].replace(' ', '-')}", "href": h, "visible": True, "has_children": p == ["Reports"]} for p, h in MENU]
    return {"menus": menus, "view_groups": groups, "breadcrumbs": []}


def state(n, seconds, fragment, *, trigger, title="Portal", heading=None, controls=(), tab=None, page=None, lists=None, logged_in=True, errors=(), frame_id=0, tab_id=1, **more):
    key = "|".join(x for x in (f"status={tab}" if tab else "", f"page={page}" if page else "") if x)
    return {
        "session": "s1", "id": f"st_{n:04d}", "seq": n, "tab_id": tab_id, "frame_id": frame_id, "captured_at": at(seconds), "trigger": trigger, "trigger_at": at(seconds - 1),
        "triggers": [trigger], "origin": SITE, "url": f"{SITE}/portal/", "pathname": "/portal/", "route": f"/portal/#/{fragment}", "query_keys": [], "title": title, "lang": "en",
        "in_iframe": False, "signature": f"{fragment}::{key}::{len(controls)}", "headings": [heading or fragment.title()], "errors": list(errors), "notices": [], "steps": [],
        "buttons": [{"text": "Submit", "id": "go", "type": "submit", "danger": True, "selector": "#go", "visible": True, "disabled": False}],
        "framework": {"framework": "angular", "version": "17", "confidence": "high"}, "auth": {"logged_in": logged_in, "evidence": "x", "confidence": "medium"},
        "controls": list(controls), "lists": lists or {"tables": [], "repeats": [], "pagination": [], "downloads": []}, "nav": nav(tab),
        "view": {"key": key, "active": []}, "blocked_frames": [], "net_refs": [], "action_ids": [], "capture_degraded": False, **more,
    }


def ledger_lists(page):
    return {
        "tables": [{"container_selector": "#ledger", "headers": ["Date", "Amount"], "row_count": 3}], "repeats": [],
        "pagination": [{"container_selector": ".pager", "style": "numbered", "next": ".next", "prev": ".prev", "page_indicator": "", "current": str(page)}],
        "downloads": [{"selector": "a.dl", "text": "Notice", "extension": "pdf", "kind": "direct"}],
    }


def act(n, seconds, label, *, route, trigger=None, kind="click", selector=None, menu=(), state_id=None, result=None, **more):
    return {
        "session": "s1", "id": f"act_{n:04d}", "seq": n, "tab_id": 1, "frame_id": 0, "kind": kind, "trigger": trigger or f"click:{label}", "at": at(seconds), "origin": SITE,
        "route": f"/portal/#/{route}", "view_key": "", "label": label, "target_type": "a", "selectors": {"primary": selector or f"#m-{label}", "fallbacks": [], "shadow_path": [], "stability": "stable", "unique": True, "role": "link", "name": label},
        "menu_path": list(menu), "in_nav": bool(menu), "pagination": False, "danger": False, "download": False, "state_id_at_time": state_id, "result_state_id": result, **more,
    }


def call(n, seconds, path, *, state_id, method="GET", body=None, status=200, mime="application/json", request=None, action=None, **more):
    return {
        "session": "s1", "id": f"net_{n:04d}", "seq": n, "tab_id": 1, "frame_id": 0, "kind": "fetch", "method": method, "url": f"{SITE}{path}", "page_url": f"{SITE}/portal/",
        "status": status, "mime_type": mime, "started_at": at(seconds), "duration_ms": 20, "request_headers": [], "response_headers": [], "request_body": request,
        "response_body": None if body is None else json.dumps(body), "response_size": -1, "body_truncated": False, "is_download": False, "state_id_at_time": state_id,
        "state_id_inferred": False, "action_id_at_time": action, "has_full_body": False, **more,
    }


def portal(spark: SparkSession) -> dict:
    year = control("year", "Year", id="year", type="select-one", options=[{"v": "1", "t": "2024"}, {"v": "2", "t": "2025"}])
    cat1 = control("category", "Category", id="mat-input-1", type="select-one", primary="#mat-input-1", stability="fragile", binding="category")
    cat2 = control("category", "Category", id="mat-input-2", type="select-one", primary="#mat-input-2", stability="fragile", binding="category", options=[{"v": "a", "t": "A"}])
    pwd = control("pin", "PIN", id="pin", type="password", redacted_entirely=True)
    states = [
        state(1, 0, "home", trigger="load", heading="Welcome"),
        state(2, 12, "returns", trigger="click:Returns", controls=[year, cat1]),
        state(3, 22, "returns", trigger="change:year", controls=[year, cat2, pwd]),
        state(4, 32, "ledger", trigger="click:Ledger", tab="Pending", page=1, lists=ledger_lists(1)),
        state(5, 42, "ledger", trigger="click:2", tab="Pending", page=2, lists=ledger_lists(2)),
        state(6, 52, "ledger", trigger="click:Responded", tab="Responded", page=1, lists=ledger_lists(1)),
        state(7, 72, "done", trigger="click:Submit", heading="Done"),
        state(8, 92, "help", trigger="load", heading="Help"),
    ]
    actions = [
        act(1, 9, "Reports", route="home", menu=["Reports"], state_id="st_0001", result="st_0002"),
        act(2, 11, "Returns", route="home", menu=["Reports", "Returns"], state_id="st_0001", result="st_0002"),
        act(3, 21, "Year", route="returns", kind="change", trigger="change:year", selector="#year", control_key="year", chosen="2025", state_id="st_0002", result="st_0003"),
        act(4, 31, "Ledger", route="returns", menu=["Reports", "Ledger"], state_id="st_0003", result="st_0004"),
        act(5, 41, "2", route="ledger", selector=".next", pagination=True, pagination_role="next", list_selector="#ledger", state_id="st_0004", result="st_0005"),
        act(6, 51, "Responded", route="ledger", selector="#tab-Responded", view_group="status", state_id="st_0005", result="st_0006"),
        act(7, 61, "Notice", route="ledger", selector="a.dl", download=True, state_id="st_0006"),
        act(8, 71, "Submit", route="ledger", selector="#go", danger=True, state_id="st_0006", result="st_0007"),
    ]
    row = lambda i: {"entryId": i, "status": "posted" if i % 2 else "pending", "amount": 1.5, "note": None}
    net = [
        call(1, 11.2, "/api/returns?page=1&size=10", state_id="st_0001", body={"data": {"items": [row(1), row(2)], "total": 2}}, action="act_0002"),
        call(2, 21.3, "/api/subcategories?category=2", state_id="st_0002", body={"data": {"items": [{"code": "a", "label": "A"}]}}, action="act_0003"),
        call(3, 31.2, "/api/ledger?page=1&size=3", state_id="st_0003", body={"data": {"items": [row(1), row(2), row(3)], "total": 9}}, action="act_0004"),
        call(4, 41.2, "/api/ledger?page=2&size=3", state_id="st_0004", body={"data": {"items": [row(4), row(5), row(6)], "total": 9, "next": None}}, action="act_0005"),
        call(5, 42.5, "/api/proceedings/1043", state_id="st_0005", body={"id": 1, "history": [{"step": "a"}]}),
        call(6, 43.5, "/api/proceedings/1044", state_id="st_0005", body={"id": 2, "history": [{"step": "b"}, {"step": "c"}]}),
        call(7, 71.1, "/api/updateEntity", state_id="st_0006", method="POST", request='{"serviceName":"submitForm"}', body={"ok": True}, action="act_0008"),
        call(8, 71.2, "/assets/app.js", state_id="st_0006", mime="text/javascript"),
        call(9, 71.3, "/api/search", state_id="st_0006", method="POST", request='{"q":"x"}', body={"error": "no"}, status=404),
        call(10, 61.2, "/files/demand-notice.pdf", state_id="st_0006", mime="application/pdf", is_download=True, action="act_0007"),
    ]
    downloads = [{"session": "s1", "id": "dl_0001", "seq": 1, "at": at(61.5), "origin": SITE, "url_kind": "http", "url": f"{SITE}/files/demand-notice.pdf", "query_keys": [], "mime": "application/pdf", "extension": "pdf",
                  "name_shape": "A{6}-A{6}.pdf", "size_bytes": 1000, "state": "complete", "tab_id": 1, "route": "/portal/#/ledger", "state_id_at_time": "st_0006", "action_id": "act_0007", "net_id": "net_0010"}]
    timeline = [{"session": "s1", "type": "paused", "at": at(80)}, {"session": "s1", "type": "resumed", "at": at(90)}]
    return {"states": frame(spark, "states", states), "actions": frame(spark, "actions", actions), "net": frame(spark, "net", net),
            "downloads": frame(spark, "downloads", downloads), "timeline": frame(spark, "timeline", timeline)}
