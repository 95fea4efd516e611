"""Declared schemas of the capture tables. Readers use these; nothing is inferred."""

from __future__ import annotations

HEADERS = "array<struct<name:string,value:string>>"

SELECTORS = "struct<primary:string,fallbacks:array<string>,shadow_path:array<string>,stability:string,unique:boolean,role:string,name:string>"

CONTROL = (
    "struct<idx:int,tag:string,type:string,role:string,key:string,id:string,name:string,binding:string,label:string,"
    "label_source:string,required:boolean,max_length:int,pattern:string,visible:boolean,value:string,"
    "redacted_entirely:boolean,options:array<struct<v:string,t:string>>,"
    "entry:struct<mode:string,evidence:string,widget_kind:string,mask:string>,"
    "selectors:struct<primary:string,fallbacks:array<string>,shadow_path:array<string>,stability:string,unique:boolean,"
    "unique_in_form:boolean,notes:string>>"
)
NAV_ITEM = (
    "struct<text:string,path:array<string>,depth:int,selector:string,href:string,visible:boolean,expanded:boolean,"
    "has_children:boolean,current:boolean>"
)
VIEW_GROUP = (
    "struct<kind:string,label:string,name:string,container_selector:string,"
    "options:array<struct<text:string,selector:string,active:boolean,disabled:boolean>>>"
)
LISTS = (
    "struct<tables:array<struct<container_selector:string,headers:array<string>,row_count:bigint>>,"
    "repeats:array<struct<container_selector:string,item_selector:string,item_count:bigint,has_download:boolean>>,"
    "pagination:array<struct<container_selector:string,style:string,next:string,prev:string,page_indicator:string,current:string>>,"
    "downloads:array<struct<selector:string,text:string,extension:string,kind:string>>>"
)

STATES = f"""
session string, id string, seq bigint, tab_id bigint, frame_id bigint, captured_at timestamp, trigger string,
trigger_at timestamp, triggers array<string>, origin string, url string, pathname string, route string,
query_keys array<string>, title string, lang string, in_iframe boolean, signature string, headings array<string>,
errors array<string>, notices array<string>, steps array<struct<text:string,active:boolean>>,
buttons array<struct<text:string,id:string,classes:string,type:string,disabled:boolean,visible:boolean,danger:boolean,selector:string>>,
framework struct<framework:string,version:string,confidence:string>,
auth struct<logged_in:boolean,evidence:string,confidence:string>, controls array<{CONTROL}>, lists {LISTS},
nav struct<menus:array<{NAV_ITEM}>,view_groups:array<{VIEW_GROUP}>,breadcrumbs:array<string>>,
view struct<key:string,active:array<struct<group:string,option:string>>>, blocked_frames array<string>,
net_refs array<string>, action_ids array<string>,
opened_from struct<tab_id:bigint,state_id:string,action_id:string>, duplicate_of string, capture_degraded boolean
"""

NET = f"""
session string, id string, seq bigint, tab_id bigint, frame_id bigint, kind string, method string, url string,
page_url string, status int, mime_type string, started_at timestamp, duration_ms bigint, request_headers {HEADERS},
response_headers {HEADERS}, request_body string, response_body string, response_size bigint, body_truncated boolean,
disposition string, disposition_ext string, is_download boolean, error string, state_id_at_time string,
state_id_inferred boolean, action_id_at_time string, has_full_body boolean
"""

ACTIONS = f"""
session string, id string, seq bigint, tab_id bigint, frame_id bigint, kind string, trigger string, at timestamp,
origin string, route string, view_key string, label string, target_type string, selectors {SELECTORS}, href string,
target string, menu_path array<string>, in_nav boolean, view_group string, pagination boolean, pagination_role string,
list_selector string, danger boolean, download boolean, control_key string, chosen string, state_id_at_time string,
result_state_id string
"""

DOWNLOADS = """
session string, id string, seq bigint, at timestamp, origin string, url_kind string, url string,
query_keys array<string>, mime string, extension string, name_shape string, size_bytes bigint, state string,
tab_id bigint, route string, state_id_at_time string, action_id string, net_id string
"""

TIMELINE = "session string, type string, at timestamp"

TRANSITIONS = """
session string, from_id string, to_id string, trigger string, url_changed boolean, fields_added array<string>,
fields_removed array<string>,
options_changed array<struct<key:string,before:array<struct<v:string,t:string>>,after:array<struct<v:string,t:string>>>>,
list_counts_changed array<struct<selector:string,before:bigint,after:bigint>>, errors_appeared array<string>,
action_id string, route_changed boolean, view_changed boolean, via_new_tab boolean
"""

DEPENDENCIES = """
session string, source_key string, target_keys array<string>, via_network boolean, confidence string, endpoint string,
state_id string
"""

TABLES = {
    "states": STATES,
    "net": NET,
    "actions": ACTIONS,
    "downloads": DOWNLOADS,
    "timeline": TIMELINE,
    "transitions": TRANSITIONS,
    "dependencies": DEPENDENCIES,
}
