"""One capture in, every derived table out.

The order is catalog, site map, routes, coverage; each step reads the tables of
the ones before it. Tables that several steps read are written to the
checkpoint folder once, so plans stay short, work is not repeated, and a lost
executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin_of
from ..operators import controls as C
from ..operators import coverage as V
from ..operators import endpoints as E
from ..operators import joins as J
from ..operators import records as Q
from ..operators import redact as X
from ..operators import routes as R
from ..operators import shapes as S
from ..operators import sitemap as M
from ..operators import transitions as T
from ..session import cut_lineage


def derive(tables: dict[str, DataFrame], *, chunk=None, fold_variance: bool = True) -> dict[str, DataFrame]:
    """Derived tables of a capture, keyed by origin.

    Ids are unique within a session alone: every join on one carries the session,
    and so do the tables that list ids.
    """
    states, net, actions = tables["states"], tables["net"], tables["actions"]
    downloads, timeline = tables["downloads"], tables["timeline"]
    by = ["origin"]
    out: dict[str, DataFrame] = {}

    claims = cut_lineage(T.claim_actions(actions, states, timeline, chunk=chunk))
    edges = cut_lineage(T.edge_causes(T.transitions(states, timeline, chunk=chunk), claims))
    deps = cut_lineage(T.distinct_dependencies(T.dependencies(edges, net)))
    outcomes = cut_lineage(T.outcomes(actions, edges, claims, states))
    out |= {"transitions": edges, "action_states": claims, "dependencies": deps, "outcomes": outcomes}

    calls = net.withColumn("origin", origin_of("page_url"))
    call = ["origin", "session", "id"]
    sent = cut_lineage(S.shape_nodes(cut_lineage(S.shape_visits(calls, body="request_body", owner=call)), owner=call))
    visits = S.shape_visits(calls, body="response_body", owner=call)
    nodes = cut_lineage(S.shape_nodes(cut_lineage(visits), owner=call))
    leaves = S.leaf_paths(nodes, owner=call)
    evidence = leaves.groupBy(*call).agg(F.array_sort(F.collect_set("leaf")).alias("response_paths"))
    sent_paths = S.leaf_paths(sent, owner=call).groupBy(*call).agg(F.array_sort(F.collect_set("leaf")).alias("request_paths"))
    calls = cut_lineage(calls.join(evidence, call, "left").join(sent_paths, call, "left"))
    catalog = E.api_catalog(calls, states, actions, by=by, base=F.col("origin"), fold_variance=fold_variance, chunk=chunk)
    catalog = {k: cut_lineage(v) for k, v in catalog.items()}
    out |= catalog
    status = calls.select(*call, E.response_split("status").alias("kind"))
    of_call = catalog["endpoint_calls"].select("origin", "session", F.col("net_id").alias("id"), "endpoint_id")
    shaped = cut_lineage(nodes.join(status, call).join(of_call, call))
    # an endpoint that only failed has its error as its response
    answered = shaped.filter("kind = 'response'").select("origin", "endpoint_id").distinct()
    failed = shaped.join(answered, ["origin", "endpoint_id"], "left_anti").withColumn("kind", F.lit("response"))
    asked = sent.join(of_call, call).withColumn("kind", F.lit("request"))
    shaped = shaped.unionByName(failed).unionByName(asked, allowMissingColumns=True)
    out["body_paging"] = E.body_paging_params(asked, by=["origin", "endpoint_id"])
    out["clean_calls"] = X.scrub_net(calls)
    out["endpoint_shapes"] = cut_lineage(S.merge_shapes(cut_lineage(shaped), by=["origin", "endpoint_id", "kind"]))
    out["endpoint_lists"] = S.list_paths(out["endpoint_shapes"], by=["origin", "endpoint_id", "kind"])

    fed = E.attribute_calls(calls, states, by=["origin", "session"], chunk=chunk)
    fed = cut_lineage(fed)
    slim = M.states_by_page(states)
    pages = cut_lineage(M.site_pages(slim))
    placed = M.actions_with_route(actions, states)
    merged_menu = cut_lineage(M.merge_menu(M.menu_sightings(states)))
    menu, clicks, leads = (cut_lineage(t) for t in M.menu_visits(merged_menu, actions, outcomes, states, pages))
    call_map = catalog["endpoint_calls"]
    lengths = cut_lineage(S.list_paths(nodes, by=call).select("origin", "session", F.col("id").alias("net_id"), "len"))
    options = cut_lineage(M.view_options(states, placed))
    lists = cut_lineage(M.list_status(states, placed, outcomes, downloads))
    page_dl = cut_lineage(M.page_downloads(downloads, states, actions, pages))
    labels = cut_lineage(M.page_labels(pages, leads, menu))
    out |= {
        "site_pages": pages, "page_views": M.page_views(slim), "site_menu": menu, "menu_clicks": clicks, "menu_leads_to": leads,
        "view_options": options, "site_lists": lists, "page_endpoints": M.page_endpoints(slim, fed, call_map),
        "list_feeds": M.list_feeds(states, fed, call_map, lengths), "page_downloads": page_dl, "page_labels": labels,
    }

    graph = edges
    if "tabs" in tables:  # tabs: session, tab_id, opener_tab_id, at, opener_state_id
        out["new_tab_edges"] = cut_lineage(T.new_tab_edges(states, tables["tabs"], actions, timeline, chunk=chunk))
        graph = edges.unionByName(out["new_tab_edges"], allowMissingColumns=True)
    hops, refused = (cut_lineage(t) for t in R.click_graph(graph, actions, claims))
    entry = R.entry_nodes(states)
    reached = R.shortest_paths(hops, entry)
    openers = cut_lineage(R.branch_openers(reached, actions, claims, edges))
    recipes = R.route_recipes(states, reached, refused, entry)
    out |= {"route_recipes": recipes, "route_steps": R.route_steps(reached, openers, states)}

    covered = cut_lineage(V.menu_covered(menu))
    gaps = cut_lineage(V.page_gaps(pages, labels, options, lists, page_dl, V.offers_download(states, actions)))
    out |= {
        "unvisited_menu": V.unvisited_menu(covered), "page_gaps": gaps, "page_coverage": V.page_coverage(pages, gaps, states, page_dl),
        "coverage_totals": V.coverage_totals(covered, pages, options, lists, downloads), "coverage_hints": V.coverage_hints(covered, gaps),
    }
    out["page_recipes"] = V.recipe_rows(R.best_recipes(recipes), pages, labels, out["page_coverage"], out["page_endpoints"], lists, options)
    out["menu_order"] = M.pages_in_menu_order(pages, leads, menu)

    controls = C.controls_of(states)
    effective = cut_lineage(C.effective_controls(controls, C.varying_ids(controls)))
    merged = cut_lineage(C.merge_controls(effective))
    sightings = cut_lineage(C.control_sightings(effective, merged))
    merged = cut_lineage(C.promote_widgets(merged, edges, sightings))
    by_origin = deps.join(states.select("session", F.col("id").alias("state_id"), "origin"), ["session", "state_id"])
    out |= {
        "controls": merged, "control_states": sightings, "control_links": C.link_dependencies(by_origin, sightings), "lists": C.merge_lists(states),
        "selectors": C.selectors_file(merged), "attention": V.attention_list(states, merged), "inventory": V.page_inventory(states),
        "summary": V.summary_counts(states, merged, C.merge_lists(states), edges, catalog["endpoints"]),
        "alternate_keys": C.alternate_keys(effective, merged), "reference_data": C.reference_data(merged),
        "locators": merged.select("origin", "key", F.explode(C.locator_candidates(F.col("selectors"), F.lit("textbox"), F.when(F.col("type") == "text", F.col("label")))).alias("locator")),
        "manifest": Q.manifest(states.select("origin"), {"states": states, "net": calls, "actions": actions, "downloads": downloads}).join(Q.site_framework(states), "origin", "left"),
        "reached_by": T.reached_by(states, edges), "narrative": T.flow_narrative(states, edges, actions, timeline),
    }
    if "raw_url" in downloads.columns:
        out["download_calls"] = J.download_to_call(downloads, net, chunk=chunk)
    return out
