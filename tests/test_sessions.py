"""Ids begin anew in every session: two sessions of one site must not mix."""

import captures
import pytest
from pyspark.sql import functions as F

from wayfold.operators import endpoints as E
from wayfold.operators import joins as J
from wayfold.plans.capture import derive


@pytest.fixture(scope="module")
def once_and_twice(spark):
    one = captures.portal(spark)
    session = next(r.session for r in one["states"].select("session").limit(1).collect())
    two = {k: v.unionByName(v.withColumn("session", F.concat("session", F.lit("-again")))) for k, v in one.items()}
    return session, derive(one), derive(two)


def count(df, *keys):
    return sorted((tuple(r)) for r in df.groupBy(*keys).count().collect())


@pytest.mark.parametrize("table", ["endpoint_calls", "endpoint_states", "endpoint_actions", "transitions", "action_states", "outcomes", "control_states", "menu_clicks"])
def test_rows_that_list_ids_double(once_and_twice, table):
    _, one, two = once_and_twice
    assert two[table].count() == 2 * one[table].count() > 0
    assert two[table].distinct().count() == two[table].count()


@pytest.mark.parametrize("table", ["endpoints", "endpoint_routes", "page_endpoints", "list_feeds", "site_pages", "site_menu", "menu_leads_to", "controls", "control_links", "endpoint_shapes", "site_lists"])
def test_rolled_up_rows_stay(once_and_twice, table):
    _, one, two = once_and_twice
    assert two[table].count() == one[table].count()


def test_counts_double(once_and_twice):
    _, one, two = once_and_twice
    keys = ["endpoint_id", "status"]
    a, b = ({tuple(r[k] for k in keys): r.n_calls for r in d["endpoint_statuses"].collect()} for d in (one, two))
    assert b == {k: 2 * n for k, n in a.items()}
    a, b = ({(r.method, r.path): r.n_calls for r in d["endpoints"].collect()} for d in (one, two))
    assert b == {k: 2 * n for k, n in a.items()}
    a, b = ({r.key: r.n_states for r in d["controls"].collect()} for d in (one, two))
    assert b == {k: 2 * n for k, n in a.items()}


def test_kinds_first_seen_together_stay_apart(spark):
    kinds = spark.createDataFrame([("b", "k1", ["a"], False, 1), ("b", "k2", ["z"], False, 1), ("b", "k3", ["a"], False, 1)], "bucket string, kind string, evidence array<string>, like boolean, seen long")
    for batch in (1, 2, 100):
        of = {r.kind: r.cluster for r in E.first_come_clusters(kinds, batch=batch).collect()}
        assert of["k1"] == of["k3"] != of["k2"]


def test_hints_of_equal_ids_stay_in_their_session(spark):
    rows = spark.createDataFrame([("s", 1, "d1", 5.0), ("t", 1, "d1", 6.0)], "session string, tab_id long, id string, s double").withColumn("at", F.timestamp_seconds("s"))
    hints = spark.createDataFrame([("s", 1, "h1", 4.0), ("t", 1, "h1", 4.0)], "session string, tab_id long, hint_id string, s double").withColumn("at", F.timestamp_seconds("s"))
    assert [r.h for r in J.consume_hints(rows, hints).select(F.col("hint.hint_id").alias("h")).collect()] == ["h1", "h1"]


def test_the_rest_of_the_plan(once_and_twice):
    _, one, two = once_and_twice
    asked = {r.kind for r in one["endpoint_shapes"].select("kind").distinct().collect()}
    assert {"request", "response"} <= asked
    man = one["manifest"].filter("n_states > 0").first()
    again = two["manifest"].filter("n_states > 0").first()
    assert (again.n_states, again.n_net, again.n_actions) == (2 * man.n_states, 2 * man.n_net, 2 * man.n_actions)
    recipes = {r.route: r for r in one["page_recipes"].collect()}
    assert recipes["/portal/#/returns"].reachable and "step(s)" in recipes["/portal/#/returns"].summary
    assert one["locators"].filter("key = 'category'").count() >= 1 and one["menu_order"].count() == one["site_pages"].count()
    assert one["reference_data"].filter("key = 'pin'").count() == 0 and one["clean_calls"].count() == 10
    assert one["alternate_keys"].count() > 0
