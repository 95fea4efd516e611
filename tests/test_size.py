"""How work is cut: what the findings on time and memory were about."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayfold.operators import pages as G
from wayfold.plans import built_queries as B

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@given
def test_no_side_is_broadcast_by_the_size_of_a_file(spark, capsys):
    entry.queries()["built_controls"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@given
def test_forms_are_dealt_to_all_cores(spark):
    """One file of one group of rows was one task, whatever each row costs."""
    assert B.part_forms(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert entry.queries()["built_clean_pages"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tasks_grow_in_number_with_the_rows(spark, tmp_path):
    from wayfold.plans import tables

    spark.range(tables.TASK_ROWS * 20).selectExpr("id as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert tables.dealt_table(spark, str(tmp_path), "customer").rdd.getNumPartitions() == 20


def test_nodes_keep_other_columns_and_leave_out_empty_pages(spark, monkeypatch):
    from wayfold.functions import columns

    monkeypatch.setattr(columns, "BATCH_ROWS", 3)
    pages = spark.createDataFrame([(1, ["a"], "<p id=x>One</p><br>"), (2, None, None), (3, [], ""), (4, None, "<i>Two</i>")], "page_id long, tags array<string>, html string").coalesce(1)
    got = [tuple(r) for r in G.page_nodes(pages, keep=["tags"]).select("page_id", "tags", "idx", "parent", "tag", "attrs", "text", "path").orderBy("page_id", "idx").collect()]
    assert got == [
        (1, ["a"], 0, None, "p", {"id": "x"}, "One", []), (1, ["a"], 1, 0, "#text", {}, "One", [0]), (1, ["a"], 2, None, "br", {}, "", []),
        (4, None, 0, None, "i", {}, "Two", []), (4, None, 1, 0, "#text", {}, "Two", [0]),
    ]


def test_nodes_of_one_body_are_those_of_its_values(spark):
    from wayfold.operators import shapes as S

    bodies = [
        '{"a":[{"s":"on","n":1},{"s":"off","n":null},{"s":"on"},{"s":"on","x":"  "},{"s":"on","x":""}],"b":{"c d":"' + "z" * 50 + '"}}', '{"a":3,"m":[1,"x",{"deep":[{"e":1}]}]}',
        '[["12","12","34","12","5"],["2024-01-01","2025-01-01"]]', '{"v":["true","false","true","true","true"],"k":["123456","1","2","3","4"],"t":["a","b","c","d","e","f","g","h","i"]}',
        "no body", None, "[1", "{}", "[null,null]", '{"q":["x","x","x","x","x",""]}', '[{"u":{"w":1}},{"u":{}},{"u":{"w":null}},{"u":[]}]',
    ]
    df = spark.createDataFrame([(i, i % 3, b) for i, b in enumerate(bodies)] + [(99, 1, '{"a":"on"}'), (99, 1, '{"a":"off"}'), (98, 2, '{"a":1}'), (98, 2, '{"a":null,"b":2}')], "id int, part int, response_body string")
    by = ["id", "part"]
    want = S.shape_nodes(S.shape_visits(df, owner=by), owner=by)
    got = S.body_shapes(df, owner=by)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 36


def test_equal_nodes_of_bodies_leave_a_task_once(spark):
    from wayfold.operators import shapes as S

    one = lambda i: f'{{"a":{i},"b":"{i % 3}","c":[{"1," * (i % 2)}2]}}' if i % 5 else '{"a":null}'
    df = spark.createDataFrame([(i, "k", one(i)) for i in range(500)] + [(501, "k", '{"a":"x"}'), (501, "k", '{"a":"y"}')], "id int, kind string, response_body string").coalesce(1)
    counted = S.body_shapes(df, owner=["kind", "id"], by=["kind"])
    assert counted.count() < 40 and counted.filter("path = '$'").agg(F.sum("bodies")).first()[0] == 501
    want = S.merge_shapes(S.shape_nodes(S.shape_visits(df, owner=["kind", "id"]), owner=["kind", "id"]), by=["kind"])
    got = S.merge_shapes(counted, by=["kind"], bodies="bodies")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_bodies_that_differ_in_numbers_are_read_once(monkeypatch):
    import random

    from wayfold.functions import shapes as W

    bits = ["{", "}", "[", "]", ":", ",", '"a"', '"x,1,"', '":1,y"', '"q\\":1,"', "1", "-1.5", "01", "1e5", "NaN", " ", '"k":1', '"k": 2', '"\\":3', '"é":4', "1.", "9" * 25, "9" * 5000, '"o":{', "true", '"":5']
    rnd = random.Random(5)
    odd = ["{" + "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))) + "}" * rnd.randint(1, 2) for _ in range(20_000)]
    read, held = W.ShapeVisits().eval, W.BodyNodes()
    monkeypatch.setattr(W.BodyNodes, "BODIES", 500)
    want = [tuple(W.node_rows(read(b, None, None, None, None))) for b in odd]
    assert sum(map(bool, want)) > 300 and [held.eval(b) for b in odd] == want and len(held.bodies) <= 500
    reads = []
    monkeypatch.setattr(held, "read", lambda *a: reads.append(a) or read(*a))
    rows = [held.eval(f'{{"key":{i},"price":{i / 7},"note":"at {i % 3}"}}') for i in range(300)]
    assert len(reads) == 3 and rows[0] is rows[3] and rows[0] != rows[1]


def test_equal_values_leave_a_task_once(spark):
    from wayfold.operators import shapes as S

    df = spark.range(500).selectExpr("'k' as kind", "array(1) as other", """concat('{"a":', id, ',"b":"', id % 3, '"}') as response_body""").coalesce(1)
    visits = S.shape_visits(df, owner=["kind"]).collect()
    assert {(r.path, r.text): r.n for r in visits} == {("$", None): 500, ("$.a", None): 500, ("$.b", "0"): 167, ("$.b", "1"): 167, ("$.b", "2"): 166}
    assert S.shape_visits(df.limit(10), owner=["other"]).count() == 30


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    import random

    from wayfold.functions import html as H

    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<title>", "</title>", "<br>", "x y", " \n", "<li>", '<a href="/x" Class="b">', "</a>", "<script>", "</script>", "&amp;", "<", "a>b", "<i a='1'>",
            "<b hidden>", "</B>", "<!-- c -->", '<a  b="1">', '<a b="1" b="2">', "<textarea>", "</textarea>", '<div role="tablist" class="nav-tabs">', "<x-y>", "</p >", '<a b="x>y">', "\0", "<plaintext>"]
    rnd = random.Random(3)
    odd = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    quick = [list(H.HtmlNodes().eval(p)) for p in odd]
    assert sum(H.plain_parts(p) is not None for p in odd) > 300
    with monkeypatch.context() as m:
        m.setattr(H, "plain_parts", lambda html: None)
        assert quick == [list(H.HtmlNodes().eval(p)) for p in odd]
    monkeypatch.setattr(H._Walk, "feed", lambda self, html: 1 / 0)  # plain pages do not come to the parser
    assert [r[2] for r in H.HtmlNodes().eval('<p id="a">One<br>two</p>')] == ["p", "#text", "br", "#text"]


def test_cells_are_found_in_rows_of_tables_alone(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>cc</td></tr></table><div role=row><p role=cell>no</p></div>")], "page_id long, html string")
    found = G.tables(G.page_nodes(pages, write=True))
    assert [(r.idx, r.n_rows, r.first_row) for r in found.orderBy("idx").collect()] == [(0, 1, ["<3 chars>", "<2 chars>"]), (4, 1, ["<1 chars>"])]


@given
def test_bodies_are_dealt_to_all_cores(spark):
    assert entry.queries()["scrub_bodies"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_short_chunks_leave_a_task_together():
    import pyarrow as pa

    from wayfold.operators import chains

    runs = [pa.table({"t": list(range(n))}) for n in (4000, 4000, 4000, 20_000, 1)]
    assert [[r.num_rows for r in held] for held in chains._some(iter(runs))] == [[4000, 4000, 4000], [20_000], [1]]


def test_counted_rows_of_the_breaker_are_worked_out_once(spark):
    from wayfold.streaming import operators as L

    df = spark.createDataFrame([("d", 1, "dom-change", 5)], "doc string, ts_ms long, trigger string, records int")
    plan = L.volume_breaker(df, by=["doc"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Scan ExistingRDD\[[^\]]*__n#", plan)  # from what was written, not from the rows given
