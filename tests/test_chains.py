"""Chains of spans, bursts and breaker against the machines that walk a whole document."""

import random

import numpy as np
import pytest

from wayfold.operators import chains
from wayfold.streaming import machines as M
from wayfold.streaming import operators as L


def plain(t, forced, span, inclusive):
    out, since = [], None
    for x, f in zip(t, forced):
        out.append(since)
        if since is None or f or x - since > span or (inclusive and x - since == span):
            since = x
    return out, since


@pytest.mark.parametrize("seed", range(6))
def test_chunk_functions_compose_to_the_walk(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, span, inclusive = rng.randint(1, 60), rng.randint(1, 12), rng.random() < 0.5
        t = np.cumsum([rng.choice([0, 1, 2, 5]) for _ in range(n)]) + 1000
        forced = np.array([rng.random() < 0.1 for _ in range(n)])
        want, end = plain(t.tolist(), forced.tolist(), span, inclusive)
        got, since, at = [], None, 0
        while at < n:  # chunks of equal times stay together, as they do by time
            to = at + rng.randint(1, 9)
            while to < n and t[to] == t[to - 1]:
                to += 1
            a, b = t[at:to], forced[at:to]
            values, known = chains.openings(a, b, span, inclusive, since)
            got += [int(v) if k else None for v, k in zip(values, known)]
            since, at = chains.leave(*chains.chunk_function(a, b, span, inclusive), span, inclusive, since), to
        assert got == want and since == end


def walked(machine, rows, inputs):
    out = []
    for doc in sorted({r[0] for r in rows}):
        m = machine()
        for r in sorted(x for x in rows if x[0] == doc):
            out += [(doc, *x) for x in m.feed(dict(zip(inputs, (r[1], *r[3:]))))]
        out += [(doc, *x) for x in m.close()]
    return sorted(out, key=str)


def documents(seed):
    """A busy document without a quiet gap, a regular one whose chains never meet, and small ones."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 40, 300, 700])
        rows.append(("busy", t, i, rng.choice(["dom-change", "click", "route"]), "/a" if i % 97 else f"/{i}", rng.randint(0, 9)))
    rows += [("regular", 500 * i, i, "dom-change", "/a", 7) for i in range(600)]
    rows += [("sparse", 5000 * i, i, "manual", "/a", 1) for i in range(30)] + [("one", 7, 0, "click", "/a", 3)]
    return rows


@pytest.mark.parametrize("chunk", [1700, 60_000])
def test_bursts_of_a_busy_document_equal_the_machine(spark, chunk):
    rows = documents(1)
    df = spark.createDataFrame([r[:5] for r in rows], "doc string, ts_ms long, n int, trigger string, route string")
    got = L.bursts(df, by=["doc"], tie=["n"], chunk=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == walked(M.Bursts, [r[:5] for r in rows], M.Bursts.inputs)
    empty = L.bursts(df.limit(0), by=["doc"], tie=["n"])
    assert empty.count() == 0


@pytest.mark.parametrize("chunk", [1700, 60_000])
def test_breaker_of_a_busy_document_equals_the_machine(spark, chunk):
    rows = [(d, t, n, trigger, records) for d, t, n, trigger, _, records in documents(2)]
    df = spark.createDataFrame(rows, "doc string, ts_ms long, n int, trigger string, records int")
    args = {"limit": 12, "window": 1000, "cooldown": 2500}
    got = L.volume_breaker(df, by=["doc"], tie=["n"], chunk=chunk, **args).collect()
    assert sorted((tuple(r) for r in got), key=str) == walked(lambda: M.VolumeBreaker(*args.values()), rows, M.VolumeBreaker.inputs)
    nulls = spark.createDataFrame([("a", None, 1, "click", 5), (None, 5, 1, None, 50)], df.schema)
    assert [tuple(r) for r in L.volume_breaker(nulls, by=["doc"], tie=["n"], **args).collect()] == [(None, 5, None, True, True)]


def test_a_busy_document_uses_many_tasks(spark):
    df = spark.range(0, 20_000).selectExpr("'a' as doc", "id * 100 as ts_ms", "'click' as trigger", "'/' as route")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks as they would be on a large table
    try:
        held = chains.span_before(df, by=["doc"], order=["ts_ms"], span=3000, chunk=50_000)
        sizes = [len(p) for p in held.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 20_000 and sum(s > 0 for s in sizes) == 4


@pytest.mark.parametrize("chunk", [1700, 10**7])
def test_overlay_memory_equals_the_machine(spark, chunk, monkeypatch):
    monkeypatch.setattr(L, "RUNS", 8)
    monkeypatch.setattr(L, "ITEMS", 3)
    rng, rows = random.Random(4), []
    for doc, n in (("busy", 120), ("small", 6), ("one", 1), (None, 5)):
        for i in range(n):
            state = f"s{rng.randint(0, 5)}" if rng.random() < 0.3 else f"t{i}"
            for pos, item in enumerate(rng.sample("abcdefghijkl", rng.randint(1, 5)) + ["a"] * rng.randint(0, 2)):
                rows.append((doc, 300 * i, state, pos, item))
    df = spark.createDataFrame(rows, "doc string, ts_ms long, state_id string, pos int, item string")
    want = sorted(
        ((doc, *x) for doc in {r[0] for r in rows} for m in [M.MenuMemory()] for x in [y for r in sorted((r[1:] for r in rows if r[0] == doc)) for y in m.feed({"state_id": r[1], "item": r[3]})] + list(m.close())), key=str
    )
    assert sorted((tuple(r) for r in L.overlay_memory(df, by=["doc"], chunk=chunk).collect()), key=str) == want
    assert L.overlay_memory(df.limit(0), by=["doc"]).count() == 0
    assert L.overlay_memory(df, by=["doc"], memory=2, shown=4).count() < len(want)
    blank = spark.createDataFrame([("a", 1, "s", 0, None), ("a", 2, "t", 0, "x"), ("a", 3, "u", 0, None)], df.schema)
    assert sorted(tuple(r) for r in L.overlay_memory(blank, by=["doc"]).collect()) == [("a", "t", "x", True), ("a", "u", "x", False)]
