"""Shortest paths from pointers against a plain search."""

import random

import pytest
from wayfold.operators import routes as R


def plain(edges, entry, max_depth=None):
    """node -> (steps, cost, seen, path), level by level with the same ties."""
    best, frontier = {entry: (0, 0, 0, [])}, {entry}
    while frontier and (max_depth is None or best[next(iter(frontier))][0] < max_depth):
        found = {}
        for a, b, cost, seen in edges:
            if a in frontier and b not in best:
                was = best[a]
                rank = (was[1] + cost, -(was[2] + seen), a)
                if b not in found or rank < found[b][0]:
                    found[b] = (rank, (was[0] + 1, was[1] + cost, was[2] + seen, was[3] + [b]))
        best |= {n: v for n, (_, v) in found.items()}
        frontier = set(found)
    return best


@pytest.mark.parametrize("max_depth", [None, 0, 3])
def test_paths_equal_a_plain_search(spark, max_depth):
    rng = random.Random(8)
    edges = {(f"n{i}", f"n{i + 1}"): (f"n{i}", f"n{i + 1}", 1, 1) for i in range(13)}  # a chain deep enough for several jumps
    for _ in range(25):
        a, b = f"n{rng.randint(0, 6)}", f"m{rng.randint(0, 9)}"
        edges[a, b] = (a, b, rng.randint(1, 3), rng.randint(1, 4))
        edges[b, a] = (b, a, 1, 1)
    edges = list(edges.values())
    hops = spark.createDataFrame([("s", *e) for e in edges] + [("t", *e) for e in edges], "site string, from_node string, to_node string, hop_cost int, seen long").selectExpr("*", "cast(null as string) as step")
    entry = spark.createDataFrame([("s", "n0"), ("t", "n3"), ("u", "x")], "site string, node string")
    rows = R.shortest_paths(hops, entry, by=["site"], payload=False, max_depth=max_depth).collect()
    got = {(r.site, r.node): (r.steps, r.cost, r.seen, r.path) for r in rows}
    want = {("s", n): v for n, v in plain(edges, "n0", max_depth).items()} | {("t", n): v for n, v in plain(edges, "n3", max_depth).items()} | {("u", "x"): (0, 0, 0, [])}
    assert got == want and len(rows) == len(got)
