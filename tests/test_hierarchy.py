import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import hierarchy as H


def brute(parent):
    out = {}
    for v in {*parent, *parent.values()}:
        path, x, seen = [v], v, {v}
        while x in parent and parent[x] not in seen:
            x = parent[x]
            seen.add(x)
            path.append(x)
        if x in parent:
            ring, y = [parent[x]], parent[parent[x]]
            while y != parent[x]:
                ring.append(y)
                y = parent[y]
            out[v] = (min(ring), -1, None)
        else:
            out[v] = (x, len(path) - 1, path[::-1])
    return out


def random_parents(seed, n=120):
    rng = random.Random(seed)
    parent = {v: rng.randrange(v) for v in range(1, n) if rng.random() < 0.93}
    parent |= {200 + i: 199 + i for i in range(1, 40)}  # a chain
    parent |= {300 + i: 300 for i in range(1, 60)}  # a hot parent
    parent |= {400: 401, 401: 402, 402: 400, 403: 400, 404: 403, 405: 405, 406: 405}  # cycles with tails
    return parent


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    parent = random_parents(seed)
    rows = [*parent.items(), *list(parent.items())[:20], (None, 1), (5, None)]
    tree = H.hierarchy(spark.createDataFrame(rows, "child long, parent long").withColumn("node_id", F.lit("clash")))
    got = {r["node_id"]: r for r in H.paths(tree).collect()}
    want = brute(parent)
    assert {v: (r["root_id"], r["depth"], r["path"]) for v, r in got.items()} == want
    below = {}
    for _, _, path in want.values():
        for a in (path or [])[:-1]:
            below[a] = below.get(a, 0) + 1
    assert {v: r["n_descendants"] for v, r in got.items() if not r["in_cycle"]} == {v: below.get(v, 0) for v, w in want.items() if w[2]}
    spans = {r["node_id"]: r for r in tree.where("not in_cycle").collect()}
    pairs = {(a, v) for v, w in want.items() for a in (w[2] or [])[:-1]}
    inside = {(a, v) for a, x in spans.items() for v, y in spans.items() if x["root_id"] == y["root_id"] and x["tin"] < y["tin"] < x["tout"]}
    assert inside == pairs == {(r["ancestor_id"], r["node_id"]) for r in H.descendant_pairs(tree).collect()}


def test_long_intervals_are_cut(spark, monkeypatch):
    monkeypatch.setattr(H, "SPAN", 3)
    tree = H.hierarchy(spark.createDataFrame([(i, 0) for i in range(1, 20)] + [(20, 19)], "child long, parent long"))
    assert sorted((r["ancestor_id"], r["node_id"], r["distance"]) for r in H.descendant_pairs(tree).collect()) == sorted([(0, i, 1) for i in range(1, 20)] + [(0, 20, 2), (19, 20, 1)])


def test_only_cycles_and_empty(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long")
    assert sorted((r["node_id"], r["root_id"], r["depth"]) for r in H.hierarchy(loop).collect()) == [(1, 1, -1), (2, 1, -1)]
    assert H.hierarchy(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_two_parents_take_the_smaller(spark):
    df = spark.createDataFrame([(1, 3), (1, 2)], "child long, parent long")
    assert {(r["node_id"], r["root_id"]) for r in H.hierarchy(df).collect()} == {(1, 2), (2, 2)}


def test_links_need_both_ends(spark):
    n = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    e = spark.createDataFrame([(1, 2, " Inherits "), (1, 9, "inherits"), (2, 1, "calls"), (1, 2, "inherits"), (None, 1, "inherits"), (1, None, None)], "source_id long, target_id long, relation string")
    assert [tuple(r) for r in H.inherit_links(n, e).collect()] == [(1, 2)]
