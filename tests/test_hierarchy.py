import random

import pytest
from pyspark.sql import functions as F

from sedimento.operators import hierarchy as H

SCHEMA = "g string, node long, parent long, root long, size string"  # root and size clash with result columns


def frame(spark, links):
    return spark.createDataFrame([("t", n, p, 5, "x") for n, p in links], SCHEMA)


def brute(links):
    parent = {}
    for n, p in links:
        if n is not None:
            parent[n] = min((x for x in (p, parent.get(n)) if x is not None), default=None)
    out = {}
    for n in parent:
        seen, x = [], n
        while parent.get(x) in parent and parent.get(x) is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        out[n] = (min(seen[seen.index(x) :]), -1) if x in seen else (x, len(seen))
    return parent, out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_against_brute_force(spark, seed):
    r = random.Random(seed)
    links = [(i, r.choice([None, i - 1, r.randrange(1, 90), r.randrange(1, 60), 10_000])) for i in range(1, 80)]
    links += [(None, 3), (7, None), links[9]]
    parent, want = brute(links)
    rows = H.hierarchy(frame(spark, links)).collect()
    assert {x.node: (x.root, x.depth) for x in rows} == want
    assert len(rows) == len(want)
    placed = {x.node: x for x in rows if x.depth >= 0}
    for v, x in placed.items():
        below = {u for u, y in placed.items() if y.root == x.root and x.pre < y.pre <= x.pre + x.size - 1}
        chain = lambda u: [u] + (chain(parent[u]) if parent[u] in parent and parent[u] is not None else [])
        assert below == {u for u in placed if u != v and v in chain(u)}


def test_paths_and_descendants(spark):
    placed = H.hierarchy(frame(spark, [(1, None), (2, 1), (3, 2), (4, 1), (5, 4), (6, 5), (8, 9), (9, 8)]))
    steps = {}
    for x in H.paths(placed).collect():
        steps.setdefault(x.node, {})[x.step] = x.ancestor
    assert [steps[6][k] for k in range(4)] == [1, 4, 5, 6]
    assert 8 not in steps
    below = {(x.node, x.descendant, x.distance) for x in H.descendants(placed).collect()}
    assert (1, 6, 3) in below and (4, 6, 2) in below and (6, 1, 3) not in below
    assert {(x.node, x.root, x.depth) for x in placed.where("depth < 0").collect()} == {(8, 8, -1), (9, 8, -1)}


def test_descendants_by_interval(spark):
    r = random.Random(3)
    links = [(i, None if i % 200 == 1 else r.randrange((i - 1) // 200 * 200 + 1, i)) for i in range(1, 401)] + [(500, 501), (501, 500)]
    placed = H.hierarchy(frame(spark, links))
    rows = [(x.node, x.descendant) for x in H.descendants_by_interval(placed).collect()]
    assert len(rows) == len(set(rows)) > 400 and set(rows) == {(x.node, x.descendant) for x in H.descendants(placed).collect()}


def test_long_chain_star_and_tail_into_a_cycle(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 301)]
    star = [(1000 + i, 1) for i in range(200)]
    tail = [(5000, 5001), (5001, 5002), (5002, 5003), (5003, 5002), (6000, 6000)]
    got = {x.node: (x.root, x.depth) for x in H.hierarchy(frame(spark, chain + star + tail), intervals=False).collect()}
    assert got[300] == (1, 299) and got[1100] == (1, 1)
    assert got[5000] == got[5001] == got[5003] == (5002, -1) and got[6000] == (6000, -1)


def test_empty(spark):
    assert H.hierarchy(frame(spark, [(1, None)]).where("false")).collect() == []
    assert [(x.root, x.depth) for x in H.hierarchy(frame(spark, [(1, None), (2, 77)])).orderBy("node").collect()] == [(1, 0), (2, 0)]
    assert H.hierarchy(frame(spark, [(2, 77)])).select(F.col("size")).first()[0] == 1


def test_hot_parents_and_many_partitions(spark, monkeypatch):
    """A parent of many children, one long chain and a cycle with tails, with bounds so low that all of it is spread."""
    monkeypatch.setattr(H, "HOT_ROWS", 12)
    monkeypatch.setattr(H, "ROWS_A_TASK", 40)
    links = [(1, None)] + [(i, 1) for i in range(2, 60)] + [(i, i - 1) for i in range(101, 140)] + [(100, 1), (201, 203), (202, 201), (203, 202)] + [(i, 201 + i % 3) for i in range(210, 240)]
    _, want = brute(links)
    rows = H.hierarchy(frame(spark, links), intervals=False).collect()
    assert {x.node: (x.root, x.depth) for x in rows} == want and len(rows) == len(want)
