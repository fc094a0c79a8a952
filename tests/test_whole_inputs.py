"""Queries over whole tables, against brute force."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from conftest import TESTDATA

from millrace.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def graph(duck):
    """(src, dst): weight of every order."""
    [(n,)] = duck.sql("SELECT count(*) FROM customer").fetchall()
    made = {}
    for c, o in duck.sql("SELECT o_custkey, o_orderkey FROM orders").fetchall():
        e = (c, o * 7 % n)
        made[e] = min(made.get(e, 99.0), 1.0 + o % 9)
    assert len(made) > 1000
    return made


def _rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, TESTDATA).collect()]


def _depths(graph):
    depth, level = {0: 0}, {0}
    while level:
        level = {b for a, b in graph if a in level} - depth.keys()
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    return depth


def test_levels_of_all_orders(spark, graph):
    depth = _depths(graph)
    sizes, pushed = defaultdict(int), defaultdict(set)
    for d in depth.values():
        sizes[d] += 1
    for a, b in graph:
        if a in depth:
            pushed[depth[a]].add(b)
    assert dict(_rows(spark, "G01_bfs_levels")) == depth
    assert dict(_rows(spark, "G02_bfs_level_sizes")) == sizes
    assert dict(_rows(spark, "G26_frontier_sizes")) == {d: len(x) for d, x in pushed.items()}
    assert {r[0] for r in _rows(spark, "G09_betweenness")} == depth.keys()


def test_distances_of_all_orders(spark, graph):
    far = {0: 0.0}
    for _ in graph:
        new = far | {}
        for (a, b), w in graph.items():
            if a in far:
                new[b] = min(new.get(b, math.inf), far[a] + w)
        if new == far:
            break
        far = new
    assert dict(_rows(spark, "G03_shortest_paths")) == far
    step = {x: float(x % 7) for e in graph for x in e}
    for (a, b), w in graph.items():
        step[b] = min(step[b], a % 7 + w)
    assert dict(_rows(spark, "G04_min_plus_step")) == step


@pytest.mark.parametrize(("name", "rounds"), [("G07_pagerank", 20), ("G08_pagerank_spmv", 5)])
def test_ranks_of_all_orders(spark, graph, name, rounds):
    nodes, out = {x for e in graph for x in e}, defaultdict(int)
    for a, _ in graph:
        out[a] += 1
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, b in graph:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    made = dict(_rows(spark, name))
    assert made.keys() == rank.keys()
    assert all(math.isclose(made[x], rank[x], abs_tol=2e-9) for x in nodes)


def test_sets_colours_and_forest_of_all_orders(spark, graph):
    nodes = {x for e in graph for x in e}
    chosen = dict(_rows(spark, "G10_independent_set"))
    assert chosen.keys() == nodes
    assert not any(chosen[a] and chosen[b] for a, b in graph if a != b)
    for name in ("G11_colour_max", "G12_colour_max_min"):
        colour = dict(_rows(spark, name))
        assert colour.keys() == nodes
        assert all(colour[a] != colour[b] for a, b in graph if a != b)
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0.0
    for (a, b), w in sorted(graph.items(), key=lambda x: x[1]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    assert sum(r[2] for r in _rows(spark, "G13_spanning_forest")) == total


def test_components_of_all_orders(spark, graph):
    least = {x: x for e in graph for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in graph:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert dict(_rows(spark, "U07_components")) == least


def test_distances_of_nations(spark, duck):
    sql = "SELECT s_nationkey, c_nationkey, sum(l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"
    far = defaultdict(lambda: math.inf) | {(a, b): float(w) for a, b, w in duck.sql(sql).fetchall() if a != b}
    nodes = sorted({x for e in far for x in e})
    for k in nodes:
        for a in nodes:
            for b in nodes:
                if a != b:
                    far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    made = {(a, b): d for a, b, d in _rows(spark, "G06_all_pairs")}
    assert made.keys() == {e for e, d in far.items() if d < math.inf}
    assert all(math.isclose(d, far[e]) for e, d in made.items())


def test_matching_of_all_parts(spark, duck):
    edges = {(int(b.split("#")[1]), s) for b, s in duck.sql("SELECT DISTINCT p_brand, p_size FROM part").fetchall()}
    held = {}

    def placed(a, seen):
        for b in {y for x, y in edges if x == a} - seen:
            seen.add(b)
            if b not in held or placed(held[b], seen):
                held[b] = a
                return True
        return False

    most = sum(placed(a, set()) for a in sorted({a for a, _ in edges}))
    made = _rows(spark, "G25_matching")
    assert set(made) <= edges
    assert len(made) == len({a for a, _ in made}) == len({b for _, b in made}) == most


def test_least_squares_of_the_whole_matrix(spark, duck):
    """At the least sum, no free entry has a slope and no entry at 0 has a falling one."""
    m = np.zeros((200, 50))
    for i, j, v in duck.sql("SELECT l_partkey % 200, l_suppkey % 50, sum(l_quantity) FROM lineitem GROUP BY ALL").fetchall():
        m[i, j] = v
    x = np.array([v for _, v in sorted(_rows(spark, "E08_least_squares"))])
    assert x.shape == (50,) and (x >= 0).all()
    right = np.arange(200) % 5 + 1.0
    slope = m.T @ (m @ x - right) / (m.T @ right).max()
    assert (slope > -1e-3).all()
    assert (np.abs(slope[x > 0]) < 1e-3).all()


def test_substrings_are_searched_in_every_page(spark, duck):
    """Beyond the pages up to 40, and the queries' own."""
    [(n,)] = duck.sql("SELECT count(*) FROM pages WHERE length(url) >= 9").fetchall()
    made = _rows(spark, "J17_substring_matches")
    assert max(r[1] for r in made) >= 40
    assert {(q, q) for q in range(12)} <= {r[:2] for r in made}
    assert len({r[1] for r in made}) <= n


def test_blocks_of_all_events(spark, duck):
    [(n,)] = duck.sql("SELECT max(event_id) // 16 FROM events").fetchall()
    assert {r[0] for r in _rows(spark, "G22_block_match")} >= set(range(1, n - 1))


def test_cycles_of_all_parts(spark):
    """sf0.01 has parts beyond 300."""
    folder = TESTDATA.replace("sf0.001", "sf0.01")
    n = spark.read.parquet(f"{folder}/part.parquet").count()
    assert n > 300
    assert QUERIES["S11_profiler_cycles"](spark, folder).count() == n
