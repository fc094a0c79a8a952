"""Operators without a SQL twin against models, and edge cases of the others."""

from __future__ import annotations

import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import alignment
from millrace.operators import aggregates as A
from millrace.operators import graphs as G
from millrace.operators import linalg as L
from millrace.operators import relational as R
from millrace.operators import windows as W
from millrace.sources import sinks, text, trace
from millrace.streaming import streams as S


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(55)})
    edges = [(a, b, float(rng.randrange(1, 9))) for a, b in rows]
    return edges, spark.createDataFrame(edges, "src long, dst long, weight double")


def _undirected(edges):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def test_independent_set_is_maximal(graph):
    edges, df = graph
    near = _undirected(edges)
    chosen = {r.node for r in G.independent_set(df).collect() if r.chosen}
    assert all(not (near[a] & chosen) for a in chosen)
    assert all(a in chosen or near[a] & chosen for a in near)


@pytest.mark.parametrize("both_ends", [False, True])
def test_colouring_is_proper(graph, both_ends):
    edges, df = graph
    colour = {r.node: r.colour for r in G.coloured(df, both_ends).collect()}
    assert set(colour) == set(_undirected(edges))
    assert all(colour[a] != colour[b] for a, b, _ in edges if a != b)


def test_spanning_forest_weight(graph):
    edges, df = graph
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    total, n = 0.0, 0
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total, n = total + w, n + 1
    made = G.spanning_forest(df).collect()
    assert len(made) == n
    assert sum(r.weight for r in made) == total


def test_betweenness_against_counting(graph):
    edges, df = graph
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
    depth, paths, level = {0: 0}, {0: 1.0}, [0]
    order = [0]
    while level:
        nxt = []
        for a in level:
            for b in near.get(a, ()):
                if b not in depth:
                    depth[b] = depth[a] + 1
                    nxt.append(b)
                if depth[b] == depth[a] + 1:
                    paths[b] = paths.get(b, 0) + paths[a]
        order += nxt
        level = nxt
    dep = dict.fromkeys(depth, 0.0)
    for a in reversed(order):
        for b in near.get(a, ()):
            if depth.get(b) == depth[a] + 1:
                dep[a] += paths[a] / paths[b] * (1 + dep[b])
    got = {r.node: r.dependency for r in G.betweenness(df, 0).collect()}
    assert got.keys() == dep.keys()
    assert all(math.isclose(got[k], dep[k], abs_tol=1e-9) for k in dep)


def test_bfs_follows_a_long_path_or_raises(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(55)], "src long, dst long")
    assert {(r.node, r.depth) for r in G.bfs(df, 0).collect()} == {(k, k) for k in range(56)}
    with pytest.raises(RuntimeError):
        G.bfs(df, 0, max_depth=3)
    with pytest.raises(RuntimeError):
        G.betweenness(df, 0, max_depth=3)


def test_refined_raises_where_cells_stay_above(spark):
    df = spark.createDataFrame([(0, 100.0)], "id long, value double")
    assert {r.value for r in G.refined(df, "value", 2.0).collect()} == {100.0 / 64}
    with pytest.raises(RuntimeError):
        G.refined(df, "value", 2.0, max_depth=2)


def test_shortest_paths_of_a_negative_cycle_end(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, weight double")
    with pytest.raises(RuntimeError):
        G.shortest_paths(df, 0, max_rounds=4)


def test_kmeans_keeps_an_empty_cluster_and_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [10.0]), (3, [11.0])], "id long, v array<double>")
    centres, assigned = L.kmeans(df, "id", "v", 3)
    assert {r.id: r.centre for r in assigned.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert {r.centre: r.position for r in centres.collect()} == {0: [0.0], 1: [0.0], 2: [10.5]}


def test_small_factorisations(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6)) + 6 * np.eye(6)
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i)) for i in range(6)], "i long, v double")
    assert np.allclose(a @ L.solved(df, b, 6), np.arange(6))
    low, up = L.lu(df, 6)
    assert np.allclose(low @ up, a)
    q, r = L.gram_schmidt(df, 6, 6)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(6))
    x = L.least_squares(df, b, 6, 6, low=0.0)
    free = np.linalg.solve(a, np.arange(6))
    assert (x >= 0).all() and np.linalg.norm(a @ x - np.arange(6)) <= np.linalg.norm(a @ np.maximum(free, 0) - np.arange(6)) + 1e-9


def test_matching_is_largest(spark):
    edges = [(0, 0), (0, 1), (1, 0), (2, 1), (2, 2), (3, 2), (4, 2)]
    made = L.bipartite_matching(spark.createDataFrame(edges, "src long, dst long"))
    assert len(made) == 3 and len(set(made.values())) == 3 and all((a, b) in edges for a, b in made.items())


def _align(a, b, match, mismatch, gap, local):
    t = [[0 if local else (i + j) * gap for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        t[i][j] = max(t[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), t[i - 1][j] + gap, t[i][j - 1] + gap, *([0] if local else []))
    return max(map(max, t)) if local else t[-1][-1]


def test_alignment_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        for local in (False, True):
            assert alignment._score(a, b, 2, -1, -2, local) == _align(a, b, 2, -1, -2, local), (a, b, local)


def test_percentile_rule(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0), *[("c", float(x)) for x in (5, 1, 4, 2, 3)], ("c", None)], "k string, v double")
    at = lambda q: {r.k: r.percentile for r in A.percentile_n_plus_1(df, ["k"], "v", q).collect()}
    assert at(50) == {"a": 3.0, "b": 1.5, "c": 3.0}
    assert at(75) == {"a": 3.0, "b": 1.75, "c": 4.5}
    assert at(100) == {"a": 3.0, "b": 2.0, "c": 5.0}
    assert at(0) == {"a": 3.0, "b": 1.0, "c": 1.0}


def test_join_edges(spark):
    left = spark.createDataFrame([(0, 5), (1, 5), (2, 7), (3, None)], "id long, key long")
    right = spark.createDataFrame([(0, 5), (1, 5), (2, None)], "r long, key long")
    for skewed in (False, True):
        assert sorted((x.id, x.r) for x in R.equi_join(left, right, "key", skewed=skewed).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    records = spark.createDataFrame([(k, k * 2) for k in range(5)], "idx long, key long")
    asked = spark.createDataFrame([(0, 2, 6), (1, 2, 5), (2, 4, 4), (3, 6, 2)], "qid long, lo long, hi long")
    assert sorted(map(tuple, R.range_lookup(records, asked, "idx", "key", "qid", "lo", "hi").collect())) == [(0, 1, 3), (1, None, None), (2, 2, 1), (3, None, None)]


def test_duplicate_stat_and_override(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    b = spark.createDataFrame([("x", 9), ("z", 3)], "k string, v long")
    assert dict(R.first_wins([a, b], ["k"], "v").collect()) == {"x": 1, "y": 2, "z": 3}
    assert dict(R.later_wins([a, b], ["k"], "v").collect()) == {"x": 9, "y": 2, "z": 3}
    with pytest.raises(Exception, match="several values"):
        R.single_valued(a, "v").collect()


def test_runs_of_nulls_and_singletons(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, None, 1, 1, 2, None])], "g string, k long, v long")
    made = [(r.run, r.v, r.length) for r in W.runs(df, ["k"], "v", ["g"]).orderBy("run").collect()]
    assert made == [(1, None, 2), (2, 1, 2), (3, 2, 1), (4, None, 1)]


def test_log2_and_threshold_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 65535, 65536)], "v long")
    assert [r[0] for r in df.select(A.bin_log2(F.col("v"))).collect()] == [0, 1, 2, 2, 16, 17]
    df = spark.createDataFrame([(v,) for v in (5, 6, 200, 201)], "v long")
    assert [r[0] for r in df.select(A.bin_thresholds(F.col("v"))).collect()] == ["<=5", "<=10", "<=200", ">200"]


def _field(n, value):
    if isinstance(value, int):
        out, value = bytearray([n << 3]), value & (1 << 64) - 1
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes(out + bytes([value]))
    return bytes([n << 3 | 2]) + _field(0, len(value))[1:] + value


def test_trace_scan_round_trip(spark, tmp_path):
    address = _field(1, 4) + _field(4, 1 << 40) + _field(5, -8) + _field(6, _field(0, 3)[1:] + _field(0, -1)[1:])
    ins = _field(1, 16) + _field(2, 4294967295) + _field(3, 7) + _field(4, -2) + _field(5, address)
    warp = _field(1, 3) + _field(2, ins) + _field(2, _field(1, 32))
    (tmp_path / "b.bin").write_bytes(_field(1, _field(1, 5) + _field(3, 1)) + _field(2, _field(1, 3) + _field(2, warp)))
    rows = trace.read_blocks(spark, str(tmp_path / "*.bin")).orderBy("seq").collect()
    assert [(r.warp, r.seq, r.pc, r.active_mask, r.predicate_mask, r.function_unique_id) for r in rows] == [(3, 0, 16, 4294967295, 7, -2), (3, 1, 32, 0, 0, 0)]
    assert tuple(rows[0].block) == (5, 0, 1)
    a = rows[0].addresses[0]
    assert (a.data_width, a.base_address, a.stride, a.addrs) == (4, 1 << 40, -8, [3, -1])
    with pytest.raises(ValueError):
        list(trace.fields(struct.pack("B", 0x0A) + b"\x05ab"))


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("-key 1\nother\n-flag\n")
    rows = text.lines(spark, str(tmp_path / "a.txt"))
    assert [(r.no, r.line) for r in rows.orderBy("no").collect()] == [(0, "-key 1"), (1, "other"), (2, "-flag")]
    assert sorted((r.key, r.value) for r in text.settings(rows).collect()) == [("-flag", None), ("-key", "1")]
    with pytest.raises(Exception, match="not a kernel list line"):
        text.kernel_list(rows).collect()
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    sinks.write_grouped(df.withColumn("w", F.lit(0)).withColumn("seq", F.lit(0)), str(tmp_path / "g"), "k", "w", "seq")
    assert spark.read.json(str(tmp_path / "g")).count() == 2
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    sinks.discard(df)


def test_app_suites(spark):
    made = text.app_suites("one:\n  execs:\n    - a: ['-x 1', 2]\n    - b:\ntwo:\n", spark)
    assert {tuple(r) for r in made.collect()} == {("one", "a", "-x 1"), ("one", "a", "2"), ("one", "b", None)}


def test_scheduling_prefers_the_open_row(spark):
    rows = [("a", 0, 1, 5), ("a", 0, 2, 6), ("a", 0, 3, 5), ("a", 50, 4, 6)]
    df = spark.createDataFrame(rows, "bank string, at long, idx long, row long")
    made = {r.idx: r.served for r in S.first_ready_first_come(df, "bank", "at", "idx", "row", 2, 9).collect()}
    assert made == {1: 9, 3: 11, 2: 20, 4: 52}


def test_polling_ends(spark):
    busy = spark.createDataFrame([("running",)], "status string")
    with pytest.raises(TimeoutError):
        S.polled(spark, lambda: busy, every_seconds=0.01, timeout=0.05)


def test_spanning_forest_shrinks_its_graph(spark, monkeypatch):
    """A long chain and ties: the very edges of Kruskal's order, without labelling the whole forest anew each round."""
    monkeypatch.delattr(G, "connected_components")
    edges = [(k, k + 1, float(k)) for k in range(70)] + [(100 + a, 100 + b, 1.0) for a in range(6) for b in range(a)] + [(7, 7, 0.0)]
    made = {tuple(r) for r in G.spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert made == {(k, k + 1, float(k)) for k in range(70)} | {(100, 100 + k, 1.0) for k in range(1, 6)}


def test_idle_attribution_meets_no_interval_with_an_amount(spark):
    """Against counting pair by pair: equal times, open ends, keys open twice, and amounts that are null or not finite."""
    rng = np.random.default_rng(2)
    starts = [(int(k), int(a)) for k, a in zip(rng.integers(0, 5, 60), rng.integers(0, 200, 60), strict=True)] + [(6, None), (7, 150)]
    ends = [(int(k), int(a)) for k, a in zip(rng.integers(0, 5, 40), rng.integers(0, 200, 40), strict=True)] + [(7, 155)]
    idle = [(int(a), float(x)) for a, x in zip(rng.integers(0, 145, 200), rng.normal(size=200).round(2), strict=True)] + [(None, 9.0), (151, None), (20, 5e11)]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    open_ = S.in_flight(df(starts, "k long, at long"), df(ends, "k long, at long"), "k", "at")
    want = {(k, a): min((e for q, e in ends if a is not None and q == k and e >= a), default=None) for k, a in starts}
    assert sorted(map(repr, ((r.k, r.opened, r.closed) for r in open_.collect()))) == sorted(repr((k, a, c)) for (k, a), c in want.items())
    for extra in ([], [(100, float("inf"))]):
        made = S.idle_attribution(df(idle + extra, "at long, amount double"), open_.select(F.col("k").alias("key"), "opened", "closed"), 32)
        total: dict = {}
        for (k, a), c in want.items():
            for t, x in idle + extra:
                if c is not None and t is not None and a <= t < c:
                    total.setdefault(k, []).append(x)
        got = {r.key: r.total for r in made.collect()}
        assert got.keys() == total.keys()
        assert got[7] is None
        for k, xs in total.items():
            known = [x for x in xs if x is not None]
            assert (got[k] is None) == (not known)
            assert not known or math.isclose(got[k], math.fsum(known), rel_tol=1e-12, abs_tol=1e-9), k
    plan = open_._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_kmeans_takes_one_pass_a_round(spark, monkeypatch):
    """Against numpy; only vectors with gaps go the way by joins."""
    x = np.random.default_rng(3).normal(size=(300, 4))
    joined, ways = L._kmeans_joined, []
    monkeypatch.setattr(L, "_kmeans_joined", lambda *a: ways.append(1) or joined(*a))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    _, assigned = L.kmeans(df, "id", "v", 3)
    c, last, label = x[:3].copy(), None, None
    while last is None or (label != last).any():
        c, last = (c if label is None else np.array([x[label == k].mean(axis=0) for k in range(3)])), label
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        last = label - 1 if last is None else last
    assert [r.centre for r in assigned.orderBy("id").collect()] == label.tolist()
    assert not ways
    L.kmeans(df.limit(6).unionByName(spark.createDataFrame([(900, None)], df.schema)), "id", "v", 2)
    assert ways == [1]


def test_pairs_histogram_of_odd_rows_without_joins(spark, monkeypatch):
    """Values on an edge, repeated and null ids, nulls, other lengths, and components that are not finite."""
    rows = [(k, [0.1 * (k % 5), 0.3, -0.2 * (k % 3)]) for k in range(40)] + [(3, [0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0]), (50, None), (51, [1.0, None, 1.0]), (52, [1.0]), (53, [0.0, 0.0, 0.0]), (54, [math.inf, 1.0, 0.0]), (55, [])]
    edges = [-0.25, 0.0, 0.09, 0.5]
    want: dict = {}
    for (i, u), (j, v) in itertools.combinations(rows, 2):
        if i is None or j is None or i == j:
            continue
        bad = u is None or v is None or len(u) != len(v) or None in u or None in v
        dot = 0.0
        for a, b in () if bad else zip(u, v, strict=True):
            dot += a * b
        k = 0 if bad else sum(math.isnan(dot) or dot >= e for e in edges)
        want[k] = want.get(k, 0) + 1
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(type(df), "join", None)  # pairs of rows are never rows themselves
    assert {r.bin: r.n for r in R.pairs_histogram(df, "id", "v", edges).collect()} == want
