"""Queries over graphs and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graphs as G
from millrace.operators import linalg as L
from millrace.plans.registry import query, r6

_E = "e AS MATERIALIZED (SELECT o_custkey AS src, (o_orderkey * 7) % (SELECT count(*) FROM customer) AS dst, CAST(min(1 + o_orderkey % 9) AS DOUBLE) AS weight FROM orders GROUP BY 1, 2)"


def whole_orders(t):
    """Every order: an edge from its customer to the customer that its key falls on."""
    n = t.customer.count()
    return t.orders.groupBy(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % F.lit(n)).alias("dst")).agg(F.min(1 + F.col("o_orderkey") % 9).cast("double").alias("weight"))


_BFS = f"WITH RECURSIVE {_E}, b(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 40) SELECT node, min(depth) AS depth FROM b GROUP BY 1"


@query("G01_bfs_levels", _BFS)
def g01(t):
    return G.bfs(G.cut(whole_orders(t)), 0)


@query("G02_bfs_level_sizes", f"SELECT depth, count(*) AS n FROM ({_BFS}) GROUP BY 1")
def g02(t):
    return G.bfs(G.cut(whole_orders(t)), 0).groupBy("depth").agg(F.count("*").alias("n"))


def _unrolled(first: str, step: str, rounds: int, last: str) -> str:
    """A chain of materialised common table expressions; ``step`` and ``last`` name the one before as {p}."""
    parts = [f"d0 AS MATERIALIZED ({first})"]
    parts += [f"d{k} AS MATERIALIZED ({step.format(p=f'd{k - 1}')})" for k in range(1, rounds + 1)]
    return f"WITH {_E}, n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), " + ", ".join(parts) + " " + last.format(p=f"d{rounds}")


@query("G03_shortest_paths", _unrolled("SELECT CAST(0 AS BIGINT) AS node, 0.0::DOUBLE AS distance", "SELECT node, min(distance) AS distance FROM (SELECT * FROM {p} UNION ALL SELECT dst, distance + weight FROM {p} JOIN e ON src = node) GROUP BY 1", 45, "SELECT node, distance FROM {p}"))
def g03(t):
    return G.shortest_paths(G.cut(whole_orders(t)), 0)


@query("G04_min_plus_step", f"WITH {_E}, x AS (SELECT node, CAST(node % 7 AS DOUBLE) AS d FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)) SELECT x.node, least(x.d, coalesce(min(y.d + weight), 1e9)) AS d FROM x LEFT JOIN e ON dst = x.node LEFT JOIN x y ON y.node = src GROUP BY x.node, x.d")
def g04(t):
    return _min_plus_step(G.cut(whole_orders(t)))


def _min_plus_step(e):
    x = G._nodes(e).withColumn("d", (F.col("node") % 7).cast("double"))
    offers = e.join(x, e.src == x.node).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("d") + F.col("weight")).alias("o"))
    return x.join(offers, "node", "left").select("node", F.least("d", F.coalesce("o", F.lit(1e9))).alias("d"))


_SOLD = "e AS MATERIALIZED (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


@query(
    "G06_all_pairs",
    f"WITH {_SOLD}, d0 AS MATERIALIZED (SELECT src, dst, min(weight) AS distance FROM e WHERE src <> dst GROUP BY 1, 2), "
    + ", ".join(f"d{k} AS MATERIALIZED (SELECT src, dst, min(distance) AS distance FROM (SELECT * FROM d{k - 1} UNION ALL SELECT a.src, b.dst, a.distance + b.distance FROM d{k - 1} a JOIN d{k - 1} b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY 1, 2)" for k in range(1, 6))
    + " SELECT src, dst, round(distance, 4) AS distance FROM d5",
)
def g06(t):
    """Nations, joined by all that is sold from one to another; an edge weighs its quantity."""
    sold = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    nation = lambda c: F.col(c).cast("bigint")
    made = G.all_pairs(sold.groupBy(nation("s_nationkey").alias("src"), nation("c_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("weight")))
    return made.select("src", "dst", r6(F.col("distance"), 4).alias("distance"))


def _pagerank_sql(rounds: int) -> str:
    first = "SELECT node, 1.0 / (SELECT count(*) FROM n) AS rank FROM n"
    step = "SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(g, 0) AS rank FROM n LEFT JOIN (SELECT dst, sum(rank / degree) AS g FROM e JOIN (SELECT src AS s, count(*) AS degree FROM e GROUP BY 1) ON s = src JOIN {p} ON node = src GROUP BY 1) ON dst = n.node"
    return _unrolled(first, step, rounds, "SELECT node, round(rank, 9) AS rank FROM {p}")


@query("G07_pagerank", _pagerank_sql(20))
def g07(t):
    return G.pagerank(G.cut(whole_orders(t))).select("node", F.round("rank", 9).alias("rank"))


@query("G08_pagerank_spmv", _pagerank_sql(5))
def g08(t):
    return _spmv_ranks(G.cut(whole_orders(t)))


def _spmv_ranks(e):
    """Five rounds of rank = 0.15 / n + 0.85 M rank, M the column-stochastic matrix."""
    degree = e.groupBy("src").agg(F.count("*").alias("degree"))
    m = G.cut(e.join(degree, "src").select(F.col("dst").alias("i"), F.col("src").alias("j"), (1 / F.col("degree")).alias("v")))
    nodes = G.cut(G._nodes(e))
    n = nodes.count()
    rank = nodes.select(F.col("node").alias("i"), F.lit(1.0 / n).alias("v"))
    for _ in range(5):
        got = L.spmv(m, rank).withColumnRenamed("v", "g")
        rank = G.cut(nodes.join(got, nodes.node == got.i, "left").select(F.col("node").alias("i"), (F.lit(0.15 / n) + 0.85 * F.coalesce("g", F.lit(0.0))).alias("v")))
    return rank.select(F.col("i").alias("node"), F.round("v", 9).alias("rank"))


@query("G09_betweenness")
def g09(t):
    return G.betweenness(G.cut(whole_orders(t)), 0).select("node", r6(F.col("dependency")).alias("dependency"))


@query("G10_independent_set")
def g10(t):
    return G.independent_set(G.cut(whole_orders(t)))


@query("G11_colour_max")
def g11(t):
    return G.coloured(G.cut(whole_orders(t)))


@query("G12_colour_max_min")
def g12(t):
    return G.coloured(G.cut(whole_orders(t)), both_ends=True)


@query("G13_spanning_forest")
def g13(t):
    return G.spanning_forest(G.cut(whole_orders(t)))


@query("G14_refinement", "WITH RECURSIVE c(id, depth, value) AS (SELECT o_orderkey, 0, o_totalprice FROM orders UNION ALL SELECT id * 4 + k, depth + 1, value / 4 FROM c, (SELECT range AS k FROM range(4)) WHERE value > 40000) SELECT id, depth, value FROM c WHERE value <= 40000")
def g14(t):
    cells = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return G.refined(cells, "value", 40000.0).select("id", "depth", "value")


@query(
    "U07_components",
    f"WITH {_E}, s AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS component FROM s), "
    + ", ".join(f"d{k} AS MATERIALIZED (SELECT node, min(component) AS component FROM (SELECT * FROM d{k - 1} UNION ALL SELECT dst, component FROM d{k - 1} JOIN s ON src = node) GROUP BY 1)" for k in range(1, 31))
    + " SELECT node, component FROM d30",
)
def u07(t):
    return G.connected_components(G.cut(whole_orders(t)))


_M = "m AS (SELECT l_partkey % 200 AS i, l_suppkey % 50 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(t):
    return t.lineitem.groupBy((F.col("l_partkey") % 200).alias("i"), (F.col("l_suppkey") % 50).alias("j")).agg(F.sum("l_quantity").alias("v"))


def _vector(t, n):
    return t.spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 5 + 1.0).alias("v"))


@query("G15_spmv", f"WITH {_M} SELECT i, round(sum(v * (j % 5 + 1)), 2) AS v FROM m GROUP BY 1")
def g15(t):
    return L.spmv(_matrix(t), _vector(t, 50)).select("i", r6(F.col("v"), 2).alias("v"))


@query("G16_gemm", f"WITH {_M} SELECT i, j, round(sum(v), 1) AS v FROM (SELECT a.i, b.i AS j, 0.5 * a.v * b.v AS v FROM m a JOIN m b ON a.j = b.j UNION ALL SELECT i, j, 2 * v FROM m) GROUP BY 1, 2")
def g16(t):
    m = G.cut(_matrix(t))
    return L.gemm(m, L.transposed(m), m, 0.5, 2.0).select("i", "j", r6(F.col("v"), 1).alias("v"))


@query("G17_atax", f"WITH {_M}, y AS (SELECT i, sum(v * (j % 5 + 1)) AS y FROM m GROUP BY 1) SELECT j AS i, round(sum(v * y), 1) AS v FROM m JOIN y USING (i) GROUP BY 1")
def g17(t):
    m = G.cut(_matrix(t))
    return L.atax(m, _vector(t, 50)).select("i", r6(F.col("v"), 1).alias("v"))


@query("G17_syrk", f"WITH {_M} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 1) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2")
def g17b(t):
    return L.syrk(G.cut(_matrix(t))).select("i", "j", r6(F.col("v"), 1).alias("v"))


@query("G17_gesummv", f"WITH {_M} SELECT i, round(sum(v * (j % 5 + 1)) * 2.5, 2) AS v FROM m GROUP BY 1")
def g17c(t):
    m = G.cut(_matrix(t))
    return L.gesummv(m, m, _vector(t, 50), 1.5, 1.0).select("i", r6(F.col("v"), 2).alias("v"))


@query("G19_nearest_centre", "WITH d AS (SELECT a.vec_id, c.vec_id AS centre, list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS d2 FROM embeddings a CROSS JOIN embeddings c WHERE c.vec_id < 10) SELECT vec_id, arg_min(centre, (d2, centre)) AS centre, round(min(d2), 6) AS d2 FROM d GROUP BY 1")
def g19(t):
    centres = t.embeddings.where("vec_id < 10").select(F.col("vec_id").alias("centre"), F.col("embedding").alias("position"))
    return L.nearest_centre(t.embeddings, centres, "vec_id", "embedding").select("vec_id", "centre", r6(F.col("d2")).alias("d2"))


@query("G20_kmeans")
def g20(t):
    """Sizes and mean squared distances of five clusters at convergence."""
    _, assigned = L.kmeans(t.embeddings, "vec_id", "embedding", 5)
    return assigned.groupBy("centre").agg(F.count("*").alias("n"), r6(F.avg("d2")).alias("d2"))


@query("G21_opening_gain", "WITH d AS (SELECT a.vec_id, c.vec_id AS centre, list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS d2 FROM embeddings a CROSS JOIN embeddings c WHERE c.vec_id < 6) SELECT round(sum(greatest(0, m - x)) - 5, 6) AS gain FROM (SELECT vec_id, min(d2) FILTER (WHERE centre < 5) AS m, min(d2) FILTER (WHERE centre = 5) AS x FROM d GROUP BY 1)")
def g21(t):
    centre = lambda c: t.embeddings.where(c).select(F.col("vec_id").alias("centre"), F.col("embedding").alias("position"))
    now = L.nearest_centre(t.embeddings, centre("vec_id < 5"), "vec_id", "embedding")
    return L.opening_gain(t.embeddings, now, "vec_id", "embedding", centre("vec_id = 5"), 5.0).select(r6(F.col("gain")).alias("gain"))


@query(
    "G22_block_match",
    """WITH c AS (SELECT event_id // 16 AS block, event_id AS pos, CAST(floor(value) AS BIGINT) AS v FROM events), f AS (SELECT block, count(*) AS size FROM c GROUP BY 1),
       s AS (SELECT block, shift, sum(abs(c.v - r.v)) AS sad, count(*) AS n FROM c CROSS JOIN (SELECT range - 4 AS shift FROM range(9)) JOIN (SELECT pos, v FROM c) r ON r.pos = c.pos + shift + 3 GROUP BY 1, 2)
       SELECT block, arg_min(shift, (sad, abs(shift), shift)) AS shift, CAST(min(sad) AS BIGINT) AS sad FROM s JOIN f USING (block) WHERE n = size GROUP BY 1""",
)
def g22(t):
    """All events are blocks and reference."""
    value = F.floor("value").cast("bigint")
    current = t.events.select(F.floor(F.col("event_id") / 16).alias("block"), F.col("event_id").alias("pos"), value.alias("v"))
    reference = t.events.select((F.col("event_id") - 3).alias("pos"), value.alias("v"))
    return L.block_match(current, reference, 4).select("block", F.col("shift").cast("bigint").alias("shift"), "sad")


@query("G23_triad", "SELECT l_orderkey, l_linenumber, round(l_quantity + 3.0 * l_tax, 6) AS v FROM lineitem")
def g23(t):
    return L.triad(t.lineitem, "l_quantity", "l_tax", 3.0, "v").select("l_orderkey", "l_linenumber", r6(F.col("v")).alias("v"))


@query("G05_convergence_test", "SELECT count(*) = 0 AS settled FROM orders a JOIN orders b USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice")
def g05(t):
    b = t.orders.select("o_orderkey", F.col("o_totalprice").alias("_new"))
    return t.orders.join(b, "o_orderkey").where("o_totalprice <> _new").limit(1).agg((F.count("*") == 0).alias("settled"))


@query("G18_solve")
def g18(t):
    """x of A x = b for the small system A = M'M + I, b = 1."""
    m = G.cut(_matrix(t))
    normal = L.gemm(L.transposed(m), m).unionByName(t.spark.range(50).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    ones = t.spark.range(50).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    x = L.solved(normal, ones, 50)
    return t.spark.createDataFrame([(k, round(float(v), 9)) for k, v in enumerate(x)], "i long, x double")


@query("G25_matching")
def g25(t):
    """Brands matched to sizes of their parts."""
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
    pairs = L.bipartite_matching(t.part.select(brand.alias("src"), F.col("p_size").cast("bigint").alias("dst")))
    return t.spark.createDataFrame(sorted(pairs.items()), "src long, dst long")


@query("E08_least_squares")
def e08(t):
    m = G.cut(_matrix(t))
    x = L.least_squares(m, _vector(t, 200), 200, 50, low=0.0)
    return t.spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(x)], "j long, x double")
