"""Graph algorithms as loops over DataFrames.

A graph is a DataFrame of edges (src, dst[, weight]).  Every round writes its
state to the shared folder, so plans do not grow and a lost executor costs one
round; rounds end by a convergence test and by a hard bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.iterate import cut, settled


def bfs(edges: DataFrame, source, max_depth: int = 10_000) -> DataFrame:
    """(node, depth) of every node reachable from ``source``; RuntimeError if any may be beyond ``max_depth``."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    seen = spark.createDataFrame([(source, 0)], "node long, depth int").withColumn("node", F.col("node").cast(kind))
    frontier = seen
    for depth in range(1, max_depth + 1):
        nxt = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("bfs: not settled")


def shortest_paths(edges: DataFrame, source, max_rounds: int = 100) -> DataFrame:
    """(node, distance) by relaxation until nothing changes; needs a graph without negative cycles (else RuntimeError)."""
    kind = edges.schema["src"].dataType
    dist = edges.sparkSession.createDataFrame([(source, 0.0)], "node long, distance double").withColumn("node", F.col("node").cast(kind))
    frontier = dist
    for _ in range(max_rounds):
        offers = frontier.join(edges, frontier.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        better = cut(offers.join(dist, "node", "left").where(F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).select("node", F.col("offer").alias("distance")))
        if not better.take(1):
            return dist
        dist = cut(dist.join(better.select("node"), "node", "left_anti").unionByName(better))
        frontier = better
    raise RuntimeError("shortest_paths: not settled")


def all_pairs(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(src, dst, distance) by min-plus squaring: the logarithm of the longest path in rounds (small graphs: the result has a row for each connected pair)."""
    paths = cut(edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("distance")).where("src <> dst"))
    for _ in range(max_rounds):
        a = paths.select(F.col("src"), F.col("dst").alias("mid"), F.col("distance").alias("d1"))
        b = paths.select(F.col("src").alias("mid"), F.col("dst"), F.col("distance").alias("d2"))
        longer = a.join(b, "mid").where("src <> dst").select("src", "dst", (F.col("d1") + F.col("d2")).alias("distance"))
        new = cut(paths.unionByName(longer).groupBy("src", "dst").agg(F.min("distance").alias("distance")))
        if settled(paths, new, ["src", "dst", "distance"]):
            return new
        paths = new
    raise RuntimeError("all_pairs: not settled")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; the mass of nodes without out-edges is lost."""
    nodes = cut(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    out = cut(edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        sent = out.join(rank, out.src == rank.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = cut(nodes.join(sent, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return rank


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable over edges in either direction.

    Labels spread along edges and then jump to their label's label, so rounds
    grow with the logarithm of a path's length in practice.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(label, both.dst == label.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("least"))
        step = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"))
        roots = step.select(F.col("node").alias("root"), F.col("component").alias("above"))
        jumped = step.join(roots, step.component == roots.root, "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"))
        new = cut(jumped)
        if settled(label, new, ["node", "component"]):
            return new
        label = new
    raise RuntimeError("connected_components: not settled")


def independent_set(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, chosen) of a maximal independent set: in each round the undecided nodes with the least hash among undecided neighbours are chosen and their neighbours dropped."""
    both = cut(_undirected(edges))
    left = cut(_nodes(edges).withColumn("v", F.struct(F.xxhash64("node"), "node")))
    chosen = None
    for _ in range(max_rounds):
        if not left.take(1):
            return _nodes(edges).join(chosen, "node", "left").select("node", F.coalesce("chosen", F.lit(False)).alias("chosen"))
        least = _neighbour(both, left, F.min("v"))
        won = cut(left.join(least, "node", "left").where("other IS NULL OR v < other").select("node"))
        now = won.withColumn("chosen", F.lit(True))
        chosen = cut(now if chosen is None else chosen.unionByName(now))
        beside = both.join(won, both.dst == won.node).select(F.col("src").alias("node")).distinct()
        left = cut(left.join(won, "node", "left_anti").join(beside, "node", "left_anti"))
    raise RuntimeError("independent_set: not settled")


def coloured(edges: DataFrame, both_ends: bool = False, max_rounds: int = 200) -> DataFrame:
    """(node, colour): each round gives the undecided nodes with the largest hash among undecided neighbours the next colour; ``both_ends`` also gives those with the least one a colour of their own."""
    both = cut(_undirected(edges))
    left = cut(_nodes(edges).withColumn("v", F.struct(F.xxhash64("node"), "node")))
    done, colour = None, 0
    for _ in range(max_rounds):
        if not left.take(1):
            return done
        near = both.join(left, both.dst == left.node).groupBy(F.col("src").alias("node")).agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
        cand = left.join(near, "node", "left")
        pick = F.when(F.col("hi").isNull() | (F.col("v") > F.col("hi")), colour)
        if both_ends:
            pick = pick.when(F.col("v") < F.col("lo"), colour + 1)
        now = cut(cand.withColumn("colour", pick).where("colour IS NOT NULL").select("node", "colour"))
        done = cut(now if done is None else done.unionByName(now))
        left = cut(left.join(now, "node", "left_anti"))
        colour += 2 if both_ends else 1
    raise RuntimeError("coloured: not settled")


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest by rounds of least outgoing edges; equal weights are ordered by the ends.

    After a round components are nodes and only the least edge between two of
    them is kept, so the graph shrinks with each round.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    left = cut(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", "src", "dst").alias("e")))
    tree = None
    for _ in range(max_rounds):
        if not left.take(1):
            return tree if tree is not None else e.limit(0)
        ends = left.select(F.col("a").alias("c"), "e", F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("c"), "e", F.col("a").alias("to")))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e"))
        now = best.select("e.*").distinct().select("src", "dst", "weight")
        tree = cut(now if tree is None else tree.unionByName(now))
        label = _roots(best)
        a = label.select(F.col("c").alias("a"), F.col("root").alias("ra"))
        b = label.select(F.col("c").alias("b"), F.col("root").alias("rb"))
        met = left.join(a, "a").join(b, "b").where("ra <> rb")
        left = cut(met.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")))
    raise RuntimeError("spanning_forest: not settled")


def _roots(best: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(c, root) of trees given by (c, to), whose only cycles are two nodes that name each other: the lesser is the root, and paths are halved each round."""
    up = best.select("c", F.col("to").alias("root"))
    mutual = best.select(F.col("to").alias("c"), F.col("c").alias("root"), F.lit(True).alias("both"))
    label = cut(up.join(mutual, ["c", "root"], "left").select("c", F.when(F.col("both") & (F.col("c") < F.col("root")), F.col("c")).otherwise(F.col("root")).alias("root")))
    for _ in range(max_rounds):
        above = label.select(F.col("c").alias("root"), F.col("root").alias("above"))
        new = cut(label.join(above, "root").select("c", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        label = new.select("c", "root")
        if not new.where("moved").take(1):
            return label
    raise RuntimeError("spanning_forest: not settled")


def betweenness(edges: DataFrame, source, max_depth: int = 10_000) -> DataFrame:
    """(node, dependency) of one source: path counts forward by level, dependencies backward."""
    levels = cut(bfs(edges, source, max_depth))
    up = levels.select(F.col("node").alias("src"), F.col("depth").alias("d1"))
    down = levels.select(F.col("node").alias("dst"), F.col("depth").alias("d2"))
    tree = cut(edges.select("src", "dst").distinct().join(up, "src").join(down, "dst").where("d2 = d1 + 1"))
    top = levels.agg(F.max("depth")).first()[0]
    paths = levels.where("depth = 0").select("node", F.lit(1.0).alias("paths"))
    for d in range(top):
        step = tree.where(F.col("d1") == d).join(paths, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        paths = cut(paths.unionByName(step))
    dep = cut(levels.where(F.col("depth") == top).select("node", F.lit(0.0).alias("dependency")))
    for d in range(top - 1, -1, -1):
        p1 = paths.select(F.col("node").alias("src"), F.col("paths").alias("p1"))
        p2 = paths.select(F.col("node").alias("dst"), F.col("paths").alias("p2"))
        got = tree.where(F.col("d1") == d).join(p1, "src").join(p2, "dst").join(dep.select(F.col("node").alias("dst"), "dependency"), "dst")
        got = got.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("p1") / F.col("p2") * (1 + F.col("dependency"))).alias("dependency"))
        here = levels.where(F.col("depth") == d).select("node").join(got, "node", "left").na.fill(0.0, ["dependency"])
        dep = cut(dep.unionByName(here))
    return dep


def refined(cells: DataFrame, value: str, threshold: float, parts: int = 4, max_depth: int = 64) -> DataFrame:
    """Cells (id, depth, value) split into ``parts`` of value / parts while the value is above the threshold (RuntimeError if it still is after ``max_depth`` rounds)."""
    open_, done = cut(cells.withColumn("depth", F.lit(0))), None
    for _ in range(max_depth):
        ready = open_.where(F.col(value) <= threshold)
        done = cut(ready if done is None else done.unionByName(ready))
        more = open_.where(F.col(value) > threshold)
        open_ = cut(more.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("id", F.col("id") * parts + F.col("_k")).withColumn(value, F.col(value) / parts).withColumn("depth", F.col("depth") + 1).drop("_k"))
        if not open_.take(1):
            return done
    raise RuntimeError("refined: not settled")


def _undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def _neighbour(both: DataFrame, state: DataFrame, what) -> DataFrame:
    return both.join(state, both.dst == state.node).groupBy(F.col("src").alias("node")).agg(what.alias("other"))
