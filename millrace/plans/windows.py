"""Queries over ordered operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.plans.registry import query, r6


def _events(t):
    return t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))



def _order_blocks():
    return [F.floor(F.col("o_orderkey") / 4096)]


@query("W01_prefix_sum", "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS upto, CAST(sum(o_custkey) OVER w - o_custkey AS BIGINT) AS before FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def w01(t):
    o = W.running_total(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", "upto", block=_order_blocks())
    return o.select("o_orderkey", F.col("upto").cast("bigint"), (F.col("upto") - F.col("o_custkey")).cast("bigint").alias("before"))


@query("W02_hierarchical_scan", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM orders")
def w02(t):
    o = W.running_total(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], "o_custkey", "upto", ["o_orderstatus"], _order_blocks())
    return o.select("o_orderkey", F.col("upto").cast("bigint"))


@query("W03_running_max", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS most FROM orders")
def w03(t):
    return W.scanned(t.orders, ["o_orderkey"], "most", F.max("o_totalprice"), ["o_custkey"]).select("o_orderkey", "most")


@query(
    "W04_segmented_scan",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey, seg ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS seg FROM orders)",
)
def w04(t):
    return W.segmented_total(t.orders, ["o_orderkey"], F.col("o_orderstatus") == "F", "o_totalprice", "total", ["o_custkey"]).select("o_orderkey", r6(F.col("total"), 2).alias("total"))


@query("W05_pair_collapse", "SELECT event_id, first_value FROM (SELECT event_id, lag(value) OVER w AS first_value, row_number() OVER w AS rn FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn % 2 = 0")
def w05(t):
    return W.paired(t.events.where("event_type = 'view'"), ["ts", "event_id"], "value", ["user_id"], "first_value").select("event_id", "first_value")


@query("W06_delta_encode", "SELECT o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta FROM orders")
def w06(t):
    return W.delta_encoded(t.orders, ["o_orderkey"], "o_orderkey", ["o_custkey"]).select("o_orderkey", "delta")


@query("W06_delta_round_trip", "SELECT o_custkey, o_orderkey FROM orders")
def w06b(t):
    coded = W.delta_encoded(t.orders.withColumn("seq", F.col("o_orderkey")), ["seq"], "o_orderkey", ["o_custkey"]).select("o_custkey", "seq", "delta")
    return W.delta_decoded(coded, ["seq"], "delta", ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("W07_reuse_same", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS same_distance FROM events")
def w07(t):
    return W.reuse_distance_same(_events(t), "event_type", "user_id", "at", "event_id").select("event_id", "same_distance")


@query("W08_reuse_other", "SELECT a.event_id, min(epoch_us(a.ts) - epoch_us(b.ts)) AS other_distance FROM events a LEFT JOIN events b ON a.event_type = b.event_type AND a.user_id <> b.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) GROUP BY 1")
def w08(t):
    return W.reuse_distance_other(_events(t), "event_type", "user_id", "at", "event_id").select("event_id", "other_distance")


@query(
    "W09_neighbour_minimum",
    """WITH g AS (SELECT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p, n_nationkey AS w FROM nation),
       s1 AS (SELECT p, w AS c FROM g WHERE r = 0), s2 AS (SELECT g.p, g.w + m AS c FROM g JOIN (SELECT p, min(c) OVER (ORDER BY p ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM s1) x ON g.p = x.p WHERE r = 1),
       s3 AS (SELECT g.p, g.w + m AS c FROM g JOIN (SELECT p, min(c) OVER (ORDER BY p ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM s2) x ON g.p = x.p WHERE r = 2) SELECT p, c AS cost FROM s3""",
)
def w09(t):
    grid = t.nation.select(F.col("n_regionkey").alias("r"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("bigint").alias("p"), F.col("n_nationkey").alias("w"))
    return W.neighbour_minimum(grid, "r", "p", "w", 3)


_GRID = "SELECT CAST(l_linenumber AS BIGINT) AS i, CAST(l_quantity AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"


def _grid(t):
    return t.lineitem.groupBy(F.col("l_linenumber").cast("bigint").alias("i"), F.col("l_quantity").cast("bigint").alias("j")).agg(F.count("*").cast("double").alias("v"))


def _stencil_sql(kernel, border=False):
    rows = ", ".join(f"({di}, {dj}, {c})" for (di, dj), c in kernel.items())
    body = f"WITH g AS ({_GRID}), k(di, dj, c) AS (VALUES {rows}), s AS (SELECT g.i - di AS i, g.j - dj AS j, sum(v * c) AS s, count(*) AS n FROM g CROSS JOIN k GROUP BY 1, 2) "
    return body + f"SELECT g.i, g.j, round(s.s, 4) AS v FROM g JOIN s USING (i, j) WHERE n = {len(kernel)}"


_FIVE = {(0, 0): -4.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}
_NINE = {(-1, -1): 0.2, (-1, 0): 0.5, (-1, 1): -0.8, (0, -1): -0.3, (0, 0): 0.6, (0, 1): -0.9, (1, -1): 0.4, (1, 0): 0.7, (1, 1): 0.1}


@query("W10_stencil", _stencil_sql(_FIVE))
def w10(t):
    return W.convolved(_grid(t), "i", "j", "v", _FIVE).select("i", "j", r6(F.col("v"), 4).alias("v"))


@query("W11_convolution", _stencil_sql(_NINE))
def w11(t):
    return W.convolved(_grid(t), "i", "j", "v", _NINE).select("i", "j", r6(F.col("v"), 4).alias("v"))


@query("W12_downsample", "WITH n AS (SELECT count(*) // 512 + 1 AS n FROM events) SELECT CAST(event_id // n AS BIGINT) AS bucket, round(sum(value) / max(n), 6) AS mean FROM events CROSS JOIN n GROUP BY 1")
def w12(t):
    return W.downsampled(t.events, "event_id", "value").select("bucket", r6(F.col("mean")).alias("mean"))


@query("W13_interval_snapshot", "SELECT day, event_type, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS upto FROM (SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def w13(t):
    days = t.events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return W.running_total(days, ["day"], "n", "upto", ["event_type"]).select("day", "event_type", "upto")


@query("W14_cumulative_difference", "SELECT event_id, round(c - coalesce(lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 4) AS step FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM events)")
def w14(t):
    cumulative = W.running_total(t.events, ["ts", "event_id"], "value", "c", ["user_id"])
    return W.cumulative_difference(cumulative, ["user_id"], ["ts", "event_id"], "c", "step").select("event_id", r6(F.col("step"), 4).alias("step"))


@query("W15_weighted_mean", "SELECT o_orderkey, round(sum(o_totalprice) OVER w / sum(o_custkey) OVER w, 6) AS mean FROM orders WHERE o_custkey > 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def w15(t):
    return W.weighted_running_mean(t.orders.where("o_custkey > 0"), ["o_custkey"], ["o_orderkey"], "o_totalprice", "o_custkey", "mean").select("o_orderkey", r6(F.col("mean")).alias("mean"))


@query(
    "W16_stage_durations",
    """WITH s AS (SELECT user_id, epoch_us(min(ts) FILTER (WHERE event_type = 'view')) AS a, epoch_us(min(ts) FILTER (WHERE event_type = 'click')) AS b, epoch_us(min(ts) FILTER (WHERE event_type = 'purchase')) AS c FROM events GROUP BY 1),
       l AS (SELECT user_id, 1 AS k, 'a' AS stage, a AS t FROM s WHERE c IS NOT NULL UNION ALL SELECT user_id, 2, 'b', b FROM s WHERE c IS NOT NULL UNION ALL SELECT user_id, 3, 'c', c FROM s WHERE c IS NOT NULL)
       SELECT user_id, stage, d AS duration FROM (SELECT user_id, stage, t - lag(t) OVER (PARTITION BY user_id ORDER BY k) AS d FROM l WHERE t IS NOT NULL) WHERE d IS NOT NULL""",
)
def w16(t):
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("at")))
    stages = _events(t).groupBy("user_id").agg(first("view").alias("a"), first("click").alias("b"), first("purchase").alias("c"))
    return W.stage_durations(stages, "user_id", ["a", "b", "c"], "c")


@query("W17_trial_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS BIGINT) AS trial FROM orders")
def w17(t):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", (F.row_number().over(w) - 1).cast("bigint").alias("trial"))


@query("W18_ranking", "SELECT p_partkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def w18(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).cast("bigint").alias("rank"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("bigint").alias("quarter"), r6(F.percent_rank().over(w)).alias("pr"), r6(F.cume_dist().over(w)).alias("cd"))
