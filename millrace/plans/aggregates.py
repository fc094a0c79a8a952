"""Queries over summaries, histograms, quantiles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import windows as W
from millrace.plans.registry import query, r6


@query("A01_global_sum", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def a01(t):
    return t.lineitem.agg(r6(F.sum("l_extendedprice"), 2).alias("total"))


@query("A02_partial_final", "SELECT l_suppkey, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def a02(t):
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.sum("l_quantity"), 2).alias("total"), F.count("*").alias("n"))


@query("A03_min_max", "SELECT l_returnflag, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1")
def a03(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query("A04_argmax", "SELECT o_custkey, o_totalprice, min(o_orderkey) AS o_orderkey FROM orders WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY 1) GROUP BY 1, 2")
def a04(t):
    return A.argmax(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("A04_argmin", "SELECT o_custkey, o_totalprice, min(o_orderkey) AS o_orderkey FROM orders WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, min(o_totalprice) FROM orders GROUP BY 1) GROUP BY 1, 2")
def a04b(t):
    return A.argmin(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey")


_RUNS = """WITH x AS (SELECT user_id, ts, event_id, event_type, value, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM x) """


def _event_runs(t):
    return W.runs(t.events, ["ts", "event_id"], "event_type", ["user_id"])


@query("A05_reduce_by_segment", _RUNS + "SELECT user_id, run, round(sum(value), 6) AS total FROM r GROUP BY 1, 2")
def a05(t):
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when((F.row_number().over(w) == 1) | ~F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 1).otherwise(0)
    cut = t.events.withColumn("new", new)
    cut = cut.withColumn("run", F.sum("new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    return cut.groupBy("user_id", "run").agg(r6(F.sum("value")).alias("total"))


@query("A06_run_length", _RUNS + "SELECT user_id, run, min(event_type) AS event_type, count(*) AS length FROM r GROUP BY 1, 2")
def a06(t):
    return _event_runs(t).select("user_id", "run", "event_type", "length")


@query("A07_nontrivial_runs", _RUNS + "SELECT user_id, run, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS length FROM r GROUP BY 1, 2 HAVING count(*) > 1")
def a07(t):
    return _event_runs(t).where("length > 1").select("user_id", "run", F.col("start.event_id").alias("first_id"), "length")


@query("A08_consecutive_distinct", _RUNS + "SELECT user_id, event_id, event_type FROM r WHERE new = 1")
def a08(t):
    return W.consecutive_distinct(t.events, ["ts", "event_id"], "event_type", ["user_id"]).select("user_id", "event_id", "event_type")


@query("A09_byte_histogram", "SELECT ascii(c) AS bin, count(*) AS n FROM (SELECT unnest(string_split(lang, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1")
def a09(t):
    return A.histogram(t.documents.select(F.explode(F.split("lang", "")).alias("c")).where("c <> ''"), F.ascii("c"))


@query("A10_saturating_histogram", "SELECT CAST(l_quantity AS INTEGER) AS bin, CAST(least(count(*), 255) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def a10(t):
    return A.histogram(t.lineitem, F.col("l_quantity").cast("int"), most=255)


@query("A11_log2_histogram", "SELECT CASE WHEN n_chars = 0 THEN 0 ELSE CAST(floor(log2(n_chars)) AS INTEGER) + 1 END AS bin, count(*) AS n FROM documents GROUP BY 1")
def a11(t):
    return A.histogram(t.documents, A.bin_log2(F.col("n_chars")))


@query("A12_linear_histogram", "SELECT CAST(least(floor(n_chars / 1000), 9) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def a12(t):
    return A.histogram(t.documents, A.bin_linear(F.col("n_chars"), 1000, 10))


@query("A13_clamped_histogram", "SELECT CAST(greatest(0, least(floor((c_acctbal - 1000) / 500), 15)) AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1")
def a13(t):
    return A.histogram(t.customer, A.bin_clamped(F.col("c_acctbal") - 1000, 500, 16))


@query(
    "A14_threshold_buckets",
    "SELECT CASE WHEN v <= 5 THEN '<=5' WHEN v <= 10 THEN '<=10' WHEN v <= 20 THEN '<=20' WHEN v <= 30 THEN '<=30' WHEN v <= 40 THEN '<=40' WHEN v <= 50 THEN '<=50' WHEN v <= 100 THEN '<=100' WHEN v <= 200 THEN '<=200' ELSE '>200' END AS bin, count(*) AS n FROM (SELECT l_extendedprice / 100 AS v FROM lineitem) GROUP BY 1",
)
def a14(t):
    return A.histogram(t.lineitem, A.bin_thresholds(F.col("l_extendedprice") / 100))


@query("A15_summary", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a15(t):
    return A.summary(t.events, ["event_type"], "value").select("event_type", "n", r6(F.col("total"), 4).alias("total"), "least", "most", r6(F.col("mean")).alias("mean"))


@query("A16_moments_nonzero", "SELECT l_linenumber, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_pop, round(var_pop(v), 6) AS var_pop, count(v) AS n FROM (SELECT l_linenumber, nullif(l_discount, 0.0) AS v FROM lineitem) GROUP BY 1")
def a16(t):
    m = A.moments_pop(t.lineitem, ["l_linenumber"], "l_discount", zero_is_missing=True)
    return m.select("l_linenumber", *(r6(F.col(c)).alias(c) for c in ("mean", "std_pop", "var_pop")), "n")


_N1 = """WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 a AS (SELECT *, CASE WHEN n = 2 THEN {q} / 100.0 ELSE greatest(0.0, least((n + 1) * ({q} / 100.0) - 1, n - 1)) END AS at FROM r)
 SELECT o_custkey, round(lo + (at - floor(at)) * (hi - lo), 4) AS percentile FROM (SELECT o_custkey, CAST(max(at) AS DOUBLE) AS at, max(v) FILTER (WHERE r = floor(at)) AS lo, max(v) FILTER (WHERE r = ceil(at)) AS hi FROM a GROUP BY 1)"""


@query("A17_percentile_n_plus_1", _N1.format(q=75).replace(" at ", " p ").replace(" at,", " p,").replace("(at", "(p").replace(" AS at", " AS p").replace("at -", "p -"))
def a17(t):
    return A.percentile_n_plus_1(t.orders, ["o_custkey"], "o_totalprice", 75).select("o_custkey", r6(F.col("percentile"), 4).alias("percentile"))


@query("A18_trial_moments", "SELECT o_custkey, round(avg(o_totalprice), 7) AS mean, round(stddev_pop(o_totalprice), 4) AS std_pop, count(*) AS n FROM orders GROUP BY 1")
def a18(t):
    return A.moments_pop(t.orders, ["o_custkey"], "o_totalprice").select("o_custkey", r6(F.col("mean"), 7).alias("mean"), r6(F.col("std_pop"), 4).alias("std_pop"), "n")


@query("A19_percent_matching", "SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS percent FROM events GROUP BY 1")
def a19(t):
    return t.events.groupBy("user_id").agg(r6(A.percent_matching(F.col("event_type") == "click")).alias("percent"))


@query("A20_sum_of_listed", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def a20(t):
    listed = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(listed, "o_custkey", "left_semi").groupBy("o_custkey").agg(r6(F.sum("o_totalprice"), 2).alias("total"))


@query("A21_mean_of_counters", "SELECT l_partkey, round(avg(l_quantity), 6) AS quantity, round(avg(l_tax) + avg(l_discount), 6) AS charges FROM lineitem GROUP BY 1")
def a21(t):
    return t.lineitem.groupBy("l_partkey").agg(r6(F.avg("l_quantity")).alias("quantity"), r6(F.avg("l_tax") + F.avg("l_discount")).alias("charges"))


@query("A22_status_tally", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a22(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_ERROR = "SELECT l_returnflag, l_linestatus, l_extendedprice AS obs, l_quantity * p_retailprice AS exp, CASE WHEN l_quantity * p_retailprice <> 0 THEN 100 * (l_extendedprice - l_quantity * p_retailprice) / (l_quantity * p_retailprice) END AS e FROM lineitem JOIN part ON l_partkey = p_partkey"


def _errors(t):
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    joined = t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity", F.col("l_extendedprice").alias("obs")).join(parts, "l_partkey")
    joined = joined.withColumn("exp", F.col("l_quantity") * F.col("p_retailprice"))
    return joined.withColumn("e", A.relative_error(F.col("obs"), F.col("exp")))


@query(
    "A23_error_summary",
    f"""SELECT l_returnflag, l_linestatus, count(e) AS n, round(avg(e), 6) AS mean, round(min(e), 6) AS least, round(max(e), 6) AS most, round(quantile_cont(e, 0.25), 6) AS q25, round(quantile_cont(e, 0.5), 6) AS median,
        round(quantile_cont(e, 0.75), 6) AS q75, round(quantile_cont(e, 0.9), 6) AS q90, round(stddev_samp(e), 6) AS std_samp, round(var_samp(e), 4) AS var_samp, round(avg(abs(e)), 6) AS mean_abs, count(*) FILTER (WHERE abs(e) >= 100) AS n_100, round(corr(obs, exp), 6) AS corr
        FROM ({_ERROR}) GROUP BY 1, 2""",
)
def a23(t):
    """The flagship: relative error of the price per suite, in one aggregation over one join."""
    s = A.error_summary(_errors(t), ["l_returnflag", "l_linestatus"], "e", "obs", "exp")
    return s.select("l_returnflag", "l_linestatus", "n", *(r6(F.col(c), 4 if c == "var_samp" else 6).alias(c) for c in ("mean", "least", "most", "q25", "median", "q75", "q90", "std_samp", "var_samp", "mean_abs")), "n_100", r6(F.col("corr")).alias("corr"))


@query("A24_relative_error", f"SELECT l_returnflag, round(e, 6) AS error, round(abs(e), 6) AS abs_error FROM ({_ERROR})")
def a24(t):
    return _errors(t).select("l_returnflag", r6(F.col("e")).alias("error"), r6(F.abs("e")).alias("abs_error"))


@query(
    "A25_normalised_ratio",
    f"""WITH m AS (SELECT l_returnflag, l_linestatus, avg(e) AS e FROM ({_ERROR}) GROUP BY 1, 2) SELECT a.l_returnflag, a.l_linestatus, round((100 + b.e) / (100 + a.e), 6) AS ratio FROM m a LEFT JOIN m b ON b.l_returnflag = a.l_returnflag AND b.l_linestatus = 'F'""",
)
def a25(t):
    m = _errors(t).groupBy("l_returnflag", "l_linestatus").agg(F.avg("e").alias("e"))
    return A.normalised_ratio(m, ["l_returnflag"], "l_linestatus", "e", "F").select("l_returnflag", "l_linestatus", r6(F.col("ratio")).alias("ratio"))


@query("A26_merge_workers", "SELECT l_linenumber, CAST(sum(n) AS BIGINT) AS n, round(sum(q), 2) AS q FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a26(t):
    workers = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return workers.groupBy("l_linenumber").agg(F.sum("n").alias("n"), r6(F.sum("q"), 2).alias("q"))


@query("A27_rollup", "SELECT l_returnflag, l_linenumber, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)")
def a27(t):
    return t.lineitem.rollup("l_returnflag", "l_linenumber").agg(r6(F.sum("l_quantity"), 2).alias("q"))


@query("A28_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def a28(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("A28_grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_linestatus, l_linenumber))")
def a28b(t):
    keys = [F.col(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber")]
    return t.lineitem.groupingSets([keys, keys[1:]], *keys).agg(F.count("*").alias("n")).select("l_returnflag", "l_linestatus", "l_linenumber", "n")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A29_floored_moments", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) <= 0.03 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM lineitem" for c in _NUMBERS))
def a29(t):
    return A.floored_moments(t.lineitem, _NUMBERS, eps=0.03).select("column", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("A30_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM lineitem" for a in _NUMBERS for b in _NUMBERS))
def a30(t):
    return A.pair_matrix(t.lineitem, _NUMBERS).select("a", "b", r6(F.col("value")).alias("value"))


@query("A31_scatter_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) * count(*), 1) AS value FROM lineitem" for a in _NUMBERS for b in _NUMBERS))
def a31(t):
    return A.pair_matrix(t.lineitem, _NUMBERS, "scatter").select("a", "b", r6(F.col("value"), 1).alias("value"))


@query("A32_dual_sum", "SELECT l_linenumber, round(sum(l_quantity), 2) AS s, round(sum(l_quantity * l_quantity), 2) AS s2 FROM lineitem GROUP BY 1")
def a32(t):
    return t.lineitem.groupBy("l_linenumber").agg(r6(F.sum("l_quantity"), 2).alias("s"), r6(F.sum(F.col("l_quantity") * F.col("l_quantity")), 2).alias("s2"))


_TYPES = ["click", "purchase", "view"]


@query("A33_weighted_pivot", "SELECT user_id, " + ", ".join(f"CAST(sum(bit_count(event_id)) FILTER (WHERE event_type = '{c}') AS BIGINT) AS \"{c}\"" for c in _TYPES) + " FROM events GROUP BY 1")
def a33(t):
    return A.pivoted(t.events, ["user_id"], "event_type", _TYPES, F.sum(F.bit_count("event_id")).cast("bigint"))


@query("A34_line_profile", "SELECT l_shipmode, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_tax), 4) AS tax, max(l_extendedprice) AS most FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1, 2")
def a34(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode"), "l_linenumber").agg(F.count("*").alias("n"), r6(F.sum("l_quantity"), 2).alias("q"), r6(F.sum("l_tax"), 4).alias("tax"), F.max("l_extendedprice").alias("most"))


@query("A35_ratio_rollup", "SELECT l_partkey, round(sum(l_quantity), 2) AS q, max(l_tax) AS most, round(CASE WHEN sum(l_discount) = 0 THEN 0 ELSE sum(l_quantity) / sum(l_discount) END, 4) AS ratio FROM lineitem GROUP BY 1")
def a35(t):
    from millrace.functions.scalar import guarded_ratio

    return t.lineitem.groupBy("l_partkey").agg(r6(F.sum("l_quantity"), 2).alias("q"), F.max("l_tax").alias("most"), r6(guarded_ratio(F.sum("l_quantity"), F.sum("l_discount")), 4).alias("ratio"))


@query("A36_degree_histogram", "SELECT CAST(floor(log2(d)) AS INTEGER) + 1 AS bin, count(*) AS n FROM (SELECT o_custkey, count(*) AS d FROM orders GROUP BY 1) GROUP BY 1")
def a36(t):
    return A.histogram(t.orders.groupBy("o_custkey").agg(F.count("*").alias("d")), A.bin_log2(F.col("d")))


@query("A37_nested_counts", "SELECT l_returnflag, string_agg(l_linenumber || ':' || n, ',' ORDER BY l_linenumber) AS counts FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a37(t):
    made = A.nested_counts(t.lineitem, "l_returnflag", "l_linenumber")
    text = F.array_join(F.transform(F.sort_array(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return made.select("l_returnflag", text.alias("counts"))


@query("A38_scatter_add", "SELECT l_suppkey AS dst, round(sum(l_quantity * l_discount), 4) AS total FROM lineitem GROUP BY 1")
def a38(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("dst")).agg(r6(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("total"))


@query("A39_tile_histogram", "SELECT CAST(l_orderkey // 1000 AS BIGINT) AS tile, CAST(l_quantity AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a39(t):
    return A.histogram(t.lineitem.withColumn("tile", F.floor(F.col("l_orderkey") / 1000).cast("bigint")), F.col("l_quantity").cast("int"), ["tile"])


@query("A40_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def a40(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))


@query("A41_running_power", "SELECT event_type, round(sum(value) / count(*), 6) AS mean, max(value) AS most, min(value) AS least FROM events GROUP BY 1")
def a41(t):
    return t.events.groupBy("event_type").agg(r6(F.sum("value") / F.count("*")).alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"))


@query("A42_rmse", "SELECT round(sqrt(avg(m * m)), 6) AS rmse FROM (SELECT a.vec_id, min(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS m FROM embeddings a CROSS JOIN embeddings c WHERE c.vec_id < 10 GROUP BY 1)")
def a42(t):
    from millrace.functions.scalar import squared_distance

    centres = t.embeddings.where("vec_id < 10").select(F.col("embedding").alias("c"))
    least = t.embeddings.crossJoin(centres).groupBy("vec_id").agg(F.min(squared_distance(F.col("embedding"), F.col("c"))).alias("m"))
    return least.agg(r6(F.sqrt(F.avg("m"))).alias("rmse"))


@query("A43_linear_score", "SELECT l_orderkey, round(sum(l_quantity * p_size), 2) AS score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5 GROUP BY 1")
def a43(t):
    coefficients = t.part.where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("k"))
    return A.linear_score(t.lineitem, coefficients, "l_partkey", ["l_orderkey"], "l_quantity", "k").select("l_orderkey", r6(F.col("score"), 2).alias("score"))
