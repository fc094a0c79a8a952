"""Queries over filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans.registry import query, r6


@query("F01_drop_containing", "SELECT doc_id, length(text) AS n FROM documents WHERE NOT coalesce(contains(text, 'License'), false)")
def f01(t):
    return R.drop_containing(t.documents, "text", "License").select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("F02_exists_in_array", "SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.4)) > 0")
def f02(t):
    return R.with_any(t.embeddings, "embedding", lambda x: x > F.lit(0.4).cast("float")).select("vec_id", "label")


@query("F03_id_range", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 2000")
def f03(t):
    return R.id_range(t.orders, "o_orderkey", 100, 2000).select("o_orderkey", "o_orderstatus")


@query("F04_membership", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def f04(t):
    ids = t.events.where("event_type = 'purchase' AND value > 90").select("user_id")
    return R.members(t.events, ids, "user_id").select("event_id", "user_id")


@query("F05_blocklist", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1 AND c.c_mktsegment = 'BUILDING')")
def f05(t):
    block = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return R.not_listed(t.customer, block, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("F06_regex_outliers", "SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '[0-9]{3}$') OR regexp_matches(url, '/a'))")
def f06(t):
    return R.without_matches(t.pages, "url", ["[0-9]{3}$", "/a"]).select("page_id", "url")


@query("F07_select_if", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def f07(t):
    return t.orders.where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query(
    "F08_partition_if",
    """SELECT o_orderkey, s AS selected, CAST(row_number() OVER (ORDER BY CASE WHEN s THEN 0 ELSE 1 END, CASE WHEN s THEN o_orderkey ELSE -o_orderkey END) - 1 AS BIGINT) AS position
       FROM (SELECT o_orderkey, o_orderstatus = 'F' AS s FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders))""",
)
def f08(t):
    return R.partitioned(t.orders.select("o_orderkey", "o_orderstatus").distinct(), F.col("o_orderstatus") == "F", "o_orderkey").select("o_orderkey", "selected", F.col("position").cast("bigint").alias("position"))


@query("F09_prune_unused", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def f09(t):
    used = t.lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return R.members(t.part, used, "p_partkey").select("p_partkey", "p_brand")


@query("F10_mask_predicate", "SELECT o_orderkey, o_custkey, CAST(bit_count(xor(o_orderkey, o_custkey)) AS INTEGER) AS off FROM orders WHERE bit_count(xor(o_orderkey, o_custkey)) > 6")
def f10(t):
    off = F.bit_count(F.col("o_orderkey").bitwiseXOR(F.col("o_custkey"))).cast("int")
    return t.orders.select("o_orderkey", "o_custkey", off.alias("off")).where("off > 6")


@query("F11_first_n", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 25")
def f11(t):
    return R.first_n(t.events.select("event_id", "user_id"), ["event_id"], 25)


@query("F12_case_projection", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS class FROM lineitem")
def f12(t):
    q = F.col("l_quantity")
    return R.classified(t.lineitem, "class", [(q < 10, "small"), (q < 30, "medium")], "large").select("l_orderkey", "l_linenumber", "l_quantity", "class")


@query("F13_first_matching_key", "SELECT min(range) AS key FROM range(200000) WHERE md5(CAST(range AS VARCHAR)) = md5('123456')")
def f13(t):
    keys = t.spark.range(200000)
    return keys.where(F.md5(F.col("id").cast("string")) == F.md5(F.lit("123456"))).agg(F.min("id").alias("key"))


@query("F14_prune_columns", "SELECT s_suppkey, s_nationkey FROM supplier")
def f14(t):
    return t.supplier.drop("s_name", "s_acctbal")


@query("F15_select_by_name", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def f15(t):
    return t.events.where(F.col("event_type") == "click").select("event_id", "value")


@query("J01_inner_join", "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def j01(t):
    joined = R.equi_join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r6(F.sum("l_quantity"), 2).alias("quantity"))


@query("J02_partitioned_join", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def j02(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.equi_join(t.lineitem.select("l_orderkey"), urgent.hint("merge"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("J03_skew_join", "SELECT e.event_type, count(*) AS n FROM events e JOIN (SELECT event_type, max(value) AS m FROM events GROUP BY 1) x USING (event_type) WHERE e.value > x.m / 2 GROUP BY 1")
def j03(t):
    top = t.events.groupBy("event_type").agg(F.max("value").alias("m"))
    joined = R.equi_join(t.events.select("event_id", "event_type", "value"), top, "event_type", skewed=True)
    return joined.where("value > m / 2").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "J04_bounds",
    """WITH k AS (SELECT DISTINCT p_size AS key FROM part), c AS (SELECT CAST(l_quantity AS INTEGER) AS key, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT k.key, CAST(coalesce(sum(n) FILTER (WHERE c.key < k.key), 0) AS BIGINT) AS lower, CAST(coalesce(sum(n) FILTER (WHERE c.key <= k.key), 0) AS BIGINT) AS upper FROM k CROSS JOIN c GROUP BY 1""",
)
def j04(t):
    return R.bounds(t.part.select(F.col("p_size").alias("key")), t.lineitem.select(F.col("l_quantity").cast("int").alias("key")), "key").select("key", F.col("lower").cast("bigint"), F.col("upper").cast("bigint"))


@query("J05_point_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def j05(t):
    records = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.select("o_orderkey", "o_custkey").join(records, "o_custkey", "left").select("o_orderkey", "c_name")


@query(
    "J06_range_lookup",
    """WITH q AS (SELECT p_partkey AS qid, p_partkey AS lo, p_partkey + p_size AS hi FROM part)
       SELECT qid, CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN a.o_orderkey END AS first, CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN b.o_orderkey - a.o_orderkey + 1 END AS length
       FROM q LEFT JOIN orders a ON a.o_orderkey = lo LEFT JOIN orders b ON b.o_orderkey = hi""",
)
def j06(t):
    records = t.orders.select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("key"))
    asked = t.part.select(F.col("p_partkey").alias("qid"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    return R.range_lookup(records, asked, "idx", "key", "qid", "lo", "hi")


@query("J06_range_join", "SELECT p_size, min(o_orderkey) AS first, count(*) AS n FROM (SELECT DISTINCT p_size FROM part) JOIN orders ON o_totalprice BETWEEN p_size * 1000 AND p_size * 1000 + 5000 GROUP BY 1")
def j06b(t):
    ranges = t.part.select("p_size").distinct().select("p_size", (F.col("p_size") * 1000.0).alias("lo"), (F.col("p_size") * 1000.0 + 5000).alias("hi"))
    return R.range_join(t.orders.select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "lo", "hi", 5000).groupBy("p_size").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"))


@query("J07_enrichment", "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j07(t):
    dim = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(dim, "c_nationkey", "left").groupBy("n_name").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal"), 4).alias("balance"))


_MICROS = "epoch_us(ts)"


def _micros(events):
    return events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    "J08_asof",
    """WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click'),
       p AS (SELECT user_id, epoch_us(ts) AS at, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
       SELECT c.event_id, c.user_id, p.value AS asof_value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.at >= p.at""",
)
def j08(t):
    e = _micros(t.events)
    return R.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "at"), e.where("event_type = 'purchase'").select("user_id", "at", "value"), "user_id", "at", "value").select("event_id", "user_id", "asof_value")


@query(
    "J18_asof_tolerance",
    """WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click'),
       p AS (SELECT user_id, epoch_us(ts) AS at, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
       SELECT c.event_id, CASE WHEN c.at - p.at <= 86400000000 THEN p.value END AS asof_value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.at >= p.at""",
)
def j18(t):
    e = _micros(t.events)
    return R.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "at"), e.where("event_type = 'purchase'").select("user_id", "at", "value"), "user_id", "at", "value", tolerance=86_400_000_000).select("event_id", "asof_value")


@query("J09_measured_vs_expected", "SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders JOIN (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 300000) USING (o_custkey, o_orderstatus, o_orderpriority) GROUP BY 1, 2, 3")
def j09(t):
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return R.equi_join(t.orders, t.orders.where("o_totalprice > 300000").select(*keys).distinct(), keys).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "J10_merge_counters",
    """SELECT l_returnflag, l_linenumber, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2
       UNION ALL SELECT l_returnflag, l_linenumber, count(*) FROM lineitem WHERE l_quantity > 40 AND l_linenumber > 2 GROUP BY 1, 2) GROUP BY 1, 2""",
)
def j10(t):
    keys = ["l_returnflag", "l_linenumber"]
    count = lambda c: t.lineitem.where(c).groupBy(*keys).agg(F.count("*").alias("n"))
    return R.merged_counters(count("l_quantity < 10"), count("l_quantity > 40 AND l_linenumber > 2"), keys, "n")


@query("J11_later_wins", "SELECT n_regionkey AS key, CASE WHEN max(s_acctbal) IS NOT NULL THEN round(max(s_acctbal), 2) ELSE min(n_nationkey) END AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND n_nationkey < 10 GROUP BY 1")
def j11(t):
    first = t.nation.groupBy(F.col("n_regionkey").alias("key")).agg(F.min("n_nationkey").cast("double").alias("v"))
    second = t.supplier.join(t.nation.where("n_nationkey < 10"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("key")).agg(r6(F.max("s_acctbal"), 2).alias("v"))
    return R.later_wins([first, second], ["key"], "v")


@query("J12_override", "SELECT n_nationkey, coalesce(m.b, 0.0) AS balance FROM nation LEFT JOIN (SELECT s_nationkey, round(max(s_acctbal), 2) AS b FROM supplier WHERE s_acctbal > 0 GROUP BY 1) m ON s_nationkey = n_nationkey")
def j12(t):
    measured = t.supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(r6(F.max("s_acctbal"), 2).alias("balance"))
    return R.overridden(t.nation.select("n_nationkey", F.lit(0.0).alias("balance")), measured, "n_nationkey", "balance", "n_nationkey")


_EDGES = [-0.25, 0.0, 0.25, 0.5, 0.75]


@query(
    "J13_pairs_histogram",
    """SELECT bin, count(*) AS n FROM (SELECT CASE WHEN d >= 0.75 THEN 5 WHEN d >= 0.5 THEN 4 WHEN d >= 0.25 THEN 3 WHEN d >= 0.0 THEN 2 WHEN d >= -0.25 THEN 1 ELSE 0 END AS bin
       FROM (SELECT list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)) GROUP BY 1""",
)
def j13(t):
    return R.pairs_histogram(t.embeddings, "vec_id", "embedding", _EDGES)


@query("J14_distance_to_all", "SELECT a.vec_id, c.vec_id AS centre, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a CROSS JOIN embeddings c WHERE c.vec_id < 8")
def j14(t):
    from millrace.functions.scalar import squared_distance

    centres = t.embeddings.where("vec_id < 8").select(F.col("vec_id").alias("centre"), F.col("embedding").alias("c"))
    return t.embeddings.crossJoin(centres).select("vec_id", "centre", r6(F.sqrt(squared_distance(F.col("embedding"), F.col("c")))).alias("distance"))


@query("J15_neighbour_join", "SELECT n.n_name, count(DISTINCT s.s_suppkey) AS suppliers, count(DISTINCT c.c_custkey) AS customers FROM nation n LEFT JOIN supplier s ON s_nationkey = n_nationkey LEFT JOIN customer c ON c_nationkey = n_nationkey GROUP BY 1")
def j15(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"))
    return t.nation.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").na.fill(0, ["suppliers", "customers"]).select("n_name", "suppliers", "customers")


@query("J16_no_neighbour", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j16(t):
    return R.not_listed(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):

    @query(f"J18_{_how}_join", f"SELECT n_nationkey, r_name FROM (SELECT * FROM nation WHERE n_nationkey > 5) {_sql} JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
    def j18_how(t, how=_how):
        return t.nation.where("n_nationkey > 5").join(t.region.where("r_regionkey > 1"), F.col("n_regionkey") == F.col("r_regionkey"), how).select("n_nationkey", "r_name")


@query(
    "J19_interpolate",
    """WITH g AS (SELECT p_brand, x, lead(x) OVER w AS hi, y, lead(y) OVER w AS yhi FROM (SELECT p_brand, p_size AS x, avg(p_retailprice) AS y FROM part GROUP BY 1, 2) WINDOW w AS (PARTITION BY p_brand ORDER BY x))
       SELECT p_partkey, p_brand, x0 AS x, round(yhi - (hi - x0) / (hi - g.x) * (yhi - y), 4) AS y
       FROM (SELECT p_partkey, p_brand, CAST(p_size + 0.5 AS DOUBLE) AS x0 FROM part) LEFT JOIN g USING (p_brand) WHERE hi IS NOT NULL AND x0 >= g.x AND x0 < hi""",
)
def j19(t):
    grid = t.part.groupBy("p_brand", F.col("p_size").cast("double").alias("gx")).agg(F.avg("p_retailprice").alias("gy"))
    points = t.part.select("p_partkey", "p_brand", (F.col("p_size") + 0.5).alias("x"))
    return R.interpolated(points, grid, "x", "gx", "gy", "p_brand", 5.0).where("y IS NOT NULL").select("p_partkey", "p_brand", F.col("x"), r6(F.col("y"), 4).alias("y"))


@query("J20_weighted_sum", "SELECT l_orderkey, round(sum(l_quantity * p_retailprice), 2) AS total, round(sum(l_quantity * p_size), 2) AS size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j20(t):
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    joined = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(parts, "l_partkey")
    return joined.groupBy("l_orderkey").agg(r6(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("total"), r6(F.sum(F.col("l_quantity") * F.col("p_size")), 2).alias("size"))


@query("O01_sort_pairs", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def o01(t):
    return t.lineitem.groupBy("l_quantity").agg(F.count("*").alias("n")).orderBy("l_quantity")


@query("O02_range_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def o02(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")


@query("O03_sorted_runs", "SELECT o_custkey, o_orderkey FROM orders")
def o03(t):
    return t.orders.select("o_custkey", "o_orderkey").repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")


@query("O04_block_sort", "SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY 1")
def o04(t):
    return t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))


@query("O05_descending_pairs", "SELECT p_size, p_partkey FROM part ORDER BY p_size DESC, p_partkey")
def o05(t):
    return t.part.select("p_size", "p_partkey").orderBy(F.desc("p_size"), "p_partkey")


@query("O06_top_k", "SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10")
def o06(t):
    from millrace.functions.scalar import squared_distance

    origin = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("o"))
    return R.nearest(t.embeddings.crossJoin(origin), "vec_id", r6(F.sqrt(squared_distance(F.col("embedding"), F.col("o")))), 10).select("vec_id", "distance")


@query("O08_sort_by_two", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 1, 2")
def o08(t):
    return t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy("event_type", "user_id")


@query("U01_union_first_wins", "SELECT p_brand, CASE WHEN min(CASE WHEN p_size < 20 THEN p_size END) IS NOT NULL THEN min(CASE WHEN p_size < 20 THEN p_size END) ELSE min(p_size) END AS p_size FROM part GROUP BY 1")
def u01(t):
    return R.first_wins([t.part.where("p_size < 20"), t.part], ["p_brand"], "p_size")


@query("U02_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u02(t):
    part = lambda c: t.orders.where(c).select("o_custkey")
    return R.intersected([part("o_orderstatus = 'F'"), part("o_orderstatus = 'O'"), part("o_orderpriority = '1-URGENT'")])


@query("U03_intersect_names", "SELECT DISTINCT event_type FROM events WHERE user_id < 20 INTERSECT SELECT DISTINCT event_type FROM events WHERE user_id >= 20")
def u03(t):
    return R.intersected([t.events.where("user_id < 20").select("event_type"), t.events.where("user_id >= 20").select("event_type")])


@query("U04_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'nation' FROM nation) GROUP BY 1")
def u04(t):
    kind = lambda df, k: df.select(F.lit(k).alias("kind"))
    return kind(t.customer, "customer").unionByName(kind(t.supplier, "supplier")).unionByName(kind(t.nation, "nation")).groupBy("kind").agg(F.count("*").alias("n"))


@query("U05_single_valued", "SELECT min(length(event_type)) AS n FROM events WHERE event_type = 'click'")
def u05(t):
    return R.single_valued(t.events.where("event_type = 'click'").select(F.length("event_type").cast("bigint").alias("n")), "n")


@query("U06_except_all", "SELECT p_size FROM part EXCEPT ALL SELECT CAST(n_nationkey AS INTEGER) FROM nation")
def u06(t):
    return t.part.select("p_size").exceptAll(t.nation.select(F.col("n_nationkey").cast("int").alias("p_size")))
