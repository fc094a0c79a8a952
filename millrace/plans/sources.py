"""Queries over scans and sinks: lines in each format are made from the tables, scanned, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.scalar import hex_padded
from millrace.operators.iterate import cut
from millrace.plans.registry import query, r6
from millrace.sources import sinks, text, trace


def _lines(df, line, order="no", file=None):
    return df.select((file if file is not None else F.lit("f")).cast("string").alias("file"), F.col(order).cast("int").alias("no"), line.alias("line"))


@query("S03_kernel_list", "SELECT CAST(p_partkey AS INTEGER) AS no, CASE WHEN p_size % 3 = 0 THEN 'copy' ELSE 'kernel' END AS kind FROM part")
def s03(t):
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("MemcpyHtoD,0x7f00,"), "p_size")).otherwise(F.concat(F.lit("kernel-"), "p_partkey", F.lit(".traceg")))
    return text.kernel_list(_lines(t.part, line, "p_partkey")).select("no", "kind")


@query("S04_kernel_ids", "SELECT CAST(p_partkey AS INTEGER) AS kernel_id FROM part WHERE p_size % 3 <> 0")
def s04(t):
    line = F.when(F.col("p_size") % 3 == 0, F.lit("MemcpyHtoD")).otherwise(F.concat(F.lit("kernel-"), "p_partkey", F.lit(".traceg.gz")))
    return text.kernel_ids(_lines(t.part, line, "p_partkey")).select("kernel_id")


def _sections(t):
    """A file for each region: a section for each nation, whose rows are brands and whose columns are two applications."""
    n = t.nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    body = F.array(F.lit("-----"), F.col("name"), F.lit("apps,bfs--k--1,nw__4--run"), F.concat(F.lit("base,"), "k", F.lit(",NA")), F.concat(F.lit("tuned,1.5,"), "r"), F.lit(""))
    cells = n.select("r", "k", F.posexplode(body).alias("i", "line"))
    return cells.select(F.col("r").cast("string").alias("file"), (F.col("k") * 10 + F.col("i")).cast("int").alias("no"), "line")


_SECTION_SQL = "SELECT n_name AS stat, c.config, c.appargs, c.kernel, {v} AS value FROM nation, LATERAL (SELECT * FROM (VALUES ('base', '{a}', 'k--1', CAST(n_nationkey AS VARCHAR)), ('base', '{b}', 'run', NULL), ('tuned', '{a}', 'k--1', '1.5'), ('tuned', '{b}', 'run', CAST(n_regionkey AS VARCHAR))) x(config, appargs, kernel, v)) c"


@query("S05_sectioned", _SECTION_SQL.format(v="c.v", a="bfs", b="nw__4"))
def s05(t):
    return text.sectioned(_sections(t)).select("stat", "config", "appargs", "kernel", "value")


@query("S06_sectioned_numbers", _SECTION_SQL.format(v="coalesce(CAST(c.v AS DOUBLE), 0)", a="BFS", b="NW__4"))
def s06(t):
    return text.sectioned(_sections(t), numbers=True).select("stat", "config", "appargs", "kernel", "value")


def _registry(t):
    return t.spark.createDataFrame([("aggregate", r"gpu_insn = ([0-9]+)"), ("rate", r"gpu_ipc = ([0-9.]+)"), ("abs", r"type = (\w+)")], "class string, pattern string")


@query("S07_regex_metrics", "SELECT CAST(event_id AS INTEGER) AS no, 'aggregate' AS class, CAST(user_id AS VARCHAR) AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT CAST(event_id AS INTEGER), 'abs', event_type FROM events WHERE event_id % 2 = 1")
def s07(t):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("gpu_insn = "), "user_id")).otherwise(F.concat(F.lit("type = "), "event_type"))
    return text.metrics(_lines(t.events, line, "event_id"), _registry(t)).select("no", "class", "value")


@query("E03_declared_metrics", "SELECT 'aggregate' AS class, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'abs', count(*) FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'rate', 0")
def e03(t):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("gpu_insn = "), "user_id")).otherwise(F.concat(F.lit("type = "), "event_type"))
    found = text.metrics(_lines(t.events, line, "event_id"), _registry(t)).groupBy("class").agg(F.count("*").alias("n"))
    return _registry(t).select("class").join(found, "class", "left").na.fill(0, ["n"])


@query("S08_series", "SELECT sample, metric, idx, v AS value FROM (SELECT CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INTEGER) AS sample, event_type AS metric, user_id FROM events), LATERAL (SELECT 0 AS idx, CAST(user_id AS DOUBLE) AS v UNION ALL SELECT 1, NULL)")
def s08(t):
    line = F.concat(F.upper("event_type"), F.lit(": "), F.col("user_id").cast("string"), F.lit(" NULL"))
    return text.series(_lines(t.events, line, "event_id")).select("sample", "metric", "idx", "value")


@query("S09_line_profile", "SELECT 'a.cu' AS source, CAST(l_linenumber AS INTEGER) AS line, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 2")
def s09(t):
    g = t.lineitem.groupBy("l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("n"))
    line = F.concat_ws(" ", F.lit("a.cu"), F.col("l_linenumber").cast("string"), F.lit(":"), F.col("q").cast("string"), F.col("n").cast("string"))
    return text.line_profile(_lines(g, line, "l_linenumber"), ["q", "n"])


@query("S10_source_map", "SELECT CAST(event_id AS INTEGER) AS no, CAST(last_value(CASE WHEN event_type = 'purchase' THEN user_id END IGNORE NULLS) OVER (PARTITION BY event_id // 500 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS source_line FROM events")
def s10(t):
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("  .loc 1 "), F.col("user_id").cast("string"), F.lit(" 0"))).otherwise(F.lit("add r1, r2"))
    return text.source_map(_lines(t.events, line, "event_id", F.floor(F.col("event_id") / 500))).select("no", "source_line")


@query("S11_profiler_cycles", "SELECT CAST(p_partkey + 1 AS INTEGER) AS kernel_id, CAST(p_size * 1234 AS DOUBLE) AS cycles FROM part")
def s11(t):
    return _profiler_cycles(t, t.part)


def _profiler_cycles(t, p):
    body = p.select((F.col("p_partkey") + 100).alias("no"), F.concat(F.lit('"'), "p_partkey", F.lit('","cycle","'), F.format_number(F.col("p_size") * 1234, 0), F.lit('"')).alias("line"))
    head = t.spark.createDataFrame([(0, "noise"), (1, '"9","cycle","1"'), (2, "==PROF== Disconnected from process 7"), (3, '"ID","Metric","Value"')], "no long, line string")
    return text.profiler_cycles(_lines(head.unionByName(body), F.col("line"))).select("kernel_id", "cycles")


@query("S12_power_samples", "SELECT CAST(l_suppkey AS INTEGER) AS no, nullif(min(l_discount), 0.0) AS watts FROM lineitem GROUP BY 1")
def s12(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.min("l_discount").alias("d"))
    return text.power_samples(_lines(g, F.col("d").cast("string"), "l_suppkey")).select("no", "watts")


@query("S13_power_report", "SELECT n_name AS kernel_name, 'c' || k AS counter, CAST(n_nationkey * k AS DOUBLE) AS watts FROM nation, LATERAL (SELECT range AS k FROM range(5, 10))")
def s13(t):
    n = t.nation.select("n_nationkey", F.regexp_replace("n_name", " ", "_").alias("n_name"))
    at = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12))))
    line = F.when(F.col("k") == 0, F.concat(F.lit("kernel_name = "), "n_name")).otherwise(F.concat(F.lit("c"), F.col("k").cast("string"), F.lit(" = "), (F.col("n_nationkey") * F.col("k")).cast("string")))
    return text.power_report(_lines(at.withColumn("no", F.col("n_nationkey") * 20 + F.col("k")), line), 5, 9).select("kernel_name", "counter", "watts")


@query("S14_app_suites", "SELECT r_name AS suite, n_name AS exec, CASE WHEN n_nationkey % 3 <> 0 THEN '-n ' || k END AS args FROM nation JOIN region ON n_regionkey = r_regionkey, LATERAL (SELECT range AS k FROM range(CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE n_nationkey % 3 END))")
def s14(t):
    """A suite for each region, a program for each nation, with none to two lines of arguments."""
    args = F.concat_ws(", ", F.transform(F.expr("slice(array(0, 1), 1, CAST(n_nationkey % 3 AS INT))"), lambda k: F.concat(F.lit("'-n "), k.cast("string"), F.lit("'"))))
    program = F.concat(F.lit("    - "), "n_name", F.lit(": ["), args, F.lit("]"))
    suites = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.concat_ws("\n", F.collect_list(program)).alias("programs"))
    return text.app_suites("\n".join(f"{r.r_name}:\n  execs:\n{r.programs}" for r in suites.collect()), t.spark)


@query("S15_gr_graph", "SELECT o_custkey AS src, o_orderkey AS dst, CAST(o_totalprice AS BIGINT) AS weight FROM orders")
def s15(t):
    o = t.orders
    line = F.concat_ws(" ", F.lit("a"), (F.col("o_custkey") + 1).cast("string"), (F.col("o_orderkey") + 1).cast("string"), F.rint("o_totalprice").cast("bigint").cast("string"))
    return text.gr_graph(_lines(o, line, "o_orderkey"))


@query("S16_metis_graph", "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(x AS BIGINT) AS dst FROM nation, LATERAL (SELECT unnest([n_regionkey, n_regionkey + 3]) AS x)")
def s16(t):
    body = t.nation.select((F.col("n_nationkey") + 2).alias("no"), F.concat_ws(" ", (F.col("n_regionkey") + 1).cast("string"), (F.col("n_regionkey") + 4).cast("string")).alias("line"))
    head = t.spark.createDataFrame([(0, "% comment"), (1, "25 25")], "no int, line string")
    return text.metis_graph(_lines(head.unionByName(body), F.col("line")))


@query("S17_csr_offsets", "SELECT node, degree, CAST(sum(degree) OVER (ORDER BY node ROWS UNBOUNDED PRECEDING) - degree AS BIGINT) AS \"offset\" FROM (SELECT o_custkey AS node, count(*) AS degree FROM orders GROUP BY 1)")
def s17(t):
    return text.csr_offsets(t.orders.select(F.col("o_custkey").alias("src"))).select("node", "degree", F.col("offset").cast("bigint").alias("offset"))


@query("S18_fixed_width", "SELECT CAST(p_partkey AS INTEGER) AS key, p_retailprice AS price FROM part")
def s18(t):
    line = F.concat(F.rpad(F.col("p_partkey").cast("string"), 12, " "), F.lpad(F.col("p_retailprice").cast("string"), 16, " "))
    return text.fixed_width(_lines(t.part, line, "p_partkey"), [("key", 1, 12, "int"), ("price", 13, 16, "double")])


@query("S19_settings", "SELECT '-' || n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def s19(t):
    line = F.concat(F.lit("-"), "n_name", F.lit("   "), F.col("n_regionkey").cast("string"))
    return text.settings(_lines(t.nation.withColumn("n_name", F.regexp_replace("n_name", " ", "_")), line, "n_nationkey")).select("key", "value")


@query("S20_decode_id", "SELECT o_orderkey, CAST(o_custkey % 4 AS INTEGER) AS device, CAST(o_custkey % 9 AS INTEGER) AS stream, CAST(o_orderkey AS INTEGER) AS kernel FROM orders")
def s20(t):
    name = F.concat(F.lit("d_"), (F.col("o_custkey") % 4).cast("string"), F.lit("_s_"), (F.col("o_custkey") % 9).cast("string"), F.lit("_k_"), F.col("o_orderkey").cast("string"), F.lit("_b_0"))
    return t.orders.select("o_orderkey", *text.decoded_id(name))


@query("S21_virtual_columns", "SELECT range AS id, 7 AS seven, range * range AS square FROM range(1000)")
def s21(t):
    return t.spark.range(1000).select("id", F.lit(7).alias("seven"), (F.col("id") * F.col("id")).alias("square"))


@query("S22_random_keys")
def s22(t):
    return t.spark.range(1024).select((F.rand(7) * 1024).cast("int").alias("key")).orderBy("key")


@query("S23_document_scan", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s23(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("K01_pivot_sink", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def k01(t):
    long = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return sinks.pivoted(long, ["l_returnflag"], "l_linestatus", ["F", "O"], "n").na.fill(0)


@query("K03_matrix", "SELECT 'q' AS stat, CAST(l_linenumber AS VARCHAR) AS config, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS \"A\", round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS \"N\" FROM lineitem GROUP BY 2")
def k03(t):
    long = t.lineitem.groupBy(F.lit("q").alias("stat"), F.col("l_linenumber").cast("string").alias("config"), "l_returnflag").agg(r6(F.sum("l_quantity"), 2).alias("v"))
    return sinks.matrix(long, "stat", "config", "l_returnflag", "v", [], ["A", "N"], configs_as_rows=True)


@query("K06_trial_table", "SELECT o_custkey, round(median(v), 4) AS median, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most, coalesce(max(CASE WHEN trial = 0 THEN 'x' END), 'N/A') AS trial0, coalesce(max(CASE WHEN trial = 9 THEN 'x' END), 'N/A') AS trial9 FROM (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS trial FROM orders) GROUP BY 1")
def k06(t):
    from pyspark.sql import Window

    trials = t.orders.select("o_custkey", F.col("o_totalprice").alias("v"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("trial"))
    made = sinks.trial_table(trials, ["o_custkey"], "trial", "v", 10)
    mark = lambda c: F.when(F.col(c) == "N/A", "N/A").otherwise("x").alias(c)
    return made.select("o_custkey", r6(F.col("median"), 4).alias("median"), r6(F.col("mean")).alias("mean"), "least", "most", mark("trial0"), mark("trial9"))


@query("K08_grouped_rows", "SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n_rows FROM events")
def k08(t):
    return sinks.grouped_rows(t.events.select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("K11_patch", "SELECT CAST(n_nationkey AS INTEGER) AS no, '-' || n_name || ' ' || CASE WHEN n_regionkey = 2 THEN 'new' ELSE 'old' END AS line FROM nation")
def k11(t):
    n = t.nation.withColumn("key", F.concat(F.lit("-"), F.regexp_replace("n_name", " ", "_")))
    template = n.select(F.col("n_nationkey").cast("int").alias("no"), F.concat("key", F.lit(" old")).alias("line"))
    return sinks.patched(template, n.where("n_regionkey = 2").select("key", F.lit("new").alias("value")))


@query("K02_csv_round_trip", "SELECT n_name, n_regionkey FROM nation")
def k02(t):
    from millrace.operators.iterate import scratch

    path = scratch(t.spark)
    sinks.write_csv(t.nation.select("n_name", "n_regionkey"), path, header=False)
    return t.spark.read.schema("n_name string, n_regionkey int").csv(path)


@query("K07_json_round_trip", "SELECT n_name, n_regionkey FROM nation")
def k07(t):
    from millrace.operators.iterate import scratch

    path = scratch(t.spark)
    sinks.write_json(t.nation.select("n_name", "n_regionkey"), path)
    return t.spark.read.schema("n_name string, n_regionkey int").json(path)


@query("K12_append_csv", "SELECT n_name, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) GROUP BY 1")
def k12(t):
    from millrace.operators.iterate import scratch

    path = scratch(t.spark)
    for _ in range(2):
        sinks.write_csv(t.nation.select("n_name"), path, append=True)
    return t.spark.read.schema("n_name string").csv(path, header=True).groupBy("n_name").agg(F.count("*").alias("n"))


def _trace(t):
    """An instruction table: a warp for each user, masks from ids, programme counters in steps."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = (F.row_number().over(w) - 1).cast("bigint")
    e = t.events.withColumn("seq", seq)
    pc = F.when(F.col("event_type") == "click", F.col("event_id")).otherwise(F.col("seq") * 16)
    mask = F.when(F.col("event_id") % 3 == 0, F.lit(4294967295)).otherwise(F.col("event_id") + 1)
    return e.select("user_id", "seq", pc.alias("pc"), mask.alias("active_mask"), F.when(F.col("event_id") % 2 == 0, mask).otherwise(F.lit(5)).cast("bigint").alias("predicate_mask"), F.when(F.col("event_type") == "view", F.array("event_id")).alias("addresses"))


@query("X33_mask_round_trip", "SELECT event_id + 1 AS id, CASE WHEN event_id % 3 = 0 THEN 4294967295 ELSE event_id + 1 END AS active_mask, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 4294967295 ELSE event_id + 1 END ELSE 5 END AS predicate_mask FROM events")
def x33b(t):
    mask = F.when(F.col("event_id") % 3 == 0, F.lit(4294967295)).otherwise(F.col("event_id") + 1)
    rows = t.events.select((F.col("event_id") + 1).alias("id"), mask.alias("active_mask"), F.when(F.col("event_id") % 2 == 0, mask).otherwise(F.lit(5)).cast("bigint").alias("predicate_mask"))
    return trace.decode_masks(trace.encode_masks(rows)).select("id", "active_mask", "predicate_mask")


@query("S01_trace_runs_round_trip", "WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type, event_id FROM events) SELECT user_id, seq, CASE WHEN event_type = 'click' THEN event_id ELSE seq * 16 END AS pc FROM s")
def s01(t):
    rows = cut(_trace(t).withColumn("flags", F.lit(3)))
    return trace.decode_runs(trace.encode_runs(rows, ["user_id"]), ["user_id"]).select("user_id", "seq", "pc")


@query("X06_hex_lines", "SELECT o_orderkey, '0x' || CASE WHEN length(to_hex(o_orderkey)) >= 4 THEN lower(to_hex(o_orderkey)) ELSE lpad(lower(to_hex(o_orderkey)), 4, '0') END AS v FROM orders")
def x06b(t):
    return t.orders.select("o_orderkey", F.concat(F.lit("0x"), hex_padded(F.col("o_orderkey"), 4)).alias("v"))
