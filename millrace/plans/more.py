"""Queries over nested documents, substring matches, declarations and stores on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graphs as G
from millrace.operators import relational as R
from millrace.operators.iterate import cut, scratch
from millrace.plans import graphs
from millrace.plans.registry import query, r6
from millrace.sources import registry, sinks, text
from millrace.streaming import streams as S


@query("S02_static_metadata", "SELECT n_regionkey AS function_id, count(*) AS instructions, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS reused FROM nation GROUP BY 1")
def s02(t):
    """A nested JSON document of kernels and instructions, written, scanned and counted."""
    operands = F.array(F.struct(F.concat(F.lit("R"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 3 == 0, ".reuse").otherwise("")).alias("operand_string")))
    instruction = F.struct((F.col("n_nationkey") * 16).cast("bigint").alias("pc"), operands.alias("operands"))
    kernels = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(instruction)).alias("instructions"))
    kernel = F.struct(F.lit("k").alias("kernel_name"), F.col("n_regionkey").cast("bigint").alias("unique_function_id"), "instructions")
    path = scratch(t.spark)
    kernels.agg(F.collect_list(kernel).alias("kernels")).select(F.lit("b").alias("benchmark_name"), "kernels").write.json(path)
    made = text.static_metadata(t.spark, path)
    reused = F.exists("operands", lambda o: o["operand_string"].contains(".reuse"))
    return made.groupBy(F.col("unique_function_id").cast("int").alias("function_id")).agg(F.count("*").alias("instructions"), F.count(F.when(reused, 1)).alias("reused"))


@query(
    "J17_substring_matches",
    """WITH r AS (SELECT page_id, i, substring(url, CAST(i + 1 AS INTEGER), 9) AS g FROM pages, LATERAL (SELECT unnest(range(length(url) - 8)) AS i) WHERE length(url) >= 9),
       p AS (SELECT q.page_id AS qid, r.page_id AS rid, q.i AS a, r.i AS b FROM r q JOIN r USING (g) WHERE q.page_id < 12), n AS (SELECT *, a - row_number() OVER (PARTITION BY qid, rid, a - b ORDER BY a) AS k FROM p)
       SELECT qid, rid, CAST(min(a) AS INTEGER) AS qpos, CAST(min(b) AS INTEGER) AS rpos, count(*) + 8 AS length FROM n GROUP BY qid, rid, a - b, k""",
)
def j17(t):
    """The first twelve pages are searched for in every page."""
    q = t.pages.where("page_id < 12").select(F.col("page_id").alias("qid"), "url")
    return R.substring_matches(q, t.pages.select(F.col("page_id").alias("rid"), "url"), "qid", "rid", "url", 9)


@query("K05_line_profile_sink", "SELECT 'a.cu' AS source, CAST(l_linenumber AS INTEGER) AS line, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 2")
def k05(t):
    profile = t.lineitem.groupBy(F.lit("a.cu").alias("source"), F.col("l_linenumber").alias("line")).agg(F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("n"))
    path = scratch(t.spark)
    sinks.write_line_profile(profile, path, ["q", "n"])
    return text.line_profile(text.lines(t.spark, path), ["q", "n"])


@query("K09_discard", "SELECT count(*) AS n FROM lineitem")
def k09(t):
    sinks.discard(t.lineitem.select("l_orderkey"))
    return t.lineitem.agg(F.count("*").alias("n"))


@query("E04_declared_variables", "SELECT * FROM (VALUES ('ipc', 'line', true, 'scalar', 'float'), ('dramutil', 'heat', false, 'idxVec', 'int')) v(name, plot, reset, organisation, datatype)")
def e04(t):
    return registry.variable_registry(t.spark, ["ipc, line, 1, scalar, float", "dramutil, heat, 0, idxVec, int"])


@query("T04_state_on_disk", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def t04(t):
    counts = S.file_stream(t.spark, t.dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return S.drain(counts, "complete", on_disk=True).select("user_id", "n", r6(F.col("total"), 4).alias("total"))


@query("G26_frontier_sizes", f"WITH RECURSIVE {graphs._E}, b(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 40), d AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1) SELECT depth, count(DISTINCT dst) AS pushed FROM d JOIN e ON src = node GROUP BY 1")
def g26(t):
    """How many distinct nodes each level's frontier pushes."""
    return _pushed(cut(graphs.whole_orders(t)))


def _pushed(e):
    levels = G.bfs(e, 0)
    return levels.join(e, levels.node == e.src).groupBy("depth").agg(F.count_distinct("dst").alias("pushed"))
