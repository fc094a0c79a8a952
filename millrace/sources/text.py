"""Scans of line-oriented logs, tables and graphs.

A scan takes lines: a DataFrame (file, no, line), no counting from 0 within a
file.  Order only ever matters within a file, so windows are partitioned by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path) -> DataFrame:
    """Lines of text files with their numbers; a file is one record of the scan, compressed files included."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    body = F.regexp_replace(F.regexp_replace("value", r"\r\n", "\n"), r"\n$", "")
    return whole.select("file", F.posexplode(F.split(body, "\n")).alias("no", "line"))


def _upto() -> Window:
    return Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)


def kernel_list(rows: DataFrame) -> DataFrame:
    """(file, no, kind, line): copies and kernels; any other line is an error."""
    kind = F.when(F.col("line").startswith("Memcpy"), "copy").when(F.col("line").startswith("kernel"), "kernel").otherwise(F.raise_error(F.concat(F.lit("not a kernel list line: "), "line")))
    return rows.select("file", "no", kind.alias("kind"), "line")


def kernel_ids(rows: DataFrame) -> DataFrame:
    """(file, no, kernel_id) of the lines that name a kernel."""
    return rows.where(F.col("line").contains("kernel-")).select("file", "no", F.regexp_extract("line", r"kernel-(\d+)", 1).cast("int").alias("kernel_id"))


def sectioned(rows: DataFrame, numbers: bool = False) -> DataFrame:
    """(file, stat, config, appargs, kernel, value) of a table file in sections.

    A section is a line of dashes, the stat's name, a header with the
    applications (``args--kernel``, split at the first ``--``), and a row for
    each configuration up to a blank line.  ``NA`` is null.  With ``numbers``
    values are doubles, applications upper case, other cells 0, and stats
    without any number are left out.
    """
    marked = rows.withColumn("section", F.sum(F.when(F.col("line").startswith("----"), 1).otherwise(0)).over(_upto())).where("section > 0")
    at = Window.partitionBy("file", "section").orderBy("no")
    placed = marked.withColumn("k", F.row_number().over(at) - 1)
    placed = placed.withColumn("ended", F.max(F.when((F.col("k") > 2) & (F.trim("line") == ""), 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("file", "section")
    cells = F.split("line", ",")
    named = placed.withColumn("stat", F.first(F.when(F.col("k") == 1, cells[0]), ignorenulls=True).over(whole)).withColumn("apps", F.first(F.when(F.col("k") == 2, cells), ignorenulls=True).over(whole))
    data = named.where("k > 2 AND ended = 0").select("file", "stat", "apps", cells.alias("row"), "no")
    long = data.select("file", "stat", F.col("row")[0].alias("config"), F.posexplode(F.slice("row", 2, 1_000_000)).alias("p", "value"), "apps")
    app = F.try_element_at("apps", F.col("p") + 2)
    first = F.instr(app, "--")
    out = long.where(app.isNotNull()).select("file", "stat", "config", F.when(first > 0, F.substring(app, F.lit(1), first - 1)).otherwise(app).alias("appargs"), F.when(first > 0, F.substring(app, first + 2, F.lit(100_000))).otherwise(F.lit("")).alias("kernel"), "value")
    if not numbers:
        return out.withColumn("value", F.nullif(F.col("value"), F.lit("NA")))
    n = F.expr("try_cast(value AS double)")
    any_number = F.max(n.isNotNull().cast("int")).over(Window.partitionBy("file", "stat"))
    return out.withColumn("_any", any_number).where("_any = 1").withColumn("value", F.coalesce(n, F.lit(0.0))).withColumn("appargs", F.upper("appargs")).drop("_any")


def metrics(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(file, no, class, pattern, value): group 1 of every registered pattern that a line matches.

    The registry is a declared list; the optimizer broadcasts it only below its size threshold.
    """
    pairs = rows.join(registry, F.expr("line RLIKE pattern"))
    return pairs.select("file", "no", "class", "pattern", F.expr("regexp_extract(line, pattern, 1)").alias("value"))


def series(rows: DataFrame) -> DataFrame:
    """(file, sample, metric, idx, value) of ``name: n n n`` lines; a metric's k-th line is sample k; NULL tokens are null."""
    parts = F.split("line", ":", 2)
    named = rows.where(F.col("line").rlike("^[^:]+:")).select("file", "no", F.lower(F.trim(parts[0])).alias("metric"), F.trim(parts[1]).alias("v"))
    k = F.row_number().over(Window.partitionBy("file", "metric").orderBy("no")) - 1
    return named.withColumn("sample", k).where("v <> ''").select("file", "sample", "metric", F.posexplode(F.split("v", r"\s+")).alias("idx", "t")).select("file", "sample", "metric", "idx", F.expr("try_cast(nullif(t, 'NULL') AS double)").alias("value"))


def line_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(source, line, columns...) of ``file line : c1 c2 ...``."""
    body = rows.where(F.col("line").rlike(r"^\S+ \d+ :"))
    n = F.regexp_extract_all(F.split("line", ":", 2)[1], F.lit(r"(-?[0-9.]+)"), F.lit(1))
    head = F.split(F.trim(F.split("line", ":", 2)[0]), " ")
    return body.select(head[0].alias("source"), head[1].cast("int").alias("at"), n.alias("n")).select("source", F.col("at").alias("line"), *(F.try_element_at("n", F.lit(k + 1)).cast("bigint").alias(c) for k, c in enumerate(columns)))


def source_map(rows: DataFrame) -> DataFrame:
    """(file, no, source_line): the last ``.loc f l c`` at or above each line."""
    loc = F.when(F.col("line").rlike(r"^\s*\.loc\s"), F.regexp_extract("line", r"\.loc\s+\d+\s+(\d+)", 1).cast("int"))
    return rows.withColumn("loc", loc).select("file", "no", F.last("loc", ignorenulls=True).over(_upto()).alias("source_line"))


def profiler_cycles(rows: DataFrame, marker: str = "==PROF== Disconnected") -> DataFrame:
    """(file, kernel_id, cycles) of the rows after the marker and its header; ids from 1, thousands commas dropped."""
    seen = F.sum(F.when(F.col("line").contains(marker), 1).otherwise(0)).over(_upto())
    after = rows.withColumn("seen", seen).where("seen > 0").where(~F.col("line").contains(marker))
    body = after.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("no"))).where("k > 1")
    cycles = F.regexp_replace(F.regexp_extract("line", r'"cycle","?([0-9.,]+)"?\s*$', 1), ",", "")
    return body.select("file", (F.regexp_extract("line", r'^"?(\d+)', 1).cast("int") + 1).alias("kernel_id"), cycles.try_cast("double").alias("cycles")).where("cycles IS NOT NULL")


def power_samples(rows: DataFrame) -> DataFrame:
    """(file, no, watts); 0 is a bad sample and null."""
    return rows.select("file", "no", F.expr("nullif(try_cast(trim(line) AS double), 0.0)").alias("watts"))


def power_report(rows: DataFrame, first: int = 5, last: int = 37) -> DataFrame:
    """(file, kernel_name, counter, watts): ``key=value`` lines at fixed offsets after each ``kernel_name`` line."""
    start = F.when(F.col("line").rlike(r"kernel_name\s*="), F.col("no"))
    held = rows.withColumn("start", F.last(start, ignorenulls=True).over(_upto())).where("start IS NOT NULL")
    name = F.first(F.when(F.col("no") == F.col("start"), F.regexp_extract("line", r"kernel_name\s*=\s*(\S+)", 1)), ignorenulls=True).over(Window.partitionBy("file", "start"))
    inside = held.withColumn("kernel_name", name).where((F.col("no") - F.col("start")).between(first, last) & F.col("line").contains("="))
    return inside.select("file", "kernel_name", F.trim(F.split("line", "=", 2)[0]).alias("counter"), F.regexp_extract(F.split("line", "=", 2)[1], r"([0-9.eE+-]+)", 1).try_cast("double").alias("watts"))


def gr_graph(rows: DataFrame) -> DataFrame:
    """(src, dst, weight) of ``a from to w`` lines, from 1 in the file and from 0 here; other lines are comments or the header."""
    p = F.split(F.trim("line"), r"\s+")
    return rows.where(F.col("line").startswith("a ")).select((p[1].cast("bigint") - 1).alias("src"), (p[2].cast("bigint") - 1).alias("dst"), p[3].cast("bigint").alias("weight"))


def metis_graph(rows: DataFrame) -> DataFrame:
    """(src, dst): line i after the header lists the neighbours of vertex i, from 1 in the file and from 0 here; ``%`` starts a comment."""
    body = rows.where(~F.col("line").startswith("%")).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("no")) - 2).where("k >= 0")
    return body.select(F.col("k").cast("bigint").alias("src"), F.explode(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).alias("n")).select("src", (F.col("n").cast("bigint") - 1).alias("dst"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """(node, degree, offset): where a node's edges start when edges are sorted by source."""
    from millrace.operators.windows import running_total

    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return running_total(degree, ["node"], "degree", "offset", block=[F.floor(F.col("node") / 65536)], exclusive=True)


def fixed_width(rows: DataFrame, fields: Sequence[tuple[str, int, int, str]]) -> DataFrame:
    """Columns (name, start from 1, length, type) cut from each line."""
    return rows.select(*(F.trim(F.substring("line", start, length)).try_cast(kind).alias(name) for name, start, length, kind in fields))


def settings(rows: DataFrame) -> DataFrame:
    """(file, no, key, value) of lines that start with ``-``."""
    p = F.split(F.trim("line"), r"\s+", 2)
    return rows.where(F.col("line").startswith("-")).select("file", "no", p[0].alias("key"), F.try_element_at(p, F.lit(2)).alias("value"))


def decoded_id(c: Column) -> list[Column]:
    """Device, stream and kernel numbers of a ``d_<n>_s_<n>_k_<n>`` name."""
    return [F.regexp_extract(c, rf"(?:^|_){letter}_(\d+)", 1).try_cast("int").alias(name) for letter, name in (("d", "device"), ("s", "stream"), ("k", "kernel"))]


def static_metadata(spark: SparkSession, path) -> DataFrame:
    """(benchmark, kernel, instruction, operands) of nested JSON documents, with an explicit schema (no pass to infer one)."""
    kind = "benchmark_name string, kernels array<struct<kernel_name:string, unique_function_id:bigint, instructions:array<struct<pc:bigint, operands:array<struct<operand_string:string>>>>>>"
    doc = spark.read.schema(kind).json(path, multiLine=True)
    kernel = doc.select("benchmark_name", F.explode_outer("kernels").alias("k"))
    return kernel.select("benchmark_name", "k.kernel_name", "k.unique_function_id", F.posexplode_outer("k.instructions").alias("seq", "i")).select("benchmark_name", "kernel_name", "unique_function_id", "seq", "i.pc", "i.operands")


def app_suites(text: str, spark: SparkSession) -> DataFrame:
    """(suite, exec, args) of a small YAML mapping of suites to ``execs`` lists of ``name: [args, ...]``; a definition file is read on the driver."""
    import yaml

    rows = [(suite, str(name), None if not args else str(a)) for suite, body in (yaml.safe_load(text) or {}).items() for entry in (body or {}).get("execs", []) for name, args in entry.items() for a in (args or [None])]
    return spark.createDataFrame(rows, "suite string, exec string, args string")
