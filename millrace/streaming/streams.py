"""Streaming forms of the windowed and stateful statistics.

Event time is a TIMESTAMP (zone-less columns are read in the session's zone).
``drain`` runs a stream over all files present and returns its result as a
table in the shared folder; the same plans run continuously with another trigger.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.iterate import scratch


def file_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet table ``name`` in a folder: one file, or a folder of files."""
    batch = spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(batch.schema).option("recursiveFileLookup", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{folder}/{name}.parquet*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain(stream: DataFrame, mode: str = "append", on_disk: bool = False) -> DataFrame:
    """Everything the stream gives for the files present: each batch is appended, or replaces the last (mode complete), exactly once by its number.

    ``on_disk`` keeps the operators' state in RocksDB, so it may outgrow memory.
    """
    spark = stream.sparkSession
    out, state = scratch(spark), scratch(spark)
    before = spark.conf.get(_PROVIDER)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    if on_disk:
        spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(out if mode == "complete" else f"{out}/batch=*")


def tumbling(events: DataFrame, ts: str, every: str, keys: list[str], *aggregates: Column, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates of each window of event time, sliding if asked; ``late`` is how long a window waits for late rows."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if late else timed
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    return timed.groupBy(w.alias("w"), *keys).agg(*aggregates).withColumn("start", F.col("w.start")).drop("w")


def without_repeats(events: DataFrame, ts: str, keys: list[str], within: str) -> DataFrame:
    """The first row of each key; state of a key is dropped once the watermark has passed it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def up_down(starts: DataFrame, ends: DataFrame, key: str, at: str, name: str = "open") -> DataFrame:
    """(key, at, open) after each event: +1 on a start and -1 on an end (ends first at equal times)."""
    both = starts.select(key, at, F.lit(1).alias("_d")).unionByName(ends.select(key, at, F.lit(-1).alias("_d")))
    return both.withColumn(name, F.sum("_d").over(Window.partitionBy(key).orderBy(at, "_d").rowsBetween(Window.unboundedPreceding, 0))).select(key, at, name)


def in_flight(starts: DataFrame, ends: DataFrame, key: str, at: str) -> DataFrame:
    """(key, opened, closed) of each start with the first end of its key at or after it (null while open); an end without a start is no row.

    On streams with watermarks this is a stream-stream join on the key; in a batch one window goes over
    each key's starts and ends, latest first.
    """
    s = starts.select(key, F.col(at).alias("_at"), F.lit(0).alias("_side")).distinct()
    e = ends.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    next_end = F.last(F.when(F.col("_side") == 1, F.col("_at")), ignorenulls=True).over(w)
    both = s.unionByName(e).withColumn("closed", next_end).where("_side = 0")
    return both.select(key, F.col("_at").alias("opened"), F.when(F.col("_at").isNotNull(), F.col("closed")).alias("closed"))


#: Amounts below this are added as decimals, whose sums have no rounding.
_EXACT = 1e9


def idle_attribution(idle: DataFrame, open_: DataFrame, width: float) -> DataFrame:
    """(key, total): each idle amount counts in full for every interval [opened, closed) that is open at its time.

    No interval meets an amount: a key's total is the sum, over its intervals, of
    what was idle before they close less what was idle before they open.  Sums
    over time are taken inside blocks of ``width``, and over one row a block.
    """
    x = F.col("amount").cast("double")
    finite, plain = F.abs(x) < float("inf"), F.abs(x) < _EXACT
    exact = x.cast("decimal(38,14)")
    parts = {
        "n": F.lit(1),
        "known": x.isNotNull().cast("int"),
        "nan": F.coalesce(F.isnan(x), F.lit(False)).cast("int"),
        "up": F.coalesce(x == float("inf"), F.lit(False)).cast("int"),
        "down": F.coalesce(x == float("-inf"), F.lit(False)).cast("int"),
        "exact": F.coalesce(F.when(plain, exact), F.lit(0).cast("decimal(38,14)")),
        "rest": F.coalesce(F.when(plain, x - exact.cast("double")).when(finite, x), F.lit(0.0)),
    }
    spans = open_.where("opened < closed")
    marks = spans.select("key", F.col("opened").alias("at"), F.lit(-1).alias("sign")).unionByName(spans.select("key", F.col("closed").alias("at"), F.lit(1).alias("sign")))
    marks = marks.groupBy("key", "at").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    amounts = idle.where("at IS NOT NULL").select("at", *(c.alias(k) for k, c in parts.items()))
    rows = marks.withColumn("_side", F.lit(0)).unionByName(amounts.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("_b", F.floor(F.col("at") / width).cast("bigint"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_b").agg(*(F.sum(k).alias(k) for k in parts)).select("_b", *(F.sum(k).over(before).alias(f"_{k}") for k in parts))
    inside = Window.partitionBy("_b").orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    at_marks = rows.select("key", "sign", "_side", "_b", *(F.sum(k).over(inside).alias(k) for k in parts)).where("_side = 0").join(blocks, "_b")
    zero = {k: F.lit(0).cast("decimal(38,14)") if k == "exact" else F.lit(0) for k in parts}
    so_far = {k: F.coalesce(F.col(k), zero[k]) + F.coalesce(F.col(f"_{k}"), zero[k]) for k in parts}
    signed = {k: F.when(F.col("sign") == 1, c).when(F.col("sign") == -1, -c).otherwise(c * F.col("sign")) for k, c in so_far.items()}
    sums = at_marks.groupBy("key").agg(*(F.sum(c).alias(k) for k, c in signed.items())).where("n > 0")
    total = F.when(F.col("known") > 0, F.when((F.col("nan") > 0) | ((F.col("up") > 0) & (F.col("down") > 0)), float("nan")).when(F.col("up") > 0, float("inf")).when(F.col("down") > 0, float("-inf")).otherwise(F.col("exact").cast("double") + F.col("rest")))
    return sums.select("key", total.alias("total"))


def locality_runs(df: DataFrame, bank: str, order: list[str], row: str, at: str) -> DataFrame:
    """(bank, accesses, service): the longest run of accesses to one row of each bank, and the longest time a run took."""
    w = Window.partitionBy(bank).orderBy(*order)
    new = F.when((F.row_number().over(w) == 1) | ~F.lag(row).over(w).eqNullSafe(F.col(row)), 1).otherwise(0)
    cut = df.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = cut.groupBy(bank, "_run").agg(F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("t"))
    return each.groupBy(bank).agg(F.max("n").alias("accesses"), F.max("t").alias("service"))


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """(key, start, n) of groups of events no further apart than ``gap``."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def completed(events: DataFrame, key: str, final: Column) -> DataFrame:
    """Rows of keys that have reached the final stage."""
    return events.join(events.where(final).select(key).distinct(), key, "left_semi")


def delayed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Each element's earliest time of leaving a queue of fixed delay."""
    return events.withColumn("leaves", F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {delay}"))


def hysteresis(df: DataFrame, bank: str, order: list[str], level: str, high: float, low: float) -> DataFrame:
    """Rows with ``mode``: write from the first level at or above ``high`` on, read from the first below ``low`` on, read at the start.

    The mode is that of the last crossing, so a fill-forward window does it.
    """
    crossing = F.when(F.col(level) >= high, "write").when(F.col(level) < low, "read")
    w = Window.partitionBy(bank).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("mode", F.coalesce(F.last(crossing, ignorenulls=True).over(w), F.lit("read")))


def first_ready_first_come(requests: DataFrame, bank: str, at: str, idx: str, row: str, hit: int, miss: int) -> DataFrame:
    """(bank, idx, served): each bank serves the oldest waiting request to its open row, else the oldest of all; a service takes ``hit`` or ``miss``.

    Each step depends on the last, so a bank is one sequence in one task, in
    memory bounded by its waiting requests only through Arrow's batches; banks are independent.
    """
    import heapq

    def serve(pdf: pd.DataFrame) -> pd.DataFrame:
        queue = list(pdf.sort_values([at, idx])[[at, idx, row]].itertuples(index=False, name=None))
        waiting: list = []
        by_row: dict = {}
        served: dict = {}
        now, open_row, k = 0, None, 0
        while len(served) < len(queue):
            if not waiting and k < len(queue):
                now = max(now, queue[k][0])
            while k < len(queue) and queue[k][0] <= now:
                heapq.heappush(waiting, queue[k])
                by_row.setdefault(queue[k][2], []).append(queue[k])
                k += 1
            ready = by_row.get(open_row, [])
            while ready and ready[0][1] in served:
                ready.pop(0)
            while waiting and waiting[0][1] in served:
                heapq.heappop(waiting)
            if not ready and not waiting:
                continue
            pick = ready[0] if ready else waiting[0]
            now += hit if pick[2] == open_row else miss
            open_row = pick[2]
            served[pick[1]] = now
        return pd.DataFrame({bank: pdf[bank].iloc[0], idx: list(served), "served": list(served.values())})

    kind = {f.name: f.dataType.simpleString() for f in requests.schema}
    return requests.select(bank, at, idx, row).groupBy(bank).applyInPandas(serve, f"{bank} {kind[bank]}, {idx} {kind[idx]}, served bigint")


def polled(spark: SparkSession, poll, every_seconds: float = 1.0, timeout: float = 60.0) -> DataFrame:
    """The first poll (a DataFrame with a status column) without running or waiting jobs; TimeoutError after ``timeout``."""
    import time

    end = time.monotonic() + timeout
    while True:
        jobs = poll()
        if not jobs.where(F.col("status").isin("running", "waiting")).take(1):
            return jobs
        if time.monotonic() > end:
            raise TimeoutError("jobs are still running")
        time.sleep(every_seconds)


def sampled(df: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` rows, the count of all): after the limit rows are only counted."""
    return df.orderBy(*order).limit(limit), df.agg(F.count("*").alias("n"))
