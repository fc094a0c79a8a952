"""Running totals, lags, runs, reuse distances, stencils and other ordered operations.

An operator over one global order takes ``block``: expressions that cut the
order into consecutive blocks (a day, a range of keys).  Work is done within
blocks in parallel; only one row a block meets in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: Sequence, value, name: str, partition: Sequence[str] = (), block: Sequence[Column] | None = None, exclusive: bool = False) -> DataFrame:
    """Inclusive (or exclusive) prefix sum of ``value`` in ``order``.

    With ``block`` the sum within blocks is added to the total of all earlier
    blocks (one row a block).  Blocks must be ordered like ``order``; ties in
    ``order`` are summed in an arbitrary but single order.
    """
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    if block is None:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum(v).over(w)
        return df.withColumn(name, total - v if exclusive else total)
    names = [f"_b{k}" for k in range(len(block))]
    cut = df.select("*", *(b.alias(n) for b, n in zip(block, names, strict=True)))
    sums = cut.groupBy(*partition, *names).agg(F.sum(v).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*partition).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("_before", before).select(*(F.col(c).alias(f"o{c}") for c in (*partition, *names)), "_before")
    w = Window.partitionBy(*partition, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn("_in", F.sum(v).over(w))
    on = None
    for c in (*partition, *names):
        same = F.col(c).eqNullSafe(F.col(f"o{c}"))
        on = same if on is None else on & same
    total = F.col("_in") + F.col("_before")
    return inner.join(offsets, on).withColumn(name, total - v if exclusive else total).drop("_in", "_before", *names, *(f"o{c}" for c in (*partition, *names)))


def scanned(df: DataFrame, order: Sequence, name: str, aggregate: Column, partition: Sequence[str]) -> DataFrame:
    """Inclusive scan with any aggregate expression (max, min, ...)."""
    return df.withColumn(name, aggregate.over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def segmented_total(df: DataFrame, order: Sequence, flag: Column, value: str, name: str, partition: Sequence[str]) -> DataFrame:
    """Prefix sum that starts anew at every row where ``flag`` holds."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = df.withColumn("_seg", F.sum(F.when(flag, 1).otherwise(0)).over(w))
    return cut.withColumn(name, F.sum(value).over(Window.partitionBy(*partition, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_seg")


def runs(df: DataFrame, order: Sequence, value: str, partition: Sequence[str]) -> DataFrame:
    """partition, run (from 1), value, start (order value), length of each run of equal consecutive values; nulls are equal."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when((F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0)
    cut = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*partition, "run").agg(F.first(value).alias(value), F.min(F.struct(*order)).alias("start"), F.count("*").alias("length"))


def consecutive_distinct(df: DataFrame, order: Sequence, value: str, partition: Sequence[str]) -> DataFrame:
    """The first row of each run."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w)).where((F.col("_rn") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_rn", "_before")


def paired(df: DataFrame, order: Sequence, carried: str, partition: Sequence[str], name: str) -> DataFrame:
    """Rows two by two: each second row with the first one's ``carried`` as ``name``; an odd last row is dropped."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).withColumn(name, F.lag(carried).over(w)).where("_rn % 2 = 0").drop("_rn")


def delta_encoded(df: DataFrame, order: Sequence, value: str, partition: Sequence[str], name: str = "delta") -> DataFrame:
    """Difference to the row before; the first is absolute."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def delta_decoded(df: DataFrame, order: Sequence, delta: str, partition: Sequence[str], name: str) -> DataFrame:
    return running_total(df, order, delta, name, partition)


def reuse_distance_same(df: DataFrame, address: str, group: str, time: str, tie: str, name: str = "same_distance") -> DataFrame:
    """Time since the latest earlier access of the same address by the same group."""
    return df.withColumn(name, F.col(time) - F.lag(time).over(Window.partitionBy(address, group).orderBy(time, tie)))


def reuse_distance_other(df: DataFrame, address: str, group: str, time: str, tie: str, name: str = "other_distance") -> DataFrame:
    """Time since the latest earlier access of the same address by another group: the last row of the preceding run of groups."""
    w = Window.partitionBy(address).orderBy(time, tie)
    border = F.when(F.lag(group).over(w) != F.col(group), F.lag(time).over(w))
    marked = df.withColumn("_edge", border)
    return marked.withColumn(name, F.col(time) - F.last("_edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_edge")


def downsampled(df: DataFrame, position: str, value: str, most: int = 512, name: str = "mean") -> DataFrame:
    """(bucket, mean): n = length div ``most`` + 1 rows a bucket; the sum is divided by n even for a short last bucket."""
    size = df.agg((F.floor(F.count("*") / most) + 1).alias("n"))
    return df.crossJoin(size).groupBy(F.floor(F.col(position) / F.col("n")).cast("bigint").alias("bucket")).agg((F.sum(value) / F.max("n")).alias(name))


def cumulative_difference(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, name: str) -> DataFrame:
    """Value of each step from a cumulative counter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def weighted_running_mean(df: DataFrame, partition: Sequence[str], order: Sequence, total: str, count: str, name: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.try_divide(F.sum(total).over(w), F.sum(count).over(w)))


def stage_durations(df: DataFrame, key: str, stages: Sequence[str], final: str) -> DataFrame:
    """(key, stage, duration) between successive set stage times, for keys whose final stage is set."""
    done = df.where(F.col(final).isNotNull())
    long = done.select(key, F.posexplode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("t")) for s in stages))).alias("k", "s")).select(key, "k", "s.stage", "s.t").where("t IS NOT NULL")
    w = Window.partitionBy(key).orderBy("k")
    return long.withColumn("duration", F.col("t") - F.lag("t").over(w)).where("duration IS NOT NULL").select(key, "stage", "duration")


def neighbour_minimum(df: DataFrame, row: str, position: str, weight: str, rows: int) -> DataFrame:
    """Last row of: new[i] = weight[row, i] + min(old[i-1..i+1]), from row 0 to ``rows`` - 1 (a bounded loop of windows)."""
    best = df.where(F.col(row) == 0).select(position, F.col(weight).alias("cost"))
    for r in range(1, rows):
        w = Window.partitionBy(F.lit(0)).orderBy(position).rowsBetween(-1, 1)
        least = best.withColumn("least", F.min("cost").over(w)).select(position, "least")
        best = df.where(F.col(row) == r).join(least, position).select(position, (F.col(weight) + F.col("least")).alias("cost"))
    return best


def convolved(cells: DataFrame, i: str, j: str, v: str, kernel: dict[tuple[int, int], float], keep_border: bool = False) -> DataFrame:
    """(i, j, v) of sum of kernel[di, dj] * cell[i + di, j + dj] over cells that have all neighbours (others, with ``keep_border``, unchanged).

    Each cell sends its weighted value to its neighbours: one aggregation, no join.
    """
    sent = F.explode(F.array(*(F.struct((F.col(i) - di).alias("i"), (F.col(j) - dj).alias("j"), (F.col(v) * c).alias("x"), F.lit((di, dj) == (0, 0)).alias("own")) for (di, dj), c in kernel.items())))
    got = cells.select(F.col(v).alias("_v"), sent.alias("s")).groupBy(F.col("s.i").alias(i), F.col("s.j").alias(j)).agg(F.sum("s.x").alias("_sum"), F.count("*").alias("_n"), F.max(F.when(F.col("s.own"), F.col("_v"))).alias("_own"))
    inner = F.col("_n") == len(kernel)
    out = got.where(F.col("_own").isNotNull())
    if keep_border:
        return out.select(i, j, F.when(inner, F.col("_sum")).otherwise(F.col("_own")).alias(v))
    return out.where(inner).select(i, j, F.col("_sum").alias(v))
