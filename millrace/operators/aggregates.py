"""Summaries, histograms, quantiles by two rules, error reports and counters.

Everything aggregates partially before it is dealt out; quantiles that need all
values of a group use Spark's own percentile, or the ranks of a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax(df: DataFrame, keys: Sequence[str], value: str, idx: str) -> DataFrame:
    """(keys, value, idx) of the largest value, ties to the smaller idx."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(idx)).alias("i")))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(value), (-F.col("b.i")).alias(idx))


def argmin(df: DataFrame, keys: Sequence[str], value: str, idx: str) -> DataFrame:
    """(keys, value, idx) of the smallest value, ties to the smaller idx."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(idx).alias("i")))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(value), F.col("b.i").alias(idx))


def histogram(df: DataFrame, bin_: Column, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(keys, bin, n); ``most`` makes the counts saturate."""
    n = F.count("*")
    return df.groupBy(*keys, bin_.alias("bin")).agg((F.least(n, F.lit(most)) if most is not None else n).cast("bigint").alias("n"))


def bin_log2(v: Column) -> Column:
    """0 for 0, else floor(log2 v) + 1: the length of the binary form."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def bin_linear(v: Column, stride, bins: int) -> Column:
    """v div stride, the last bin open."""
    return F.least(F.floor(v / stride), F.lit(bins - 1)).cast("bigint")


def bin_clamped(v: Column, size, bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(v / size), F.lit(bins - 1))).cast("bigint")


#: Upper ends of the distance classes (fixed values); the last class is above them.
DISTANCE_EDGES = (5, 10, 20, 30, 40, 50, 100, 200)


def bin_thresholds(v: Column, edges: Sequence = DISTANCE_EDGES) -> Column:
    """Label of the first edge that is not exceeded."""
    out = F
    for e in edges:
        out = out.when(v <= e, F.lit(f"<={e}"))
    return out.otherwise(F.lit(f">{edges[-1]}"))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, sum, min, max, avg of the values that are numbers."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))


def moments_pop(df: DataFrame, keys: Sequence[str], value: str, zero_is_missing: bool = False) -> DataFrame:
    """Mean and population deviation and variance, and count; zeros count as missing samples if asked."""
    v = F.nullif(F.col(value), F.lit(0.0)) if zero_is_missing else F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.var_pop(v).alias("var_pop"), F.count(v).alias("n"))


def percentile_n_plus_1(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Percentile at position (n + 1) q / 100 - 1 of the sorted values, linear between neighbours.

    Positions before the first and after the last value give the least and the
    largest; of two values the weight is q / 100.  Ranks come from a window, so
    no group is gathered in an array.
    """
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")).withColumn("r", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w))
    at = F.greatest(F.lit(0.0), F.least((F.col("n") + 1) * F.lit(q / 100) - 1, (F.col("n") - 1).cast("double")))
    lo, hi = F.max(F.when(F.col("r") == F.floor("at"), F.col("v"))), F.max(F.when(F.col("r") == F.ceil("at"), F.col("v")))
    by = ranked.withColumn("at", F.when(F.col("n") == 2, F.lit(min(max(q / 100, 0.0), 1.0))).otherwise(at)).groupBy(*keys)
    return by.agg(lo.alias("lo"), hi.alias("hi"), F.max("at").alias("at")).select(*keys, (F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))).alias("percentile"))


def percent_matching(flag: Column) -> Column:
    """100 * matching / all, 0 for none."""
    n = F.count("*")
    return F.when(n > 0, 100.0 * F.count(F.when(flag, 1)) / n).otherwise(0.0)


def relative_error(observed: Column, expected: Column) -> Column:
    """Signed error in percent; null where nothing is expected."""
    return F.when(expected != 0, 100 * (observed - expected) / expected)


def error_summary(df: DataFrame, keys: Sequence[str], error: str, observed: str | None = None, expected: str | None = None) -> DataFrame:
    """Mean, extremes, quartiles, sample deviation, mean absolute error, count of errors of 100 % or more, and correlation, for each suite, in one aggregation."""
    e = F.col(error)
    q = F.percentile(e, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    extra = [F.corr(observed, expected).alias("corr")] if observed and expected else []
    out = df.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.min(e).alias("least"), F.max(e).alias("most"), q.alias("_q"), F.stddev_samp(e).alias("std_samp"), F.var_samp(e).alias("var_samp"), F.avg(F.abs(e)).alias("mean_abs"), F.count(F.when(F.abs(e) >= 100, 1)).alias("n_100"), *extra)
    return out.select(*keys, "n", "mean", "least", "most", *(F.col("_q")[k].alias(name) for k, name in enumerate(("q25", "median", "q75", "q90"))), "std_samp", "var_samp", "mean_abs", "n_100", *(["corr"] if extra else []))


def normalised_ratio(df: DataFrame, keys: Sequence[str], config: str, error: str, base: str) -> DataFrame:
    """(100 + error of ``base``) / (100 + error), beside each row of the same keys; null without a base row."""
    b = df.where(F.col(config) == base).groupBy(*keys).agg(F.min(error).alias("_base"))
    return df.join(b, list(keys), "left").withColumn("ratio", F.try_divide(100 + F.col("_base"), 100 + F.col(error))).drop("_base")


def floored_moments(df: DataFrame, columns: Sequence[str], eps: float = 0.005) -> DataFrame:
    """(column, mean, std): population deviation, 1 where it is not above ``eps``; one pass for all columns."""
    one = df.agg(*(F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.mean").alias("mean"), F.when(F.col(f"{c}.std") <= eps, 1.0).otherwise(F.col(f"{c}.std")).alias("std")) for c in columns))).alias("r"))
    return rows.select("r.*")


def pair_matrix(df: DataFrame, columns: Sequence[str], kind: str = "corr") -> DataFrame:
    """(a, b, value) for all column pairs from one aggregation: ``corr``, or ``scatter`` (sum of centred products, not divided by n)."""
    value = {"corr": F.corr, "scatter": lambda a, b: F.covar_pop(a, b) * F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))}[kind]
    names = [(a, b) for a in columns for b in columns]
    one = df.agg(*(value(a, b).alias(f"_{k}") for k, (a, b) in enumerate(names)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("value")) for k, (a, b) in enumerate(names)))).alias("r")).select("r.*")


def pivoted(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, value: Column) -> DataFrame:
    """A column for each of the named ``values`` (naming them spares a pass over the data)."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(value)


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, counts: map of inner to count)."""
    return df.groupBy(outer, inner).agg(F.count("*").alias("n")).groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "n")))).alias("counts"))


def linear_score(counters: DataFrame, coefficients: DataFrame, on: str, keys: Sequence[str], count: str, coefficient: str) -> DataFrame:
    """Sum of counter times coefficient; counters without one add nothing."""
    return counters.join(coefficients, on).groupBy(*keys).agg(F.sum(F.col(count) * F.col(coefficient)).alias("score"))
