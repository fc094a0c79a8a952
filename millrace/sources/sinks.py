"""Writers.  Each writes in parallel; where a format wants one ordered file, the caller asks for one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivoted(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """A row for each key, a column for each of the named values."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(value))


def matrix(df: DataFrame, stat: str, config: str, app: str, value: str, configs: Sequence[str], apps: Sequence[str], configs_as_rows: bool) -> DataFrame:
    """One stat as a table: applications by configurations, or the other way round."""
    return pivoted(df, [stat, config], app, apps, value) if configs_as_rows else pivoted(df, [stat, app], config, configs, value)


def write_csv(df: DataFrame, path: str, header: bool = True, append: bool = False, compression: str | None = None) -> None:
    """CSV files; appending writes new files with a header each and leaves the old ones."""
    writer = df.write.mode("append" if append else "overwrite").option("header", header)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def trial_table(df: DataFrame, keys: Sequence[str], trial: str, value: str, trials: int) -> DataFrame:
    """keys, median, mean, std_pop, min, max, trial0 ...; N/A for a missing trial."""
    stats = df.groupBy(*keys).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.min(value).alias("least"), F.max(value).alias("most"))
    wide = df.groupBy(*keys).pivot(trial, list(range(trials))).agg(F.first(value))
    named = wide.select(*keys, *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("N/A")).alias(f"trial{k}") for k in range(trials)))
    return stats.join(named, list(keys))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def grouped_rows(df: DataFrame, block: str, warp: str, seq: str) -> DataFrame:
    """Rows dealt out by block and in order within, each with its warp's row count."""
    from pyspark.sql import Window

    counted = df.withColumn("n_rows", F.count("*").over(Window.partitionBy(block, warp)))
    return counted.repartition(block).sortWithinPartitions(block, warp, seq)


def write_grouped(df: DataFrame, path: str, block: str, warp: str, seq: str) -> None:
    grouped_rows(df, block, warp, seq).write.mode("overwrite").partitionBy(block).json(path)


def discard(df: DataFrame) -> None:
    """Run the plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def patched(template: DataFrame, measured: DataFrame) -> DataFrame:
    """Template lines (no, line) with ``-key value`` replaced where (key, value) is measured, in order."""
    key = F.split(F.trim("line"), r"\s+")[0]
    t = template.withColumn("key", F.when(F.col("line").startswith("-"), key))
    line: Column = F.when(F.col("value").isNotNull(), F.concat_ws(" ", "key", "value")).otherwise(F.col("line"))
    return t.join(measured, "key", "left").select("no", line.alias("line")).orderBy("no")


def write_line_profile(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """``source line : c1 c2 ...`` for each (source, line)."""
    text = F.concat_ws(" ", "source", F.col("line").cast("string"), F.lit(":"), *(F.col(c).cast("string") for c in columns))
    df.select(text.alias("value")).write.mode("overwrite").text(path)
