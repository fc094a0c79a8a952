"""What loops over DataFrames share: cutting lineage and testing for convergence."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A path of its own in the folder in ``spark.checkpoint.dir``, deleted when the session's JVM ends.

    Where none is named, a temporary folder of this machine serves a local master;
    on a cluster, whose executors would not see it, that is a RuntimeError.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="millrace-"))
        top = _own[0]
    path = f"{top.rstrip('/')}/millrace/state-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a short plan that no executor's loss undoes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(before: DataFrame, after: DataFrame, columns: list[str]) -> bool:
    """Whether two states hold the same rows: one row of counts and hashes each."""
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return mark(before) == mark(after)
