"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.iterate import scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of its own in the folder that ``spark.checkpoint.dir`` names, and read it again.

    What is read no longer depends on executors' memory or shuffle files.  The
    table is deleted by ``discard``, or when the session's JVM ends; ``name``
    says what it holds.
    """
    path = f"{scratch(df.sparkSession)}/{name}"
    with _set(df.sparkSession, _FREE, "true"):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)  # most columns are hashes and ids
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A query's shuffle files go when it ends: nothing reads them once its result is a table.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _set(spark: SparkSession, name: str, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside: bounds the memory of wide rows on both sides of Python."""
    return _set(spark, _BATCH, rows)


def keep_batches_small(spark: SparkSession, rows: int) -> None:
    """Arrow batches of at most ``rows`` rows in this session from now on, or fewer where it says so.

    For steps that return a narrow pass which the caller runs: the setting must
    still hold then.  Results do not depend on it.
    """
    now = int(spark.conf.get(_BATCH))
    if not 0 < now <= rows:
        spark.conf.set(_BATCH, rows)


_RULES = "spark.sql.optimizer.excludedRules"


def _without_rule(spark: SparkSession, name: str):
    rules = filter(None, [spark.conf.get(_RULES, None), f"org.apache.spark.sql.catalyst.optimizer.{name}"])
    return _set(spark, _RULES, ",".join(rules))


def held_joins(spark: SparkSession):
    """Semi joins of what runs inside stay above the exchange that their sides share, so it is made once."""
    return _without_rule(spark, "PushDownLeftSemiAntiJoin")


def held_generators(spark: SparkSession):
    """Generators of what runs inside make what they take apart once: no filter beneath makes it again to leave out empty ones."""
    return _without_rule(spark, "InferFiltersFromGenerate")


def room_for_groups(spark: SparkSession, bits: int):
    """Compiled aggregates of what runs inside keep up to 2 ** bits groups in their first, faster hash table."""
    return _set(spark, "spark.sql.codegen.aggregate.fastHashMap.capacityBit", bits)


def give_back(spark: SparkSession) -> bool:
    """Memory that the driver's Python and JVM have freed goes back to the system; whether both C libraries could be told.

    Planning and compiling many queries leaves hundreds of MB in the allocators of
    both processes, outside the JVM's heap, and they grow with every call.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
    if trim is not None:
        trim(0)
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    try:
        # the server's own class is not open to reflection, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # the command, its name, neither arguments nor their types
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # a JVM without the command keeps what it has
        return False
    return trim is not None
