"""Binary traces: a protobuf wire reader as a Python data source, and the lossless row codecs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "block struct<x:int,y:int,z:int>, warp int, seq int, pc bigint, active_mask bigint, predicate_mask bigint, function_unique_id int, addresses array<struct<data_width:int,udesc_value:bigint,compression_format:int,base_address:bigint,stride:int,addrs:array<bigint>>>"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of one message: varints as numbers, length-delimited fields as bytes; cut data is a ValueError."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= end:
                raise ValueError("the message is cut off")
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            if at + size > end:
                raise ValueError("the message is cut off")
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


def signed(n: int, bits: int = 64) -> int:
    n &= (1 << 64) - 1
    n = n - (1 << 64) if n >> 63 else n
    return (n + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))


def _packed(value) -> list[int]:
    if isinstance(value, int):
        return [signed(value)]
    out, n, shift = [], 0, 0
    for b in value:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(signed(n))
            n = shift = 0
    return out


def _address(data: bytes) -> tuple:
    plain, addrs = {}, []
    for k, v in fields(data):
        if k == 6:
            addrs += _packed(v)
        else:
            plain[k] = v
    return signed(plain.get(1, 0), 32), plain.get(2, 0), signed(plain.get(3, 0), 32), signed(plain.get(4, 0)), signed(plain.get(5, 0), 32), addrs


def block_rows(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of one thread block message, by warp and position."""
    block, warps = (0, 0, 0), {}
    for k, v in fields(data):
        if k == 1:
            xyz = dict(fields(v))
            block = tuple(signed(xyz.get(i, 0), 32) for i in (1, 2, 3))
        elif k == 2:
            entry = dict(fields(v))
            warps[signed(entry.get(1, 0), 32)] = entry.get(2, b"")
    for warp in sorted(warps):
        for seq, ins in enumerate(x for k, x in fields(warps[warp]) if k == 2):
            plain, addresses = {}, []
            for k, v in fields(ins):
                if k == 5:
                    addresses.append(_address(v))
                else:
                    plain[k] = v
            yield block, warp, seq, plain.get(1, 0), plain.get(2, 0), plain.get(3, 0), signed(plain.get(4, 0), 32), addresses


def read_blocks(spark, path) -> DataFrame:
    """The instruction table of thread block files: files are read by Spark (any store), decoded in Arrow batches of a few files."""
    import pyarrow as pa

    schema = T._parse_datatype_string("file string, " + SCHEMA)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        names = [f.name for f in kind]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for r in block_rows(content):
                    addresses = [dict(zip(("data_width", "udesc_value", "compression_format", "base_address", "stride", "addrs"), a, strict=True)) for a in r[7]]
                    rows.append(dict(zip(names, (file, dict(zip("xyz", r[0], strict=True)), *r[1:7], addresses), strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return raw.mapInArrow(run, schema)


# --- lossless row codecs -----------------------------------------------------


def encode_masks(rows: DataFrame) -> DataFrame:
    """Masks that are the default become null: ``flags`` bit 0 for all lanes active, bit 1 for a predicate equal to the active mask."""
    full = F.col("active_mask") == 4294967295
    same = F.col("predicate_mask") == F.col("active_mask")
    flags = F.when(full, 1).otherwise(0) + F.when(same, 2).otherwise(0)
    return rows.withColumn("flags", flags).withColumn("predicate_mask", F.when(~same, F.col("predicate_mask"))).withColumn("active_mask", F.when(~full, F.col("active_mask")))


def decode_masks(rows: DataFrame) -> DataFrame:
    active = F.when(F.col("flags").bitwiseAND(F.lit(1)) != 0, F.lit(4294967295)).otherwise(F.col("active_mask"))
    predicate = F.when(F.col("flags").bitwiseAND(F.lit(2)) != 0, active).otherwise(F.col("predicate_mask"))
    return rows.withColumn("predicate_mask", predicate).withColumn("active_mask", active).drop("flags")


def encode_runs(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, seq, pc_start, pc_delta, flags, count) for runs of at least ``least`` rows without addresses with one step and equal flags; other rows have count 1."""
    w = Window.partitionBy(*keys).orderBy("seq")
    plain = F.coalesce(F.size("addresses"), F.lit(0)) <= 0
    step = F.col("pc") - F.lag("pc").over(w)
    marked = rows.withColumn("_plain", plain).withColumn("_step", step)
    same = F.col("_plain") & F.lag("_plain").over(w) & (F.lag("flags").over(w) == F.col("flags"))
    cut = marked.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_grp", F.sum(F.when(F.col("_same") & (F.col("_step") == F.lag("_step").over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut.groupBy(*keys, "_grp").agg(F.min("seq").alias("seq"), F.min_by("pc", "seq").alias("pc_start"), F.max_by("_step", "seq").alias("pc_delta"), F.min_by("flags", "seq").alias("flags"), F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("seq", "pc"))).alias("rows"))
    long = runs.where(F.col("count") >= least).select(*keys, "seq", "pc_start", "pc_delta", "flags", "count")
    short = runs.where(F.col("count") < least).select(*keys, "flags", F.explode("rows").alias("r")).select(*keys, F.col("r.seq").alias("seq"), F.col("r.pc").alias("pc_start"), F.lit(0).cast("bigint").alias("pc_delta"), "flags", F.lit(1).cast("bigint").alias("count"))
    return long.unionByName(short)


def decode_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, pc, flags) of every row."""
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("k")
    return runs.select(*keys, "seq", "pc_start", "pc_delta", "flags", k).select(*keys, (F.col("seq") + F.col("k")).alias("seq"), (F.col("pc_start") + F.col("k") * F.col("pc_delta")).alias("pc"), "flags")
