"""Run-time declarations: metrics as patterns in classes, and plotted variables as checked specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Classes of metrics: to be differenced between kernels, per kernel, or valid as a last snapshot (fixed values).
METRIC_CLASSES = ("aggregate", "abs", "rate")
#: What a variable specification may say (fixed values).
ORGANISATIONS = ("scalar", "idxVec", "idx2DVec", "vec", "stackbar", "sparse")
DATATYPES = ("int", "float")


def metric_registry(spark: SparkSession, declared: dict[str, list[str]]) -> DataFrame:
    """(class, pattern) of a mapping of classes to patterns with one group; an unknown class is a ValueError."""
    import re

    rows = []
    for name, patterns in declared.items():
        if name not in METRIC_CLASSES:
            raise ValueError(f"class {name}")
        for p in patterns:
            if re.compile(p).groups < 1:
                raise ValueError(f"pattern without a group: {p}")
            rows.append((name, p))
    return spark.createDataFrame(rows, "class string, pattern string")


def variable(spec: str) -> tuple[str, str, bool, str, str]:
    """(name, plot, reset, organisation, datatype) of ``name, plot, reset, organisation, datatype``; what cannot be is a ValueError."""
    parts = [p.strip() for p in spec.split(",")]
    if len(parts) != 5 or not parts[0]:
        raise ValueError(f"five parts are needed: {spec}")
    name, plot, reset, organisation, datatype = parts
    if reset not in ("0", "1") or organisation not in ORGANISATIONS or datatype not in DATATYPES:
        raise ValueError(f"not a variable: {spec}")
    return name, plot, reset == "1", organisation, datatype


def variable_registry(spark: SparkSession, specs: list[str]) -> DataFrame:
    return spark.createDataFrame([variable(s) for s in specs], "name string, plot string, reset boolean, organisation string, datatype string")
