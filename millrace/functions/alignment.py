"""Alignment scores by dynamic programming: each cell needs three earlier ones, so rows are computed in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _score(a: str, b: str, match: int, mismatch: int, gap: int, local: bool) -> int:
    """Best score, with one row of the table kept; gaps within a row are a running maximum."""
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(y) + 1) * gap
    row = np.zeros(len(y) + 1, np.int64) if local else steps.copy()
    best = 0
    for k, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        new = np.empty_like(row)
        new[0] = 0 if local else k * gap
        new[1:] = np.maximum(row[:-1] + np.where(y == c, match, mismatch), row[1:] + gap)
        if local:
            new = np.maximum(new, 0)
        row = np.maximum.accumulate(new - steps) + steps
        best = max(best, int(row.max()))
    return best if local else int(row[-1])


def _udf(match: int, mismatch: int, gap: int, local: bool):
    @F.pandas_udf("bigint")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _score(x, y, match, mismatch, gap, local) for x, y in zip(a, b, strict=True)], dtype="Int64")

    return score


def global_alignment(match: int, mismatch: int, gap: int):
    """Score of aligning two strings end to end; null if either is."""
    return _udf(match, mismatch, gap, False)


def local_alignment(match: int, mismatch: int, gap: int):
    """Score of the best aligned pair of substrings, 0 at least; null if either string is."""
    return _udf(match, mismatch, gap, True)
