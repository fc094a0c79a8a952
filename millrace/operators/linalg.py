"""Sparse and dense linear algebra over (i, j, v) tables, and clustering.

Products are equi-joins on the inner index followed by one aggregation, which
combines before it is dealt out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import squared_distance
from millrace.operators.iterate import cut


def spmv(matrix: DataFrame, vector: DataFrame, transpose: bool = False) -> DataFrame:
    """(i, v) of A x, or of A' x; rows without entries are absent."""
    row, col = ("j", "i") if transpose else ("i", "j")
    x = vector.select(F.col("i").alias(col), F.col("v").alias("_x"))
    return matrix.join(x, col).groupBy(F.col(row).alias("i")).agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(i, j, v) of alpha A B + beta C."""
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("w"))
    product = a.select("i", F.col("j").alias("k"), "v").join(right, "k").select("i", "j", (F.col("v") * F.col("w") * alpha).alias("v"))
    if c is not None:
        product = product.unionByName(c.select("i", "j", (F.col("v") * beta).alias("v")))
    return product.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def syrk(a: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A A' + beta C."""
    return gemm(a, transposed(a), c, alpha, beta)


def syr2k(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha (A B' + B A') + beta C."""
    return gemm(b, transposed(a), gemm(a, transposed(b), c, alpha, beta), alpha, 1.0)


def atax(a: DataFrame, x: DataFrame) -> DataFrame:
    return spmv(a, spmv(a, x), transpose=True)


def gesummv(a: DataFrame, b: DataFrame, x: DataFrame, alpha: float, beta: float) -> DataFrame:
    """alpha A x + beta B x."""
    scaled = a.select("i", "j", (F.col("v") * alpha).alias("v")).unionByName(b.select("i", "j", (F.col("v") * beta).alias("v")))
    return spmv(scaled, x)


def triad(df: DataFrame, a: str, b: str, s: float, name: str) -> DataFrame:
    return df.withColumn(name, F.col(a) + s * F.col(b))


def nearest_centre(points: DataFrame, centres: DataFrame, idx: str, vector: str, max_centres: int = 10_000) -> DataFrame:
    """(idx, centre, d2): the nearest centre, the first of equals.  Centres are broadcast, and counted before."""
    if centres.count() > max_centres:
        raise ValueError("too many centres to compare every point with")
    pairs = points.select(idx, vector).crossJoin(F.broadcast(centres.select(F.col("centre"), F.col("position"))))
    best = pairs.groupBy(idx).agg(F.min(F.struct(squared_distance(F.col(vector), F.col("position")).alias("d2"), "centre")).alias("b"))
    return best.select(idx, F.col("b.centre").alias("centre"), F.col("b.d2").alias("d2"))


def kmeans(points: DataFrame, idx: str, vector: str, k: int, threshold: int = 0, max_rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """(centres, assignment): the k points of least id are the first centres; an empty cluster keeps its centre; ends when at most ``threshold`` points change.

    Points are packed once; a round is one pass over them that gives sums a
    centre for each task, and compares the nearest of these centres with the
    nearest of the last ones, so nothing is joined or written.  Points with null,
    non-finite or missing components and repeated ids go the way by joins.
    """
    rows = points.select(idx, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    centres = cut(rows.orderBy(idx).limit(k).select((F.row_number().over(Window.orderBy(idx)) - 1).alias("centre"), F.col(vector).alias("position")))
    first = [r["position"] for r in centres.orderBy("centre").toLocalIterator()]
    d = len(first[0]) if first and first[0] else 0
    fits = (F.size(vector) == d) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct(idx).alias("ids"), F.count(F.when(fits, 1)).alias("fit")).first()
    if d == 0 or len(first) * d > _SENT or not seen["n"] == seen["ids"] == seen["fit"]:
        return _kmeans_joined(rows, centres, idx, vector, threshold, max_rounds)

    def pack(batches):
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.column(0).slice(a, 2048)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.flatten(), np.float64).tobytes()], pa.binary())], names=["x"])

    def passed(now, last):
        def run(batches):
            changed, n, total = 0, np.zeros(len(now), np.int64), np.zeros(now.shape)
            for batch in batches:
                for raw in batch.column(0):
                    x = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, d)
                    label = _nearest(x, now)[0]
                    changed += 0 if last is None else int((label != _nearest(x, last)[0]).sum())
                    n += np.bincount(label, minlength=len(now))
                    for c in np.unique(label):
                        total[c] += x[label == c].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([changed]), *(pa.array([z.tobytes()], pa.binary()) for z in (n, total))], names=["changed", "n", "total"])

        got = packed.mapInArrow(run, "changed bigint, n binary, total binary").collect()
        return sum(r["changed"] for r in got), sum(np.frombuffer(r["n"], np.int64) for r in got), sum(np.frombuffer(r["total"]).reshape(now.shape) for r in got)

    def assigned(now):
        def run(batches):
            for batch in batches:
                label, d2 = _nearest(np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, d), now)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(d2)], names=[idx, "centre", "d2"])

        return cut(rows.mapInArrow(run, f"`{idx}` {rows.schema[idx].dataType.simpleString()}, centre int, d2 double"))

    conf = rows.sparkSession.conf
    size = conf.get(_ARROW_ROWS)
    packed = cut(rows.select(vector).mapInArrow(pack, "x binary"))
    now, last, settled_ = np.array(first, np.float64), None, False
    conf.set(_ARROW_ROWS, 8)
    try:
        for _ in range(max_rounds):
            changed, n, total = passed(now, last)
            settled_ = last is not None and changed <= threshold
            if settled_:
                break
            last, now = now, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now)
    finally:
        conf.set(_ARROW_ROWS, size)
    made = rows.sparkSession.createDataFrame([(c, x.tolist()) for c, x in enumerate(now)], "centre int, position array<double>")
    return made, assigned(now if settled_ or last is None else last)


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Components of all centres that a task may give for its sums.
_SENT = 100_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest centre of each row, the first of equals; components are added in their order."""
    columns = np.ascontiguousarray(x.T)
    label, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for c, centre in enumerate(centres):
        d2 = np.zeros(len(x))
        for column, v in zip(columns, centre, strict=True):
            off = column - v
            d2 += off * off
        nearer = d2 < best
        label[nearer], best[nearer] = c, d2[nearer]
    return label, best


def _kmeans_joined(rows: DataFrame, centres: DataFrame, idx: str, vector: str, threshold: int, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The rounds of ``kmeans`` by joins, in any vectors."""
    before = None
    for _ in range(max_rounds):
        now = cut(nearest_centre(rows, centres, idx, vector))
        if before is not None and now.join(before.select(idx, F.col("centre").alias("_old")), idx).where("centre <> _old").count() <= threshold:
            return centres, now
        means = rows.join(now, idx).select("centre", F.posexplode(vector).alias("d", "x")).groupBy("centre", "d").agg(F.avg("x").alias("m"))
        moved = means.groupBy("centre").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("_new"))
        centres = cut(centres.join(moved, "centre", "left").select("centre", F.coalesce("_new", "position").alias("position")))
        before = now
    return centres, before


def opening_gain(points: DataFrame, assigned: DataFrame, idx: str, vector: str, candidate: DataFrame, cost: float) -> DataFrame:
    """(gain) of opening one more centre: what points save by moving to it, less its cost."""
    one = candidate.select(F.col("position").alias("_p")).limit(1)
    now = points.select(idx, vector).join(assigned.select(idx, "d2"), idx).crossJoin(F.broadcast(one))
    saved = F.greatest(F.lit(0.0), F.col("d2") - squared_distance(F.col(vector), F.col("_p")))
    return now.agg((F.sum(saved) - cost).alias("gain"))


def block_match(current: DataFrame, reference: DataFrame, window: int) -> DataFrame:
    """(block, shift, sad): the shift of least sum of absolute differences within the window, smaller shifts first among equals.

    Both are (block, pos, v) along one axis.
    """
    shifted = current.withColumn("shift", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("at", F.col("pos") + F.col("shift"))
    ref = reference.select(F.col("pos").alias("at"), F.col("v").alias("w"))
    sad = shifted.join(ref, "at").groupBy("block", "shift").agg(F.sum(F.abs(F.col("v") - F.col("w"))).alias("sad"), F.count("*").alias("n"))
    full = current.groupBy("block").agg(F.count("*").alias("size"))
    best = sad.join(full, "block").where("n = size").groupBy("block").agg(F.min(F.struct("sad", F.abs("shift").alias("a"), "shift")).alias("b"))
    return best.select("block", F.col("b.shift").alias("shift"), F.col("b.sad").alias("sad"))


def _small(matrix: DataFrame, rows: int, cols: int, most: int = 4096) -> np.ndarray:
    if rows > most or cols > most:
        raise ValueError(f"a factorisation runs on the driver for up to {most} rows and columns")
    out = np.zeros((rows, cols))
    for r in matrix.select("i", "j", "v").toLocalIterator():
        out[r.i, r.j] = r.v
    return out


def solved(matrix: DataFrame, right: DataFrame, n: int) -> np.ndarray:
    """x of A x = b for a small dense system (bounded by the size check)."""
    b = np.zeros(n)
    for r in right.select("i", "v").toLocalIterator():
        b[r.i] = r.v
    return np.linalg.solve(_small(matrix, n, n), b)


def lu(matrix: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper factor without pivoting, of a small matrix."""
    u = _small(matrix, n, n)
    low = np.eye(n)
    for k in range(n):
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return low, u


def gram_schmidt(matrix: DataFrame, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Q and R of a small matrix, by modified Gram-Schmidt."""
    a = _small(matrix, rows, cols)
    q, r = np.zeros_like(a), np.zeros((cols, cols))
    for k in range(cols):
        r[k, k] = np.linalg.norm(a[:, k])
        q[:, k] = a[:, k] / r[k, k]
        r[k, k + 1 :] = q[:, k] @ a[:, k + 1 :]
        a[:, k + 1 :] -= np.outer(q[:, k], r[k, k + 1 :])
    return q, r


def least_squares(matrix: DataFrame, right: DataFrame, rows: int, cols: int, low: float = 0.0, high: float = np.inf, rounds: int = 5000) -> np.ndarray:
    """Bounded least squares by accelerated projected gradient, for a small system."""
    a = _small(matrix, rows, cols)
    b = np.zeros(rows)
    for r in right.select("i", "v").toLocalIterator():
        b[r.i] = r.v
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-30)
    x = y = np.clip(np.zeros(cols), low, high)
    t = 1.0
    for _ in range(rounds):
        new = np.clip(y - step * (a.T @ (a @ y - b)), low, high)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def bipartite_matching(edges: DataFrame, most: int = 100_000) -> dict:
    """A largest matching (left -> right) by augmenting paths, for a small graph."""
    near: dict = {}
    for k, r in enumerate(edges.select("src", "dst").distinct().orderBy("src", "dst").toLocalIterator()):
        if k >= most:
            raise ValueError(f"matching runs on the driver for up to {most} edges")
        near.setdefault(r.src, []).append(r.dst)
    held: dict = {}
    for start in near:
        before, stack, end = {}, [start], None
        while stack and end is None:
            a = stack.pop()
            for b in near[a]:
                if b not in before:
                    before[b] = a
                    if b not in held:
                        end = b
                        break
                    stack.append(held[b])
        while end is not None:
            a = before[end]
            nxt = next((b for b, x in held.items() if x == a), None)
            held[end] = a
            end = nxt
            if nxt is not None:
                del held[nxt]
    return {a: b for b, a in held.items()}
