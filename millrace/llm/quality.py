"""Quality classifier: supervised subword embeddings.

A document is the bag of its hashed words, word pairs and character n-grams.
Each bucket has a learned vector; a document's vector is their mean, a linear
layer and a softmax give the classes.  Training is stochastic gradient descent
in numpy, one document a step, on a bounded sample of labelled documents
(``max_rows``).  As the layer is linear, scoring needs one number a bucket
(vector times difference of the two output rows), which is what is broadcast:
its size is fixed by the number of buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.textwords import U, mix, string_bytes, word_hashes, word_table

#: log2 of the buckets.
BITS = 17
#: Labelled documents that a model is fitted on, at most.
MAX_ROWS = 4096
_BLANK = word_table("blank")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_SLICE = 1 << 19


def buckets(part: np.ndarray, borders: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature of some rows' bytes; no feature crosses a row's border."""
    n_rows = len(borders) - 1
    hashes, starts = word_hashes(part, borders, _BLANK)
    row_of_word = np.searchsorted(borders, starts, side="right") - 1
    shift = U(64 - bits)
    out, rows = [hashes >> shift], [row_of_word]
    if len(hashes) > 1:  # a word and the next one: whether they are the same word, and both words' hashes
        same = np.flatnonzero(row_of_word[:-1] == row_of_word[1:])
        with np.errstate(over="ignore"):
            repeat = np.where(hashes[same] == hashes[same + 1], U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25))
            pair = mix(hashes[same] * U(31) + hashes[same + 1])
        out += [repeat >> shift, pair >> shift]
        rows += [row_of_word[same], row_of_word[same]]
    low = _FOLD[part].astype(U)
    row_of_byte = np.repeat(np.arange(n_rows), np.diff(borders))
    for n in (2, 3, 4):
        if len(low) >= n:
            at = np.flatnonzero(row_of_byte[: len(low) - n + 1] == row_of_byte[n - 1 :])
            with np.errstate(over="ignore"):
                code = np.full(len(low) - n + 1, U(n))
                for j in range(n):
                    code = (code << U(8)) | low[j : len(low) - n + 1 + j]
                out.append((code[at] * U(0x9E3779B97F4A7C15)) >> shift)
            rows.append(row_of_byte[at])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


def row_slices(texts: pa.Array, size: int = _SLICE):
    """(first, last, bytes, borders) of slices of about ``size`` bytes; a longer row is a slice of its own."""
    data, ends = string_bytes(texts)
    first = 0
    while first < len(texts):
        last = min(len(texts), max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1))
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


@dataclass
class QualityModel:
    weight: np.ndarray  # float32, of each bucket: log-odds of class 1 over class 0 if a document were that feature alone
    bias: float
    bits: int

    def log_odds(self, part: np.ndarray, borders: np.ndarray) -> np.ndarray:
        n = len(borders) - 1
        ids, rows = buckets(part, borders, self.bits)
        total = np.bincount(rows, weights=self.weight[ids], minlength=n)
        count = np.bincount(rows, minlength=n)
        return total / np.maximum(count, 1) + self.bias


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = 12, epochs: int = 6, rate: float = 8.0, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over (buckets, counts, class) bags; classes are balanced by weights of the root of their odds."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.3, (1 << bits, dim)).astype(np.float32)
    layer = np.zeros((2, dim), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, counts, label = bags[k]
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[ids]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            lr = rate * (1 - done / steps)
            back = p @ layer
            layer -= 0.1 * lr * np.outer(p, hidden)
            bias -= 0.02 * lr * p
            vectors[ids] -= lr * share[:, None] * back
            done += 1
    return QualityModel((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def labelled(labels: DataFrame, label: str, key: str, where=None, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled ids, chosen by a hash of the id: (key, label).  Null and contradictory labels are left out."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if where is not None:
        one = one.where(where)
    one = one.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_most")).where(F.col(label) == F.col("_most"))
    return one.select(key, F.col(label).cast("int").alias(label)).orderBy(F.xxhash64(key), key).limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", where=None, max_rows: int = MAX_ROWS, bits: int = BITS, **options) -> QualityModel:
    """Fit on documents that ``labels`` marks 0 or 1.

    The sample's ids are broadcast to the documents (its size is bounded by
    ``max_rows``), and only hashed bags come back, never texts.  Without any
    labelled document the model answers 0.5 for all texts.
    """
    sample = labelled(labels, label, key, where, max_rows)
    chosen = docs.where(F.col(key).isNotNull()).select(key, text).join(F.broadcast(sample), key).select(F.col(key).cast("string").alias("k"), F.col(label).alias("y"), F.col(text).alias("t"))
    schema = "k string, y int, ids binary, counts binary"

    def run(batches):
        for batch in batches:
            for a, b, part, borders in row_slices(batch.column(2)):
                ids, rows = buckets(part, borders, bits)
                packed, counts = np.unique((rows << bits) | ids, return_counts=True)
                cut = np.searchsorted(packed, np.arange(b - a + 1) << bits)
                some = batch.slice(a, b - a)
                made = [((packed[x:y] & ((1 << bits) - 1)).astype("<u4").tobytes(), np.minimum(counts[x:y], 65535).astype("<u2").tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([x for x, _ in made], pa.binary()), pa.array([y for _, y in made], pa.binary())], names=["k", "y", "ids", "counts"])

    rows = sorted(chosen.mapInArrow(run, schema).toLocalIterator(), key=lambda r: (r.k, r.ids))
    bags = [(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.counts, "<u2"), int(r.y > 0)) for r in rows]
    if len({y for *_, y in bags}) < 2:
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, bits)
    return fit(bags, bits, **options)


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score", within: int | None = None) -> DataFrame:
    """``keep`` and the probability of class 1 of every whole text: one narrow pass.

    A null or empty text has no features and gets the model's prior.  Columns
    besides ``text`` never reach the score.  Repeated rows are scored each.
    ``within`` says that the text is that field of the first kept column, a
    struct, so that it is not sent twice.
    """
    if name in keep:
        raise ValueError(f"column {name} is made here")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, part, borders in row_slices(batch.column(n_keep) if within is None else batch.column(0).field(within)):
                out.append(shared.value.log_odds(part, borders))
            z = np.clip(np.concatenate(out), -500, 500)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(1 / (1 + np.exp(-z)))], names=schema.names)

    return docs.select(*keep, *([text] if within is None else [])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep``, held_out, score and predicted of every document.

    Held out are ids whose crc32 (of the id as text) leaves 2 when divided by 4;
    no label of theirs is learned.  A null id is not held out.
    """
    part = F.crc32(F.col(key).cast("string")) % 4
    model = train(docs, labels, key=key, text=text, where=part != 2, **options)
    held = docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    return score(held, model, (*keep, "held_out"), text).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", **options) -> DataFrame:
    """All columns, whatever their names, of the documents that the classifier accepts."""
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs, labels, text=text, where=part != 2, **options)
    rows = docs.select(F.struct("*").alias("row"))
    return score(rows, model, ("row",), within=docs.columns.index(text)).where(F.col("score") >= threshold).select("row.*")
