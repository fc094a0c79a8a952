"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector for all
ordered thresholds; x marks which hashed words, and first bytes of words, a
text has.  Features are selected by a likelihood-ratio test of presence against
grade on a bounded sample of labelled documents (``max_rows``); weights and
thresholds are fitted in numpy.
The answer is the expected grade, with the probability of each grade.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.quality import labelled, row_slices
from millrace.llm.textwords import U, mix, word_hashes, word_table

BITS = 22
#: Labelled documents that a model is fitted on, at most.
MAX_ROWS = 8192
#: Lengths in bytes of the beginnings of words that are features, besides whole words.
STEMS = (5, 7, 9)
#: Features that a model weighs, at most and at least (those with the largest statistic).
MAX_WORDS, MIN_WORDS = 4096, 64
#: Likelihood-ratio statistic from which a feature is weighed whatever the others' (chi-square with one degree of freedom: p about 0.0016).
LEAST_G = 10.0
_TABLE = word_table("alnum")


def features(part: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of BITS bits, row) of every word and of its first bytes, with repeats."""
    hashes, starts = word_hashes(part, borders, _TABLE)
    rows = np.searchsorted(borders, starts, side="right") - 1
    after = np.append(starts[1:], len(part) + 1)
    out, where = [hashes >> U(64 - BITS)], [rows]
    for n in STEMS:
        at = np.flatnonzero(after > starts + n - 1)
        at = at[starts[at] + n <= borders[rows[at] + 1]]
        at = at[_TABLE[part[starts[at] + n - 1]]]
        code = np.full(len(at), U(n))
        with np.errstate(over="ignore"):
            for j in range(n):
                byte = part[starts[at] + j].astype(U)
                byte[(byte >= 0x41) & (byte <= 0x5A)] += U(32)
                code = code * U(0x100000001B3) + byte
        out.append(mix(code) >> U(64 - BITS))
        where.append(rows[at])
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted hashes, cut to BITS
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, grades - 1

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """Of each grade, for each text's w.x."""
        upto = 1 / (1 + np.exp(np.clip(z[:, None] - self.thresholds[None, :], -500, 500)))
        edges = np.concatenate([np.zeros((len(z), 1)), upto, np.ones((len(z), 1))], axis=1)
        return np.diff(edges, axis=1)

    def linear(self, part: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """w.x of each row of some bytes: each known feature counts once a row."""
        n = len(borders) - 1
        if not len(self.words):
            return np.zeros(n)
        ids, rows = features(part, borders)
        at = np.searchsorted(self.words, ids)
        at[at == len(self.words)] = 0
        known = np.flatnonzero(self.words[at] == ids)
        pairs = np.unique(rows[known] * len(self.words) + at[known])
        return np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=n)


def select_words(bags: list[np.ndarray], grades: np.ndarray, least: float = LEAST_G, most: int = MAX_WORDS, fewest: int = MIN_WORDS) -> np.ndarray:
    """Sorted hashes of the words whose presence tells most about whether a grade is above the lowest: those of statistic ``least``, or the ``fewest`` best."""
    flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    positive = np.repeat(grades > 0, [len(b) for b in bags])
    ids, where = np.unique(flat, return_inverse=True)
    n1, n = float((grades > 0).sum()), float(len(grades))
    a = np.bincount(where, weights=positive, minlength=len(ids))
    total = np.bincount(where, minlength=len(ids)).astype(float)
    cells = np.stack([a, total - a, n1 - a, n - n1 - total + a])
    means = np.stack([total * n1 / n, total * (n - n1) / n, (n - total) * n1 / n, (n - total) * (n - n1) / n])
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * np.where(cells > 0, cells * np.log(cells / means), 0).sum(axis=0)
    best = np.argsort(-g, kind="stable")
    return np.sort(ids[best[: min(most, max(fewest, int((g >= least).sum())))]])


def fit(bags: list[np.ndarray], grades: np.ndarray, l2: float = 0.5, rounds: int = 400, rate: float = 0.1, least_g: float = LEAST_G, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> OrdinalModel:
    """Penalised maximum likelihood by full-batch Adam steps; thresholds stay ordered as a first value plus positive steps."""
    top = int(grades.max()) if len(grades) else 0
    if top < 1 or (grades == grades[0]).all():
        prior = np.where(np.arange(max(top, 1)) >= (grades[0] if len(grades) else 0), 8.0, -8.0)
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), prior)
    chosen = select_words(bags, grades, least_g, max_words, min_words)
    col = [np.searchsorted(chosen, b[np.isin(b, chosen)]) for b in bags]
    rows, cols = np.repeat(np.arange(len(bags)), [len(c) for c in col]), np.concatenate(col).astype(np.int64)
    n, m = len(bags), len(chosen)
    share = np.clip(np.array([(grades <= k).mean() for k in range(top)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, theta = p[:m], np.cumsum(np.concatenate([p[m : m + 1], np.exp(p[m + 1 :])]))
        z = np.bincount(rows, weights=w[cols], minlength=n)
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = ends[grades + 1] - z, ends[grades] - z
        s_hi, s_lo = 1 / (1 + np.exp(-np.clip(hi, -500, 500))), 1 / (1 + np.exp(-np.clip(lo, -500, 500)))
        mass = np.maximum(s_hi - s_lo, 1e-12)
        d_hi, d_lo = s_hi * (1 - s_hi) / mass, s_lo * (1 - s_lo) / mass
        g_z = d_hi - d_lo
        g_w = np.bincount(cols, weights=g_z[rows], minlength=m) + l2 * w
        g_theta = np.array([-(d_hi[grades == k].sum() - d_lo[grades == k + 1].sum()) for k in range(top)])
        back = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, back[:1], back[1:] * np.exp(p[m + 1 :])])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    return OrdinalModel(chosen, p[:m], np.cumsum(np.concatenate([p[m : m + 1], np.exp(p[m + 1 :])])))


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", key: str = "doc_id", text: str = "text", where=None, max_rows: int = MAX_ROWS, **options) -> OrdinalModel:
    """Fit on documents that ``labels`` gives a grade 0, 1, ... (negative, null and contradictory grades teach nothing); ``options`` go to ``fit``."""
    usable = F.col(grade) >= 0
    sample = labelled(labels, grade, key, usable if where is None else usable & where, max_rows)
    chosen = docs.where(F.col(key).isNotNull()).select(key, text).join(F.broadcast(sample), key).select(F.col(key).cast("string").alias("k"), F.col(grade).alias("y"), F.col(text).alias("t"))

    def run(batches):
        for batch in batches:
            for first, last, part, borders in row_slices(batch.column(2)):
                ids, rows = features(part, borders)
                packed = np.unique((rows << BITS) | ids)
                cut = np.searchsorted(packed, np.arange(last - first + 1) << BITS)
                packed = (packed & ((1 << BITS) - 1)).astype("<u4")
                some = batch.slice(first, last - first)
                made = [packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(made, pa.binary())], names=["k", "y", "ids"])

    rows = sorted(chosen.mapInArrow(run, "k string, y int, ids binary").toLocalIterator(), key=lambda r: (r.k, r.ids))
    return fit([np.frombuffer(r.ids, "<u4") for r in rows], np.array([r.y for r in rows], dtype=np.int64), **options)


def grade(docs: DataFrame, model: OrdinalModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, expected_severity, probabilities (of each grade), grade (the likeliest; the lower of equals) and toxic (grade above 0 likelier than not).

    One narrow pass over whole texts.  A null or empty text gets the model's
    answer for no known word.  ``keep`` must not name a column made here.
    """
    made = [("expected_severity", T.DoubleType()), ("probabilities", T.ArrayType(T.DoubleType())), ("grade", T.IntegerType()), ("toxic", T.BooleanType())]
    if clash := {n for n, _ in made} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here")
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in made)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            z = np.concatenate([np.zeros(0), *(shared.value.linear(part, borders) for _, _, part, borders in row_slices(batch.column(n_keep)))])
            p = shared.value.probabilities(z)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(p @ np.arange(p.shape[1])), pa.array(list(p), pa.list_(pa.float64())), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] < 0.5)], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)
