"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of word hashes; of every ``window`` consecutive
grams the one with the smallest hash (the last of equals) is a fingerprint.
Two texts that share k + window - 1 words in a row share a fingerprint, so with
k + window - 1 = ``span`` no shared span of that length is missed.  Shared
fingerprints are joined, each hit is extended both ways over equal words, and
extended spans of at least ``span`` words are contamination.  A benchmark item
of fewer words is one span by itself: its whole run of words is its fingerprint.

The benchmark is read in blocks of bounded size, each broadcast; documents pass
once through all blocks in one narrow stage, so they are never shuffled, and
work grows with documents times blocks for a benchmark of any size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.textwords import U, gram_hashes, string_bytes, word_hashes, word_table, words

SPAN = 13
GRAM = 7
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 32 << 20
_TABLE = word_table("alnum")


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Indices of the fingerprints of one text's gram hashes; for fewer grams than a window, of the smallest alone."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(n - 1 - (np.arange(n - window + 1) + np.argmin(views, axis=1)))


def _sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    out, have = x, 1
    while have < window:
        step = min(have, window - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


@dataclass
class Block:
    """Items of one part of the benchmark: their words' hashes end to end, and their sorted fingerprints."""

    ids: list[str]
    bounds: np.ndarray
    hashes: np.ndarray
    prints: np.ndarray  # sorted
    owner: np.ndarray  # item of each fingerprint
    at: np.ndarray  # its first word in hashes
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words -> (sorted hashes, items) of items with fewer words than a span
    span: int
    gram: int


def make_block(items: list[tuple[str, str]], span: int = SPAN, gram: int = GRAM) -> Block:
    texts = pa.array([t for _, t in items], pa.large_string())
    data, ends = string_bytes(texts)
    hashes, starts = word_hashes(data[: ends[-1]], ends, _TABLE)
    bounds = np.searchsorted(starts, ends)
    prints, owner, at = [], [], []
    short: dict[int, list] = {}
    for k in range(len(items)):
        own = hashes[bounds[k] : bounds[k + 1]]
        if len(own) >= span:
            g = gram_hashes(own, gram)
            pick = winnow(g, span - gram + 1)
            prints.append(g[pick])
            owner.append(np.full(len(pick), k))
            at.append(pick + bounds[k])
        elif len(own):
            short.setdefault(len(own), []).append((gram_hashes(own, len(own))[0], k))
    joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    p, o, a = joined(prints, U), joined(owner, np.int64), joined(at, np.int64)
    order = np.argsort(p, kind="stable")
    tables = {}
    for n, found in short.items():
        h, k = np.array([x for x, _ in found], dtype=U), np.array([x for _, x in found])
        by = np.argsort(h, kind="stable")
        tables[n] = h[by], k[by]
    return Block([i for i, _ in items], bounds, hashes, p[order], o[order], a[order], tables, span, gram)


def _matches(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into wanted, index into sorted_keys) of all equal pairs."""
    lo = np.searchsorted(sorted_keys, wanted, side="left")
    n = np.searchsorted(sorted_keys, wanted, side="right") - lo
    at = np.repeat(np.arange(len(wanted)), n)
    return at, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(at))


def spans_in(block: Block, w) -> list[tuple[int, int, int, int]]:
    """(row, first word, end, item) of all maximal shared spans of at least ``span`` words, and of whole short items.

    Words are counted within the row.  Runs over one slice of documents.
    """
    out: list[tuple[int, int, int, int]] = []
    h, rows, bounds, span, gram = w.hashes, w.rows, w.bounds, block.span, block.gram
    if len(block.prints) and len(h) >= gram:
        window = span - gram + 1
        g = gram_hashes(h, gram)
        if len(g) >= window:
            low = _sliding_min(g, window)  # smallest of each window that starts at i
            low = low[np.flatnonzero(rows[: len(low)] == rows[span - 1 : span - 1 + len(low)])]  # windows within one row
            known = np.unique(low[_member(block.prints, low)])
            if len(known):
                near = np.flatnonzero(_member(known, g))
                d, p = _matches(block.prints, g[near])
                d = near[d]
                diagonal = d - block.at[p]
                done: dict[tuple[int, int], int] = {}
                for dw, off, item, iw in zip(d.tolist(), diagonal.tolist(), block.owner[p].tolist(), block.at[p].tolist(), strict=True):
                    row = int(rows[dw])
                    if done.get((off, item), -1) > dw:  # within a span already extended on this diagonal
                        continue
                    lo_lim = min(dw - int(bounds[row]), iw - int(block.bounds[item]))
                    hi_lim = min(int(bounds[row + 1]) - dw, int(block.bounds[item + 1]) - iw)
                    same = h[dw : dw + hi_lim] == block.hashes[iw : iw + hi_lim]
                    up = hi_lim if same.all() else int(np.argmin(same))
                    back = h[dw - lo_lim : dw][::-1] == block.hashes[iw - lo_lim : iw][::-1]
                    down = lo_lim if back.all() else int(np.argmin(back))
                    done[off, item] = dw + up
                    if up + down >= span:
                        base = int(bounds[row])
                        out.append((row, dw - down - base, dw + up - base, item))
    for n, (keys, items) in block.short.items():
        if len(h) < n:
            continue
        g = gram_hashes(h, n)
        g_at = np.flatnonzero((rows[: len(g)] == rows[n - 1 :]) & _member(keys, g))
        d, k = _matches(keys, g[g_at])
        for dw, item in zip(g_at[d].tolist(), items[k].tolist(), strict=True):
            row = int(rows[dw])
            own = block.hashes[block.bounds[item] : block.bounds[item + 1]]
            if (h[dw : dw + n] == own).all():
                out.append((row, dw - int(bounds[row]), dw - int(bounds[row]) + n, item))
    return out


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The benchmark in blocks of about block_bytes of text, read one partition at a time."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''").distinct()
    for i, t in rows.toLocalIterator():
        if part and size + len(t) > block_bytes:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += 4 * len(t)
    if part:
        yield part


def find_spans(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, within: int | None = None) -> DataFrame:
    """Documents' ``keep`` columns with n_words, spans (array of first, end, item_id; words, end exclusive) and item_ids.

    ``docs`` and ``benchmark`` may have any further columns; ``keep`` must not
    name n_words, spans or item_ids (ValueError).  A null or empty text has no
    words and no spans; an item without words is none; the words that an item
    with a null id shares are hit, but it is not among item_ids; repeated rows on either side count once per document row, and items
    with equal ids are one item.  An empty benchmark finds nothing.  Equality
    of words is that of 64-bit hashes, checked word by word over the span.
    ``within`` says that the text is that field of the first kept column, a
    struct, so that it is not sent twice.
    """
    if not 1 <= gram <= span:
        raise ValueError("a gram has from 1 to span words")
    if clash := {"n_words", "spans", "item_ids"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here")
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(make_block(b, span, gram)) for b in _blocks(benchmark, item_id, item_text, block_bytes)]
    kind = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("item_id", T.StringType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("spans", kind), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    arrow_kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("item_id", pa.string())]))
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(n_keep) if within is None else batch.column(0).field(within)
            for w in words(texts, _TABLE):
                found: list[list] = [[] for _ in range(w.last - w.first)]
                for one in shared:
                    block = one.value
                    for row, a, b, item in spans_in(block, w):
                        found[row].append((a, b, block.ids[item]))
                spans = [sorted(set(x), key=lambda s: (s[:2], s[2] or "")) for x in found]
                cols = [c.slice(w.first, w.last - w.first) for c in batch.columns[:n_keep]]
                cols += [pa.array(np.diff(w.bounds)), pa.array([[{"first": a, "end": b, "item_id": i} for a, b, i in x] for x in spans], arrow_kind), pa.array([sorted({i for *_, i in x if i is not None}) for x in spans], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep, *([text] if within is None else [])).mapInArrow(run, schema)


def hit_words(spans: str = "spans"):
    """Words inside any of a row's spans, which are sorted by their first word: a union of intervals."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], acc["upto"]))).cast("long").alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated, item_ids and spans of each document (see find_spans).

    Contaminated: some word is hit, and at least one word in twenty.
    """
    found = find_spans(docs, benchmark, keep, **options).withColumn("n_hit", hit_words())
    return found.select(*keep, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.expr("n_hit > 0 AND 20 * n_hit >= n_words")).alias("contaminated"), "item_ids", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All columns, whatever their names, of the documents that are not contaminated; one narrow pass."""
    rows = docs.select(F.struct("*").alias("row"))
    return contamination(rows, benchmark, ("row",), within=docs.columns.index(text), **options).where(~F.col("contaminated")).select("row.*")


def digest(ids: list[str]) -> str:
    """items_sha256 of a list of item ids, as a plain function."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
