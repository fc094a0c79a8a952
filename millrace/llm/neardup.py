"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

Signature: one permutation sigma scatters the shingles over 0..2**32-1; coordinate
k is the least value of a second permutation pi, circularly shifted by k, so two
permutations make all coordinates.  Bands of a few coordinates give buckets; at
similarity 0.8 these are 31 of 4, and two such sets share no bucket with
probability below 1e-7 (``MISSED``).

A sketch of two bits of each of 256 coordinates (b-bit minwise hashing) says whether
a pair is worth confirming: at similarity 0.8, 38 coordinates differ on average, with
a standard deviation of 5.7; a pair is left out beyond six of these, which happens
with probability below 1e-7.  Unrelated sets differ in 192.  Besides, each set has a
parity sketch: every shingle flips one of 2,048 bits, so two sketches differ in no
more bits than the sets differ in shingles, and a pair whose bits differ in more than
a link allows is left out for certain.

Links are searched without emitting the pairs of a bucket.  Documents with equal
sets are one class.  (1) Each class is compared with the least id of each of
its buckets, links are confirmed on the full sets, and components are formed.
(2) Only buckets that still hold more than one component are left.  Of small
ones, pairs from different components are compared; in large ones, pairs from
different components that share a shingle among the rarest n - ceil(t n) + 1
of either set, which every pair of similarity t must (so the search within a
bucket of any size is complete).  A final run over all links gives the components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components
from millrace.llm.store import batches_of, discard, stored
from millrace.llm.textwords import U, gram_hashes, mix, word_table, words

#: Of two sets of the stated similarity, the probability that they share no bucket; bands and rows follow from it.
MISSED = 1e-7
MOST_BANDS, MOST_ROWS = 128, 4
#: Members up to which a bucket's cross-component pairs are compared directly.
SMALL = 40
#: Rows in an Arrow batch: a row may hold two shingle sets.
BATCH_ROWS = 1000
#: Ids that are broadcast to filter the documents, at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: log2 of the counters that order shingles by rarity.
COUNTER_BITS = 20
#: Coordinates whose two bits make the sketch, and the 64-bit numbers that hold them.
SKETCHED = 256
SKETCH = tuple(f"s{k}" for k in range(SKETCHED // 32))
#: Bits of the parity sketch, and the 64-bit numbers that hold them.
PARITY_BITS = 2048
PARITY = tuple(f"o{k}" for k in range(PARITY_BITS // 64))
#: What tells whether two classes are worth confirming.
MARKS = ("n", *SKETCH, *PARITY)
_TABLE = word_table("blank")
_CHUNK = 1 << 15


def shingle_sets(w, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; of fewer words, the whole sequence as one."""
    if not len(w.hashes):
        return [np.zeros(0, U)] * (w.last - w.first)
    g = gram_hashes(w.hashes, k)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(gram_hashes(w.hashes[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def _pi(x: np.ndarray, spare: np.ndarray) -> None:
    """A permutation of 0..2**32-1, in place."""
    np.right_shift(x, 16, out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, 15, out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(0x846CA68B), out=x)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(sets, count) circulant MinHash coordinates; an empty set has the largest value throughout."""
    out = np.full((len(sets), count), np.uint32(0xFFFFFFFF))
    sizes = np.array([len(s) for s in sets])
    k, n = 0, len(sets)
    while k < n:
        if sizes[k] > _CHUNK:  # a large set in pieces
            for a in range(0, sizes[k], _CHUNK):
                np.minimum(out[k], _minima([sets[k][a : a + _CHUNK]], count)[0], out=out[k])
            k += 1
            continue
        last, total = k, 0
        while last < n and sizes[last] <= _CHUNK and total + sizes[last] <= _CHUNK:
            total += sizes[last]
            last += 1
        full = k + np.flatnonzero(sizes[k:last])
        if len(full):
            out[full] = _minima([sets[j] for j in full], count)
        k = last
    return out


def _minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    flat = np.concatenate(sets)
    sigma = (mix(flat) >> U(32)).astype(np.uint32)
    firsts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x, spare = np.empty_like(sigma), np.empty_like(sigma)
    out = np.empty((count, len(sets)), dtype=np.uint32)
    for k in range(count):
        np.subtract(sigma, np.uint32(k), out=x)
        _pi(x, spare)
        np.minimum.reduceat(x, firsts, out=out[k])
    return out.T


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows to a band whose bands miss a pair with probability ``MISSED`` at most; ValueError where there are none."""
    for rows in range(MOST_ROWS, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if bands <= MOST_BANDS:
            return bands, rows
    raise ValueError(f"a similarity of {percent} percent is too low for {MOST_BANDS} bands")


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit bucket keys."""
    parts = sig.reshape(len(sig), bands, rows).astype(U)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]).copy()
        for j in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> list[np.ndarray]:
    """The numbers of SKETCH for each set: two bits of each of its first SKETCHED coordinates."""
    bits = np.stack([(sig[:, :SKETCHED] >> 7) & 1, (sig[:, :SKETCHED] >> 8) & 1], axis=2).astype(np.uint8).reshape(len(sig), -1)
    packed = np.packbits(bits, axis=1).view("<i8")
    return [np.ascontiguousarray(packed[:, k]) for k in range(len(SKETCH))]


def parities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The numbers of PARITY for each set: which of PARITY_BITS slots hold an odd number of its shingles."""
    out = np.zeros((len(sets), len(PARITY)), "<i8")
    for at in range(0, len(sets), 64):
        some = sets[at : at + 64]
        slots = [(s & U(PARITY_BITS - 1)).astype(np.int64) + k * PARITY_BITS for k, s in enumerate(some)]
        odd = (np.bincount(np.concatenate(slots), minlength=len(some) * PARITY_BITS) & 1).astype(np.uint8)
        out[at : at + 64] = np.packbits(odd.reshape(len(some), -1), axis=1).view("<i8")
    return [np.ascontiguousarray(out[:, k]) for k in range(len(PARITY))]


def most_different(percent: int) -> int:
    """Sketched coordinates in which sets of a similarity differ, plus six standard deviations: 72 for 80 percent."""
    q = 0.75 * (1 - percent / 100)
    return int(SKETCHED * q + 6 * math.sqrt(SKETCHED * q * (1 - q)))


def _alike(x: str, y: str, percent: int) -> str:
    """SQL for: parities and lengths allow a link, and the sketches differ in few enough coordinates (a coordinate's two bits are neighbours)."""
    pair = 0x5555555555555555
    length = f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n)"
    odd = " + ".join(f"bit_count({x}{o} ^ {y}{o})" for o in PARITY)
    differ = " + ".join(f"bit_count((({x}{s} ^ {y}{s}) | shiftrightunsigned({x}{s} ^ {y}{s}, 1)) & {pair}L)" for s in SKETCH)
    return f"{length} AND {100 + percent} * ({odd}) <= {100 - percent} * ({x}n + {y}n) AND {differ} <= {most_different(percent)}"


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that may be linked."""
    of = lambda side: classes.select(F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in MARKS))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_alike("a_", "b_", percent)).select("a", "b")


def signed(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest of the set, bands, sketches) of each document; one narrow pass."""
    schema = "id bigint, n_shingles bigint, digest binary, bands array<bigint>, " + ", ".join(f"{c} bigint" for c in (*SKETCH, *PARITY))

    def run(batches):
        for batch in batches:
            for w in words(batch.column(1), _TABLE):
                sets = shingle_sets(w, k)
                sig = signatures(sets, max(bands * rows, SKETCHED))
                keys, sketch = band_keys(sig[:, : bands * rows], bands, rows), sketches(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(w.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                        *(pa.array(x) for x in (*sketch, *parities(sets))),
                    ],
                    names=["id", "n_shingles", "digest", "bands", *SKETCH, *PARITY],
                )

    return docs.select(F.col(key).cast("bigint").alias("id"), text).mapInArrow(run, schema)


def _sets(docs: DataFrame, key: str, text: str, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents among ``ids`` (stored, distinct): sets are made again from the texts rather than kept."""
    few = ids.count() <= BROADCAST_IDS
    some = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            for w in words(batch.column(1), _TABLE):
                sets = shingle_sets(w, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return some.mapInArrow(run, "id bigint, shingles binary")


def _shared(a: bytes, b: bytes) -> tuple[int, int]:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def confirmed(docs: DataFrame, pairs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (stored) whose full sets have 100 * intersection >= percent * union."""
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = _sets(docs, key, text, ids, k)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in range(2)]
            keep = []
            for n in range(batch.num_rows):
                i, u = _shared(batch.column(2)[n].as_buffer(), batch.column(3)[n].as_buffer())
                if 100 * i >= percent * u:
                    keep.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([c[n] for n in keep], pa.int64()) for c in cols], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _prefix_pairs(docs: DataFrame, key: str, text: str, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) from different components that share one of their rarest shingles.

    ``members``: (rep, c, MARKS) of the documents to search.  Rarity is that of a
    shingle's counter over these documents; any order would be complete, this
    one keeps common shingles out of the prefixes.  Components that share a
    shingle are paired first, so a large one is never paired with itself.
    """
    sets = stored(_sets(docs, key, text, members.select(F.col("rep").alias("id")), k), "sets")

    def counted(batches):
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), U) >> U(64 - COUNTER_BITS), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in sets.select("shingles").mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.at] = r.n
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32) if counts.max() < 2**32 else counts)

    def prefixes(batches):
        for batch in batches:
            ids, tokens, place = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(x.as_buffer(), U)
                n = len(s)
                p = n + percent * n // -100 + 1  # n - ceil(t n) + 1
                pick = s[np.lexsort((s, shared.value[(s >> U(64 - COUNTER_BITS)).astype(np.int64)]))[:p]]
                ids.append(np.full(p, i)), tokens.append(pick.view(np.int64)), place.append(np.arange(p))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, tokens, place)], names=["rep", "token", "i"])

    size = members.groupBy("c").agg(F.count("*").alias("size"))
    known = stored(members.join(size, "c"), "searched")
    rows = sets.mapInArrow(prefixes, "rep bigint, token bigint, i bigint").join(known, "rep")
    held = rows.groupBy("token", "c").agg(F.count("*").alias("m"), F.min("n").alias("n"), F.max("n").alias("hi"), F.min("i").alias("i"), *(F.first(x).alias(x) for x in ("size", *SKETCH, *PARITY)))
    held = stored(held, "prefixes")
    several = held.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("token")
    held = held.join(several, "token", "left_semi")
    x, y = held.alias("x"), held.alias("y")
    # what any two members could reach at best: lengths, position at the first shared shingle, and (of two single members) sketches
    length = f"100 * x.hi >= {percent} * y.n AND 100 * y.hi >= {percent} * x.n"
    position = f"{100 + percent} * least(x.hi - x.i, y.hi - y.i) >= {percent} * (x.n + y.n)"
    single = f"x.m > 1 OR y.m > 1 OR ({_alike('x.', 'y.', percent)})"
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & F.expr(f"(x.size > y.size OR (x.size = y.size AND x.c > y.c)) AND {length} AND {position} AND ({single})"))
    cross = stored(cross.select(F.col("x.c").alias("c1"), F.col("y.c").alias("c2")).distinct(), "cross")
    # the smaller component's members first; the larger one's meet them under the filters
    of = lambda c, side: known.select(F.col("c").alias(c), *(F.col(v).alias(f"{side}_{v}") for v in ("rep", *MARKS)))
    meet = (F.col("c1") == F.col("c1_")) & F.expr(_alike("x_", "y_", percent))
    pairs = cross.join(of("c2", "y"), "c2").join(of("c1_", "x"), meet)
    return pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, small: int = SMALL) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each document row.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of k-word shingles (A-Z as a-z; words part at space and \\t-\\r; a text
    of fewer words is one shingle).  component_id is the least key reachable;
    kept marks the document that has it.  A null or empty text, or one of white
    space, has n_shingles 0 and is its own component.  A row with a null key
    takes no part: component_id is null and kept true.  Rows with equal keys
    are one document for linking and are returned each.  Other columns are
    never read.  An empty table gives an empty table.  ``percent`` is 12 to 100
    (ValueError below, where buckets would not find all links).
    """
    bands, rows = band_shape(percent)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        base = stored(signed(docs, key, text, k, bands, rows), "signatures")
        usable = base.where("id IS NOT NULL AND n_shingles > 0")
        classes = stored(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("bands", *SKETCH, *PARITY))), "classes")
        entries = classes.select("rep", F.explode("bands").alias("bucket"))
        heads = stored(entries.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("held")).where("held > 1"), "heads")
        members = stored(entries.join(heads, "bucket"), "members")
        discard(heads)

        met = stored(members.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "met")
        tried = stored(_likely(met, classes, percent), "pairs")
        discard(met)
        links = stored(confirmed(docs, tried, key, text, k, percent), "confirmed")
        found = components(links)

        now = members.where("held > 2").join(found.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        mixed = now.groupBy("bucket").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("bucket")
        now = stored(now.join(mixed, "bucket", "left_semi").join(classes.select("rep", *MARKS), "rep"), "mixed")
        discard(members)
        x, y = now.where(f"held <= {small}").alias("x"), now.where(f"held <= {small}").alias("y")
        near = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & F.expr(_alike("x.", "y.", percent))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        large = stored(now.where(f"held > {small}").select("rep", "c", *MARKS).distinct(), "large")
        if large.take(1):
            near = near.unionByName(_prefix_pairs(docs, key, text, large, k, percent)).distinct()
        rest = stored(near.join(tried, ["a", "b"], "left_anti"), "rest")
        if rest.take(1):
            more = stored(confirmed(docs, rest, key, text, k, percent), "confirmed")
            if more.take(1):
                found = components(links.unionByName(more))

    named = classes.select("digest", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = base.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id")).select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of one document of each component: the one whose key is component_id; rows with a null key stay."""
    gone = near_duplicates(docs, key, text, **options).where("NOT kept").select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, F.col(key).cast("bigint") == F.col("_gone"), "left_anti")
