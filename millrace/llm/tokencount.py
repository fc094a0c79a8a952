"""Token counts of fields and sections, from one encoding of the whole document.

The document (its fields laid end to end) is encoded once.  Token spans are
joined to section spans as intervals; a token that crosses a border is given
out by an explicit rule, so the counts of all sections add up to the document's.
"""

from __future__ import annotations

import base64
import re
import uuid

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: first, last: the section of a token's first, last character; most: the one with most of its characters (the earlier of equals).
RULES = ("first", "last", "most")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Unicode White_Space, which the patterns' \\s stands for.
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space from this length are cut out of a text before its pattern is matched, which goes too deep on some hundred thousands.
LONG_BLANK = 4096

_here: dict = {}


def encode(enc: tiktoken.Encoding, text: str, least: int = LONG_BLANK) -> list[int]:
    """The ids of a text whose pattern ends in ``\\s+(?!\\S)|\\s+``: of a run of white space, all but the last character before a word is one piece."""
    ids, done = [], 0
    for run in re.finditer(f"{_BLANK}{{{max(least, 2)},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[done : run.start()])
        ids += enc._encode_single_piece(text[run.start() : end])
        done = end
    return ids + enc.encode_ordinary(text[done:])


def _encoding(shared, pattern: str, key: str) -> tuple:
    """The encoder of one call, kept by a worker over its tasks."""
    if key not in _here:
        _here.clear()
        ranks = shared.value
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            length[k] = len(token)
        _here[key] = tiktoken.Encoding("here", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length
    return _here[key]


def allocate(token_starts: np.ndarray, token_ends: np.ndarray, section_starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a border).

    Positions are characters; sections are [start, next start), the last ends
    at ``total``.  A token within one character (a part of its bytes) lies in
    that character's section.
    """
    n = len(section_starts)
    last_char = np.maximum(token_ends - 1, token_starts)
    a = np.searchsorted(section_starts, token_starts, side="right") - 1
    b = np.searchsorted(section_starts, last_char, side="right") - 1
    cross = np.flatnonzero(a != b)
    chosen = b.copy() if rule == "last" else a.copy()
    if rule == "most" and len(cross):
        ends = np.append(section_starts[1:], total)
        for k in cross:
            own = np.arange(a[k], b[k] + 1)
            held = np.minimum(ends[own], token_ends[k]) - np.maximum(section_starts[own], token_starts[k])
            chosen[k] = own[int(np.argmax(held))]
    return np.bincount(chosen, minlength=n), len(cross)


def spans(ids: np.ndarray, length: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first characters, ends, character index of each byte) of byte-level tokens."""
    stop = np.cumsum(length[ids])
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    first, last = stop - length[ids], stop - 1
    return char[first], char[last] + 1, char


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, fields: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ("doc_id",), lines: bool = True, rule: str = "first") -> DataFrame:
    """``keep``, n_tokens, n_crossing and sections (array of field, line, n_tokens) of every row.

    The fields' texts (cast to string, null as empty) are laid end to end,
    each but the last followed by a line feed that belongs to it.  With
    ``lines`` every line of a field, its line feed included, is a section of
    its own, else each field is one; empty sections are listed with 0 tokens.
    A row whose fields are all empty has no tokens.  Whole texts are encoded,
    special tokens' strings as ordinary text.  Repeated rows are counted each;
    ``keep`` must not name a column made here (ValueError).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    made = [("n_tokens", T.LongType()), ("n_crossing", T.LongType()), ("sections", T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("n_tokens", T.LongType())])))]
    if clash := {n for n, _ in made} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here")
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in made)])
    shared, call = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex
    n_keep = len(keep)
    kind = pa.struct([("field", pa.string()), ("line", pa.int32()), ("n_tokens", pa.int64())])

    def run(batches):
        enc, length = _encoding(shared, pattern, call)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, crossing, names, numbers, counts, bounds = [], [], [], [], [], [0]
                for row in zip(*(c.to_pylist() for c in part.columns[n_keep:]), strict=True):
                    texts = [x or "" for x in row]
                    texts = [x + "\n" for x in texts[:-1]] + texts[-1:]
                    whole = "".join(texts)
                    starts, base = [], 0
                    for name, x in zip(fields, texts, strict=True):
                        own = [base]
                        if lines:
                            code = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
                            feeds = np.flatnonzero(code[:-1] == 10) if name != fields[-1] else np.flatnonzero(code == 10)
                            own += (base + 1 + feeds).tolist()
                        starts += own
                        names += [name] * len(own)
                        numbers += range(len(own))
                        base += len(x)
                    data = whole.encode("utf-8", "replace")
                    ids = np.array(encode(enc, whole), dtype=np.int64)
                    if len(ids):
                        first, end, _ = spans(ids, length, data)
                        n, crossed = allocate(first, end, np.array(starts), len(whole), rule)
                    else:
                        n, crossed = np.zeros(len(starts), np.int64), 0
                    tokens.append(len(ids))
                    crossing.append(crossed)
                    counts.append(n)
                    bounds.append(bounds[-1] + len(starts))
                values = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], names=schema.names)

    return docs.select(*keep, *(F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate(fields))).mapInArrow(run, schema)
