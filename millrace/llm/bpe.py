"""Exact byte-pair encoding by backtracking, and decoding through an offset table.

A word is written over an alphabet of byte units (the last unit of a word has
a form of its own where the vocabulary marks word ends).  The encoder walks a
word from left to right, takes the longest vocabulary entry that starts at the
present unit (found for all units at once by an Aho-Corasick automaton over
reversed entries), and keeps it only if the pair (previous, chosen) is
compatible: merging could not have crossed the border between them.  Otherwise
it tries the next shorter entry, and steps back when none is left.  Each unit
is left at most once as a dead end, so the work is linear in the word.

Results are those of applying the merges in rank order.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.textwords import string_bytes

#: Words kept by a Python worker, those met again lately and others; the memory they take is bounded by this.
CACHE_WORDS = 200_000
#: Pairs of entries of which a Python worker keeps whether they are compatible.
CACHE_PAIRS = 200_000
#: Bytes of text that one slice of an Arrow batch may hold.
SLICE_BYTES = 500_000
_NOT_WHITE = regex.compile("[\x1c-\x1f]").search
_END = 0x1000  # added to the code point of a unit that ends a word


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class BpeTables:
    """Everything the encoder needs; built once on the driver, broadcast to the workers."""

    parts: np.ndarray  # (n, 2): the two ids an entry was merged from, itself twice for a unit
    merged: dict[int, int]  # left << 32 | right -> entry
    shorter: list[int]  # the longest usable entry that is a proper prefix, or -1
    length: list[int]  # units of an entry
    units: dict[str, int]
    automaton: object  # of entries of two units and more
    specials: dict[str, int]
    blob: np.ndarray  # texts of all entries, each after one blank
    offset: np.ndarray  # where the entry's blank stands in blob
    size: np.ndarray  # bytes with the blank
    word_end: str
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def compatible(self, left: int, right: int, limit: int = sys.maxsize) -> bool:
        """Whether left and right stay apart while all merges below ``limit`` are applied.

        The merges that made the two entries are undone, latest first; if the
        entries then at the border form an entry older than the one undone,
        merging would have joined them first.
        """
        parts, merged = self.parts_list, self.merged
        while True:
            both = merged.get(left << 32 | right, -1)
            if 0 <= both < limit:
                return False
            a, b = parts[left][1], parts[right][0]
            if left > right:
                if a != left:
                    left, limit = a, left
                elif b != right:
                    right, limit = b, right + 1
                else:
                    return True
            elif b != right:
                right, limit = b, right + 1
            elif a != left:
                left, limit = a, left
            else:
                return True

    def meets(self, left: int, right: int) -> bool:
        """``compatible`` for entries next to each other in a word, kept: rare words consist of common pairs."""
        pairs = self.cache.setdefault("pairs", {})
        pair = left << 32 | right
        known = pairs.get(pair)
        if known is None:
            if len(pairs) >= CACHE_PAIRS:
                pairs.clear()
            known = pairs[pair] = self.compatible(left, right)
        return known

    @property
    def parts_list(self) -> list:
        made = self.cache.get("")
        if made is None:
            made = self.cache[""] = self.parts.tolist()
        return made

    def encode_units(self, word: str) -> list[int]:
        """Ids of a word already written in units."""
        n = len(word)
        last = n - 1
        # of the entries that start at one unit the automaton gives the longest first: it is written over the others
        longest = dict([*self.automaton.iter(word[::-1])][::-1])
        length, shorter = self.length, self.shorter
        kept, meets, units = self.cache.setdefault("pairs", {}).get, self.meets, self.units
        out: list[int] = []
        dead: set[int] = set()
        at, entry, before = 0, -1, -1
        fresh = True
        while at < n:
            if fresh:
                entry = longest.get(last - at, -1)
                if entry < 0:
                    entry = units.get(word[at], -1)
            while entry >= 0:
                end = at + length[entry]
                if end not in dead:
                    if before < 0:
                        break
                    met = kept(before << 32 | entry)
                    if met or (met is None and meets(before, entry)):
                        break
                entry = shorter[entry]
            if entry >= 0:
                out.append(entry)
                before, at, fresh = entry, end, True
            else:
                dead.add(at)
                fresh = False
                entry = out.pop()  # taken up again: its end is a dead end now
                at -= length[entry]
                before = out[-1] if out else -1
        return out


def load_tables(path: str) -> BpeTables:
    """Read a tokenizers JSON file with a BPE model whose ids follow merge order.

    Raises ValueError where the file's settings are none that this encoder has.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, word_end = model["vocab"], model.get("end_of_word_suffix") or ""
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or not word_end:
        raise ValueError("the encoder takes BPE files with word ends and without dropout, prefixes or byte fallback")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    first = len(vocab) - len(pairs)
    n = len(vocab)
    parts = np.repeat(np.arange(n, dtype=np.int64), 2).reshape(n, 2)
    merged: dict[int, int] = {}
    for k, (a, b) in enumerate(pairs):
        if vocab[a + b] != first + k:
            raise ValueError("ids must follow the order of merges")
        parts[first + k] = vocab[a], vocab[b]
        merged[vocab[a] << 32 | vocab[b]] = first + k
    names = [""] * n
    for name, k in vocab.items():
        names[k] = name

    def in_units(name: str) -> str:
        return name[: -len(word_end) - 1] + chr(ord(name[-len(word_end) - 1]) + _END) if name.endswith(word_end) else name

    written = [in_units(name) for name in names]
    specials = {}
    for added in spec.get("added_tokens", []):
        if added["lstrip"] or added["rstrip"] or added["single_word"] or added["normalized"]:
            raise ValueError("added tokens with options are not supported")
        specials[added["content"]] = added["id"]
    top = max([n - 1, *specials.values()]) + 1
    texts = [*names, *[""] * (top - n)]
    for name, k in specials.items():
        texts[k] = name
    raw = [b" " + t.encode() for t in texts]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    out = BpeTables(parts, merged, [], [len(x) for x in written], {}, None, specials, np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]), size, word_end)
    # An entry that merging never leaves whole (its own parts would not meet) must not be chosen.
    usable = [True] * n
    for k in range(first, n):
        a, b = (int(x) for x in parts[k])
        usable[k] = usable[a] and usable[b] and out.compatible(a, b, k)
    automaton = ahocorasick.Automaton()
    ids = {w: k for k, w in enumerate(written) if usable[k]}
    for w, k in ids.items():
        if len(w) > 1 or not pairs:  # a unit alone is looked up
            automaton.add_word(w[::-1], k)
    automaton.make_automaton()
    out.shorter = [next((ids[w[:e]] for e in range(len(w) - 1, 0, -1) if w[:e] in ids), -1) for w in written]
    out.units = ids
    out.automaton = automaton
    return out


class Encoder:
    """Texts to ids and back, with the words met kept in a bounded cache."""

    #: The pre-tokenizer's pattern of the word-end vocabulary (a fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, tables: BpeTables):
        self.tables = tables
        self.words: dict[str, bytes] = {}  # pieces, and what stands between white space
        self.older: dict[str, bytes] = {}  # those before them, of which the ones met again return
        self.find = regex.compile(self.PATTERN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(tables.specials, key=len, reverse=True)) + ")") if tables.specials else None
        self.special_ids = {k: np.uint32(v).tobytes() for k, v in tables.specials.items()}

    def word(self, word: str) -> bytes:
        units = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        ids = self.tables.encode_units(units[:-1] + chr(ord(units[-1]) + _END))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _kept(self, word: str, made) -> bytes:
        """Ids of a word that ``words`` may not hold: from the older ones, or made and kept."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = made(word)
            if len(word) <= 64:
                if len(self.words) >= CACHE_WORDS // 2:
                    self.words, self.older = {}, self.words
                self.words[word] = ids
        return ids

    def _pieces(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return self.word(text)
        return b"".join([self._kept(w, self.word) for w in self.find(text)])

    def _plain(self, text: str) -> bytes:
        """No piece holds white space, so what stands between white space is encoded, and kept, by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no form of its own at a word's end
        text = text.lower()
        if _NOT_WHITE(text):  # split() would part the text there, the pattern does not
            return self._pieces(text)
        found = text.split()
        out = list(map(self.words.get, found))
        if None in out:
            out = [self._kept(w, self._pieces) if ids is None else ids for w, ids in zip(found, out, strict=True)]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; no text gives none."""
        if not text:
            return b""
        if self.special is None or "<|" not in text:
            return self._plain(text)
        return b"".join(self.special_ids[x] if x in self.special_ids else self._plain(x) for x in self.special.split(text) if x)

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, their ends) for ids of many texts laid end to end: entries joined by one blank."""
        t = self.tables
        size, start = t.size[ids], t.offset[ids]
        ends = np.cumsum(counts)
        firsts = (ends - counts)[counts > 0]
        size[firsts] -= 1  # no blank before the first entry of a text
        start[firsts] += 1
        stop = np.cumsum(size, dtype=np.int64)
        total = int(stop[-1]) if len(stop) else 0
        index = np.int32 if total < 2**31 - len(t.blob) else np.int64
        out = t.blob[np.repeat((start - (stop - size)).astype(index), size) + np.arange(total, dtype=index)]
        return out, np.concatenate([[0], stop])[ends]


def _encoder(tables: BpeTables) -> Encoder:
    """The encoder of some tables, kept with them and the words it has met: a worker lets go of it when it lets go of the broadcast."""
    if "encoder" not in tables.cache:
        tables.cache["encoder"] = Encoder(tables)
    return tables.cache["encoder"]


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """(first, last) row ranges whose texts hold about ``size`` bytes; a longer text is a range of its own."""
    _, ends = string_bytes(texts)
    first = 0
    while first < len(texts):
        last = min(len(texts), max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1))
        yield first, last
        first = last


def encode_column(df: DataFrame, tables: BpeTables, text: str = "text", keep: tuple[str, ...] = ("doc_id",), raw: bool = False) -> DataFrame:
    """Encode and decode one text column: a narrow pass, no shuffle.

    Returns the ``keep`` columns with n_tokens, ids_sha256 and decoded_sha256,
    and with ``raw`` also the ids (binary, little-endian unsigned 32-bit) and
    the decoded text.  A null or empty text has no tokens.  Repeated rows are
    encoded each; other columns are never read.  A text is held whole, whatever
    its length; memory is that of one slice of texts.  Columns of ``keep`` that
    clash with an output name make the call fail at once with ValueError.
    """
    more = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] + [("ids", T.BinaryType()), ("decoded", T.StringType())] * raw
    if clash := {n for n, _ in more} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here")
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in more)])
    shared = df.sparkSession.sparkContext.broadcast(tables)
    n_keep = len(keep)

    def run(batches):
        enc = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(n_keep)
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                ids = [enc.encode(x) for x in part.column(n_keep).to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                data, ends = enc.decode_many(np.frombuffer(b"".join(ids), dtype="<u4"), counts)
                data = data.tobytes()
                starts = [0, *ends[:-1].tolist()]
                decoded = [data[s:e] for s, e in zip(starts, ends.tolist(), strict=True)]
                cols = [*part.columns[:n_keep], pa.array(counts), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                if raw:
                    cols += [pa.array(ids, pa.binary()), pa.array([x.decode() for x in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)
