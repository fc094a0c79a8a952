"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words, kept as 63-bit keys: seven bits of rarity (how
often the word's counter was hit over the whole corpus), then 56 of a hash.  Keys
are ordered by rarity, and each line is indexed under its first n - ceil(t n) + 1
keys only.  Lines that share such a key meet if their lengths, what is left from
that key on (position), and a bitmap of their keys allow a similarity of t.
Every pair of similarity t passes these filters at its first shared key.  Lines
that share the key before as well met there (32 bits of it are compared: a pair can
be lost with probability 2**-32).  A line goes if an earlier line (by document id,
then line number) matches it.

Lines with equal sets (equal 128-bit digests of the sorted keys) are one class, so
copies never meet; lines too short to be similar to any other set (up to three
words at 80 %) meet no line at all.  A key's lines are dealt out by length too: a
line stands in the band of lengths that holds its own, and where longer partners
may lie in the next band, in that one as well; two lines meet in the higher of
their bands.

Pairs are never made into rows.  Semi joins keep the entries that pass the filters
with an earlier line of their key, and the entries these pass with; both get the
64-bit hashes of all their words, and one more semi join, on the words, says which
later lines match.  Each search ends at its first hit, so rows grow with the lines
of a key.  A line that matches nothing is still compared with all earlier lines of
its keys.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import discard, held_generators, held_joins, room_for_groups, stored

PERCENT = 80
#: Lines with fewer distinct words (blank ones) stay.
MIN_WORDS = 1
#: log2 of the counters that order words by rarity: a table of one byte each, of fixed size.
COUNTER_BITS = 18
#: Distinct words from which a line has a second half of its bitmap.
LONG = 96
#: Rows that are broadcast to the documents, at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _words(line: Column) -> Column:
    """Lower-cased words between white space, some of them empty."""
    low = F.lower(line)
    odd = reduce(or_, (F.contains(line, F.lit(c)) for c in "\t\x0b\f\r"))  # much cheaper than a pattern
    return F.when(odd, F.split(low, r"\s+")).otherwise(F.split(low, " "))


def _counter(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1).cast("bigint"))


def rarity(lines: DataFrame) -> Column:
    """An array literal: of each counter, 0 (no hit) to 127 as its count's logarithm grows, counted over all words of all ``lines``."""
    counts = lines.select(F.explode("k").alias("w")).groupBy(_counter(F.col("w")).alias("c")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(127), 1 + F.floor(4 * F.log2("n"))).cast("bigint")
    eight = counts.groupBy(F.shiftright("c", 3).alias("at")).agg(F.bit_or(F.call_function("shiftleft", level, (F.col("c").bitwiseAND(F.lit(7)) * 8).cast("int"))).alias("levels"))
    table = bytearray(1 << COUNTER_BITS)
    with room_for_groups(lines.sparkSession, COUNTER_BITS + 1):
        for r in eight.toLocalIterator():  # 8 counters a row
            table[r["at"] * 8 : (r["at"] + 1) * 8] = r["levels"].to_bytes(8, "little")
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # the optimizer makes it a literal


def _few(table: DataFrame, lists: str) -> bool:
    """Whether ``table`` and the members of its lists are few enough to broadcast."""
    return (table.agg(F.sum(F.size(lists) + 1)).first()[0] or 0) <= BROADCAST_ROWS


def _lines(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(id, h, no, line) and ``more`` of the documents with an id; h tells apart rows that share it."""
    # made below the generator (see ``held_generators``): above it, whole texts would be copied and hashed for each line
    whole = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), *more, F.split(text, "\n").alias("_lines"))
    return whole.select("id", "h", *more, F.posexplode("_lines").alias("no", "line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """``lines`` with k for the line: the distinct words' hashes."""
    hashes = F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))
    return lines.select(*(c for c in lines.columns if c != "line"), F.array_except(hashes, F.array(F.xxhash64(F.lit("")))).alias("k"))


def _keyed(lines: DataFrame, rank: Column) -> DataFrame:
    """``lines`` with their hashes in k made into keys, rarest first."""

    def number(h: Column) -> Column:
        made = F.shiftleft(F.get(rank, _counter(h)), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
        return F.coalesce(made, F.lit(0).cast("bigint"))  # never null, and known to be: else each number is sorted as an object

    return lines.withColumn("k", F.sort_array(F.transform("k", number)))


def _digest() -> list[Column]:
    return [F.xxhash64("k").alias("d1"), F.xxhash64(F.lit(1), "k").alias("d2")]


def _bitmap(half: bool = False) -> Column:
    """64 bits, each flipped once for every key whose six lowest bits name it: k words that two sets do not share differ in k bits at most.

    ``half`` takes the keys whose bit 6 is set only, of sets of ``LONG`` words and
    more; what the whole bitmap differs in from it is that of the other keys.
    """
    low = lambda k, bits: k.bitwiseAND(F.lit(bits).cast("bigint"))
    one = lambda k: F.shiftright(low(k, 64), 6) if half else F.lit(1).cast("bigint")
    bits = F.aggregate("k", F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", one(k), low(k, 63).cast("int"))))
    return F.when(F.size("k") >= LONG, bits).otherwise(F.lit(0).cast("bigint")) if half else bits


def _band(n: Column) -> Column:
    """floor(log2(n)) + 1, exactly."""
    return F.length(F.bin(n.cast("bigint")))


def _entries(classes: DataFrame, percent: int) -> DataFrame:
    """(token, id, np, ni, b, b2): a row for each prefix key of each class, and one more where a longer partner lies in the next band.

    token is of the key and the band; np holds the line's number and 32 bits of the
    key before this one; ni holds the length, the key's place, and in its lowest bit
    whether the band is not its own.
    """
    n = F.col("n")
    own, upper = _band(n), _band(F.floor(n * 100 / percent))
    shorter = n - F.ceil(n * (2 * percent) / (100 + percent)) + 1  # as the shorter one of a pair
    long_enough = classes.where(f"100 * n >= {percent} * (n + 1)")  # a set of n words is n / (n + 1) similar to another one at most
    whole = lambda c: c.cast("bigint")

    rows = long_enough.select("id", "no", "n", "b", "b2", "prefix", own.alias("own"), F.when(upper > own, shorter).otherwise(0).cast("int").alias("more"))
    at = rows.select("*", F.posexplode(F.concat("prefix", F.slice("prefix", F.lit(1), F.col("more")))).alias("at", "key"))
    extra = F.col("at") >= F.size("prefix")
    at = at.select("id", "no", "n", "b", "b2", "prefix", "key", extra.cast("int").alias("extra"), (F.col("at") - F.when(extra, F.size("prefix")).otherwise(0)).alias("i"), (F.col("own") + extra.cast("int")).alias("band"))
    last = F.when(F.col("i") == 0, F.xxhash64("id", "no")).otherwise(F.get("prefix", F.col("i") - 1))
    ni = F.shiftleft(whole(F.col("n")), 32).bitwiseOR(F.shiftleft(whole(F.col("i")), 2)).bitwiseOR(whole(F.col("extra")))
    np = F.shiftleft(whole(F.col("no")), 32).bitwiseOR(last.bitwiseAND(whole(F.lit(0xFFFFFFFF))))
    return at.select(F.xxhash64("key", "band").alias("token"), "id", np.alias("np"), ni.alias("ni"), "b", "b2")


_LINE = ("id", "np", "ni", "b", "b2")


def _as(rows: DataFrame, side: str) -> DataFrame:
    """token and the line's columns, named after the side of a join that they are on."""
    return rows.select("token", *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "token"))


def _earlier(x: str, y: str) -> str:
    return f"({x}_id < {y}_id OR ({x}_id = {y}_id AND shiftright({x}_np, 32) < shiftright({y}_np, 32)))"


def _fits(percent: int, x: str, y: str) -> str:
    """Length, position and bitmap filters: none rejects two sets of the similarity at their first shared key."""
    n = lambda s: f"shiftright({s}_ni, 32)"
    left = lambda s: f"(shiftright({s}_ni, 32) - shiftright({s}_ni & 4294967295L, 2))"
    length = f"100 * least({n(x)}, {n(y)}) >= {percent} * greatest({n(x)}, {n(y)})"
    position = f"{100 + percent} * least({left(x)}, {left(y)}) >= {percent} * ({n(x)} + {n(y)})"
    bitmap = f"{100 + percent} * bit_count({x}_b ^ {y}_b) <= {100 - percent} * ({n(x)} + {n(y)})"
    halves = f"bit_count({x}_b2 ^ {y}_b2) + bit_count({x}_b ^ {y}_b ^ {x}_b2 ^ {y}_b2)"
    both = f"(least({n(x)}, {n(y)}) < {LONG} OR {100 + percent} * ({halves}) <= {100 - percent} * ({n(x)} + {n(y)}))"
    return f"({length} AND {position} AND {bitmap} AND {both})"


def _candidates(entries: DataFrame, meets: str) -> DataFrame:
    """``entries`` that may match an earlier line at their token (later) and those that may be that line, stored: a row each, not a row a pair."""
    # neither side's plan differs below this exchange, so it is made once
    entries = entries.where(" AND ".join(f"{c} IS NOT NULL" for c in entries.columns)).repartition("token")
    plain = lambda rows, side: rows.select("token", *(F.col(f"{side}_{c}").alias(c) for c in _LINE))
    later = plain(_semi(_as(entries, "x"), _as(entries, "y"), meets), "x").repartition("token", "id")
    earlier = plain(_semi(_as(entries, "y"), _as(later, "x"), meets), "y")
    with held_joins(later.sparkSession):
        return stored(later.withColumn("later", F.lit(True)).unionByName(earlier.withColumn("later", F.lit(False))), "candidates")


def _semi(left: DataFrame, right: DataFrame, meets: str) -> DataFrame:
    """Rows of ``left`` for which a row of ``right`` has the same token and ``meets``: the search ends at the first."""
    right = right.withColumnRenamed("token", "_token")
    return left.join(right, F.expr(f"token = _token AND {meets}"), "left_semi")


def _confirmed(docs: DataFrame, found: DataFrame, meets: str, key: str, text: str, percent: int) -> DataFrame:
    """(id, no, h) of the later lines of ``found`` of which an earlier one has 100 * intersection >= percent * union, distinct."""
    no = F.shiftright("np", 32).cast("int").alias("no")
    ends = stored(found.select("id", no).groupBy(F.col("id").alias("_id")).agg(F.collect_set("no").alias("_nos")), "ends")  # of each document, its lines
    some = docs.join(F.broadcast(ends) if _few(ends, "_nos") else ends, F.col(key).cast("bigint") == F.col("_id"))
    lines = _lines(some, key, text, "_nos").where(F.array_contains("_nos", F.col("no"))).select("id", "h", "no", "line")
    with held_generators(lines.sparkSession):
        lines = stored(_hashed(lines).distinct(), "hashes")
    held = found.withColumn("no", no).join(lines, ["id", "no"])
    x, y = _as(held.where("later"), "x"), _as(held.where("NOT later"), "y")
    similar = f"{100 + percent} * size(array_intersect(x_k, y_k)) >= {percent} * (size(x_k) + size(y_k))"
    gone = stored(_semi(x, y, f"{meets} AND {similar}").select(F.col("x_id").alias("id"), F.col("x_no").alias("no"), F.col("x_h").alias("h")).distinct(), "gone")
    discard(ends, lines)
    return gone


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, no) of every line that goes; h is the hash of its document's text."""
    with held_generators(docs.sparkSession):
        words = stored(_hashed(_lines(docs, key, text)), "words")
    n = F.size("k")
    prefix = F.slice("k", F.lit(1), n - F.ceil(n * percent / F.lit(100)).cast("int") + 1)
    keyed = _keyed(words, rarity(words))
    keyed = stored(keyed.select("id", "h", "no", *_digest(), n.alias("n"), _bitmap().alias("b"), _bitmap(half=True).alias("b2"), prefix.alias("prefix")), "lines")
    discard(words)
    first = F.min(F.struct("id", "no", "h", "n", "b", "b2", "prefix")).alias("first")
    classes = stored(keyed.groupBy("d1", "d2").agg(first, F.count("*").alias("m")).where(F.col("first.n") >= max(least_words, 1)).select("d1", "d2", "m", "first.*"), "classes")
    lines = stored(keyed.select("id", "h", "no", "d1", "d2"), "digests")
    discard(keyed)

    # two lines whose keys before this one are equal have met there
    meets = f"(x_ni & y_ni & 1) = 0 AND {_earlier('y', 'x')} AND ((x_np ^ y_np) & 4294967295L) <> 0 AND {_fits(percent, 'x', 'y')}"
    found = _candidates(_entries(classes, percent), meets)
    gone = _confirmed(docs, found, meets, key, text, percent).withColumn("matched", F.lit(True))
    discard(found)

    # of a class that matched all lines go, of another one all but the first
    several = classes.select("id", "no", "h", "d1", "d2", "m").join(gone, ["id", "no", "h"], "left").where("m > 1 OR matched")
    several = several.select("d1", "d2", F.col("id").alias("_id"), F.col("no").alias("_no"), "matched")
    return lines.select("id", "h", "no", "d1", "d2").join(several, ["d1", "d2"]).where("matched OR id <> _id OR no <> _no").select("id", "h", "no")


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, count: str | None = None) -> DataFrame:
    """``docs`` with later matches removed from ``text``; ``count`` names an added column with how many lines went.

    Lines end at \\n; words are lower-cased and part at white space.  Lines without
    a word stay.  A null text stays null and an
    empty one empty; a document that loses every line keeps an empty text.  A
    row with a null key keeps all lines and removes none.  Rows that share a
    key are one document: their lines at equal places are not later than each
    other.  All other columns pass through; none may be named _id, _h or _gone
    (ValueError).  An empty table gives an empty table.
    """
    if clash := {"_id", "_h", "_gone"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are used here")
    gone = stored(repeated_lines(docs, key, text, percent).groupBy("id", "h").agg(F.collect_set("no").alias("_gone")), "by_doc")
    gone = gone.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "_gone")
    joined = docs.join(F.broadcast(gone) if _few(gone, "_gone") else gone, (F.col(key).cast("bigint") == F.col("_id")) & (F.xxhash64(text) == F.col("_h")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    out = joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left))
    if count:
        out = out.withColumn(count, F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("bigint"))
    return out.drop("_id", "_h", "_gone")
