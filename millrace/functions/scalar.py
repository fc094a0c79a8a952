"""Scalar functions as column expressions; none leaves whole-stage code generation for Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(s: Column, delimiter: str) -> Column:
    """Split at a regular expression, empty tokens dropped."""
    return F.filter(F.split(s, delimiter), lambda x: x != "")


def regex_int(s: Column, pattern: str) -> Column:
    """Group 1 as a number, 0 if there is none."""
    return F.coalesce(F.regexp_extract(s, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def hex_padded(n: Column, digits: int) -> Column:
    """Lower-case hexadecimal with at least so many digits (longer numbers are kept whole)."""
    h = F.lower(F.hex(n))
    return F.when(F.length(h) >= digits, h).otherwise(F.lpad(h, digits, "0"))


def hex_parsed(s: Column) -> Column:
    return F.conv(F.regexp_replace(F.lower(s), "^0x", ""), 16, 10).cast("bigint")


#: Characters that an argument list loses for a slug, each written as an underscore (fixed values).
SLUG_CHARACTERS = " /.-=><,"


def slug(s: Column) -> Column:
    return F.when(s.isNull() | (s == ""), F.lit("NO_ARGS")).otherwise(F.translate(s, SLUG_CHARACTERS, "_" * len(SLUG_CHARACTERS)))


def word_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9a-zA-Z]+", "_")


def bit_field(x: Column, low: int, bits: int) -> Column:
    return F.shiftright(x, low).bitwiseAND(F.lit((1 << bits) - 1))


def first_set(x: Column) -> Column:
    """Position of the lowest set bit from 1, 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.bitwiseAND(-x))))


def leading_zeros(x: Column, width: int = 64) -> Column:
    return F.when(x == 0, width).otherwise(width - F.length(F.bin(x)))


def xor_index(idx: Column, high: Column, n: int) -> Column:
    """idx xor the low bits of ``high``; n is a power of two."""
    return idx.bitwiseXOR(high.bitwiseAND(F.lit(n - 1)))


def polynomial_hash(x: Column, taps: list[list[int]]) -> Column:
    """Bit k of the result is the xor of the bits of ``x`` that taps[k] names."""
    out = F.lit(0).cast("bigint")
    for k, bits in enumerate(taps):
        bit = F.lit(0).cast("bigint")
        for b in bits:
            bit = bit.bitwiseXOR(F.shiftright(x, b).bitwiseAND(F.lit(1)).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(bit, k))
    return out


def linear_index(x: Column, y: Column, z: Column, nx, ny) -> Column:
    return z * ny * nx + y * nx + x


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b).cast("bigint")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 on a zero divisor."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def percent_difference(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """0 where both are tiny, else 100 |a - b| / |a + eps|."""
    return F.when((F.abs(a) < 0.01) & (F.abs(b) < 0.01), 0.0).otherwise(100 * F.abs(F.abs(a - b) / F.abs(a + eps)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def planar_distance(x1: Column, y1: Column, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def active_lanes(mask: Column, lanes: int = 32) -> Column:
    """Array of the set bits' positions."""
    return F.filter(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda k: F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1)


def lane_addresses(base: Column, stride: Column, mask: Column, lanes: int = 32) -> Column:
    """Address of each active lane: base + k * stride, k counting active lanes."""
    return F.transform(active_lanes(mask, lanes), lambda _, k: base + k * stride)


def delta_addresses(base: Column, deltas: Column) -> Column:
    """Base, then the running sums of the deltas on it."""
    step = lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d))
    return F.aggregate(deltas, F.array(base.cast("bigint")), step)


FULL_MASK = 4294967295


def filled_masks(flags: Column, active: Column, predicate: Column) -> tuple[Column, Column]:
    """Bit 0 of ``flags``: all lanes are active; bit 1: the predicate mask equals the active one."""
    a = F.when(flags.bitwiseAND(F.lit(1)) != 0, F.lit(FULL_MASK)).otherwise(active).cast("bigint")
    return a, F.when(flags.bitwiseAND(F.lit(2)) != 0, a).otherwise(predicate).cast("bigint")


def expanded_run(start: Column, delta: Column, count: Column) -> Column:
    """start, start + delta, ... of ``count`` values."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1), lambda k: start + k * delta)).otherwise(F.array().cast("array<bigint>"))


def seconds_in_parentheses(s: Column) -> Column:
    """N of a trailing ``(N sec)``."""
    return F.regexp_extract(s, r"\(([0-9]+) sec\)", 1).try_cast("int")


def bit_complement(x: Column, bits: int) -> Column:
    return F.bitwise_not(x).bitwiseAND(F.lit((1 << bits) - 1))


def bit_reversed(x: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("bigint")


def bit_transposed(x: Column, bits: int) -> Column:
    """The two halves of an index of an even number of bits swapped."""
    half, mask = bits // 2, (1 << (bits // 2)) - 1
    return F.shiftleft(x.bitwiseAND(F.lit(mask)), half).bitwiseOR(F.shiftright(x, half).bitwiseAND(F.lit(mask)))


def bit_rotated(x: Column, bits: int) -> Column:
    """One place to the left, within ``bits`` bits."""
    return F.shiftleft(x, 1).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.shiftright(x, bits - 1).bitwiseAND(F.lit(1)))
