"""Format-preserving pseudonyms for numbers and dates, in DataFrame operations only.

Validated card numbers (Luhn), phone numbers, IPv4 addresses and calendar dates
are replaced by others of the same form.  A value is split into two numbers
A < a and B < b and put through a keyed Feistel network with modular addition,
A += F(B) mod a and B += F(A) mod b in turn, F being SHA-256 under the key: a
permutation of the a * b values, so equal values stay linked over all documents
and different ones stay different.  A card's check digit is computed anew; a
date stays within its block of 72,900 days (the last block of the calendar: 7,059).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_DATE_ISO = r"(?<![0-9A-Za-z])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z])"
_DATE_DAY = r"(?<![0-9A-Za-z])(?:[0-9]{2}\.[0-9]{2}\.|[0-9]{2}/[0-9]{2}/)[0-9]{4}(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
_PHONE = r"\+1[ -]?\([0-9]{3}\)[ -]?[0-9]{3}-[0-9]{4}(?![0-9])"
_GROUPS = "|".join(f"[0-9]{{4}}(?:{s}[0-9]{{4}}){{2}}{s}[0-9]{{1,7}}|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}" for s in " -")
_CARD = rf"(?<![0-9A-Za-z])(?:[0-9]{{13,19}}|{_GROUPS})(?![0-9A-Za-z])"
#: Alternatives in the order in which they are tried at a place.
KINDS = {"date_iso": _DATE_ISO, "date_day": _DATE_DAY, "ip": _IP, "phone": _PHONE, "card": _CARD}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_BLOCK, _SIDE = 72_900, 270  # days of a block, and its square root
_TAIL, _TAIL_A, _TAIL_B = 3_645_000, 39, 181  # first day of the last block, and the two factors of its 7,059 days


def _int(c: Column) -> Column:
    return c.cast("bigint")


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Sum with every second digit doubled; ``odd`` 1: from the last digit on, 0: from the one before it."""

    def worth(c: Column, i: Column) -> Column:
        d = _int(c)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == odd, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0).cast("bigint"), lambda a, b: a + b)


def _feistel(key: str, tag: Column, a_size: Column, b_size: Column, a: Column, b: Column) -> Column:
    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        other = F.when(even, acc["b"]).otherwise(acc["a"])
        size = F.when(even, a_size).otherwise(b_size)
        word = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, a_size.cast("string"), b_size.cast("string"), r.cast("string"), other.cast("string")), 256), 1, 15), 16, 10)
        moved = F.pmod(F.when(even, acc["a"]).otherwise(acc["b"]) + _int(word), size)
        return F.struct(F.when(even, moved).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(moved).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), step)


def _kind(m: Column) -> Column:
    out = F
    for name, p in KINDS.items():
        out = out.when(m.rlike(rf"^(?:{p})$"), F.lit(name))
    return out


def _days_in_month(y: Column, mo: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)


def _put_digits(m: Column, digits: Column) -> Column:
    """The string ``m`` with its digits replaced in order."""

    def one(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _parsed(m: Column) -> Column:
    """Kind and raw parts of a match."""
    kind = _kind(m)
    digits = F.regexp_replace(m, "[^0-9]", "")
    iso = kind == "date_iso"
    y = _int(F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4)))
    mo = _int(F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2)))
    d = _int(F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2)))
    date = kind.isin("date_iso", "date_day")
    whole = F.when(date, F.lit(0).cast("bigint"))
    return F.struct(m.alias("m"), kind.alias("kind"), digits.alias("digits"), F.when(date, y).otherwise(whole).alias("y"), F.when(date, mo).alias("mo"), F.when(date, d).alias("d"))


def _valid(p: Column) -> Column:
    date = (p["y"] >= 1) & p["mo"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= _days_in_month(p["y"], p["mo"]))
    return F.when(p["kind"].isin("date_iso", "date_day"), date).when(p["kind"] == "card", _luhn_sum(p["digits"], 0) % 10 == 0).otherwise(F.lit(True))


def _numbers(p: Column) -> Column:
    """The two halves of a valid match's value, and their ranges.  Only meaningful where the match is valid."""
    day = F.datediff(F.make_date(p["y"].cast("int"), p["mo"].cast("int"), p["d"].cast("int")), F.lit("0001-01-01").cast("date")).cast("bigint")
    first = F.floor(day / _BLOCK) * _BLOCK
    tail = day >= _TAIL
    b_date = F.when(tail, F.lit(_TAIL_B)).otherwise(F.lit(_SIDE)).cast("bigint")
    body = F.when(p["kind"] == "card", F.substring(p["digits"], F.lit(1), F.length(p["digits"]) - 1)).otherwise(F.substring(p["digits"], 2, 10))
    half = F.floor(F.length(body) / 2).cast("int")
    octet = lambda k: _int(F.element_at(F.split(p["m"], r"\."), k))
    date = p["kind"].isin("date_iso", "date_day")
    ip = p["kind"] == "ip"
    ten = lambda n: F.pow(F.lit(10.0), n).cast("bigint")
    return F.struct(
        F.when(date, _int(first)).alias("first"),
        F.when(date, F.lit("date")).otherwise(p["kind"]).alias("tag"),
        F.when(date, F.floor((day - first) / b_date)).when(ip, octet(1) * 256 + octet(2)).otherwise(_int(F.substring(body, F.lit(1), half))).cast("bigint").alias("a"),
        F.when(date, (day - first) % b_date).when(ip, octet(3) * 256 + octet(4)).otherwise(_int(F.substring(body, half + 1, F.lit(20)))).cast("bigint").alias("b"),
        F.when(date, F.when(tail, F.lit(_TAIL_A)).otherwise(F.lit(_SIDE))).when(ip, F.lit(65536)).otherwise(ten(half)).cast("bigint").alias("sa"),
        F.when(date, b_date).when(ip, F.lit(65536)).otherwise(ten(F.length(body) - half)).cast("bigint").alias("sb"),
        F.length(body).alias("width"),
        half.alias("half"),
    )


def _written(p: Column, n: Column, f: Column) -> Column:
    """The pseudonym in the form of the match."""
    day = F.date_add(F.lit("0001-01-01").cast("date"), (n["first"] + f["a"] * n["sb"] + f["b"]).cast("int"))
    part = lambda c, w: F.lpad(c.cast("string"), w, "0")
    y, mo, d = part(F.year(day), 4), part(F.month(day), 2), part(F.day(day), 2)
    body = F.concat(part(f["a"], n["half"]), part(f["b"], n["width"] - n["half"]))
    card = F.concat(body, F.pmod(10 - _luhn_sum(body, 1) % 10, F.lit(10)).cast("string"))
    dot = F.lit(".")
    ip = F.concat_ws(".", *(F.floor(x / 256).cast("bigint").cast("string") if hi else (x % 256).cast("string") for x in (f["a"], f["b"]) for hi in (True, False)))
    sep = F.substring(p["m"], 3, 1)
    return (
        F.when(p["kind"] == "date_iso", F.concat_ws("-", y, mo, d))
        .when(p["kind"] == "date_day", F.concat(d, sep, mo, sep, y))
        .when(p["kind"] == "ip", ip)
        .when(p["kind"] == "phone", _put_digits(p["m"], F.concat(F.lit("1"), body)))
        .otherwise(_put_digits(p["m"], card))
    )


def _over(c: Column, f) -> Column:
    """f of a value that is computed once (a lambda's argument)."""
    return F.element_at(F.transform(F.array(c), f), 1)


def pseudonym(m: Column, key: str) -> Column:
    """(kind, original, pseudonym) of one match; an invalid one keeps its text and has no kind."""

    def of(p: Column) -> Column:
        def put(n: Column) -> Column:
            return _over(_feistel(key, n["tag"], n["sa"], n["sb"], n["a"], n["b"]), lambda f: _written(p, n, f))

        ok = _valid(p)
        return F.struct(F.when(ok, p["kind"]).alias("kind"), p["m"].alias("original"), F.when(ok, _over(_numbers(p), put)).otherwise(p["m"]).alias("pseudonym"))

    return _over(_parsed(m), of)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``found``: array of (kind, original, pseudonym) of its replaced values in order.

    One projection: no shuffle, and documents without a candidate are only
    scanned.  Invalid candidates (a wrong check digit, no such day) stay as
    they are and are not in ``found``.  A null text stays null with an empty
    array.  Repeated rows are treated each; other columns pass through, and
    none may be named like ``found`` or _made (ValueError).
    """
    if clash := {found, "_made"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are made here")
    has = F.coalesce(F.col(text).rlike("[0-9]"), F.lit(False))
    matches = F.when(has, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    made = docs.withColumn("_made", F.transform(matches, lambda m: pseudonym(m, key)))
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.transform(pieces, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.element_at("_made", F.greatest(i, F.lit(1)))["pseudonym"], s))), "")
    changed = F.coalesce(F.size("_made"), F.lit(0)) > 0
    none = F.array().cast(made.schema["_made"].dataType)
    return made.withColumn(found, F.coalesce(F.filter("_made", lambda x: x["kind"].isNotNull()), none)).withColumn(text, F.when(changed, joined).otherwise(F.col(text))).drop("_made")
