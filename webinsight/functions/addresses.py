"""Internet addresses as text keys: `4` and 8 hex digits, or `6` and 32, so that keys of one version sort and compare as numbers.

Text is taken as strictly as published lists and well-formed logs have it: four decimal octets without leading zeros; eight groups
of hex digits, of which :: stands for one or more, the last two perhaps as dotted octets, perhaps with a %zone, which is left out.
Anything else is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webinsight.operators.common import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
BITS = {"4": 32, "6": 128}


def _whole(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def _dotted_hex(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))


def _v6(plain: Column) -> Column:
    """Text without zone -> 32 hex digits."""
    none = F.array().cast("array<string>")

    def sides(p: Column) -> Column:
        at = F.instr(p, "::")
        left = F.when(at > 0, _groups(F.substring(p, F.lit(1), at - 1))).otherwise(F.split(p, ":", -1))
        return F.struct((at > 0).alias("cut"), left.alias("left"), F.when(at > 0, _groups(F.substring(p, at + 2, F.length(p)))).otherwise(none).alias("right"))

    def whole(x: Column) -> Column:
        n = F.size(x["left"]) + F.size(x["right"])
        groups = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), x["right"])
        return F.when(F.when(x["cut"], n <= 7).otherwise(n == 8), groups)

    good = lambda g: F.forall(g, lambda x: _whole(x, "[0-9A-Fa-f]{1,4}"))
    digits = lambda g: F.lower(F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
    return let(let(let(plain, sides), whole), lambda g: F.when(good(g), digits(g)))


def _dotted_tail(text: Column) -> Column:
    """The last two groups, where they are dotted octets, as hex groups."""
    tail = let(F.regexp_extract(text, rf":({DOTTED})\z", 1), lambda t: F.when(t != "", _dotted_hex(t)))
    return let(tail, lambda h: F.when(h.isNull(), text).otherwise(F.concat(F.regexp_replace(text, rf"{DOTTED}\z", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))))


def address_key(text: Column) -> Column:
    """An address of either version -> its key."""
    v6 = let(F.regexp_replace(text, r"%[^%]+\z", ""), lambda p: F.concat(F.lit("6"), _v6(_dotted_tail(p))))
    return F.when(_whole(text, DOTTED), F.concat(F.lit("4"), _dotted_hex(text))).when(text.contains(":"), v6)


def cell(key: Column, prefix: Column) -> Column:
    """The first `prefix` bits of a key: its version, /prefix, and the hex digits that these bits fill, with the rest of the last one zero."""
    whole, rest = F.floor(prefix / 4).cast("int"), (prefix % 4).cast("int")
    digit = F.conv(F.substring(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    cut = F.get(F.array(*map(F.lit, (0, 8, 12, 14))), rest)
    last = F.when(rest == 0, "").otherwise(F.lower(F.hex(digit.bitwiseAND(cut))))
    return F.concat(F.substring(key, 1, 1), F.lit("/"), prefix.cast("string"), F.lit(":"), F.substring(key, F.lit(2), whole), last)


def _prefix(key: Column, parts: Column) -> Column:
    """Bits of a network's prefix: all, a number, or those of a dotted mask of either kind."""
    mask, width = F.get(parts, 1), F.when(key.startswith("4"), BITS["4"]).otherwise(BITS["6"])
    bits = F.array_join(F.transform(F.split(mask, r"\."), lambda o: F.lpad(F.bin(o.cast("int")), 8, "0")), "")
    by_mask = let(bits, lambda b: let(F.length(F.replace(b, F.lit("0"), F.lit(""))), lambda ones: F.when(b.rlike(r"\A1*0*\z"), ones).when(b.rlike(r"\A0*1*\z"), 32 - ones)))
    return F.when(F.size(parts) == 1, width).when(_whole(mask, "[0-9]{1,4}"), mask.cast("int")).when(key.startswith("4") & _whole(mask, DOTTED), by_mask)


def _strict(key: Column, prefix: Column) -> Column:
    width = 4 * (F.length(key) - 1)
    first = F.rpad(F.element_at(F.split(cell(key, prefix), ":"), 2), F.length(key) - 1, "0")
    return F.when(prefix.between(F.lit(0), width) & (first == F.substring(key, F.lit(2), F.length(key))), F.struct(key.alias("key"), prefix.cast("int").alias("prefix")))


def network(text: Column) -> Column:
    """A network `address`, `address/bits` or `dotted/dotted mask` -> (key, prefix); null where bits beyond the prefix are set."""
    parts = lambda p: let(address_key(F.get(p, 0)), lambda k: let(_prefix(k, p), lambda n: _strict(k, n)))
    return let(F.split(text, "/", -1), lambda p: F.when(F.size(p) <= 2, parts(p)))
