"""Scalar functions as Column expressions; all stay in the JVM and take part in code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_BITS = 12


def _c(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def entity_id(key: Column | str, archetype_id: Column | str | int) -> Column:
    """A 52-bit key and a 12-bit archetype id in one long; 0 is no entity."""
    return F.shiftleft(_c(key).cast("long"), ID_BITS).bitwiseOR(_c(archetype_id).cast("long"))


def entity_key(id_: Column | str) -> Column:
    return F.shiftrightunsigned(_c(id_), ID_BITS)


def archetype_of(id_: Column | str) -> Column:
    return _c(id_).bitwiseAND((1 << ID_BITS) - 1).cast("int")


# The masks that spread 16 bits to the even places of 32, and gather them again.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))
_GATHER = ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF))


def _even(x: Column) -> Column:
    return reduce(lambda v, s: v.bitwiseXOR(F.shiftleft(v, s[0])).bitwiseAND(s[1]), _SPREAD, x.cast("long").bitwiseAND(0xFFFF))


def _odd_out(x: Column) -> Column:
    return reduce(lambda v, s: v.bitwiseXOR(F.shiftright(v, s[0])).bitwiseAND(s[1]), _GATHER, x.bitwiseAND(0x55555555)).cast("int")


def morton(x: Column | str, y: Column | str) -> Column:
    """Interleave the low 16 bits of x (even places) and y (odd places); a long, so that it never turns negative."""
    return _even(_c(x)).bitwiseOR(F.shiftleft(_even(_c(y)), 1))


def morton_x(key: Column | str) -> Column:
    return _odd_out(_c(key).cast("long"))


def morton_y(key: Column | str) -> Column:
    return _odd_out(F.shiftright(_c(key).cast("long"), 1))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def cell_index(x: Column | str, origin: float, size: float, cells: int) -> Column:
    """The clamped cell of a coordinate; a coordinate that isn't finite is an error."""
    x = _c(x).cast("double")
    index = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((x - origin) / size)))
    return F.when(is_finite(x) | x.isNull(), index).otherwise(F.raise_error(F.lit("a coordinate is not finite"))).cast("int")


# 100-ns ticks at 1970-01-01 counted from year 1, and the ticks of a packed unit as a shift.
EPOCH_TICKS, PACKED_SHIFT = 621355968000000000, 10


def pack_time(ts: Column | str) -> Column:
    """A timestamp in units of 1024 ticks (102.4 microseconds) since 1970."""
    return F.shiftright(F.unix_micros(_c(ts)) * 10, PACKED_SHIFT)


def unpack_time(packed: Column | str) -> Column:
    return F.timestamp_micros(F.floor(F.shiftleft(_c(packed).cast("long"), PACKED_SHIFT) / 10).cast("long"))


def to_ticks(packed: Column | str) -> Column:
    return F.shiftleft(_c(packed).cast("long"), PACKED_SHIFT) + EPOCH_TICKS


def pack_span(micros: Column | str, bits: int = 48) -> Column:
    """A duration in microseconds in units of 1024 ticks; out of range is null."""
    p = F.shiftright(_c(micros).cast("long") * 10, PACKED_SHIFT)
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    return F.when(p.between(low, high), p)


# The tags of a variant's text, "tt:data".
VARIANT_TAGS = {"Boolean": "bo", "Byte": "sb", "Short": "ss", "Int": "si", "Long": "sl", "String": "st"}


def variant(value: Column | str, kind: str) -> Column:
    v = _c(value)
    text = F.when(v, F.lit("1")).when(~v, F.lit("0")) if kind == "Boolean" else v.cast("string")
    return F.concat(F.lit(VARIANT_TAGS[kind] + ":"), text)


def variant_type(v: Column | str) -> Column:
    tag = F.when(F.substring(_c(v), 3, 1) == ":", F.substring(_c(v), 1, 2))
    return reduce(lambda out, kt: out.when(tag == kt[1], F.lit(kt[0])), VARIANT_TAGS.items(), F.when(tag.isNull(), F.lit(None).cast("string")))


def variant_as(v: Column | str, kind: str) -> Column:
    """The value if the variant is of that kind, else null."""
    data = F.substr(_c(v), F.lit(4))
    value = data == "1" if kind == "Boolean" else data if kind == "String" else data.try_cast({"Byte": "byte", "Short": "short", "Int": "int", "Long": "long"}[kind])
    return F.when(variant_type(v) == kind, value)


def fixed_text(s: Column | str, size: int = 64) -> Column:
    """Text cut to a fixed number of UTF-8 bytes, one of them kept for the end, without a torn last character."""
    b = _c(s).cast("binary")
    cut = lambda n: F.substring(b, 1, n)
    return F.when(F.length(b) < size, _c(s)).otherwise(reduce(lambda out, k: F.coalesce(out, F.try_validate_utf8(cut(size - 1 - k).cast("string"))), range(1, 4), F.try_validate_utf8(cut(size - 1).cast("string"))))


def compare(x: Column, op: str, y: Column | object, floating: bool = True) -> Column:
    """One of == != < <= > >= by the rules of IEEE 754: a NaN makes all but != false. Nulls give null."""
    y = y if isinstance(y, Column) else F.lit(y)
    out = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if not floating:
        return out
    odd = F.isnan(x.cast("double")) | F.isnan(y.cast("double"))
    return (odd | out) if op == "!=" else (~odd & out)


def category_match(category: Column, mask: int, how: str = "all") -> Column:
    """Whether a category has all, or any, of the mask's bits; mask 0 is no filter."""
    if not mask:
        return F.lit(True)
    both = category.bitwiseAND(mask)
    return both == mask if how == "all" else both != 0
