"""Column helpers over BINARY: bytes, little-endian numbers, byte search, running sums.

A binary decoded as ISO-8859-1 has one character a byte, so string search gives byte offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def char_literal(hex_digits: str) -> Column:
    """The ISO-8859-1 string of some bytes."""
    return F.lit(bytes.fromhex(hex_digits).decode("latin-1"))


def as_column(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cut(data: Column, offset: Column | int, size: Column | int) -> Column:
    """`size` bytes from a zero-based offset; shorter at the end."""
    return F.substring(data, (as_column(offset) + 1).cast("int"), as_column(size).cast("int"))


def number(data: Column, offset: Column | int, size: int, little: bool = True) -> Column:
    """Unsigned number of `size` bytes; null where the bytes aren't all there. Eight bytes give a decimal(20,0)."""
    places = range(size - 1, -1, -1) if little else range(size)
    turned = lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in places])
    value = let(F.hex(cut(data, offset, size)), lambda h: F.conv(turned(h), 16, 10)).cast("decimal(20,0)" if size > 7 else "bigint")
    return F.when(F.length(data) >= as_column(offset) + size, value)


def u8(data: Column, offset: Column | int) -> Column:
    return number(data, offset, 1)


def u16(data: Column, offset: Column | int) -> Column:
    return number(data, offset, 2)


def u32(data: Column, offset: Column | int) -> Column:
    return number(data, offset, 4)


def starts(data: Column, hex_digits: str) -> Column:
    return has(data, 0, hex_digits)


def has(data: Column, offset: Column | int, hex_digits: str) -> Column:
    """Whether the bytes at an offset are these."""
    return F.hex(cut(data, offset, len(hex_digits) // 2)) == hex_digits


def find(data: Column, hex_digits: str) -> Column:
    """Offset of the first place of some bytes, or null."""
    at = F.instr(latin1(data), char_literal(hex_digits))
    return F.when(at > 0, at - 1)


def rfind(data: Column, hex_digits: str) -> Column:
    """Offset of the last place of some bytes, or null."""
    turned = bytes.fromhex(hex_digits)[::-1].hex()
    at = F.instr(F.reverse(latin1(data)), char_literal(turned))
    return F.when(at > 0, F.length(data) - (at - 1) - len(hex_digits) // 2)


def running(lengths: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of bigint, in blocks so that long arrays aren't copied for each element."""
    zero, none = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def last(xs: Column) -> Column:
        return F.coalesce(F.try_element_at(xs, F.lit(-1)), none)

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: F.concat(a, F.array(last(a) + x)))

    def parts(v: Column) -> Column:
        count = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        return F.transform(F.sequence(F.lit(0), count), lambda b: sums(F.slice(v, b * block + 1, F.lit(block))))

    def joined(p: Column) -> Column:
        before = let(sums(F.transform(p, last)), lambda t: F.concat(F.array(none), t))
        return F.flatten(F.zip_with(p, F.slice(before, F.lit(1), F.size(p)), lambda x, o: F.transform(x, lambda v: v + o)))

    return let(lengths, lambda v: let(parts(v), joined))
