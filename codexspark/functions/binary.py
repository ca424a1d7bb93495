"""Integers, text and dates inside binary columns, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTSET = 0xFFFFFFFF
#: Seconds from 1904 to 1970 (a fixed value of the container format).
EPOCH_1904 = 2082844800


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row: a lambda's argument is bound and never inlined, so expressions
    that use it often stay small."""
    return F.transform(F.array(value), body)[0]


def part(data: Column, at: Column | int, size: Column | int) -> Column:
    """size bytes of data from 0-based offset `at`; null when data ends before."""
    at, size = (x if isinstance(x, Column) else F.lit(x) for x in (at, size))
    return F.when((at >= 0) & (at + size <= F.length(data)), F.substring(data, (at + 1).cast("int"), size.cast("int")))


def number(data: Column) -> Column:
    """A big-endian unsigned integer of up to 7 bytes."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def u8(data: Column, at: Column | int) -> Column:
    return number(part(data, at, 1))


def u16(data: Column, at: Column | int) -> Column:
    return number(part(data, at, 2))


def u24(data: Column, at: Column | int) -> Column:
    return number(part(data, at, 3))


def u32(data: Column, at: Column | int) -> Column:
    return number(part(data, at, 4))


def le32(data: Column, at: int) -> Column:
    return number(F.concat(*[part(data, at + i, 1) for i in (3, 2, 1, 0)]))


def swapped(value: Column) -> Column:
    """The same 32 bits in the other byte order."""
    return sum((F.shiftleft(F.shiftright(value, 8 * i).bitwiseAND(255), 24 - 8 * i) for i in range(1, 4)), F.shiftleft(value.bitwiseAND(255), 24))


def be(value: Column | int, width: int) -> Column:
    """An integer as so many big-endian bytes."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def first_value(data: Column) -> Column:
    """The big-endian number in the first four bytes or fewer; 0 for none."""
    return F.coalesce(number(F.when(F.length(data) > 0, F.substring(data, 1, 4))), F.lit(0).cast("long"))


def varlen(data: Column, at: Column | int, forward: bool = True) -> Column:
    """(value, size) of a 7-bit-group integer of at most 4 bytes whose end (forward: last byte, backward: first byte)
    has its top bit set. Backward reading starts at the byte before `at` and never takes byte 0."""
    at = at if isinstance(at, Column) else F.lit(at)
    byte = lambda i: u8(data, at + i if forward else at - 1 - i)
    ok = lambda i: F.lit(True) if forward else at - 1 - i > 0

    def step(acc: Column, i: Column) -> Column:
        b = F.when(ok(i), byte(i))
        go = ~acc["done"] & b.isNotNull()
        low = b.bitwiseAND(127)
        grown = F.shiftleft(acc["value"], 7).bitwiseOR(low) if forward else acc["value"] + low * F.pow(F.lit(128), i).cast("long")
        return F.struct(
            F.when(go, grown).otherwise(acc["value"]).alias("value"),
            F.when(go, acc["size"] + 1).otherwise(acc["size"]).alias("size"),
            (acc["done"] | b.isNull() | (b >= 128)).alias("done"),
        )

    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("size"), F.lit(False).alias("done"))
    got = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step)
    return F.struct(got["value"].alias("value"), got["size"].alias("size"))


def encoded_varlen(value: Column) -> Column:
    """Forward form: the top bit marks the last byte."""
    groups = [F.shiftright(value, 7 * i).bitwiseAND(127) for i in range(4)]
    size = F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).otherwise(4)
    out = [F.when(size > i, be(groups[i] + (128 if i == 0 else 0), 1)).otherwise(F.lit(b"")) for i in (3, 2, 1, 0)]
    return F.concat(*out)


def latin(data: Column) -> Column:
    """Bytes up to the first NUL, one character each."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), "(?s)\\x00.*", "")


def base32(text: Column) -> Column:
    """The value of digits 0-9A-V: leading zeros don't count, at most six digits do; else null."""
    return F.when(text.rlike("^0*[0-9A-V]{0,6}$"), F.coalesce(F.conv(F.when(text != "", text), 32, 10).cast("long"), F.lit(0).cast("long")))


def to_base32(value: Column, width: int = 4) -> Column:
    return F.lpad(F.conv(value.cast("string"), 10, 32), width, "0")


def container_time(value: Column) -> Column:
    """A container's time in UTC. Values below 1996 were written in the other byte order; with the top bit set the count
    starts in 1904, else in 1970."""
    v = F.when(value < 1996, swapped(value)).otherwise(value)
    return F.timestamp_seconds(F.when(v >= 1 << 31, v - EPOCH_1904).otherwise(v))


def xml_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out
