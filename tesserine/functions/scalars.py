"""Scalar functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes by powers of 1024, and of times in microseconds; fixed values.
SIZES = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
TIMES = ((1_000, "msec"), (1_000_000, "sec"), (60_000_000, "min"))


def human_size(n: Column) -> Column:
    """A count of bytes as text with a binary unit."""
    out = F.concat(n.cast("long").cast("string"), F.lit("bytes"))
    for k, unit in enumerate(SIZES, 1):
        out = F.when(n >= 1 << 10 * k, F.format_string(f"%.2f{unit}", n / float(1 << 10 * k))).otherwise(out)
    return out


def human_time(us: Column) -> Column:
    """Microseconds as text with a unit."""
    out = F.concat(us.cast("long").cast("string"), F.lit("usec"))
    for size, unit in TIMES:
        out = F.when(us >= size, F.format_string(f"%.2f{unit}", us / float(size))).otherwise(out)
    return out


def zigzag(n: Column) -> Column:
    """Signed to unsigned, small magnitudes first."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1)))


def _size(n: Column, bits: int, most: int) -> Column:
    out = F.lit(most)
    for k in range(most - 1, 0, -1):
        out = F.when(F.shiftrightunsigned(n, bits * k) == 0, k).otherwise(out)
    return out


def varint_size(n: Column) -> Column:
    """Bytes of a variable-length integer of seven bits a byte, of an unsigned long."""
    return _size(n, 7, 10)


def uint_bytes(n: Column) -> Column:
    """Least whole bytes that hold an unsigned long."""
    return _size(n, 8, 8)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two texts share."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def shared_suffix(a: Column, b: Column) -> Column:
    return shared_prefix(F.reverse(a), F.reverse(b))


def parse_int(text: Column, base: int) -> Column:
    """The signed number of 64 bits that a text begins with in a base from 2 to 36, after white space; signs that are
    no digits end it, and null stands for a text that begins with none."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    digits = f"[{digits}{digits.upper()}]+"
    body = F.regexp_extract(text, rf"^\s*([+-]?)({digits})", 2)
    value = F.conv(body, base, 10).cast("decimal(20,0)")
    signed = F.when(F.regexp_extract(text, rf"^\s*([+-]?)({digits})", 1) == "-", -value).otherwise(value)
    return F.when(body != "", signed.try_cast("long"))
