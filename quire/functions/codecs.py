"""Column functions for hashes, variable-length numbers and bit sizes of the index formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_hash(url: Column) -> Column:
    """h = (43 h + d) mod 2**32 over the characters; '/' counts 44, those beyond 'Z' code - 80, others code - 48; 0 becomes 1."""

    def step(h: Column, c: Column) -> Column:
        o = F.ascii(c).cast("bigint")
        d = F.when(c == "/", F.lit(44)).when(o > 90, o - 80).otherwise(o - 48)
        return (h * 43 + d).bitwiseAND(4294967295)

    h = F.aggregate(F.filter(F.split(url, ""), lambda c: c != ""), F.lit(0).cast("bigint"), step)
    return F.when(h == 0, 1).otherwise(h).cast("bigint")


def _groups(n: Column) -> Column:
    """Number of seven-bit groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7).cast("int"))


def leb128_len(n: Column) -> Column:
    """Number of bytes of ``leb128_hex``."""
    return _groups(n).cast("bigint")


def leb128_hex(n: Column) -> Column:
    """Little-endian groups of seven bits, the high bit set on all but the last."""
    last = _groups(n) - 1
    part = lambda i: F.pmod(F.floor(n / F.pow(F.lit(128.0), i)).cast("bigint"), F.lit(128)) + F.when(i < last, 128).otherwise(0)
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(part(i)), 2, "0")), ""))


def encint_hex(n: Column) -> Column:
    """Big-endian groups of seven bits, the high bit set on all but the last; negative numbers are an error."""
    n = F.when(n < 0, F.raise_error(F.lit("negative number"))).otherwise(n)
    last = _groups(n) - 1
    part = lambda i: F.pmod(F.floor(n / F.pow(F.lit(128.0), last - i)).cast("bigint"), F.lit(128)) + F.when(i < last, 128).otherwise(0)
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(part(i)), 2, "0")), ""))


def scale_root_bits(n: Column, root: int) -> Column:
    """The code of a number as a string of bits: a prefix of ones, a zero, then the number's bits without the leading one."""
    size = F.when(n == 0, 0).otherwise(F.length(F.bin(n)))
    prefix = F.greatest(size - root, F.lit(0))
    width = F.greatest(size - 1, F.lit(root))
    width = F.when(size <= root, F.lit(root)).otherwise(width)
    low = F.when(size <= root, F.lpad(F.bin(n), root, "0")).otherwise(F.substring(F.bin(n), F.lit(2), width))
    return F.concat(F.repeat(F.lit("1"), prefix.cast("int")), F.lit("0"), low)


def scale_root_size(n: Column, root: int) -> Column:
    """Number of bits of ``scale_root_bits``."""
    size = F.when(n == 0, 0).otherwise(F.length(F.bin(n)))
    return (F.greatest(size - root, F.lit(0)) + 1 + F.greatest(size - 1, F.lit(root))).cast("bigint")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the shared prefix of two strings."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when((a == "") | (b == ""), 0).otherwise(F.when(at == 0, F.length(a)).otherwise(at - 1)).cast("bigint")


def filetime(at: Column) -> Column:
    """100-nanosecond steps since 1601."""
    return F.unix_micros(at) * 10 + F.lit(116444736000000000)
