"""Byte-string functions, all JVM-side columns.

Spark orders BINARY as unsigned bytes with the shorter string first, so no
comparator has to be supplied; these give the remaining byte-level operations.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: Column, b: Column) -> Column:
    """Three-way byte comparison: -1, 0 or 1; null if either side is."""
    a, b = a.cast("binary"), b.cast("binary")
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def equal(a: Column, b: Column) -> Column:
    return a.cast("binary") == b.cast("binary")


def less(a: Column, b: Column) -> Column:
    return a.cast("binary") < b.cast("binary")


def size(a: Column) -> Column:
    return F.octet_length(a)


def byte_at(a: Column, n: int) -> Column:
    """The byte at 0-based position ``n``; null past the end."""
    return F.conv(F.nullif(F.hex(F.substring(a.cast("binary"), n + 1, 1)), F.lit("")), 16, 10).cast("int")


def to_text(a: Column) -> Column:
    return F.decode(a.cast("binary"), "UTF-8")


def fingerprint(a: Column) -> Column:
    """A 64-bit hash for dealing and bucketing; its value has no meaning outside Spark."""
    return F.xxhash64(a)


def bytes_of(a: Column) -> Column:
    """The bytes as an array of ints, empty for an empty string."""
    return F.transform(_one_by_one(a), lambda c: F.ascii(c))


def _one_by_one(a: Column) -> Column:
    """The bytes as an array of one-character strings."""
    return F.filter(F.split(F.decode(a.cast("binary"), "ISO-8859-1"), ""), lambda c: c != "")


def escape(a: Column) -> Column:
    """Printable ASCII as it is, any other byte as its decimal in brackets."""
    shown = F.transform(_one_by_one(a), lambda c: F.when((c >= " ") & (c <= "~"), c).otherwise(F.concat(F.lit("["), F.ascii(c).cast("string"), F.lit("]"))))
    return F.array_join(shown, "")


def trim_nuls(a: Column) -> Column:
    """The hex form without trailing NUL bytes: equal for keys that differ in those alone."""
    return F.regexp_replace(F.hex(a.cast("binary")), "(00)+$", "")
