"""Dealing keys out to shards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.slices import bytes_of

#: Fixed values of the shard hash: h = h * 101 + signed byte, modulo 2**64.
MULTIPLIER, HALF = 101, 1 << 32


def _halves(key: Column) -> Column:
    """The hash as two numbers of 32 bits, ``hi`` and ``lo``, so that no product leaves 64 bits."""
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)

    def step(h: Column, b: Column) -> Column:
        low = h["lo"] * F.lit(MULTIPLIER) + signed(b)
        high = h["hi"] * F.lit(MULTIPLIER) + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(F.lit(HALF - 1)).alias("hi"), low.bitwiseAND(F.lit(HALF - 1)).alias("lo"))

    zero = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    return F.aggregate(bytes_of(key), zero, step)


def shard_hash(key: Column) -> Column:
    """The exact shard hash as DECIMAL(38,0), for diagnostics; dealing itself uses Spark's hash."""
    wide, h = "decimal(20,0)", _halves(key)
    return (h["hi"].cast(wide) * F.lit(HALF).cast(wide) + h["lo"].cast(wide)).cast("decimal(38,0)")


def shard_of(key: Column, n: int) -> Column:
    """The shard's number; ``n`` is below 2**31."""
    if n < 1:
        raise ValueError("a table has at least one shard")
    h = _halves(key)
    return ((h["hi"] % n) * F.lit(HALF % n) + h["lo"]) % n


def histogram(table: DataFrame, key: Column, n: int) -> DataFrame:
    return table.groupBy(shard_of(key, n).alias("shard")).agg(F.count(F.lit(1)).alias("n_keys"))


def deal(table: DataFrame, n: int, key: str) -> DataFrame:
    """Hash partitions: all versions of a key lie together."""
    return table.repartition(n, key)


def stripe(table: DataFrame, number: Column, n: int, i: int) -> DataFrame:
    """Every n-th row by a dense number: disjoint shares for parallel writers."""
    return table.where(number % n == i)


def merge(shards: list[DataFrame], key: str) -> DataFrame:
    """One ordered table from disjoint shards."""
    out = shards[0]
    for more in shards[1:]:
        out = out.unionByName(more)
    return out.orderBy(key)
