"""Connected components, and groups in tasks of bounded size."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.shared import SharedTables, checkpointed

#: Rows of a few numbers that fill a file.
FILE_ROWS = 100_000
#: Bits per key of a broadcast filter, most bits (16 MB), and bits of one of its rows.
KEY_BITS, FILTER_BITS, CHUNK = 16, 1 << 27, 4096


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b) but the roots: ``root`` is the smallest node it reaches.

    Alternating stars: every node hands its larger neighbours, then its smaller
    ones, to the smallest node next to it, until only stars are left. A round
    is a few aggregations and joins on nodes with one row per link, so a hub is
    never collected; each round is cut from its lineage in the shared folder, in
    as many files as its links ask for: a round at most doubles them.
    """
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        n, odd = _counted(links)
        if not odd:
            break
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("_m")).select(F.col("n").alias("_n"), F.least("n", "_m").alias("_m"))
        large = both.where("m > n").join(least, F.col("n") == F.col("_n")).select(F.col("m").alias("hi"), F.col("_m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("_m")).select(F.col("hi").alias("_hi"), "_m")
        moved = large.join(small, F.col("hi") == F.col("_hi")).where("lo <> _m").select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
        links = checkpointed(moved.unionByName(small.select(F.col("_hi").alias("hi"), F.col("_m").alias("lo"))).distinct().coalesce(n_files(edges.sparkSession, 2 * n)))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def n_files(spark: SparkSession, n: int) -> int:
    """Files for ``n`` rows of a few numbers: no more than they fill, and no more than the session has partitions."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_ROWS)))


def _counted(links: DataFrame) -> tuple[int, int]:
    """How many links there are, and at how many nodes they are not stars: a larger end has one smaller end, which is no larger end itself."""
    ends = links.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, odd = nodes.agg(F.sum("up"), F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()
    return n or 0, odd


def screened(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key``, a hash, may be one of ``keys``, a table of that one column, and those of which it is none.

    A bit for each key comes to the rows, so that rows of the second kind need
    not be dealt by key. One in 16 of them at most is taken for the first kind;
    past 8 million keys the filter does not grow, and more are. So a join has to
    follow on the first.
    """
    bits = max(CHUNK, min(1 << (KEY_BITS * keys.count()).bit_length(), FILTER_BITS))
    words = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(bits)).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("set"))
    chunks = words.groupBy(F.expr(f"word div {CHUNK // 64}").alias("_tidelog_chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"word % {CHUNK // 64}"), "set"))).alias("sets"))
    chunks = chunks.select("_tidelog_chunk", F.expr(f"transform(sequence(0L, {CHUNK // 64 - 1}L), w -> coalesce(try_element_at(sets, w), 0L))").alias("_tidelog_bits"))
    at = rows.withColumn("_tidelog_at", F.pmod(key, F.lit(bits)))
    found = at.join(F.broadcast(chunks), F.expr(f"_tidelog_at div {CHUNK}") == F.col("_tidelog_chunk"), "left")
    is_set = F.expr(f"coalesce(getbit(_tidelog_bits[cast(_tidelog_at % {CHUNK} div 64 as int)], cast(_tidelog_at % 64 as int)) = 1, false)")
    return found.where(is_set).select(*rows.columns), found.where(~is_set).select(*rows.columns)


def split(rows: DataFrame, key: str, by: Column, most: int) -> DataFrame:
    """``rows`` with ``part``: no (key, part) has more than about twice ``most`` rows.

    A key with more is cut into blocks by a hash of ``by``, and each pair of
    blocks is a part of its own, so that every two rows of a key meet in one
    part. The rows of a part are of one block, or of two of which the lower has
    ``first`` set.
    """
    big = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_blocks")).where("_blocks > 1").select(F.col(key).alias("_key"), "_blocks")
    big = SharedTables(rows.sparkSession).put(big)  # of known size: where few keys are big, the rows need not be dealt by key
    held = rows.join(big, F.col(key) == F.col("_key"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    held = held.withColumn("_block", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    lo, hi = F.least("_block", "_other"), F.greatest("_block", "_other")
    held = held.withColumn("part", lo.cast("long") * F.col("_blocks") + hi).withColumn("first", F.col("_block") == lo)
    return held.drop("_key", "_blocks", "_block", "_other")


def dealt(rows: DataFrame, key: str, by: Column, most: int) -> DataFrame:
    """``split``, in partitions sorted by (key, part)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return split(rows, key, by, most).repartition(n, key, "part").sortWithinPartitions(key, "part")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal integer ``keys`` in sorted batches, over their borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(values[:, lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


class Sets:
    """Union-find over 0..n-1; a set's root is its smallest number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> int:
        i, j = self.find(i), self.find(j)
        if i > j:
            i, j = j, i
        self.up[j] = i
        return i
