"""From an operation log to the state of its keys.

All of these are one hash exchange on the key with map-side partial
aggregation, so a key written very often costs one row per map task. A
predicate on the key passes through the aggregate to the scan; one on the
value or on ``is_del`` must stay above it, as it does here.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: Sequence[str], seq: str, carried: Sequence[str], is_del: str | None = None) -> DataFrame:
    """The newest version of each key, tombstones included. ``seq`` is unique within a key."""
    fields = [seq, *([is_del] if is_del else []), *carried]
    newest = log.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_v"))
    return newest.select(*keys, *[F.col("_v")[f].alias(f) for f in fields])


def live(log: DataFrame, keys: Sequence[str], seq: str, carried: Sequence[str], is_del: str) -> DataFrame:
    """Last writer wins; keys whose newest version is a tombstone are gone."""
    return latest(log, keys, seq, carried, is_del).where(~F.col(is_del)).drop(is_del)


def first_wins(log: DataFrame, keys: Sequence[str], seq: str, carried: Sequence[str]) -> DataFrame:
    """Add-if-absent within one log: the oldest version of each key."""
    oldest = log.groupBy(*keys).agg(F.min(F.struct(seq, *carried)).alias("_v"))
    return oldest.select(*keys, *[F.col("_v")[f].alias(f) for f in (seq, *carried)])


def absent_only(incoming: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose keys the table does not hold."""
    return incoming.join(current.select(*keys).distinct(), [*keys], "left_anti")


def without(current: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bulk delete; keys that are not there are ignored."""
    return current.join(deleted.select(*keys).distinct(), [*keys], "left_anti")


def merge_versions(logs: Sequence[DataFrame], keys: Sequence[str], seq: str, carried: Sequence[str]) -> DataFrame:
    """Version-guarded repointing: over all logs the greater version of a key wins."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return latest(out, keys, seq, carried)


def garbage(log: DataFrame, keys: Sequence[str], seq: str, is_del: str) -> DataFrame:
    """Per key: versions stored, versions that reads still need, and what compaction frees."""
    state = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_versions"), F.max(F.struct(seq, is_del)).alias("_v"))
    needed = F.when(F.col("_v")[is_del], 0).otherwise(1).cast("bigint")
    return state.select(*keys, "n_versions", needed.alias("n_live"), (F.col("n_versions") - needed).alias("n_garbage"))


def sequenced(batch: DataFrame, order_by: Sequence[Column | str], base: int, carried: Sequence[str] | None = None) -> DataFrame:
    """Numbers a batch from ``base`` in the caller's total order, without a single-task window over rows.

    Range partitions are sorted on their own; a table of two numbers for each of
    the session's shuffle partitions has what goes before it, and is broadcast.
    The sorted batch is cut from its lineage in between, for its partitions to
    stay as counted. ``carried`` names the columns to keep, all by default; a
    ``seq`` among them is replaced.
    """
    from tidelog.sources.shared import checkpointed

    n = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = batch.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    names = [c for c in (batch.columns if carried is None else carried) if c != "seq"]
    # the low 33 bits of the id are the row's place in its partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = checkpointed(ranged.select(F.struct(*names).alias("_row"), F.spark_partition_id().alias("_p"), place.alias("_i")))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.lit(base)).cast("bigint").alias("_start"))
    return placed.join(F.broadcast(starts), "_p").select(*[F.col("_row")[c].alias(c) for c in names], (F.col("_i") + F.col("_start")).alias("seq"))
