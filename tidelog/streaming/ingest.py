"""Streams into and over a log.

Versions order the writes of a key, so late or replayed rows cannot displace
newer ones and no watermark is needed for correctness.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.sources.table import Table


def append_stream(stream: DataFrame, table_path: str, checkpoint: str, **trigger):
    """Starts a query that appends micro-batches of (key, value, seq[, is_del]) to a table.

    A batch that is replayed after a failure appends the same versions again;
    reads resolve them to the same rows and compaction drops them.
    """

    def put(batch: DataFrame, _: int) -> None:
        Table.open(batch.sparkSession, table_path).merge_versions(batch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(stream: DataFrame, keys: list[str], seq: str, carried: list[str], is_del: str) -> DataFrame:
    """The newest version of each key as a streaming aggregate (update or complete mode)."""
    newest = stream.groupBy(*keys).agg(F.max(F.struct(seq, is_del, *carried)).alias("_v"))
    return newest.select(*keys, *[F.col("_v")[c].alias(c) for c in (seq, is_del, *carried)])
