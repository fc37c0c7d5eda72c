"""Schemas of the operation log and of what is read from it."""

from pyspark.sql import types as T

#: One physical version of a key. ``value`` is null in tombstones only.
OPLOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("seq", T.LongType(), False),
    T.StructField("is_del", T.BooleanType(), False),
])

#: The resolved table: one row per live key.
CURRENT = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), False),
])

#: What ``store_registry`` derives from file names.
STORES = T.StructType([
    T.StructField("file_name", T.StringType(), True),
    T.StructField("store_seq", T.LongType(), True),
    T.StructField("store_level", T.LongType(), True),
    T.StructField("compressed", T.BooleanType(), True),
])
