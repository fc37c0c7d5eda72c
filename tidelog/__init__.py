"""tidelog: versioned, byte-ordered key-value tables on Spark.

An append-only operation log in Parquet is resolved with DataFrame aggregates
into a last-writer-wins view and read by key, by range and by neighbour.
"""

__version__ = "0.1.0"
