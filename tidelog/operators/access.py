"""Reads of a resolved table by key, by range and by neighbour."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get(table: DataFrame, key: str, wanted) -> DataFrame:
    """The row of one key, or none. The predicate reaches the scan."""
    return table.where(F.col(key) == F.lit(wanted))


def multi_get(table: DataFrame, probes: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """One row per probe with ``found`` and the table's columns, null on a miss.

    The planner broadcasts whichever side its statistics show to be small and
    sort-merges otherwise; an empty value is found, an absent key is not.
    """
    held = table.select(F.col(key), *carried, F.lit(True).alias("_hit"))
    return probes.join(held, key, "left").select(probes["*"], F.coalesce("_hit", F.lit(False)).alias("found"), *carried)


def exists(probes: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return probes.join(table.select(key), key, "left_semi")


def missing(probes: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return probes.join(table.select(key), key, "left_anti")


def scan(table: DataFrame, key: str, lo=None, hi=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Keys in [lo, hi) in order. With a limit this plans as a top-k per partition, not a full sort."""
    if lo is not None:
        table = table.where(F.col(key) >= F.lit(lo))
    if hi is not None:
        table = table.where(F.col(key) < F.lit(hi))
    out = table.orderBy(F.col(key).desc() if reverse else F.col(key).asc())
    return out if limit is None else out.limit(limit)


def seek(table: DataFrame, key: str, target, n: int = 1) -> DataFrame:
    """The first ``n`` keys at or above ``target``; empty past the end."""
    return scan(table, key, lo=target, limit=n)


def after(table: DataFrame, key: str, at, n: int = 1) -> DataFrame:
    return scan(table.where(F.col(key) > F.lit(at)), key, limit=n)


def before(table: DataFrame, key: str, at, n: int = 1) -> DataFrame:
    return scan(table.where(F.col(key) < F.lit(at)), key, reverse=True, limit=n)


def ends(table: DataFrame, key: str) -> DataFrame:
    """The smallest and largest key in one pass."""
    return table.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def _filled(rows: DataFrame, key: Column, ties: list[Column], value: Column, names: dict[str, bool]) -> DataFrame:
    """In key order, the nearest non-null ``value`` strictly on one side of each row.

    ``names`` has each new column with whether it looks downward. Rows are
    range-partitioned once and filled within each partition; the partitions'
    edge values, one row each, are filled across partitions and joined back. No
    task sees more than its own range, so this has no single-partition window
    over rows. Looking upward is looking downward in reversed order: both frames
    run, so a row costs the same however long its partition is.
    """
    from tidelog.sources.shared import checkpointed

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = checkpointed(rows.withColumn("_v", value).repartitionByRange(n, key, *ties).withColumn("_p", F.spark_partition_id()))
    edge = put.groupBy("_p").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = (Window.unboundedPreceding, -1)
    near, carry = [], []
    for name, downward in names.items():
        inside = Window.partitionBy("_p").orderBy(*[c.asc() if downward else c.desc() for c in (key, *ties)]).rowsBetween(*before)
        across = Window.orderBy(F.col("_p") if downward else F.col("_p").desc()).rowsBetween(*before)
        near.append(F.last("_v", ignorenulls=True).over(inside).alias(f"_near_{name}"))
        carry.append(F.last("_hi" if downward else "_lo", ignorenulls=True).over(across).alias(f"_carry_{name}"))
    filled = put.select("*", *near).join(edge.select("_p", *carry), "_p")
    return filled.select(*rows.columns, *[F.coalesce(f"_near_{name}", f"_carry_{name}").alias(name) for name in names])


def neighbours(table: DataFrame, key: str) -> DataFrame:
    """Each key of a unique-key table with its predecessor and successor; a null is no key and has no row."""
    keys = table.select(key).where(F.col(key).isNotNull())
    return _filled(keys, F.col(key), [], F.col(key), {"prev_key": True, "next_key": False})


def lower_bounds(table: DataFrame, probes: DataFrame, key: str, target: str) -> DataFrame:
    """The probes with ``lower_bound``, the smallest key at or above ``target``: null past the end and for a null target.

    Distinct targets and keys are sorted together once, targets first on ties,
    instead of being joined by an inequality; a target that many probes share is
    one row there, and the answers are joined back to all probes.
    """
    wanted = probes.select(F.col(target).alias("_k")).where("_k is not null").distinct()
    marked = wanted.select("_k", F.lit(0).alias("_t"), F.lit(None).cast(table.schema[key].dataType).alias("_key"))
    held = table.select(F.col(key).alias("_k"), F.lit(1).alias("_t"), F.col(key).alias("_key")).where("_k is not null")
    out = _filled(marked.unionByName(held), F.col("_k"), [F.col("_t")], F.col("_key"), {"_bound": False})
    bounds = out.where(F.col("_t") == 0).select("_k", "_bound")
    return probes.join(bounds, probes[target] == bounds["_k"], "left").select(probes["*"], F.col("_bound").alias("lower_bound"))


def payload_bytes(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and total bytes of the named columns: a full scan with map-side sums."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(total).alias("n_bytes"))
