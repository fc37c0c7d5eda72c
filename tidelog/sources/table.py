"""A key-value table over an append-only Parquet log.

Each write lands in a store of its own, a folder named by its number and level
below a batch folder that no other writer uses, and becomes visible when the
manifest that lists it is committed: a crashed write leaves the table as it was,
and there is nothing to repair. A handle reads the version it was opened at.
"""

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import access, resolve
from tidelog.schema import CURRENT, OPLOG
from tidelog.sources import files
from tidelog.sources.cursor import Cursor
from tidelog.sources.manifest import Manifest
from tidelog.sources.shared import remove

#: Rows from which a store goes on in a further file.
FILE_ROWS = 1 << 24


#: Tasks move their files to the store themselves, not the driver one after another; the manifest decides what is visible.
#: On a local disk Hadoop starts a child process for each file and another for its .crc file, which Parquet's page
#: checksums stand in for; this takes the .crc files away there and says nothing of other file systems.
WRITE = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "parquet.page.write-checksum.enabled": "true", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Stores are read with their pages' checksums compared.
READ = {"parquet.page.verify-checksum.enabled": "true"}


class Table:
    """Open with :meth:`open`. Writes return the new version and move this handle to it."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path, manifest

    @classmethod
    def open(cls, spark: SparkSession, path: str, num_shards: int | None = None, version: int | None = None, file_rows: int = FILE_ROWS, compressed: bool = True) -> "Table":
        """Opens the newest or the given version, or creates the table.

        Frozen at creation: the shard count, the rows a file holds at most, and
        whether stores of level 0 are compressed; those of compaction always are.
        """
        path = path.rstrip("/")
        if num_shards is not None and num_shards < 1:
            raise ValueError("a table has at least one shard")
        if file_rows < 1:
            raise ValueError("a file holds at least one row")
        manifest = Manifest.newest(spark, f"{path}/_manifest", version)
        if manifest is None:
            if version is not None:
                raise ValueError(f"{path} has no version {version}")
            values = {"num_shards": num_shards or spark.sparkContext.defaultParallelism, "file_rows": file_rows, "compressed": int(compressed), "seq": 0, "stores": 0, "batches": []}
            manifest = Manifest(spark, f"{path}/_manifest", values=values).commit()
        return cls(spark, path, manifest)

    @property
    def version(self) -> int:
        return self.manifest.version

    @property
    def num_shards(self) -> int:
        return self.manifest.get("num_shards")

    def log(self) -> DataFrame:
        """All versions of all keys that this table version lists."""
        return self._read(self.manifest.get("batches"))

    def _read(self, batches: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{b['dir']}" for b in batches]
        return self.spark.read.schema(OPLOG).options(**READ).parquet(*paths) if paths else self.spark.createDataFrame([], OPLOG)

    def current(self) -> DataFrame:
        return resolve.live(self.log(), ["key"], "seq", ["value"], "is_del").select("key", "value")

    def as_view(self, name: str) -> None:
        self.current().createOrReplaceTempView(name)

    # writes

    def _append(self, rows: DataFrame, next_seq: int | None, level: int = 0, replacing: list[dict] | None = None) -> int:
        number, packed = self.manifest.get("stores", 0), level > 0 or bool(self.manifest.get("compressed", 1))
        name = f"batch-{uuid.uuid4().hex}/store_{number}_{level}.{'cprs' if packed else 'plain'}"
        # Ranges over (key, seq) keep files in key order, so that a key predicate skips row groups, and split a hot key over tasks.
        n = max(self.num_shards, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        put = rows.select([F.col(f.name).cast(f.dataType) for f in OPLOG]).repartitionByRange(n, "key", "seq").sortWithinPartitions("key", "seq")
        seen = Observation()  # counted by the writing tasks themselves
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        put = put.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("bytes"), F.max("seq").alias("top"))
        writer = put.write.option("compression", "zstd" if packed else "none").option("maxRecordsPerFile", self.manifest.get("file_rows", FILE_ROWS))
        writer.options(**WRITE).parquet(f"{self.path}/{name}")
        top = seen.get["top"]
        seq = max(self.manifest.get("seq"), 0 if top is None else top + 1) if next_seq is None else next_seq
        values = dict(self.manifest.values)
        values["batches"] = [b for b in values["batches"] if b not in (replacing or [])] + [{"dir": name, "level": level, "number": number, "rows": seen.get["rows"], "bytes": seen.get["bytes"]}]
        values["seq"], values["stores"] = seq, number + 1
        self.manifest = Manifest(self.spark, self.manifest.folder, self.manifest.version, values).commit()
        return self.version

    def _checked(self, df: DataFrame) -> DataFrame:
        bad = F.col("key").isNull() | (F.octet_length("key") == 0)
        out = df.withColumn("key", F.when(bad, F.raise_error(F.lit("a key has at least one byte"))).otherwise(F.col("key").cast("binary")))
        if "value" in df.columns:
            out = out.withColumn("value", F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
        return out

    def _numbered(self, df: DataFrame, order_by) -> DataFrame:
        order = [order_by] if isinstance(order_by, (str, Column)) else [*order_by]
        return resolve.sequenced(self._checked(df), order, self.manifest.get("seq"), ["key", "value"])

    def add(self, df: DataFrame, order_by) -> int:
        """Upserts (key, value), null values as empty ones; within the batch the last row by ``order_by`` wins."""
        return self._append(self._numbered(df, order_by).withColumn("is_del", F.lit(False)), None)

    def add_if_absent(self, df: DataFrame, order_by) -> int:
        """Adds keys the table lacks; of a key's rows in the batch the first by ``order_by`` stays."""
        first = resolve.first_wins(self._numbered(df, order_by), ["key"], "seq", ["value"])
        return self._append(resolve.absent_only(first, self.current(), ["key"]).withColumn("is_del", F.lit(False)), None)

    def merge_versions(self, df: DataFrame) -> int:
        """Rows (key, value, seq) that bring their own versions; the greater version of a key wins."""
        rows = self._checked(df)
        if "is_del" not in df.columns:
            rows = rows.withColumn("is_del", F.lit(False))
        return self._append(rows, None)

    def delete(self, df: DataFrame) -> int:
        """A tombstone for each distinct key; keys that are not there have no effect on reads."""
        base = self.manifest.get("seq")
        rows = self._checked(df).select("key").distinct().select("key", F.lit(None).cast("binary").alias("value"), F.lit(base).alias("seq"), F.lit(True).alias("is_del"))
        return self._append(rows, base + 1)

    def compact(self) -> bool:
        """Rewrites the live rows as one base batch. Returns whether more could be done: after a full rewrite, no."""
        batches = self.manifest.get("batches")
        if len(batches) > 1 or any(b["level"] == 0 for b in batches):
            self._rewrite(batches, 1 + max(b["level"] for b in batches))
        return False

    def merge_level(self, fanout: int = 8) -> bool:
        """Merges the lowest level that has ``fanout`` batches into one of the next, and returns whether more could be done.

        Repeated after writes this rewrites a row once per level, about log(size) times in all, where
        :meth:`compact` rewrites the whole table. Versions decide between rows, so any batches can be merged.
        """
        if fanout < 2:
            raise ValueError("at least two batches are merged")
        at = self._full_level(fanout)
        if at is not None:
            self._rewrite([b for b in self.manifest.get("batches") if b["level"] == at], at + 1)
        return self._full_level(fanout) is not None

    def _full_level(self, fanout: int) -> int | None:
        levels = [b["level"] for b in self.manifest.get("batches")]
        return min((n for n in levels if levels.count(n) >= fanout), default=None)

    def _rewrite(self, batches: list[dict], level: int) -> None:
        """One batch with the newest version of each key; tombstones go where no other batch may hold what they hide."""
        newest = resolve.latest(self._read(batches), ["key"], "seq", ["value"], "is_del")
        if len(batches) == len(self.manifest.get("batches")):
            newest = newest.where(~F.col("is_del"))
        self._append(newest, self.manifest.get("seq"), level, replacing=batches)

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Removes batch folders that the newest version does not list, and the versions that did.

        A folder that some version listed has been committed and replaced, and
        goes at once. One that no version lists may be a batch whose writer is
        about to commit; it goes when it was last changed ``older_than_hours``
        ago, which is to exceed the longest write.
        """
        folder = self.manifest.folder
        newest = Manifest.newest(self.spark, folder)
        known = Manifest.versions(self.spark, folder)
        held = lambda m: {b["dir"].split("/")[0] for b in m.get("batches")}
        listed = held(newest)
        committed = set().union(*(held(m) for m in (Manifest.newest(self.spark, folder, v) for v in known) if m))
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        before = 1000 * (time.time() - 3600 * older_than_hours)
        stale = []
        for s in jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(jpath):
            name = s.getPath().getName()
            if name.startswith("batch-") and name not in listed and (name in committed or s.getModificationTime() < before):
                stale.append(name)
        for v in known:
            if v != newest.version and held(Manifest.newest(self.spark, folder, v)) - listed:
                Manifest.forget(self.spark, folder, v)
        for name in stale:
            remove(self.spark, f"{self.path}/{name}")
        return len(stale)

    def retire_store(self) -> int:
        """The number of the store that the next write starts: none goes on with an older one."""
        return self.manifest.get("stores", 0)

    def sync(self) -> None:
        """A write is durable once it returns; there is nothing left to flush."""

    def close(self) -> None:
        """State is in the manifest already; a handle holds no resources."""

    # reads

    def get(self, key: bytes) -> tuple[bool, bytes | None]:
        found = access.get(self.current(), "key", bytearray(key)).take(1)
        return (True, bytes(found[0]["value"])) if found else (False, None)

    def get_version(self, key: bytes) -> int | None:
        """The version that a read of ``key`` sees; None if the key is not there."""
        newest = resolve.live(access.get(self.log(), "key", bytearray(key)), ["key"], "seq", ["value"], "is_del").take(1)
        return newest[0]["seq"] if newest else None

    def cursor(self) -> Cursor:
        """An unpositioned cursor over this version."""
        return Cursor(self.current())

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return access.multi_get(self.current(), probes, "key", ["value"])

    def scan(self, lo: bytes | None = None, hi: bytes | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        as_key = lambda b: None if b is None else bytearray(b)
        return access.scan(self.current(), "key", as_key(lo), as_key(hi), reverse, limit)

    def first(self) -> DataFrame:
        return self.scan(limit=1)

    def last(self) -> DataFrame:
        return self.scan(reverse=True, limit=1)

    def seek(self, key: bytes, n: int = 1) -> DataFrame:
        return access.seek(self.current(), "key", bytearray(key), n)

    def next(self, key: bytes, n: int = 1) -> DataFrame:
        return access.after(self.current(), "key", bytearray(key), n)

    def prev(self, key: bytes, n: int = 1) -> DataFrame:
        return access.before(self.current(), "key", bytearray(key), n)

    def stores(self) -> DataFrame:
        """The stores on disk by what their names say, with files, bytes and whether this version lists them."""
        found = files.files_of(self.spark, self.path).select(F.regexp_extract("file_name", r"^(.*)/[^/]*$", 1).alias("_dir"), "n_bytes")
        # one row per store
        sizes = found.groupBy("_dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
        listed = F.concat_ws("/", F.element_at(F.split("file_name", "/"), -2), F.element_at(F.split("file_name", "/"), -1)).isin([b["dir"] for b in self.manifest.get("batches")])
        return files.store_registry(sizes, "_dir", ["n_files", "n_bytes"]).withColumn("listed", listed)

    def _records(self, batches: list[dict]) -> DataFrame:
        """token, key, value, seq and is_del of stored records; a token is the store's number and the record's place in it.

        A store's files follow each other by the numbers in their names, of the writing task and of the file
        in it. What lies before each is one row per file, and is broadcast.
        """
        if not batches:
            return self._read([]).select(F.lit(None).cast("bigint").alias("token"), *OPLOG.names)
        rows = self._read(batches).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"), *OPLOG.names)
        # names are taken apart once a file, not once a row
        number = lambda pattern: F.regexp_extract(codec.base_name(F.col("_path")), pattern, 1).cast("bigint")
        store = codec.store_seq(F.element_at(F.split("_path", "/"), -2))
        counts = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
        named = counts.select("_path", "_n", store.alias("_store"), number("^part-([0-9]+)-").alias("_part"), number("-c([0-9]+)[.]").alias("_turn"))
        before = Window.partitionBy("_store").orderBy("_part", "_turn").rowsBetween(Window.unboundedPreceding, -1)
        starts = named.select("_path", "_store", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        placed = rows.join(F.broadcast(starts), "_path")
        return placed.select(codec.token(F.col("_store"), F.col("_start") + F.col("_row")).alias("token"), *OPLOG.names)

    def records(self) -> DataFrame:
        """Every stored record of this version with its token."""
        return self._records(self.manifest.get("batches"))

    def by_token(self, probes: DataFrame, column: str = "token") -> DataFrame:
        """The probes with key, value, seq, is_del and ``found``: the records at their tokens."""
        held = self.records().withColumnRenamed("token", "_token").withColumn("_hit", F.lit(True))
        out = probes.join(held, F.col(column) == F.col("_token"), "left")
        return out.select(probes["*"], F.coalesce("_hit", F.lit(False)).alias("found"), *OPLOG.names)

    def record_at(self, token: int) -> tuple[bytes, bytes | None] | None:
        """Key and value (None in a tombstone) of the record at ``token``; None if there is none. Reads its store alone."""
        here = [b for b in self.manifest.get("batches") if b["number"] == token >> 32]
        found = self._records(here).where(F.col("token") == token).take(1) if here else []
        return (bytes(found[0]["key"]), None if found[0]["is_del"] else bytes(found[0]["value"])) if found else None

    def stats(self) -> DataFrame:
        """Versions, live keys and garbage over the whole table."""
        per_key = resolve.garbage(self.log(), ["key"], "seq", "is_del")
        return per_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_versions", "n_live", "n_garbage")])

    def empty(self) -> bool:
        return not self.current().take(1)


assert [f.name for f in CURRENT] == ["key", "value"]
