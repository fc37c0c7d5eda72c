"""The life of a table, one query per step: each makes a table in the shared folder and reads it.

The table gets the orders (key customer, value priority), the events (key user,
value type), a delete of all users with an error, and all customers that are
absent. Keys are decimal text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import files
from tidelog.sources.manifest import Manifest
from tidelog.sources.shared import SharedTables
from tidelog.sources.table import Table
from tidelog.streaming.ingest import append_stream

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _kv(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.select(F.col(key).cast("string").cast("binary").alias("key"), F.col(value).cast("binary").alias("value"), F.col(order).alias("n"))


def _written(spark: SparkSession, d: str, **options) -> Table:
    """Five versions: empty, orders, events, deletes, absent customers."""
    t = Table.open(spark, SharedTables(spark).folder(), num_shards=4, **options)
    t.add(_kv(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey"), "n")
    t.add(_kv(_t(spark, d, "events"), "user_id", "event_type", "event_id"), "n")
    t.delete(_kv(_t(spark, d, "events").where("event_type = 'error'"), "user_id", "props", "event_id"))
    t.add_if_absent(_kv(_t(spark, d, "customer"), "c_custkey", "c_name", "c_custkey"), "n")
    return t


#: Rows of the log by batch (1 to 4) in SQL, then versions of the table as the newest row of each key.
_LOG = """b1 as (select o_custkey::varchar as k, o_orderpriority as v, o_orderkey as n, 1 as batch, false as del from orders),
b2 as (select user_id::varchar as k, event_type as v, event_id as n, 2 as batch, false as del from events),
b3 as (select distinct user_id::varchar as k, null as v, 0 as n, 3 as batch, true as del from events where event_type = 'error'),
l3 as (select * from b1 union all select * from b2 union all select * from b3),
s3 as (select k from (select *, row_number() over (partition by k order by batch desc, n desc) as r from l3) where r = 1 and not del),
b4 as (select c_custkey::varchar as k, c_name as v, c_custkey as n, 4 as batch, false as del from customer where c_custkey::varchar not in (select k from s3)),
l4 as (select * from l3 union all select * from b4),
s4 as (select k, v from (select *, row_number() over (partition by k order by batch desc, n desc) as r from l4) where r = 1 and not del)"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.hex("key").alias("key_hex"), F.col("value").cast("string").alias("value"))


@_query("q28_table_writes", f"with {_LOG} select hex(encode(k)) as key_hex, v as value from s4")
def q28(spark, d):
    return _shown(_written(spark, d).current())


@_query("q28b_table_versions", f"""with {_LOG}, v as (select * from range(1, 6) r(version)), l as (select version, k, batch, n, del from l4 join v on batch < version),
    c as (select version, count(*) as n_stored, count(distinct k) filter (r = 1 and not del) as n_live from (select *, row_number() over (partition by version, k order by batch desc, n desc) as r from l) group by 1)
    select version, coalesce(n_stored, 0) as n_stored, coalesce(n_live, 0) as n_live from v left join c using (version)""")
def q28b(spark, d):
    t = _written(spark, d)
    out = None
    for version in range(1, 6):
        old = Table.open(spark, t.path, version=version)
        row = old.stats().select(F.lit(version).cast("bigint").alias("version"), F.col("n_versions").cast("bigint").alias("n_stored"), F.col("n_live").cast("bigint").alias("n_live"))
        out = row if out is None else out.unionByName(row)
    return out


@_query("q29_table_compact", f"""with {_LOG} select hex(encode(k)) as key_hex, v as value, 1 as n_stores, (select count(*) from s4) as n_versions, 0 as n_garbage from s4""")
def q29(spark, d):
    t = _written(spark, d)
    while t.compact():
        pass
    totals = t.stats().select("n_versions", F.col("n_garbage").cast("bigint").alias("n_garbage"))
    return _shown(t.current()).withColumn("n_stores", F.lit(len(t.manifest.get("batches"))).cast("bigint")).crossJoin(totals)  # one row of totals


@_query("q29b_table_merge_level", f"with {_LOG} select hex(encode(k)) as key_hex, v as value, 1 as n_stores from s4")
def q29b(spark, d):
    t = _written(spark, d)
    while t.merge_level(2):
        pass
    return _shown(t.current()).withColumn("n_stores", F.lit(len(t.manifest.get("batches"))).cast("bigint"))


@_query("q30_stores_on_disk", f"""with {_LOG} select 0 as store_seq, 0 as store_level, false as compressed, count(*) as n_rows, true as listed from b1 union all select 1, 0, false, count(*), true from b2
    union all select 2, 0, false, count(*), true from b3 union all select 3, 0, false, count(*), true from b4""")
def q30(spark, d):
    t = _written(spark, d, compressed=False)
    rows = t.records().groupBy(F.shiftright("token", 32).alias("_s")).agg(F.count(F.lit(1)).alias("n_rows"))
    return t.stores().join(rows, F.col("store_seq") == F.col("_s")).select("store_seq", "store_level", "compressed", "n_rows", "listed")


@_query("q30b_stores_after_merges", """select * from (values (0, 0, false, false), (1, 0, false, false), (2, 0, false, false), (3, 0, false, false), (4, 1, true, true)) s(store_seq, store_level, compressed, listed)""")
def q30b(spark, d):
    t = _written(spark, d, compressed=False)
    t.compact()
    return t.stores().select("store_seq", "store_level", "compressed", "listed")


@_query("q31_record_by_token", f"""with {_LOG}, r as (select batch - 1 as store, k, v, del, row_number() over (partition by batch order by k, n) - 1 as place from l4)
    select (store::bigint << 32) | place as token, true as found, hex(encode(k)) as key_hex, v as value, del as is_del from r""")
def q31(spark, d):
    t = _written(spark, d, file_rows=1000)
    found = t.by_token(t.records().select("token"))
    return found.select("token", "found", F.hex("key").alias("key_hex"), F.col("value").cast("string").alias("value"), "is_del")


@_query("q32_store_rollover", f"with {_LOG} select batch - 1 as store_seq, count(*) as n_rows, true as within from l4 group by 1")
def q32(spark, d):
    t = _written(spark, d, file_rows=500)
    size = t.log().groupBy(F.input_file_name().alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    store = F.regexp_extract("_f", "store_([0-9]+)_", 1).cast("bigint").alias("store_seq")
    return size.groupBy(store).agg(F.sum("_n").alias("n_rows"), (F.max("_n") <= 500).alias("within"))


@_query("q33_table_multi_get", f"with {_LOG} select c_custkey, s4.k is not null as found, v as value from customer left join s4 on c_custkey::varchar = s4.k")
def q33(spark, d):
    probes = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").cast("binary").alias("key"))
    return _written(spark, d).multi_get(probes).select("c_custkey", "found", F.col("value").cast("string").alias("value"))


@_query("q34_table_scan_range", f"with {_LOG} select hex(encode(k)) as key_hex, v as value from s4 where k >= '12' and k < '7'")
def q34(spark, d):
    return _shown(_written(spark, d).scan(b"12", b"7"))


@_query("q35_manifest", "select * from (values ('close', '1'), ('name', 'db/é'), ('raw', '00FF7F'), ('seq', '9007199254740993')) m(name, value)")
def q35(spark, d):
    folder = SharedTables(spark).folder()
    m = Manifest(spark, folder).commit()
    for name, value in (("close", 0), ("close", 1), ("name", "db/é"), ("raw", b"\x00\xff\x7f"), ("seq", (1 << 53) + 1)):
        m.set(name, value)
    m.commit()
    held = Manifest.newest(spark, folder)
    rows = [(n, v.hex().upper() if isinstance(v := held.get(n), bytes) else str(v)) for n in sorted(held.values)]
    return spark.createDataFrame(rows, "name string, value string")


@_query("q36_text_files", """select count(*) as n_items, sum(octet_length(encode(string_agg_v)))::bigint as n_value_bytes from (select n // 9 as item, string_agg(b, '' order by n) filter (n % 9 >= 2) as string_agg_v from (
    select b, row_number() over (order by doc_id, i) - 1 as n from (select doc_id, unnest(string_split(t, chr(10))) as b, generate_subscripts(string_split(t, chr(10)), 1) as i
    from (select doc_id, text as t from documents where text is not null))) group by 1 having count(*) = 9)""")
def q36(spark, d):
    folder = SharedTables(spark).folder()
    texts = _t(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("t"))
    texts.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select("t").write.text(folder)
    items = files.line_items(files.numbered_lines(spark, folder), "line", "n")
    return items.agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.octet_length("value").cast("bigint")).alias("n_value_bytes"))


@_query("q37_stream_append", "select hex(encode(k)) as key_hex, v as value from (select user_id::varchar as k, event_type as v, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def q37(spark, d):
    folders = SharedTables(spark)
    source, path = folders.folder(), folders.folder()
    _kv(_t(spark, d, "events"), "user_id", "event_type", "event_id").withColumnRenamed("n", "seq").write.parquet(source)
    stream = spark.readStream.schema("key binary, value binary, seq long").parquet(source)
    append_stream(stream, path, folders.folder()).awaitTermination()
    return _shown(Table.open(spark, path).current())
