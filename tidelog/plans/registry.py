"""One query per operator over the supplied tables, each with its SQL counterpart.

Bytes are shown as hex and integers as BIGINT, so that values compare across
engines.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec, slices
from tidelog.operators import access, resolve, shards
from tidelog.sources import files


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark, d):
    return _t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("is_del"), "props")


def _live(spark, d):
    return resolve.live(_log(spark, d), ["user_id"], "event_id", ["props"], "is_del")


QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


_NEWEST = """(select *, row_number() over (partition by user_id order by event_id desc) rn,
    row_number() over (partition by user_id order by event_id) ra from events)"""


@_query("q01_lww_live_users", f"select user_id, event_id, props from {_NEWEST} where rn = 1 and event_type <> 'error'")
def q01(spark, d):
    return _live(spark, d).select("user_id", "event_id", "props")


@_query("q02_lww_with_tombstones", f"select user_id, event_id, event_type = 'error' as is_del, props from {_NEWEST} where rn = 1")
def q02(spark, d):
    return resolve.latest(_log(spark, d), ["user_id"], "event_id", ["props"], "is_del").select("user_id", "event_id", "is_del", "props")


@_query("q03_insert_if_absent", f"select user_id, event_id, props from {_NEWEST} where ra = 1")
def q03(spark, d):
    return resolve.first_wins(_log(spark, d), ["user_id"], "event_id", ["props"]).select("user_id", "event_id", "props")


@_query("q03b_absent_only", """select c_custkey, c_name from customer where not exists
    (select 1 from events where user_id = c_custkey)""")
def q03b(spark, d):
    held = _t(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return resolve.absent_only(_t(spark, d, "customer").select("c_custkey", "c_name"), held, ["c_custkey"])


@_query("q04_point_get", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 4242 or o_orderkey = (select max(o_orderkey) from orders)")
def q04(spark, d):
    orders = _t(spark, d, "orders")
    last = access.scan(orders, "o_orderkey", reverse=True, limit=1)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    return access.get(orders, "o_orderkey", 4242).select(cols).unionByName(last.select(cols)).distinct()


@_query("q05_multi_get_found_flag", f"""select c_custkey as user_id, u.user_id is not null as found, u.event_id, u.props from customer
    left join (select * from {_NEWEST} where rn = 1 and event_type <> 'error') u on c_custkey = u.user_id""")
def q05(spark, d):
    probes = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return access.multi_get(_live(spark, d), probes, "user_id", ["event_id", "props"])


@_query("q06a_exists_semi", f"""select c_custkey as user_id from customer where c_custkey in
    (select user_id from {_NEWEST} where rn = 1 and event_type <> 'error')""")
def q06a(spark, d):
    return access.exists(_t(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _live(spark, d), "user_id")


@_query("q06b_missing_anti", f"""select c_custkey as user_id from customer where c_custkey not in
    (select user_id from {_NEWEST} where rn = 1 and event_type <> 'error')""")
def q06b(spark, d):
    return access.missing(_t(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _live(spark, d), "user_id")


@_query("q07_seek_limit_n", "select c_name, c_custkey from customer where c_name >= 'Customer#000000050' order by c_name limit 5")
def q07(spark, d):
    return access.seek(_t(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "Customer#000000050", 5)


@_query("q08_seek_past_end", "select c_name, c_custkey from customer where c_name >= 'a' order by c_name limit 1")
def q08(spark, d):
    return access.seek(_t(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "a")


@_query("q09_reverse_scan_n", "select o_orderkey, o_totalprice from orders where o_orderkey < 5000 order by o_orderkey desc limit 7")
def q09(spark, d):
    return access.before(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 7)


@_query("q09b_range_scan", "select o_orderkey, o_custkey from orders where o_orderkey >= 100 and o_orderkey < 900 order by o_orderkey")
def q09b(spark, d):
    return access.scan(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", lo=100, hi=900)


@_query("q09c_next_n", "select c_name, c_custkey from customer where c_name > 'Customer#000000050' order by c_name limit 3")
def q09c(spark, d):
    return access.after(_t(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "Customer#000000050", 3)


@_query("q10_first_last", "select min(c_name) as first_key, max(c_name) as last_key from customer")
def q10(spark, d):
    return access.ends(_t(spark, d, "customer"), "c_name")


@_query("q11_neighbours", "select c_name, lag(c_name) over (order by c_name) as prev_key, lead(c_name) over (order by c_name) as next_key from customer")
def q11(spark, d):
    return access.neighbours(_t(spark, d, "customer"), "c_name")


@_query("q12_batch_lower_bound", """select t as target, (select min(c_custkey) from customer where c_custkey >= t) as lower_bound
    from (select distinct o_custkey * 7 % 20011 as t from orders)""")
def q12(spark, d):
    probes = _t(spark, d, "orders").select((F.col("o_custkey") * 7 % 20011).alias("target")).distinct()
    return access.lower_bounds(_t(spark, d, "customer"), probes, "c_custkey", "target")


@_query("q12b_lower_bound_of_all_probes", """select o_orderkey, t as target, case when t is not null then (select min(c_custkey) from customer where c_custkey >= t) end as lower_bound
    from (select o_orderkey, case when o_orderpriority like '1%' then null when o_orderstatus = 'F' then 77 else o_custkey * 7 % 20011 end as t from orders)""")
def q12b(spark, d):
    target = F.when(F.col("o_orderpriority").startswith("1"), None).when(F.col("o_orderstatus") == "F", 77).otherwise(F.col("o_custkey") * 7 % 20011)
    probes = _t(spark, d, "orders").select("o_orderkey", target.cast("bigint").alias("target"))
    return access.lower_bounds(_t(spark, d, "customer"), probes, "c_custkey", "target")


@_query("q13_full_scan_bytes", """select count(*) as n_rows, cast(sum(octet_length(encode(url)) + coalesce(octet_length(encode(html)), 0)) as bigint) as n_bytes from pages""")
def q13(spark, d):
    return access.payload_bytes(_t(spark, d, "pages"), ["url", "html"])


_SHARD = """list_reduce(list_prepend(0::hugeint, list_transform(string_split(c_name, ''), lambda x: ascii(x)::hugeint)),
    lambda h, b: (h * 101 + b) % 18446744073709551616::hugeint)"""


@_query("q14_shard_histogram", f"select cast({_SHARD} % 8 as bigint) as shard, count(*) as n_keys from customer group by 1")
def q14(spark, d):
    return shards.histogram(_t(spark, d, "customer"), F.col("c_name"), 8)


_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::hugeint)"


@_query("q14b_shard_non_ascii", f"""select conv_id * 100 + turn as item_id, h::varchar as shard_hash, (h % 8)::bigint as shard from (select conv_id, turn, list_reduce(list_prepend(0::hugeint, {_BYTES}),
    lambda h, b: (h * 101 + case when b > 127 then b - 256 else b end + 18446744073709551616::hugeint) % 18446744073709551616::hugeint) as h from conversations where text is not null)""")
def q14b(spark, d):
    c = _t(spark, d, "conversations").where("text is not null")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), shards.shard_hash(F.col("text")).cast("string").alias("shard_hash"), shards.shard_of(F.col("text"), 8).alias("shard"))


@_query("q15_shard_merge", "select o_orderkey, o_totalprice from orders order by o_orderkey")
def q15(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return shards.merge([shards.stripe(orders, F.col("o_orderkey"), 4, i) for i in range(4)], "o_orderkey")


@_query("q16a_token_pack", """select l_orderkey, l_linenumber, l_partkey, (l_orderkey << 32) | l_partkey as token,
    l_partkey * 4096 as page_offset from lineitem""")
def q16a(spark, d):
    node = codec.node_token(F.col("l_partkey") * 4096, 4096)
    token = codec.token(F.col("l_orderkey"), F.col("l_partkey"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", token.alias("token"), codec.node_offset(node, 4096).alias("page_offset"))


@_query("q16b_token_unpack", """select l_orderkey as store_seq, l_partkey as record_offset, l_linenumber, false as is_node, true as is_record,
    true as node_is_node from lineitem""")
def q16b(spark, d):
    token = codec.token(F.col("l_orderkey"), F.col("l_partkey"))
    return _t(spark, d, "lineitem").select(
        codec.token_seq(token).alias("store_seq"), codec.token_offset(token).alias("record_offset"), "l_linenumber",
        codec.is_node(token).alias("is_node"), codec.is_record(token).alias("is_record"),
        codec.is_node(codec.node_token(F.col("l_partkey") * 4096, 4096)).alias("node_is_node"),
    )


@_query("q17_record_roundtrip", """select page_id, case when k then hex(encode(url)) end as key_hex, case when k then octet_length(encode(html)) end as value_bytes, case when k then false end as is_del,
    case when k then octet_length(encode(url)) + octet_length(encode(html)) + case when octet_length(encode(url)) < 128 then 1 when octet_length(encode(url)) < 16384 then 2 else 3 end end as record_bytes,
    case when k then cast(octet_length(encode(url)) as bigint) end as key_bytes, case when k then true end as value_same, case when k then hex(encode(url)) end as deleted_hex
    from (select *, octet_length(encode(url)) > 0 and html is not null as k from pages)""")
def q17(spark, d):
    pages = _t(spark, d, "pages")
    rec = codec.encode_put(F.col("url"), F.col("html"))
    return pages.withColumn("r", rec).withColumn("x", codec.encode_delete(F.col("url"))).select(
        "page_id", F.hex(codec.record_key(F.col("r"))).alias("key_hex"), F.octet_length(codec.record_value(F.col("r"))).cast("bigint").alias("value_bytes"),
        codec.record_is_delete(F.col("r")).alias("is_del"), F.octet_length("r").cast("bigint").alias("record_bytes"), codec.varint_value(F.col("r")).alias("key_bytes"),
        (codec.record_value(F.col("r")) == F.col("html").cast("binary")).alias("value_same"), F.hex(codec.record_key(F.col("x"))).alias("deleted_hex"),
    )


@_query("q17b_varint", """select n, case when n < 128 then format('{:02X}', n)
    when n < 16384 then format('{:02X}{:02X}', n % 128 + 128, n // 128)
    when n < 2097152 then format('{:02X}{:02X}{:02X}', n % 128 + 128, n // 128 % 128 + 128, n // 16384)
    else format('{:02X}{:02X}{:02X}{:02X}', n % 128 + 128, n // 128 % 128 + 128, n // 16384 % 128 + 128, n // 2097152) end as varint_hex, n as decoded
    from (select distinct o_orderkey * 37 as n from orders)""")
def q17b(spark, d):
    n = _t(spark, d, "orders").select((F.col("o_orderkey") * 37).alias("n")).distinct()
    return n.withColumn("v", codec.varint(F.col("n"))).select("n", F.hex("v").alias("varint_hex"), codec.varint_value(F.col("v")).alias("decoded"))


def _names(spark, d):
    n, lv = F.col("o_orderkey"), F.col("o_custkey") % 4
    name = F.when(n % 5 == 0, codec.index_name(n, F.lit("/db/"))).otherwise(codec.store_name(n, lv, n % 3 == 0, F.lit("/db/")))
    return _t(spark, d, "orders").select("o_orderkey", name.alias("file_name"))


_NAMES = """(select o_orderkey, case when o_orderkey % 5 = 0 then '/db/index_' || o_orderkey else
    '/db/store_' || o_orderkey || '_' || (o_custkey % 4) || case when o_orderkey % 3 = 0 then '.cprs' else '.plain' end end as file_name from orders)"""


@_query("q18_filename_parse", f"""select file_name, split_part(file_name, '/', 3) as base, split_part(file_name, '/', 3) like 'index\\_%' escape '\\' as is_index,
    split_part(file_name, '/', 3) like 'store\\_%' escape '\\' as is_store, file_name like '%.cprs' as is_compressed, file_name like '%.plain' as is_plain,
    try_cast(regexp_extract(file_name, 'store_([0-9]+)_', 1) as bigint) as store_seq, try_cast(regexp_extract(file_name, '_([0-9]+)[.]', 1) as bigint) as store_level from {_NAMES}""")
def q18(spark, d):
    p = F.col("file_name")
    return _names(spark, d).select(
        p, codec.base_name(p).alias("base"), codec.is_index(p).alias("is_index"), codec.is_store(p).alias("is_store"), codec.is_compressed_store(p).alias("is_compressed"),
        codec.is_plain_store(p).alias("is_plain"), codec.store_seq(p).alias("store_seq"), codec.store_level(p).alias("store_level"),
    )


@_query("q19a_slice_compare", """select o_orderkey, case when o_orderpriority < o_orderstatus then -1 when o_orderpriority = o_orderstatus then 0 else 1 end as cmp,
    o_orderpriority < o_orderstatus as lt, o_orderpriority = o_orderstatus as eq, cast(octet_length(encode(o_orderpriority)) as bigint) as n_bytes,
    cast(ascii(substr(o_orderpriority, 3, 1)) as bigint) as third_byte from orders""")
def q19a(spark, d):
    a, b = F.col("o_orderpriority"), F.col("o_orderstatus")
    return _t(spark, d, "orders").select(
        "o_orderkey", slices.compare(a, b).alias("cmp"), slices.less(a, b).alias("lt"), slices.equal(a, b).alias("eq"),
        slices.size(a).cast("bigint").alias("n_bytes"), slices.byte_at(a, 2).cast("bigint").alias("third_byte"),
    )


@_query("q19b_slice_escape", """select conv_id * 100 + turn as item_id, coalesce(list_aggregate(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x:
    case when ('0x' || x)::int between 32 and 126 then chr(('0x' || x)::int) else '[' || ('0x' || x)::int || ']' end), 'string_agg', ''), case when text = '' then '' end) as shown
    from conversations""")
def q19b(spark, d):
    c = _t(spark, d, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), slices.escape(F.col("text")).alias("shown"))


@_query("q19d_slice_text_and_hash", """select item_id, text, n_same from (select conv_id * 100 + turn as item_id, text, count(*) over (partition by text) as n_same from conversations)""")
def q19d(spark, d):
    c = _t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.col("text").cast("binary").alias("b"))
    c = c.withColumn("h", slices.fingerprint(F.col("b")))
    same = c.groupBy("h").agg(F.count(F.lit(1)).alias("n_same"))
    return c.join(same, c["h"].eqNullSafe(same["h"])).select("item_id", slices.to_text(F.col("b")).alias("text"), "n_same")


@_query("q20_nul_collision_check", """select regexp_replace(k, '(00)+$', '') as trimmed, count(*) as n_keys
    from (select hex(encode(c_mktsegment)) || repeat('00', c_custkey % 3) as k from (select c_mktsegment, min(c_custkey) as c_custkey from customer group by c_mktsegment, c_custkey % 3)) group by 1 having count(*) > 1""")
def q20(spark, d):
    keys = _t(spark, d, "customer").select(F.unhex(F.concat(F.hex("c_mktsegment"), F.repeat(F.lit("00"), (F.col("c_custkey") % 3).cast("int")))).alias("k")).distinct()
    return keys.groupBy(slices.trim_nuls(F.col("k")).alias("trimmed")).agg(F.count(F.lit(1)).alias("n_keys")).where("n_keys > 1")


@_query("q21_version_guarded_merge", """select o_custkey, version, payload from (select *, row_number() over (partition by o_custkey order by version desc) rn from (
    select o_custkey, o_orderkey as version, o_orderpriority as payload from orders union all
    select user_id, event_id * 3 + 1000000000, event_type from events)) where rn = 1""")
def q21(spark, d):
    a = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("payload"))
    b = _t(spark, d, "events").select(F.col("user_id").alias("o_custkey"), (F.col("event_id") * 3 + 1000000000).alias("version"), F.col("event_type").alias("payload"))
    return resolve.merge_versions([a, b], ["o_custkey"], "version", ["payload"])


@_query("q22_delete_bulk", "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def q22(spark, d):
    gone = _t(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return resolve.without(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


@_query("q23_compact_stats", f"""select user_id, n_versions, n_live, n_versions - n_live as n_garbage from
    (select user_id, count(*) as n_versions, cast(max(case when rn = 1 and event_type <> 'error' then 1 else 0 end) as bigint) as n_live from {_NEWEST} group by user_id)""")
def q23(spark, d):
    return resolve.garbage(_log(spark, d), ["user_id"], "event_id", "is_del")


@_query("q24_store_registry_by_level", f"""select try_cast(regexp_extract(file_name, '_([0-9]+)[.]', 1) as bigint) as store_level, count(*) as n_stores,
    cast(sum(case when file_name like '%.cprs' then 1 else 0 end) as bigint) as n_compressed, max(o_orderkey) as newest_seq from {_NAMES} where file_name like '/db/store%' group by 1""")
def q24(spark, d):
    return files.stores_by_level(_names(spark, d), "file_name")


@_query("q24b_store_level_of", f"""select w.q as store_seq, try_cast(regexp_extract(file_name, '_([0-9]+)[.]', 1) as bigint) as store_level, coalesce(file_name like '%.cprs', false) as compressed
    from (select distinct o_custkey as q from orders) w left join {_NAMES} on file_name like '/db/store%' and o_orderkey = w.q""")
def q24b(spark, d):
    wanted = _t(spark, d, "orders").select(F.col("o_custkey").alias("store_seq")).distinct()
    return files.store_level_of(wanted, _names(spark, d), "file_name").select("store_seq", "store_level", "compressed")


_LINES = "string_split(text, chr(10))"


@_query("q25_text_to_items", f"""select doc_id, item, substr(hex(encode(array_to_string(l[9 * item + 1 : 9 * item + 2], ''))), 1, 2000) || hex(encode(item::varchar)) as key_hex,
    md5(array_to_string(l[9 * item + 3 : 9 * item + 9], '')) as value_md5
    from (select doc_id, l, unnest(range(0, len(l) // 9)) as item from (select doc_id, {_LINES} as l from documents))""")
def q25(spark, d):
    items = files.text_items(_t(spark, d, "documents"), "text", ["doc_id"])
    return items.select("doc_id", "item", F.hex("key").alias("key_hex"), F.md5("value").alias("value_md5"))


@_query("q26_sequenced_batch", "select o_orderkey, o_custkey, row_number() over (order by o_custkey, o_orderkey) + 99 as seq from orders")
def q26(spark, d):
    return resolve.sequenced(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 100)


@_query("q27_overwrite_workload", """select l_orderkey, l_linenumber, l_shipdate, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber
    order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) rn from lineitem) where rn = 1""")
def q27(spark, d):
    version = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("version")
    newest = resolve.latest(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", version), ["l_orderkey", "l_linenumber"], "version", [])
    return newest.select("l_orderkey", "l_linenumber", F.col("version.l_shipdate").alias("l_shipdate"), F.col("version.l_partkey").alias("l_partkey"))


# text and generated items


@_query("q25b_text_ingest", """select item, array_to_string(list_transform(regexp_extract_all(substr(head, 1, 2000), '..'), lambda x: case when x = '00' then '01' else x end), '') || hex(encode(item::varchar)) || '00' as key_hex, value_md5
    from (select n // 9 as item, hex(encode(string_agg(b, '' order by n) filter (n % 9 < 2))) as head, md5(string_agg(b, '' order by n) filter (n % 9 >= 2)) as value_md5 from (
    select b, row_number() over (order by doc_id, i) - 1 as n from (select doc_id, unnest(string_split(text, chr(10))) as b, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null))
    group by 1 having count(*) = 9)""")
def q25b(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    items = files.line_items(resolve.sequenced(lines, ["doc_id", "i"], 0, ["line"]), "line", "seq")
    return items.select("item", F.hex("key").alias("key_hex"), F.md5("value").alias("value_md5"))


def _word_sql(k: int) -> str:
    return " || ".join(f"substr(format('{{:016X}}', id * {3**k}), {i}, 2)" for i in range(15, 0, -2))


@_query("q25c_generated_items", f"""select id, {_word_sql(1)} || {_word_sql(3)} || {_word_sql(5)} || hex(encode((id * 729)::varchar)) || '00' as key_hex,
    {_word_sql(2)} || {_word_sql(4)} || {_word_sql(6)} as value_hex from (select range as id from range((select count(*) from lineitem)))""")
def q25c(spark, d):
    items = files.bench_items(spark, _t(spark, d, "lineitem").count())
    return items.select("id", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


from tidelog.plans import tables  # noqa: E402

QUERIES |= tables.QUERIES
ORACLE_SQL |= tables.ORACLE_SQL
