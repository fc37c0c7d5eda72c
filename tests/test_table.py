import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, slices
from tidelog.operators import access, resolve, shards
from tidelog.plans.registry import QUERIES
from tidelog.sources import files
from tidelog.sources.manifest import CommitConflict, Manifest
from tidelog.sources.table import Table

KV = "key binary, value binary, n int"


def kv(spark, rows):
    return spark.createDataFrame([(bytearray(k), bytearray(v), i) for i, (k, v) in enumerate(rows)], KV)


def keys(spark, ks):
    return spark.createDataFrame([(bytearray(k),) for k in ks], "key binary")


def content(t):
    return [(bytes(r.key), bytes(r.value)) for r in t.scan().collect()]


def test_against_a_dict(spark, tmp_path):
    rng, model = random.Random(3), {}
    t = Table.open(spark, f"{tmp_path}/t", num_shards=2)
    assert t.empty() and content(t) == []
    for step in range(4):
        batch = [(b"k%02d" % rng.randrange(12), b"v%d.%d" % (step, i)) for i in range(8)]
        if step == 2:
            t.add_if_absent(kv(spark, batch), ["n"])
            for k, v in batch:
                model.setdefault(k, v)
        else:
            t.add(kv(spark, batch), ["n"])
            model |= dict(batch)
        gone = [b"k%02d" % rng.randrange(12) for _ in range(3)] + [b"never"]
        t.delete(keys(spark, gone))
        for k in gone:
            model.pop(k, None)
        assert content(t) == sorted(model.items())
    old = t.version
    while t.compact():
        pass
    assert content(t) == sorted(model.items())
    s = t.stats().first()
    assert (s.n_versions, s.n_live, s.n_garbage) == (len(model), len(model), 0)
    assert content(Table.open(spark, f"{tmp_path}/t", version=old)) == sorted(model.items())
    again = Table.open(spark, f"{tmp_path}/t", num_shards=7)
    assert again.num_shards == 2
    order = sorted(model)
    mid = order[len(order) // 2]
    assert bytes(again.prev(mid).first().key) == order[order.index(mid) - 1]
    assert bytes(again.next(mid).first().key) == order[order.index(mid) + 1]
    assert bytes(again.seek(mid).first().key) == mid
    assert [bytes(again.first().first().key), bytes(again.last().first().key)] == [order[0], order[-1]]
    assert again.seek(b"\xff").count() == 0
    assert again.get(mid) == (True, model[mid]) and again.get(b"nope") == (False, None)
    assert again.vacuum() > 0 and content(again) == sorted(model.items())


def test_empty_values_bad_keys_and_byte_order(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t")
    ks = [b"ab", b"a", b"\x7f", b"a\0", b"\xff", b"a\0\0"]
    t.add(kv(spark, [(k, b"") for k in ks]), ["n"])
    assert [k for k, _ in content(t)] == sorted(ks)
    assert t.get(b"a") == (True, b"")
    with pytest.raises(Exception, match="one byte"):
        t.add(kv(spark, [(b"", b"x")]), ["n"])
    assert len(content(t)) == len(ks)
    found = {bytes(r.key): r.found for r in t.multi_get(keys(spark, [b"a", b"zz"])).collect()}
    assert found == {b"a": True, b"zz": False}
    with pytest.raises(ValueError):
        Table.open(spark, f"{tmp_path}/u", num_shards=0)


def test_merge_versions_and_snapshots(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t")
    put = lambda rows: t.merge_versions(spark.createDataFrame([(bytearray(k), bytearray(v), s) for k, v, s in rows], "key binary, value binary, seq long"))
    put([(b"k", b"new", 9)])
    reader = Table.open(spark, f"{tmp_path}/t")
    put([(b"k", b"old", 4), (b"l", b"x", 1)])
    assert content(t) == [(b"k", b"new"), (b"l", b"x")]
    assert content(reader) == [(b"k", b"new")]


def test_commit_conflict(spark, tmp_path):
    a = Manifest(spark, f"{tmp_path}/m").commit()
    b = Manifest.newest(spark, f"{tmp_path}/m")
    a.set("n", 1)
    a.set("n", 2)
    assert a.commit().get("n") == 2
    with pytest.raises(CommitConflict):
        b.commit()


def test_golden_bytes(spark):
    items = files.generated_items(spark, 10_000)
    assert access.payload_bytes(items, ["key", "value"]).first().n_bytes == 328_890
    first = items.where("id = 258").first()
    assert bytes(first.key) == b"\x02\x01" + bytes(6) + b"258\0" and bytes(first.value) == str((1 << 64) - 1 - 258).encode()


def test_varint_boundaries_and_records(spark):
    ns = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2**32 - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n long").withColumn("v", codec.varint(F.col("n")))
    for r in df.select("n", "v", codec.varint_value(F.col("v")).alias("m"), codec.varint_length(F.col("v")).alias("l")).collect():
        want, n = [], r.n
        while n >= 128:
            want.append(n % 128 + 128)
            n //= 128
        assert bytes(r.v) == bytes([*want, n]) and r.m == r.n and r.l == len(r.v)
    key = spark.createDataFrame([(b"k" * n, b"") for n in (1, 127, 128, 16383, 16384)], "k binary, v binary").withColumn("r", codec.encode_put(F.col("k"), F.col("v")))
    for r in key.select("k", codec.record_key(F.col("r")).alias("k2"), codec.record_value(F.col("r")).alias("v2")).collect():
        assert r.k == r.k2 and bytes(r.v2) == b""
    assert spark.createDataFrame([(b"", b"v")], "k binary, v binary").select(codec.encode_put(F.col("k"), F.col("v")).alias("r")).first().r is None


def test_slices_and_tokens(spark):
    r = spark.createDataFrame([(bytearray(b"a\0\x7f\xc3"), bytearray(b""))], "a binary, e binary").select(
        slices.escape(F.col("a")).alias("x"), slices.escape(F.col("e")).alias("y"), slices.byte_at(F.col("a"), 3).alias("b"), slices.byte_at(F.col("a"), 9).alias("z"),
        codec.token_offset(codec.token(F.lit(2**31 - 1), F.lit(2**31 - 1))).alias("o"), codec.token_seq(codec.token(F.lit(2**31 - 1), F.lit(0))).alias("s"),
        codec.is_node(F.lit(codec.NULL_TOKEN).cast("bigint")).alias("n"), codec.node_token(F.lit(5).cast("bigint"), 4096).alias("odd"),
    ).first()
    assert (r.x, r.y, r.b, r.z, r.o, r.s, r.n, r.odd) == ("a[0][127][195]", "", 195, None, 2**31 - 1, 2**31 - 1, True, None)


def test_whole_texts_are_escaped(spark, tmp_path):
    texts = ["x" * 40 + "é\n\x7f~ end", "".join(map(chr, range(1, 300))) * 20, "\0" * 41, ""]
    spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.item_id: r.shown for r in QUERIES["q19b_slice_escape"](spark, str(tmp_path)).collect()}
    assert got == {101 * i: "".join(chr(b) if 32 <= b <= 126 else f"[{b}]" for b in t.encode()) for i, t in enumerate(texts)}


def test_shard_hash_of_high_bytes(spark):
    def model(b):
        h = 0
        for x in b:
            h = (h * 101 + (x - 256 if x > 127 else x)) % 2**64
        return h

    for text in (b"", b"abc", "é".encode(), b"\xff" * 40):
        got = spark.createDataFrame([(bytearray(text),)], "k binary").select(shards.shard_hash(F.col("k")).alias("h"), shards.shard_of(F.col("k"), 7).alias("s")).first()
        assert int(got.h) == model(text) and got.s == model(text) % 7


def test_file_names(spark):
    names = ["/a/index_", "/a/index_3", "/a/store_7_2.cprs", "store_1_0.plain", "/a/store_x", "/a/other"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = {r.file_name: (r.store_seq, r.store_level, r.compressed) for r in files.store_registry(df, "f").collect()}
    assert got == {"/a/store_7_2.cprs": (7, 2, True), "store_1_0.plain": (1, 0, False)}
    assert [r.f for r in df.where(codec.is_index(F.col("f"))).collect()] == ["/a/index_3"]


def test_text_items_cut_keys(spark):
    text = "\n".join(["é" * 600, "b", *"cdefghi", "short", "group"])
    r = files.text_items(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "text", ["id"]).collect()
    assert [(x.id, x.item, bytes(x.key), bytes(x.value)) for x in r] == [(1, 0, ("é" * 500).encode() + b"0", b"cdefghi")]


def test_neighbours_over_partitions(spark):
    ks = random.Random(1).sample(range(1000), 60)
    got = {r.k: (r.prev_key, r.next_key) for r in access.neighbours(spark.createDataFrame([(k,) for k in ks], "k long"), "k").collect()}
    ordered = sorted(ks)
    assert got == {k: (ordered[i - 1] if i else None, ordered[i + 1] if i + 1 < len(ordered) else None) for i, k in enumerate(ordered)}
    empty = spark.createDataFrame([], "k long")
    assert access.neighbours(empty, "k").count() == 0
    assert access.lower_bounds(empty, spark.createDataFrame([(1,), (1,)], "t long"), "k", "t").count() == 2
    assert resolve.sequenced(empty, ["k"], 5).count() == 0


def test_stream_append(spark, tmp_path):
    from tidelog.streaming.ingest import append_stream, latest_stream

    src = f"{tmp_path}/src"
    rows = [(bytearray(b"a"), bytearray(b"1"), 1), (bytearray(b"b"), bytearray(b"2"), 2), (bytearray(b"a"), bytearray(b"3"), 3)]
    spark.createDataFrame(rows, "key binary, value binary, seq long").write.parquet(src)
    read = lambda: spark.readStream.schema("key binary, value binary, seq long").parquet(src)
    append_stream(read(), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(60)
    assert content(Table.open(spark, f"{tmp_path}/t")) == [(b"a", b"3"), (b"b", b"2")]
    q = latest_stream(read().withColumn("is_del", F.lit(False)), ["key"], "seq", ["value"], "is_del").writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((bytes(r.key), r.seq) for r in spark.table("newest").collect()) == [(b"a", 3), (b"b", 2)]


def test_single_row_batches_keep_their_order(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t")
    for value in (b"b", b"a", b"c", b""):
        t.add(kv(spark, [(b"k", value)]), "n")
        assert t.get(b"k") == (True, value)
    assert t.get_version(b"k") == 3 and t.get_version(b"l") is None
    t.delete(keys(spark, [b"k"]))
    assert t.get(b"k") == (False, None) and t.get_version(b"k") is None


def test_orders_clashing_columns_and_null_values(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t")
    rows = [(bytearray(b"a"), None, 2, "x"), (bytearray(b"a"), bytearray(b"1"), 1, "y"), (bytearray(b"b"), bytearray(b"2"), 3, "z")]
    df = spark.createDataFrame(rows, "key binary, value binary, seq int, is_del string").withColumn("_p", F.lit(0)).withColumn("_i", F.lit(0))
    t.add(df, "seq")
    assert content(t) == [(b"a", b""), (b"b", b"2")]
    t.add(df, [-F.col("seq")])
    assert content(t) == [(b"a", b"1"), (b"b", b"2")]
    t.add_if_absent(df.withColumn("key", F.lit(b"c")), [F.col("is_del").desc()])
    assert t.get(b"c") == (True, b"2")


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", num_shards=4)
    hot = spark.range(4000).select(F.lit(b"hot").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), F.col("id").alias("n"))
    t.add(hot, "n")
    sizes = [r["count"] for r in t.log().groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert content(t) == [(b"hot", b"3999")]


def test_cursor_walks_both_ways(spark, tmp_path):
    from tidelog.sources.cursor import Cursor

    t = Table.open(spark, f"{tmp_path}/t")
    ks = [b"%02d" % i for i in range(0, 20, 2)]
    t.add(kv(spark, [(k, b"v" + k) for k in ks]), "n")
    assert not t.cursor().valid()
    for page in (2, 256):
        c = Cursor(t.current(), page)
        c.seek_to_first()
        seen = []
        while c.valid():
            seen.append((c.key(), c.value()))
            c.next()
        assert seen == [(k, b"v" + k) for k in ks]
        with pytest.raises(ValueError):
            c.key()
        with pytest.raises(ValueError):
            c.next()
        with pytest.raises(ValueError):
            c.prev()
        c.seek(b"07")
        assert c.key() == b"08"
        c.prev()
        assert c.key() == b"06"
        c.next()
        c.next()
        assert c.key() == b"10"
        c.seek_to_last()
        c.prev()
        c.next()
        assert c.key() == ks[-1]
        c.next()
        assert not c.valid()
        c.seek(b"99")
        assert not c.valid()


def test_levels_merge_and_keep_tombstones(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t")
    t.add(kv(spark, [(b"a", b"1"), (b"b", b"1")]), "n")
    t.add(kv(spark, [(b"c", b"1")]), "n")
    assert not t.merge_level(2)  # one batch of level 1
    t.delete(keys(spark, [b"a"]))
    t.add(kv(spark, [(b"c", b"2")]), "n")
    old = t.version
    assert t.merge_level(2)  # the tombstone stays: the other batch of level 1 holds its key
    assert content(t) == [(b"b", b"1"), (b"c", b"2")] and t.stats().first().n_versions == 5
    assert not t.merge_level(2)
    assert content(t) == [(b"b", b"1"), (b"c", b"2")] and t.stats().first().n_versions == 2
    assert not t.merge_level(2)
    t.add(kv(spark, [(b"a", b"3")]), "n")
    assert content(t) == [(b"a", b"3"), (b"b", b"1"), (b"c", b"2")]
    assert content(Table.open(spark, f"{tmp_path}/t", version=old)) == [(b"b", b"1"), (b"c", b"2")]
    with pytest.raises(ValueError):
        t.merge_level(1)


def test_lower_bounds_of_null_and_repeated_probes(spark):
    keys_ = spark.createDataFrame([(k,) for k in (3, 10, 10, None)], "k long")
    probes = spark.createDataFrame([(1, None, "a"), (2, 3, "b"), (3, 4, "c"), (4, 11, "d"), (5, 4, "e"), (6, -9, "f")], "i long, t long, k string")
    out = access.lower_bounds(keys_.withColumnRenamed("k", "key"), probes, "key", "t")
    assert out.columns == ["i", "t", "k", "lower_bound"]
    assert {r.i: (r.k, r.lower_bound) for r in out.collect()} == {1: ("a", None), 2: ("b", 3), 3: ("c", 10), 4: ("d", None), 5: ("e", 10), 6: ("f", 3)}
    assert access.neighbours(keys_.dropDuplicates(), "k").count() == 2


def test_vacuum_spares_a_batch_that_is_being_written(spark, tmp_path, monkeypatch):
    a = Table.open(spark, f"{tmp_path}/t")
    a.add(kv(spark, [(b"a", b"1")]), "n")
    b = Table.open(spark, f"{tmp_path}/t")
    commit = Manifest.commit

    def late(manifest):
        monkeypatch.setattr(Manifest, "commit", commit)
        assert Table.open(spark, f"{tmp_path}/t").vacuum() == 0  # between the batch and its manifest
        return commit(manifest)

    monkeypatch.setattr(Manifest, "commit", late)
    b.add(kv(spark, [(b"b", b"2")]), "n")
    assert content(b) == [(b"a", b"1"), (b"b", b"2")]
    with pytest.raises(CommitConflict):
        a.delete(keys(spark, [b"a"]))
    old = b.version
    b.compact()
    assert a.vacuum() == 2  # by a handle that is behind
    assert content(b) == content(Table.open(spark, f"{tmp_path}/t")) == [(b"a", b"1"), (b"b", b"2")]
    with pytest.raises(ValueError):
        Table.open(spark, f"{tmp_path}/t", version=old)
    assert b.vacuum(older_than_hours=0) == 1  # the batch of the writer that lost


def test_records_by_token(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", num_shards=3, file_rows=2)
    assert t.records().count() == 0 and t.record_at(0) is None
    assert t.retire_store() == 0
    t.add(kv(spark, [(b"%02d" % i, b"v%d" % i) for i in range(9)]), "n")
    t.delete(keys(spark, [b"04"]))
    assert t.retire_store() == 2
    for r in t.records().collect():
        assert t.record_at(r.token) == (bytes(r.key), None if r.is_del else bytes(r.value))
    assert t.record_at(4) == (b"04", b"v4") and t.record_at(1 << 32) == (b"04", None) and t.record_at(9) is None and t.record_at(5 << 32) is None
    probes = spark.createDataFrame([(0, "x"), (99, "y"), (None, "z")], "token long, tag string")
    assert {r.tag: (r.found, r.key and bytes(r.key)) for r in t.by_token(probes).collect()} == {"x": (True, b"00"), "y": (False, None), "z": (False, None)}
    sizes = [r["count"] for r in t.log().groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 2 and sum(sizes) == 10
    assert [(r.store_seq, r.store_level, r.compressed, r.listed) for r in t.stores().orderBy("store_seq").collect()] == [(0, 0, True, True), (1, 0, True, True)]


def test_tokens_follow_a_task_past_its_thousandth_file(spark, tmp_path):
    n, before = 1003, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        t = Table.open(spark, f"{tmp_path}/t", num_shards=1, file_rows=1)  # by name, c1000 to c1002 come before c101
        t.add(kv(spark, [(b"k%05d" % i, b"%d" % i) for i in range(n)]), "n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.token, bytes(r.key)) for r in t.records().orderBy("token").collect()] == [(i, b"k%05d" % i) for i in range(n)]


def test_a_store_is_moved_by_its_tasks_and_read_by_page_checksums(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", num_shards=1, compressed=False)
    t.add(kv(spark, [(b"k%03d" % i, b"value-%03d" % i) for i in range(300)]), "n")
    assert len(content(t)) == 300
    assert not [*(tmp_path / "t").glob("batch-*/store_*/.part-*.crc")]
    for f in (tmp_path / "t").glob("batch-*/store_*/part-*"):
        data = f.read_bytes()
        at = data.find(b"value-")
        if at >= 0:
            f.write_bytes(data[:at] + b"VALUE" + data[at + 5 :])
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        content(Table.open(spark, f"{tmp_path}/t"))


def test_plain_stores_and_crashed_writes(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", compressed=False)
    t.add(kv(spark, [(b"a", b"1")]), "n")
    bad = kv(spark, [(b"b", b"1"), (b"", b"2")])
    with pytest.raises(Exception, match="one byte"):
        t.add(bad, "n")
    assert content(Table.open(spark, f"{tmp_path}/t")) == [(b"a", b"1")]
    t.compact()
    assert {r.store_level: r.compressed for r in t.stores().collect()} == {0: False, 1: True}


def test_text_files_as_one_stream(spark, tmp_path):
    rng = random.Random(6)
    lines = ["".join(rng.choice(["x", "é", "\0", "\r", " "]) for _ in range(rng.choice([0, 3, 700]))) for _ in range(9 * 7 + 4)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("".join(x + "\n" for x in lines[:40]).encode())
    (tmp_path / "t" / "b.txt").write_bytes("\n".join(lines[40:]).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "600"):  # whole files, and several splits of each
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.item: (bytes(r.key), bytes(r.value)) for r in files.line_items(files.numbered_lines(spark, f"{tmp_path}/t"), "line", "n").collect()}
            want = {}
            for i in range(7):
                part = [x.encode() for x in lines[9 * i : 9 * i + 9]]
                want[i] = ((part[0] + part[1])[:1000].replace(b"\0", b"\1") + b"%d\0" % i, b"".join(part[2:]))
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert files.files_of(spark, f"{tmp_path}/t").agg(F.sum("n_bytes")).first()[0] == sum(len(x.encode()) + 1 for x in lines) - 1


def test_bench_items(spark):
    for r in files.bench_items(spark, 400).collect():
        h, k, v = r.id, b"", b""
        for _ in range(3):
            h *= 3
            k += h.to_bytes(8, "little")
            h *= 3
            v += h.to_bytes(8, "little")
        assert (bytes(r.key), bytes(r.value)) == (k + b"%d\0" % h, v)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidelog.sources.shared import shared_folder

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077"))


def test_manifest_values(spark, tmp_path):
    m = Manifest(spark, f"{tmp_path}/m")
    m.set("b", b"\x00\xff")
    m.set("n", -5)
    m.commit()
    held = Manifest.newest(spark, f"{tmp_path}/m")
    assert (held.get("b"), held.get("n"), held.get("x", 7)) == (b"\x00\xff", -5, 7) and Manifest.versions(spark, f"{tmp_path}/m") == [1]
