"""Store files by name, text as items, and generated items."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import codec

#: Fixed values of the text format: 9 lines an item, of which 2 make the key, cut at 1000 bytes.
LINES, KEY_LINES, KEY_BYTES = 9, 2, 1000


def store_registry(names: DataFrame, column: str, carried: Sequence[str] = ()) -> DataFrame:
    """The stores among the named files with what their names say, and the columns ``carried`` along."""
    path = F.col(column)
    kept = names.where(codec.is_store(path) & (codec.is_plain_store(path) | codec.is_compressed_store(path)))
    return kept.select(path.alias("file_name"), codec.store_seq(path).alias("store_seq"), codec.store_level(path).alias("store_level"), codec.is_compressed_store(path).alias("compressed"), *carried)


def stores_by_level(names: DataFrame, column: str) -> DataFrame:
    level = store_registry(names, column).groupBy("store_level")
    return level.agg(F.count(F.lit(1)).alias("n_stores"), F.sum(F.col("compressed").cast("bigint")).alias("n_compressed"), F.max("store_seq").alias("newest_seq"))


def store_level_of(wanted: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Level and compression of each ``store_seq``; level null and not compressed where unknown."""
    known = store_registry(names, column).select("store_seq", "store_level", "compressed")
    return wanted.join(known, "store_seq", "left").withColumn("compressed", F.coalesce("compressed", F.lit(False)))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """The files under a folder with their sizes, listed by Spark's binary source without reading them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file_name"), F.col("length").alias("n_bytes"))


def _cut(head: Column) -> Column:
    """A key's text part: at most 1000 bytes, NUL as 0x01."""
    as_text = F.decode(F.substring(head, 1, KEY_BYTES), "ISO-8859-1")
    return F.encode(F.translate(as_text, "\x00", "\x01"), "ISO-8859-1")


def text_items(texts: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Items of 9 lines from each text; a short last group gives none.

    Line order is inside the row, so no order between rows is relied on. Item i
    has as key lines 9i and 9i+1 cut to 1000 bytes plus its decimal number, as
    value the other seven lines. An item is cut out of the text's lines before
    it has a row of its own, so a row carries its own nine lines only.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    numbers = F.filter(F.sequence(F.lit(0), F.floor(F.size("_l") / LINES).cast("int")), lambda i: i < F.floor(F.size("_l") / LINES))
    groups = F.transform(numbers, lambda i: F.slice("_l", i * LINES + 1, LINES))
    items = texts.select(*by, lines.alias("_l")).select(*by, F.posexplode(groups).alias("item", "_g"))
    head = F.array_join(F.slice("_g", 1, KEY_LINES), "").cast("binary")
    key = F.concat(F.substring(head, 1, KEY_BYTES), F.col("item").cast("string").cast("binary"))
    value = F.array_join(F.slice("_g", KEY_LINES + 1, LINES - KEY_LINES), "").cast("binary")
    return items.select(*by, F.col("item").cast("bigint").alias("item"), key.alias("key"), value.alias("value"))


def line_items(lines: DataFrame, line: str, number: str) -> DataFrame:
    """Items of 9 lines from lines numbered from 0 without gaps; a short last group gives none.

    Item i has as key lines 9i and 9i+1 joined, cut to 1000 bytes and with NUL
    bytes made 0x01, then its decimal number and a NUL; as value the other seven
    lines. Lines meet by their item: a group has nine rows.
    """
    at = F.col(number) % LINES
    part = F.struct(at.alias("at"), F.col(line).cast("binary").alias("b"))
    grouped = lines.groupBy(F.floor(F.col(number) / LINES).cast("bigint").alias("item")).agg(F.sort_array(F.collect_list(part)).alias("_g"))
    bytes_of = lambda lo, hi: F.concat(*[F.col("_g")[i]["b"] for i in range(lo, hi)])
    key = F.concat(_cut(bytes_of(0, KEY_LINES)), F.col("item").cast("string").cast("binary"), F.unhex(F.lit("00")))
    return grouped.where(F.size("_g") == LINES).select("item", key.alias("key"), bytes_of(KEY_LINES, LINES).alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files at ``path`` as (line, n): numbered through all files, in order of their paths.

    Files are read in splits, in parallel. The splits' line counts, one row
    each, give the number that each split starts with.
    """
    split = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    read = spark.read.option("lineSep", "\n").text(path).select("value", *split, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    each = read.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(F.col("_f").alias("_ff"), F.col("_b").alias("_bb"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"))
    return read.join(starts, (F.col("_f") == F.col("_ff")) & (F.col("_b") == F.col("_bb"))).select(F.col("value").alias("line"), (F.col("_i") + F.col("_shift")).alias("n"))


def bench_items(spark: SparkSession, n: int) -> DataFrame:
    """Items 0..n-1 of the generated workload, n at most 10**16.

    The item's number is made three times as large again and again; the first,
    third and fifth product are the key's 8-byte words, low byte first, the
    second, fourth and sixth the value's. The key goes on with the last product
    in decimal and a NUL.
    """
    product = lambda k: F.col("id") * F.lit(3**k)
    key = F.concat(*[_word(product(k)) for k in (1, 3, 5)], product(6).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return spark.range(n).select("id", key.alias("key"), F.concat(*[_word(product(k)) for k in (2, 4, 6)]).alias("value"))


def _word(n: Column) -> Column:
    """A number's 8 bytes, low byte first."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def generated_items(spark: SparkSession, n: int) -> DataFrame:
    """Test items 0..n-1: key = the number's 8 raw bytes, its decimal form and a NUL; value = the decimal form of its complement."""
    j: Column = F.col("id")
    key = F.concat(_word(j), j.cast("string").cast("binary"), F.unhex(F.lit("00")))
    # the complement is taken as an unsigned 64-bit number
    value = (F.lit(str((1 << 64) - 1)).cast("decimal(20,0)") - j.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string").cast("binary")
    return spark.range(n).select(j, key.alias("key"), value.alias("value"))
