"""Tokens, varints, records and file names as column expressions.

Fixed values: a token holds a store's sequence number in its high 32 bits and
the record's offset in its low 32; the top bit marks a node, whose other bits
are its page number; all ones is the null token; varints carry 7 bits a byte,
low group first; a record is varint(key length), key, value, where length 0
marks a tombstone; files are index_N and store_SEQ_LEVEL.plain or .cprs.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF
LOW63 = 0x7FFFFFFFFFFFFFFF
NULL_TOKEN = -1


def token(seq: Column, offset: Column) -> Column:
    return F.shiftleft(seq.cast("bigint"), 32).bitwiseOR(offset.cast("bigint"))


def token_seq(tok: Column) -> Column:
    return F.shiftrightunsigned(tok, 32)


def token_offset(tok: Column) -> Column:
    return tok.bitwiseAND(F.lit(LOW32))


def node_token(offset: Column, page: int) -> Column:
    """``offset`` is a multiple of ``page``; null otherwise."""
    pages = F.floor(offset / F.lit(page)).cast("bigint")
    return F.when(offset % page == 0, F.shiftleft(F.lit(1).cast("bigint"), 63).bitwiseOR(pages))


def node_offset(tok: Column, page: int) -> Column:
    return tok.bitwiseAND(F.lit(LOW63)) * F.lit(page)


def is_node(tok: Column) -> Column:
    return tok < 0


def is_record(tok: Column) -> Column:
    return tok >= 0


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2, "0"))


def varint(n: Column) -> Column:
    """An unsigned 32-bit number as 1 to 5 bytes."""
    n = n.cast("bigint")
    group = lambda i: F.shiftright(n, 7 * i).bitwiseAND(F.lit(127))
    more = lambda i: _byte(group(i) + 128)
    upto = lambda k: F.concat(*[more(i) for i in range(k)], _byte(group(k)))
    out = F.when(n < 1 << 7, _byte(n))
    for k in (1, 2, 3):
        out = out.when(n < 1 << 7 * (k + 1), upto(k))
    return out.when(n <= LOW32, upto(4))


def _byte_value(b: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("bigint")


def varint_length(b: Column) -> Column:
    """Bytes that the varint at the start of ``b`` takes; null if it takes over 5 or ``b`` ends in it."""
    out = F.when((F.octet_length(b) > 0) & (_byte_value(b, 0) < 128), 1)
    for i in range(1, 5):
        out = out.when((F.octet_length(b) > i) & (_byte_value(b, i) < 128), i + 1)
    return out


def varint_value(b: Column) -> Column:
    n = varint_length(b)
    group = lambda i: F.shiftleft(_byte_value(b, i).bitwiseAND(F.lit(127)), 7 * i)
    out, total = None, None
    for k in range(1, 6):
        total = group(0) if k == 1 else total + group(k - 1)
        out = F.when(n == 1, total) if out is None else out.when(n == k, total)
    return out


def encode_put(key: Column, value: Column) -> Column:
    """A record; null for an empty key, whose record would read as a tombstone."""
    key, value = key.cast("binary"), value.cast("binary")
    return F.when(F.octet_length(key) > 0, F.concat(varint(F.octet_length(key)), key, value))


def encode_delete(key: Column) -> Column:
    key = key.cast("binary")
    return F.when(F.octet_length(key) > 0, F.concat(F.unhex(F.lit("00")), key))


def record_is_delete(rec: Column) -> Column:
    return varint_value(rec) == 0


def record_key(rec: Column) -> Column:
    at = varint_length(rec)
    rest = F.substr(rec, at + 1)
    return F.when(record_is_delete(rec), rest).otherwise(F.substr(rec, at + 1, varint_value(rec).cast("int")))


def record_value(rec: Column) -> Column:
    """Null for a tombstone."""
    return F.when(~record_is_delete(rec), F.substr(rec, varint_length(rec) + varint_value(rec).cast("int") + 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_compressed_store(path: Column) -> Column:
    return base_name(path).endswith(".cprs")


def is_plain_store(path: Column) -> Column:
    return base_name(path).endswith(".plain")


def is_index(path: Column) -> Column:
    name = base_name(path)
    return name.startswith("index_") & (F.length(name) > len("index_"))


def is_store(path: Column) -> Column:
    name = base_name(path)
    return name.startswith("store_") & (F.length(name) > len("store_"))


def _number(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(base_name(path), pattern, 1), F.lit("")).cast("bigint")


def store_seq(path: Column) -> Column:
    return _number(path, r"^store_([0-9]+)_")


def store_level(path: Column) -> Column:
    return _number(path, r"^store_[0-9]+_([0-9]+)[.]")


def index_name(n: Column, folder: Column) -> Column:
    return F.concat(folder, F.lit("index_"), n.cast("string"))


def store_name(seq: Column, level: Column, compressed: Column, folder: Column) -> Column:
    suffix = F.when(compressed, ".cprs").otherwise(".plain")
    return F.concat(folder, F.lit("store_"), seq.cast("string"), F.lit("_"), level.cast("string"), suffix)
